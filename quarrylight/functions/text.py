"""Text, path and hashing functions of the retrieval engine, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokenize(x: Column) -> Column:
    """Lower-cased runs of letters, numbers and underscores, in order."""
    return F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def coverage(query: Column, content: Column) -> Column:
    """Share of the query's tokens, repeats counted, that occur among the content's; 0 for an empty query."""
    # bound as a lambda's variable, or the content would be made anew for each of the query's tokens
    hit = F.transform(F.array(content), lambda c: F.size(F.filter(query, lambda t: F.array_contains(c, t))))[0]
    return F.when(F.size(query) > 0, hit / F.size(query)).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.size(F.array_union(a, b))).otherwise(0.0)


def rounded(x: Column, places: int = 4) -> Column:
    """Half up, towards plus infinity."""
    return F.floor(x * 10**places + 0.5) / 10**places


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def slugify(x: Column, limit: int = 80) -> Column:
    dashed = F.regexp_replace(F.lower(F.trim(x)), r"[^\p{L}\p{N}_-]+", "-")
    return F.substring(F.regexp_replace(dashed, r"^-+|-+$", ""), 1, limit)


def normalize_key(x: Column) -> Column:
    """Slashes unified, everything up to the last dot or colon and parentheses dropped, lower-cased."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.replace(F.trim(x), F.lit("\\"), F.lit("/")), "^.*[.:]", ""), r"[()]", ""))


def normalize_embedding_text(x: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


def top_level_module(path: Column) -> Column:
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.when(F.size(parts) > 1, parts[0])


def truncate(x: Column, n: int) -> Column:
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("..."))).otherwise(x)


def truncate_trimmed(x: Column, n: int) -> Column:
    """``truncate`` of ``trimmed``; what follows the first ``n`` characters is only searched for one that is no white space."""
    body = F.regexp_replace(x, r"^\s+", "")
    head = F.substring(body, 1, n)
    return F.when(F.substr(body, F.lit(n + 1)).rlike(r"\S"), F.concat(head, F.lit("..."))).otherwise(trimmed(head))


def estimate_tokens(x: Column, overhead: int = 0) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(x) / 4).cast("int")) + overhead


def chunk_texts(x: Column, size: int = 1200, overlap: int = 150) -> Column:
    """array<struct<start,content>>: trimmed windows over the trimmed text; empty ones go."""
    t = F.trim(x)
    last = F.greatest(F.lit(0), F.ceil((F.length(t) - size) / (size - overlap)).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct((k * (size - overlap)).alias("start"), F.trim(F.substr(t, k * (size - overlap) + 1, F.lit(size))).alias("content")))
    return F.filter(cut, lambda c: c["content"] != "")


def dot(a: Column, b: Column) -> Column:
    """Sum of products, 0 if the lengths differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), total).otherwise(0.0)


def normalized(x: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    size = F.sqrt(dot(x, x))
    return F.when(size > 0, F.transform(x, lambda v: v / size)).otherwise(x)


def trimmed(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def lines(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, r"\r?\n"), trimmed), lambda t: t != "")


def count_matches(x: Column, patterns: tuple[str, ...]) -> Column:
    """Matches of each pattern, added up; overlaps between patterns count for both."""
    return sum((F.regexp_count(x, F.lit(p)) for p in patterns), F.lit(0))


def match_tokens(x: Column, keep: int = 64, least: int = 3) -> Column:
    """The first ``keep`` tokens of ``least`` characters or more; hyphens belong to a token."""
    return F.slice(F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}_-]+"), lambda t: F.length(t) >= least), 1, keep)


def interesting_phrase(x: Column, words: int = 3) -> Column:
    """Longest part between commas and line ends with ``words`` words or more, the first of equals; null if none."""
    parts = F.filter(F.transform(F.split(x, r"[,\n]"), trimmed), lambda p: F.size(F.split(p, r"\s+")) >= words)
    return F.aggregate(parts, F.lit(None).cast("string"), lambda best, p: F.when(best.isNull() | (F.length(p) > F.length(best)), p).otherwise(best))


def truncate_line(x: Column, n: int) -> Column:
    flat = trimmed(F.regexp_replace(x, r"\s+", " "))
    return F.when(F.length(flat) > n, F.concat(F.rtrim(F.substring(flat, 1, n - 3)), F.lit("..."))).otherwise(flat)


def ascii_slug(x: Column, limit: int = 80) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(trimmed(x)), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, limit)


def domain_slug(x: Column) -> Column:
    dashed = F.regexp_replace(F.lower(trimmed(x)), r"[\s/]+", "-")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(dashed, "[^a-z0-9_-]", ""), "-+", "-"), "^-|-$", "")


def symbol_name(x: Column) -> Column:
    """The last part after a dot or colon, without parentheses."""
    return F.regexp_replace(F.regexp_replace(trimmed(x), "^.*[.:]", ""), "[()]", "")


def subject(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, r"[^\w/-]", ""))


def unique_strings(xs: Column) -> Column:
    """Trimmed, slashes unified, empty ones dropped; of strings that differ by case only the first stays."""
    clean = F.filter(F.transform(xs, lambda s: F.replace(trimmed(s), F.lit("\\"), F.lit("/"))), lambda s: s != "")
    fresh = lambda out, s: F.when(F.exists(out, lambda o: F.lower(o) == F.lower(s)), out).otherwise(F.concat(out, F.array(s)))
    return F.aggregate(clean, F.array().cast("array<string>"), fresh)


def parent_bucket(path: Column) -> Column:
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.lit("."))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def path_tail(path: Column, parts: int = 2) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -parts)


#: Languages by file extension.
LANGUAGES = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "py": "python", "go": "go", "rs": "rust", "java": "java", "json": "json", "md": "markdown", "yaml": "yaml", "yml": "yaml", "toml": "toml", "html": "html", "css": "css", "sql": "sql", "sh": "shell"}


def language_of(path: Column) -> Column:
    """Language by extension, ``text`` for others."""
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.try_element_at(table, ext), F.lit("text"))


def content_hash(x: Column) -> Column:
    return F.sha1(normalize_embedding_text(x).cast("binary"))


def freshness_label(age_hours: Column) -> Column:
    return F.when(age_hours <= 72, "fresh").when(age_hours <= 336, "recent").otherwise("stale")


#: Extensions that make a token a file mention.
FILE_EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "go", "rs", "java", "json", "md", "yaml", "yml", "toml", "html", "css", "sql", "sh", "txt")


def file_mentions(x: Column) -> Column:
    """Distinct paths with a known extension that a text names, slashes unified, in order."""
    found = F.regexp_extract_all(x, F.lit(r"([A-Za-z0-9_./\\-]+\.(?:" + "|".join(FILE_EXTENSIONS) + r"))(?![A-Za-z0-9_])"), 1)
    return F.array_distinct(F.transform(found, lambda p: F.replace(p, F.lit("\\"), F.lit("/"))))


#: Patterns of symbols in diagnostics, and words that are none.
MENTIONS = (r"\bat\s+([A-Za-z_][$\w.]*)\s*\(", r"(?i)\b(?:function|method|symbol|member)\s+([A-Za-z_][$\w.]*)", r"(?i)\b([A-Za-z_][$\w]*)\s+is not defined\b", r"\bReferenceError:\s+([A-Za-z_][$\w]*)\b")
NO_SYMBOLS = ("if", "for", "while", "switch", "catch", "return", "async")


def symbol_mentions(x: Column, keep: int = 5) -> Column:
    """The first ``keep`` distinct symbols that a diagnostic names, letter case aside."""
    found = F.concat(*(F.transform(F.regexp_extract_all(x, F.lit(p), 1), symbol_name) for p in MENTIONS))
    return F.slice(unique_strings(F.filter(found, lambda s: ~F.lower(s).isin(*NO_SYMBOLS))), 1, keep)
