"""Writing notes: templates, remember and forget, switches and votes, caches, lookups, export, checkpoints and domains.

All are relations in, relations out: a caller writes what comes back, so a failed job leaves the old state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from . import governance as G
from . import ingest as I

#: Tier and stability of a new note by its source kind, and of any other.
DEFAULTS = {"decision": ("stable", 0.95), "manual": ("stable", 0.82), "imported": ("stable", 0.72), "diary": ("working", 0.46)}
OTHER = ("project", 0.52)
LOG_REASON = "Project logs record temporal progress and model performance observations."


def _default(kind: Column, at: int) -> Column:
    return S.lookup(kind, {k: v[at] for k, v in DEFAULTS.items()}, OTHER[at])


def log_note(event: Column, time: Column, model: Column, action: Column, result: Column, notes: Column, tags: Column) -> Column:
    """Markdown of a log: header lines that are null or empty go, as do blank lines."""
    line = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"**{name}**: "), c))
    body = F.when(F.coalesce(notes, F.lit("")) != "", notes).otherwise("No additional notes provided.")
    listed = F.when(F.size(tags) > 0, F.concat(F.lit("## Tags\n"), F.array_join(F.transform(tags, lambda t: F.concat(F.lit("- "), t)), "\n")))
    return F.concat_ws("\n", F.concat(F.lit("# Log: "), event), line("Time", time), line("Model", model), line("Action", action), line("Test Result", result), F.lit("## Details"), body, listed)


def log_fields(content: Column) -> dict[str, Column]:
    """time, model, action, test_result and details of a log's Markdown; absent ones are null, without a details head all of it is."""
    own = lambda name: F.nullif(T.trimmed(F.regexp_extract(content, rf"(?m)^\*\*{name}\*\*:(.*)$", 1)), F.lit(""))
    head = F.locate("## Details", content)
    rest = F.when(head > 0, F.regexp_replace(F.substr(content, head), r"^[^\n]*\n?", "")).otherwise(content)
    return {"time": own("Time"), "model": own("Model"), "action": own("Action"), "test_result": own("Test Result"), "details": T.trimmed(rest)}


def _note_path(title: Column, root: str) -> Column:
    return F.concat_ws("/", F.lit(root.rstrip("/")), "source_kind", F.concat(T.slugify(title), F.lit(".md")))


def note_title(at_ms: int) -> Column:
    """A note's title, or its kind and time."""
    return F.coalesce("title", F.concat_ws("-", "source_kind", F.lit(str(at_ms))))


def note_id(root: str, at_ms: int) -> Column:
    """Id of the document that a note (title, source_kind) leads to."""
    return F.concat(F.lit("manual:"), F.sha1(_note_path(note_title(at_ms), root).cast("binary")))


def remember(notes: DataFrame, root: str, at_ms: int, *, each: bool = False) -> DataFrame:
    """Documents of notes (title, content, source_kind, and optionally tags, module_name, memory_tier, stability_score).

    The path follows from kind and title, or from kind and time without a title; the id from the path.
    A null or empty content is remembered as empty and has no chunks. Of notes that lead to one path one stays,
    as a later one overwrites an earlier one: the last by ``seq`` (a column of the notes), without it the one
    with the greatest content and title. ``each`` keeps them all, for a caller that writes one after the other.
    """
    have = set(notes.columns)
    order = F.struct("seq") if "seq" in have else F.struct("content", "title")
    if not each:
        notes = notes.groupBy(note_id(root, at_ms).alias("_id")).agg(F.max_by(F.struct(*notes.columns), order).alias("n")).select("n.*")
    given = lambda c, kind: F.col(c) if c in have else F.lit(None).cast(kind)
    title = note_title(at_ms)
    path = _note_path(title, root)
    content = T.trimmed(F.coalesce("content", F.lit("")))
    kind = F.col("source_kind")
    rows = notes.select(
        F.concat(F.lit("manual:"), F.sha1(path.cast("binary"))).alias("doc_id"), kind, path.alias("path"), title.alias("title"), content.alias("content"),
        F.coalesce(given("tags", "array<string>"), F.array().cast("array<string>")).alias("tags"), given("module_name", "string").alias("module_name"),
        F.coalesce(given("memory_tier", "string"), _default(kind, 0)).alias("memory_tier"), T.clamp01(F.coalesce(given("stability_score", "double"), _default(kind, 1))).alias("stability_score"),
        F.sha1(content.cast("binary")).alias("checksum"), F.lit(at_ms).alias("updated_at"),
    )
    return rows.withColumn("chunk_count", F.size(T.chunk_texts(F.col("content"))))


def find_by_path(paths: DataFrame, manifests: DataFrame, chunks: DataFrame) -> DataFrame:
    """path, doc_id, source_kind of each asked path: its manifest's, else its chunks', else null."""
    one = lambda t, n: t.groupBy("path").agg(F.min(F.struct("doc_id", "source_kind")).alias(n))
    both = paths.select("path").distinct().join(one(manifests, "m"), "path", "left").join(one(chunks, "c"), "path", "left")
    return both.select("path", F.coalesce("m.doc_id", "c.doc_id").alias("doc_id"), F.coalesce("m.source_kind", "c.source_kind").alias("source_kind"))


def manifests_of(manifests: DataFrame, kind: str, path: str | None = None) -> DataFrame:
    """Manifests of a source kind, or the one at a path."""
    rows = manifests.where(F.col("source_kind") == kind)
    return rows if path is None else rows.where(F.col("path") == path).orderBy("doc_id").limit(1)


def forget(tables: dict[str, DataFrame], paths: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables (``manifests`` and ``chunks`` among them) without the documents at ``paths``, and what was found."""
    found = find_by_path(paths, tables["manifests"], tables["chunks"])
    return I.cascade_delete(tables, found.where("doc_id is not null")), found.withColumn("removed", F.col("doc_id").isNotNull())


def touch(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """New updated_at (doc_id, updated_at) for the documents that have one."""
    return I.patch(rows, ids.groupBy("doc_id").agg(F.max("updated_at").alias("updated_at")), ["updated_at"])


def upsert_cache(cache: DataFrame, new: DataFrame) -> DataFrame:
    """One vector for each (profile_key, content_hash), the latest by updated_at; of equal times the new one."""
    both = cache.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    best = F.max_by(F.struct(*cache.columns), F.struct("updated_at", "_new")).alias("r")
    return both.groupBy("profile_key", "content_hash").agg(best).select("r.*")


def profile_key(name: Column, kind: Column, model: Column, base_url: Column, dims: Column) -> Column:
    return F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in (name, kind, model, base_url, dims)))


def fill_from_cache(texts: DataFrame, cache: DataFrame, profile: str, embed) -> tuple[DataFrame, DataFrame]:
    """Every text (place, text) with its vector, and the new cache rows.

    ``embed`` turns the distinct misses (content_hash, text) into (content_hash, embedding); texts with
    one hash share the vector of one of them.
    """
    resolved, misses = I.resolve_cache(texts, cache, profile)
    new = embed(misses)
    own = cache.where(F.col("profile_key") == profile).select("content_hash", "embedding").unionByName(new.select("content_hash", "embedding"))
    return resolved.join(own, "content_hash", "left"), new.withColumn("profile_key", F.lit(profile))


# ---------------------------------------------------------------- switches and votes


def rate(votes: DataFrame, signals: DataFrame, known: DataFrame, at_ms: int) -> DataFrame:
    """Votes (doc_id, helpful, noisy, last_ms) after signals (doc_id, signal) about known documents; others count nothing."""
    own = signals.join(known.select("doc_id").distinct(), "doc_id", "left_semi").where("signal in ('helpful', 'noisy')")
    new = own.groupBy("doc_id").agg(*(F.count_if(F.col("signal") == s).alias(s) for s in ("helpful", "noisy")), F.lit(at_ms).alias("last_ms"))
    both = votes.select("doc_id", "helpful", "noisy", "last_ms").unionByName(new)
    out = both.groupBy("doc_id").agg(F.sum("helpful").alias("helpful"), F.sum("noisy").alias("noisy"), F.max("last_ms").alias("last_ms"))
    return out.withColumn("net", F.col("helpful") - F.col("noisy"))


def switch(disabled: DataFrame, votes: DataFrame, orders: DataFrame, known: DataFrame, at_ms: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """disabled (doc_id, reason), votes and an answer for each order (doc_id, action: disable or enable, reason).

    Disabling, even twice, adds a noisy vote. Unknown documents change nothing. A document has one order.
    """
    own = orders.join(known.select("doc_id").distinct().withColumn("known", F.lit(True)), "doc_id", "left").join(disabled.select("doc_id", F.lit(True).alias("off")), "doc_id", "left")
    answer = F.when(F.col("known").isNull(), "unknown").when(F.col("action") == "disable", "disabled").when(F.col("off").isNotNull(), "enabled").otherwise("already enabled")
    own = own.withColumn("answer", answer)
    off = own.where("answer = 'disabled'").select("doc_id", "reason")
    kept = disabled.select("doc_id", "reason").join(own.where("known").select("doc_id"), "doc_id", "left_anti").unionByName(off)
    return kept, rate(votes, off.select("doc_id", F.lit("noisy").alias("signal")), known, at_ms), own.select("doc_id", "answer")


# ---------------------------------------------------------------- export, summaries, listings


def listed(sources: DataFrame, k: int | None = None) -> DataFrame:
    """Latest first, ties by id."""
    rows = sources.orderBy(F.desc("updated_at"), "doc_id")
    return rows if k is None else rows.limit(k)


def export(sources: DataFrame, contents: DataFrame, *, kinds: tuple[str, ...] = (), content: bool = False, project: bool = False, limit: int | None = None) -> DataFrame:
    """The latest sources of the kinds, with their content if asked (that of project files only if asked as well).

    Content that is missing is null. Nothing is superseded and no subjects are in conflict here.
    """
    rows = listed(sources.where(F.col("source_kind").isin(*kinds)) if kinds else sources, limit)
    included = F.lit(content) & ((F.col("source_kind") != "project") | F.lit(project))
    rows = rows.withColumns({"superseded_by": F.lit(None).cast("string"), "conflict_subjects": F.array().cast("array<string>"), "content_included": included})
    if not content:
        return rows.withColumn("content", F.lit(None).cast("string"))
    return rows.join(contents.select("doc_id", "content"), "doc_id", "left").withColumn("content", F.when(F.col("content_included"), F.col("content")))


def inspection(sources: DataFrame, recent: int = 8) -> tuple[DataFrame, DataFrame]:
    """One row of total, active and disabled sources, and the most recent ones."""
    totals = sources.agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("is_disabled")).alias("active"), F.count_if("is_disabled").alias("disabled"))
    return totals, listed(sources, recent).select("doc_id", "source_kind", "title", "memory_tier", "updated_at", "is_disabled")


def index_summary(changes: DataFrame) -> DataFrame:
    """One row: indexed, skipped, unchanged and removed files of ``ingest.scan_changes``."""
    of = lambda *s: F.count_if(F.col("status").isin(*s))
    return changes.agg(of("new", "changed").alias("indexed"), of("too_large").alias("skipped"), of("unchanged", "refreshed").alias("unchanged"), of("removed").alias("removed"))


# ---------------------------------------------------------------- checkpoints and domains


def save_checkpoints(history: DataFrame, new: DataFrame, key: str = "project") -> tuple[DataFrame, DataFrame]:
    """(history with the new records, the active one of each project: the new one, else the latest before)."""
    both = history.unionByName(new)
    latest = F.max_by(F.struct(*both.columns), F.struct("updated_at", "id")).alias("r")
    return both, both.groupBy(key).agg(latest).select("r.*")


def clear_checkpoints(active: DataFrame, gone: DataFrame, key: str = "project") -> tuple[DataFrame, DataFrame]:
    """Active checkpoints without those of the projects in ``gone``, and for each of these whether there was one."""
    had = gone.select(key).distinct().join(active.select(key).distinct().withColumn("cleared", F.lit(True)), key, "left").fillna(False, ["cleared"])
    return active.join(gone.select(key).distinct(), key, "left_anti"), had


def create_domains(domains: DataFrame, new: DataFrame, today: str) -> DataFrame:
    """New domains (name, display_name, aliases, description, tags, sections) under their safe names; one that exists is replaced."""
    empty = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind)).alias(c)
    kinds = dict(domains.dtypes)
    shown = F.when(F.coalesce("display_name", F.lit("")) != "", F.col("display_name")).otherwise(F.col("name"))
    rows = new.select(
        T.domain_slug(F.col("name")).alias("name"), shown.alias("display_name"), empty("aliases", kinds["aliases"]), F.coalesce("description", F.lit("")).alias("description"),
        empty("tags", kinds["tags"]), empty("sections", kinds["sections"]), F.lit(today).alias("created_at"), F.lit(today).alias("updated_at"),
    )
    return I.replace_rows(domains, rows, "name")


def update_domains(domains: DataFrame, changes: DataFrame, today: str) -> DataFrame:
    """Changes of display_name, aliases, description or tags; what is null stays. Unknown names change nothing."""
    fields = ["display_name", "aliases", "description", "tags"]
    out = I.patch(domains, changes, fields, "name").join(changes.select("name", F.lit(True).alias("_hit")), "name", "left")
    return out.withColumn("updated_at", F.when(F.col("_hit"), F.lit(today)).otherwise(F.col("updated_at"))).drop("_hit")


def add_sections(domains: DataFrame, sections: DataFrame) -> DataFrame:
    """A section (name, dir, label) for each domain, unless it has one of that folder."""
    out = domains.join(sections.select("name", F.struct("dir", "label").alias("_s")), "name", "left")
    fresh = F.col("_s").isNotNull() & ~F.exists("sections", lambda s: s["dir"] == F.col("_s.dir"))
    return out.withColumn("sections", F.when(fresh, F.concat("sections", F.array("_s"))).otherwise(F.col("sections"))).drop("_s")


def delete_domains(domains: DataFrame, gone: DataFrame) -> DataFrame:
    return domains.join(gone.select("name").distinct(), "name", "left_anti")


def domain_files(files: DataFrame, name: str, section: str | None = None) -> DataFrame:
    """Markdown files (name, path) of a domain or one of its sections; parts that start with an underscore are left out."""
    rows = files.where((F.col("name") == name) & F.col("path").rlike(r"\.md$") & ~F.col("path").rlike("(^|/)_"))
    return rows if section is None else rows.where(F.startswith(F.col("path"), F.lit(section.rstrip("/") + "/")))


# ---------------------------------------------------------------- names, paths and parameters


def profile_directory(name: Column) -> Column:
    return F.regexp_replace(T.trimmed(name), "[^a-zA-Z0-9._-]+", "_")


def relative_to(root: Column, path: Column) -> Column:
    """The path from ``root`` on with forward slashes, or the whole path outside of it."""
    flat = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    base = F.concat(F.regexp_replace(flat(root), "/+$", ""), F.lit("/"))
    return F.when(F.startswith(flat(path), base), F.substr(flat(path), F.length(base) + 1)).otherwise(flat(path))


def pick_defined(new: Column, old: Column) -> Column:
    return F.coalesce(new, old)


def optional_int(x: Column) -> Column:
    """The whole number that a text begins with, null if it begins with none."""
    return F.nullif(F.regexp_extract(x, r"^\s*([+-]?\d+)", 1), F.lit("")).try_cast("long")


def optional_bool(x: Column) -> Column:
    return F.when(x == "true", True).when(x == "false", False)


def optional_string(x: Column) -> Column:
    return F.when(T.trimmed(x) != "", x)


def parse_date(x: Column) -> Column:
    """Milliseconds of a date or time; null, which filters nothing, where there is none."""
    return F.unix_millis(F.try_to_timestamp(x))


def in_order(rows: DataFrame, keys: list[str], place: str) -> DataFrame:
    """Ordered union without repeats: of equal keys the row with the least place stays (rows may come from several unions)."""
    return G.first_arrivals(rows, keys, place)


def ranks(rows: DataFrame, *by: Column) -> DataFrame:
    """Adds ``place`` over a bounded table."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*by)))
