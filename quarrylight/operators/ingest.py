"""Ingest: change detection by size, time and checksum, replacing rows, symbols, hash embeddings, embedding cache."""

from __future__ import annotations

import ast
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import lexer


def scan_changes(files: DataFrame, manifests: DataFrame, profile: str, max_bytes: int = 256_000) -> DataFrame:
    """path, status of files (path, mtime_ms, size_bytes, checksum) against manifests of the same with embedding_profile.

    too_large: skipped, but seen. unchanged: equal time, size and profile. refreshed: equal checksum and
    profile. Else new or changed; removed: no such file any more.
    """
    f, m = files.alias("f"), manifests.alias("m")
    same = F.col("m.embedding_profile") == profile
    status = (
        F.when(F.col("f.path").isNull(), "removed").when(F.col("f.size_bytes") > max_bytes, "too_large").when(F.col("m.path").isNull(), "new")
        .when(same & (F.col("f.mtime_ms") == F.col("m.mtime_ms")) & (F.col("f.size_bytes") == F.col("m.size_bytes")), "unchanged")
        .when(same & (F.col("f.checksum") == F.col("m.checksum")), "refreshed").otherwise("changed")
    )
    return f.join(m, F.col("f.path") == F.col("m.path"), "full_outer").select(F.coalesce("f.path", "m.path").alias("path"), status.alias("status"))


def replace_rows(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """All rows of the keys in ``new`` give way to its rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    return {n: t.join(gone.select(key).distinct(), key, "left_anti") for n, t in tables.items()}


def patch(old: DataFrame, new: DataFrame, fields: list[str], key: str = "doc_id") -> DataFrame:
    """New values where there are any: a null can't clear a field. ``new`` has one row for each key."""
    n = new.select(key, *(F.col(c).alias(f"_{c}") for c in fields))
    return old.join(n, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in fields}).drop(*(f"_{c}" for c in fields))


def last_state(log: DataFrame, key: str, action: str, at: str, seq: str) -> DataFrame:
    """key, action and time of the last event of each key."""
    return log.groupBy(key).agg(F.max_by(F.struct(action, at), F.struct(at, seq)).alias("s")).select(key, "s.*")


#: Patterns of symbols, and names that are none.
SYMBOLS = (
    r"export\s+(?:async\s+)?function\s+([A-Za-z_]\w*)", r"function\s+([A-Za-z_]\w*)\s*\(", r"export\s+class\s+([A-Za-z_]\w*)", r"class\s+([A-Za-z_]\w*)\s*",
    r"^\s*(?:public|private|protected)?\s*(?:static\s+)?(?:async\s+)?([A-Za-z_]\w*)\s*\([^)]*\)[^\n]*\{", r"const\s+([A-Za-z_]\w*)\s*=\s*(?:async\s*)?\(", r"interface\s+([A-Za-z_]\w*)", r"type\s+([A-Za-z_]\w*)\s*=", r"def\s+([A-Za-z_]\w*)\s*\(",
)
RESERVED = {"if", "for", "while", "switch", "catch", "return", "async"}
_COMPILED = [re.compile(p, re.M) for p in SYMBOLS]


#: Patterns that infer the name of a text, the first that matches counts.
INFERRED = (*SYMBOLS[:6], r"const\s+([A-Za-z_]\w*)\s*=\s*(?:async\s*)?(?:function|<)", *SYMBOLS[6:], r"struct\s+([A-Za-z_]\w*)", r"enum\s+([A-Za-z_]\w*)")
_INFERRED = [re.compile(p, re.M) for p in INFERRED]


def inferred_symbol(label: str, content: str, *, label_too: bool = True, language: str | None = None) -> str | None:
    """A file's first declared symbol, else the first pattern's name in its first 2000 characters, else its label without extension."""
    if language and (found := symbols_in(content, language)):
        return found[0][0]
    for p in _INFERRED:
        m = p.search(content[:2000])
        if m and m.group(1).lower() not in RESERVED:
            return m.group(1)
    return (re.sub(r"\.[^./\\]*$", "", label).strip() or None) if label_too else None


def inferred_symbols(files: DataFrame) -> DataFrame:
    """doc_id, symbol of files (doc_id, path, content); the path's last part is the label."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            names = [inferred_symbol(p or "", c or "", language=lang) for p, c, lang in zip(f["label"], f["content"], f["language"], strict=True)]
            yield pd.DataFrame({"doc_id": f["doc_id"], "symbol": names})

    rows = files.select("doc_id", T.base_name(F.col("path")).alias("label"), "content", T.language_of(F.col("path")).alias("language"))
    return rows.mapInPandas(run, "doc_id long, symbol string")


def symbols_in(content: str, language: str | None = None) -> list[tuple[str, int]]:
    """(name, index) by index: Python through its parser, Go, Rust, Java, TypeScript and JavaScript by their declarations,
    all else and what does not parse through patterns."""
    if language in lexer.QUOTED and (found := lexer.declarations(content, language)):
        return found
    if language == "python":
        try:
            tree = ast.parse(content)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            tree = None
        if tree is not None:
            starts = np.cumsum([0, *(len(x) + 1 for x in content.split("\n"))])
            kinds = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
            if found := sorted({(int(starts[n.lineno - 1]) + n.col_offset, n.name) for n in ast.walk(tree) if isinstance(n, kinds)}):
                return [(name, at) for at, name in found]
    hits = [(m.start(), k, m.group(1)) for k, p in enumerate(_COMPILED) for m in p.finditer(content) if m.group(1).lower() not in RESERVED]
    seen: dict[tuple[str, int], None] = {}
    for at, _, name in sorted(hits):
        seen.setdefault((name, at))
    return list(seen)


def symbol_spans(files: DataFrame) -> DataFrame:
    """doc_id, name, at, turn of the symbols of files (doc_id, content, language); a null content has none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(doc, n, a, i) for doc, content, language in f.itertuples(index=False) if content for i, (n, a) in enumerate(symbols_in(content, language))]
            yield pd.DataFrame(rows, columns=["doc_id", "name", "at", "turn"])

    return files.select("doc_id", "content", "language").mapInPandas(run, "doc_id long, name string, at long, turn int")


def symbol_for_chunk(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """Adds ``symbol``: the last span that starts in a chunk [start, end), else the last before it; both are the last that starts before its end.

    One sort of chunks and spans together by document, no range join. chunks: doc_id, chunk_index, start, end.
    """
    both = spans.select("doc_id", F.col("at").alias("pos"), F.lit(1).alias("kind"), F.col("turn"), "name", F.lit(None).cast("int").alias("chunk_index"))
    both = both.unionByName(chunks.select("doc_id", F.col("end").cast("long").alias("pos"), F.lit(0).alias("kind"), F.lit(0).alias("turn"), F.lit(None).cast("string").alias("name"), "chunk_index"))
    w = Window.partitionBy("doc_id").orderBy("pos", "kind", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("symbol", F.last("name", ignorenulls=True).over(w)).where("kind = 0").select("doc_id", "chunk_index", "symbol")


class HashCounts:
    """Signed counts of texts: every byte of each token's SHA-256 adds the next byte's sign at its place.

    Tokens met before are kept, about ``keep`` of them, one byte a place; a block's new tokens are hashed and
    laid out together.
    """

    def __init__(self, dims: int, keep: int = 200_000, block: int = 8192):
        self.dims, self.keep, self.block = dims, keep, block
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.rows = np.zeros((4096, self.dims), np.int8)

    def _learn(self, tokens: list[str]) -> None:
        """Rows of tokens that are new; a row's counts lie between -32 and 32."""
        raw = np.frombuffer(b"".join(hashlib.sha256(t.encode()).digest() for t in tokens), np.uint8).reshape(len(tokens), 32)
        sign = np.where(np.roll(raw, -1, axis=1) % 2 == 0, 1.0, -1.0)
        at = raw % self.dims + np.arange(len(tokens))[:, None] * self.dims
        rows = np.bincount(at.ravel(), sign.ravel(), len(tokens) * self.dims).reshape(len(tokens), self.dims)
        start = len(self.place)
        while start + len(tokens) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[start : start + len(tokens)] = rows
        self.place.update(zip(tokens, range(start, start + len(tokens)), strict=True))

    def __call__(self, texts: pd.Series) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), np.int64)
        for i, text in enumerate(texts):
            tokens = (text or "").lower().split()
            for k in range(0, len(tokens), self.block):
                if len(self.place) > self.keep:
                    self.clear()
                seen = Counter(tokens[k : k + self.block])  # each distinct token once
                place = self.place
                if new := [t for t in seen if t not in place]:
                    self._learn(new)
                ids = np.fromiter(map(place.__getitem__, seen), np.int64, len(seen))
                counts = np.fromiter(seen.values(), np.float32, len(ids))
                out[i] += np.rint(counts @ self.rows[ids].astype(np.float32)).astype(np.int64)  # exact: sums below 2 ** 24
        return out


def hash_embedding(docs: DataFrame, dims: int = 64, text: str = "text") -> DataFrame:
    """doc_id, embedding (length 1, or all zero without tokens), raw (the signed counts)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = HashCounts(dims)
        for f in frames:
            n = counts(f[text]).astype(np.float64)
            size = np.sqrt((n * n).sum(axis=1, keepdims=True))
            yield pd.DataFrame({"doc_id": f["doc_id"], "embedding": list(np.divide(n, size, out=n.copy(), where=size > 0)), "raw": list(n.astype(np.int64))})

    return docs.select("doc_id", text).mapInPandas(run, "doc_id long, embedding array<double>, raw array<long>")


def resolve_cache(texts: DataFrame, cache: DataFrame, profile: str) -> tuple[DataFrame, DataFrame]:
    """(texts with content_hash and hit, distinct misses) against cache (profile_key, content_hash)."""
    known = cache.where(F.col("profile_key") == profile).select("content_hash").distinct().withColumn("hit", F.lit(True))
    out = texts.withColumn("content_hash", T.content_hash(F.col("text"))).join(known, "content_hash", "left").fillna(False, ["hit"])
    return out, out.where("not hit").groupBy("content_hash").agg(F.min("text").alias("text"))


def embedding_metrics(resolved: DataFrame, *keys: str) -> DataFrame:
    """Items, characters, estimated tokens, unique, duplicates and their share, hits and misses."""
    n = F.count(F.lit(1))
    m = resolved.groupBy(*keys).agg(
        n.alias("items"), F.sum(F.length("text")).alias("chars"), F.sum(F.when(F.col("text") == "", 0).otherwise(T.estimate_tokens(F.col("text")))).alias("tokens"),
        F.countDistinct("content_hash").alias("unique_items"), F.count_if("hit").alias("hits"),
    )
    return m.withColumns({"duplicates": F.col("items") - F.col("unique_items"), "misses": F.col("items") - F.col("hits")}).withColumn("duplicate_ratio", T.rounded(F.col("duplicates") / F.col("items")))


def decision_note(title, decision, rationale, impact, tags):
    """Markdown of a decision; parts that are null go."""
    part = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"## {name}\n"), c))
    return F.concat_ws("\n\n", F.concat(F.lit("# "), title), part("Decision", decision), part("Rationale", rationale), part("Impact", impact), F.when(F.size(tags) > 0, F.concat(F.lit("Tags: "), F.concat_ws(", ", tags))))
