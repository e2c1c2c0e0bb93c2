"""File sources: project trees, Markdown folders, whole texts, TOML configuration, branch, JSON records."""

from __future__ import annotations

import fnmatch
import json
import os
import re
import tomllib
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .tables import ship
from .tree import TreeSource, glob_pattern, ignore_pattern

#: What a project scan takes and leaves by default, and the largest file.
INCLUDE = tuple(f"**/*.{x}" for x in ("md", "txt", "ts", "tsx", "js", "jsx", "py", "go", "rs", "java", "cs", "c", "cpp", "h", "hpp", "json", "yaml", "yml", "toml", "sql", "sh", "ps1"))
EXCLUDE = ("**/.git/**", "**/node_modules/**", "**/dist/**", "**/build/**", "**/target/**", "**/.next/**", "**/coverage/**", "**/*.lock", "**/*.png", "**/*.jpg", "**/*.jpeg", "**/*.gif", "**/*.pdf", "**/*.zip")
MAX_BYTES = 256_000


def among(path: Column, patterns) -> Column:
    patterns = list(patterns)
    return path.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def wanted(path: Column, include=INCLUDE, exclude=EXCLUDE) -> Column:
    """Whether a relative path is scanned: included, not excluded in either reading, and without parts that start with a dot."""
    return among(path, map(glob_pattern, include)) & ~among(path, map(glob_pattern, exclude)) & ~among(path, map(ignore_pattern, exclude)) & ~path.rlike(r"(^|/)\.")


def scan(spark: SparkSession, root: str, include=INCLUDE, exclude=EXCLUDE, max_bytes: int | None = None) -> DataFrame:
    """path (from ``root`` on), size_bytes, mtime_ms, content, checksum of a tree's files; text that isn't UTF-8 is repaired.

    Files are listed by ``tree.TreeSource``: executors walk the folders, excluded folders are not entered, and
    only files that are taken are opened. With ``max_bytes`` the contents of larger files are null, and the
    files stay closed.
    """
    ship(spark)
    spark.dataSource.register(TreeSource)
    options = {"include": json.dumps(list(include)), "exclude": json.dumps(list(exclude)), "max_bytes": "" if max_bytes is None else str(max_bytes)}
    raw = spark.read.format(TreeSource.name()).options(**options).load(root)
    return raw.select("path", "size_bytes", "mtime_ms", F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.sha1("content").alias("checksum"))


def markdown(spark: SparkSession, root: str) -> DataFrame:
    """The Markdown files of a tree, without folders whose names start with an underscore."""
    return scan(spark, root, ("**/*.md",), ()).where(~F.col("path").rlike("(^|/)_[^/]*/"))


def texts_at(paths: DataFrame, files: DataFrame, missing: str | None = "") -> DataFrame:
    """paths with the content of their files; a missing file has ``missing`` (empty, or null)."""
    out = paths.join(files.select("path", "content"), "path", "left")
    return out if missing is None else out.fillna(missing, ["content"])


def index_documents(files: DataFrame, profile: str, at_ms: int, *, max_bytes: int = MAX_BYTES, dims: int = 64) -> dict[str, DataFrame]:
    """manifests, chunks (with symbol and embedding) and edges of scanned files: one pass of the whole ingest.

    Files that are too large are left out. A chunk is embedded by the hash of its tokens and named by the
    last symbol that starts before its end.
    """
    from ..operators import graph as G
    from ..operators import ingest as I

    kept = files.where(F.col("size_bytes") <= max_bytes)
    docs = kept.select(F.xxhash64("path").alias("doc_id"), "path", "checksum", "mtime_ms", "size_bytes", F.coalesce("content", F.lit("")).alias("content"), T.language_of(F.col("path")).alias("language"), T.top_level_module(F.col("path")).alias("module_name"))
    manifests = docs.select("doc_id", "path", F.lit("project").alias("source_kind"), "checksum", "mtime_ms", "size_bytes", F.lit(profile).alias("embedding_profile"), F.lit(at_ms).alias("updated_at"))
    cut = docs.select("doc_id", "path", "language", "module_name", F.posexplode(T.chunk_texts(F.col("content"))).alias("chunk_index", "c"))
    chunks = cut.select("doc_id", "path", "language", "module_name", "chunk_index", F.col("c.start").alias("start"), (F.col("c.start") + F.length("c.content")).alias("end"), F.col("c.content").alias("content"))
    spans = I.symbol_spans(docs)
    named = chunks.join(I.symbol_for_chunk(chunks, spans), ["doc_id", "chunk_index"])
    keyed = named.withColumn("key", F.xxhash64("doc_id", "chunk_index"))
    vectors = I.hash_embedding(keyed.select(F.col("key").alias("doc_id"), "content"), dims, "content").select(F.col("doc_id").alias("key"), "embedding")
    symbols = spans.groupBy("doc_id").agg(F.collect_set("name").alias("symbols"))
    whole = docs.join(symbols, "doc_id", "left").withColumns({"branch_name": F.lit(None).cast("string"), "tags": F.array().cast("array<string>")})
    return {"manifests": manifests, "chunks": keyed.join(vectors, "key").drop("key"), "edges": G.build_edges(whole)}


# ---------------------------------------------------------------- small driver-side inputs


def merged(defaults: dict[str, Any], given: dict[str, Any]) -> dict[str, Any]:
    """Section by section; lists of profiles replace the defaults as a whole unless they are empty."""
    out = dict(defaults)
    for k, v in given.items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = out[k] | v
        elif not isinstance(v, list) or v:
            out[k] = v
    return out


def config(path: str, defaults: dict[str, Any]) -> dict[str, Any]:
    """Defaults under a TOML file; without a file, the defaults."""
    if not os.path.exists(path):
        return dict(defaults)
    with open(path, "rb") as f:
        return merged(defaults, tomllib.load(f))


def branch(root: str) -> str | None:
    """The branch that a work tree's HEAD names; null if it is detached or there is none."""
    try:
        with open(os.path.join(root, ".git", "HEAD"), encoding="utf-8") as f:
            found = re.fullmatch(r"ref: refs/heads/(.+)", f.read().strip())
    except OSError:
        return None
    return found.group(1) if found else None


def suite(path: str) -> list[dict[str, Any]]:
    """Projects of a benchmark suite (a JSON list, or an object with ``projects``); relative roots start from its folder."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    projects = found.get("projects", []) if isinstance(found, dict) else found
    here = os.path.dirname(os.path.abspath(path))
    return [p | {"root": os.path.normpath(os.path.join(here, p.get("root", ".")))} for p in projects]


def history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Runs from JSON lines."""
    return spark.read.schema(schema).json(path)


def matches(path: str, glob: str) -> bool:
    """The same reading of a glob for one path on the driver."""
    return re.search(glob_pattern(glob), path) is not None or fnmatch.fnmatchcase(path, glob)
