"""Rollups, last-event-wins state, conflict claims, graph expansion and change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import rounded

#: Phrases before a claim's subject.
FOR = r"\b(?:prefer|use|choose|adopt|enable|default to|standardize on)\s+([\w/-]+)"
AGAINST = r"\b(?:avoid|disable|deprecate|reject|do not use|don't use|never use|not use)\s+([\w/-]+)"


def claims(decisions: DataFrame, text: str = "content", positive: str = FOR, negative: str = AGAINST) -> DataFrame:
    """doc_id, polarity, subject, and path if there is one: distinct claims; a negative phrase may hold a positive one as well."""
    low = F.lower(F.col(text))
    found = F.concat(
        F.transform(F.regexp_extract_all(low, F.lit(positive), 1), lambda s: F.struct(F.lit("for").alias("polarity"), s.alias("subject"))),
        F.transform(F.regexp_extract_all(low, F.lit(negative), 1), lambda s: F.struct(F.lit("against").alias("polarity"), s.alias("subject"))),
    )
    own = [c for c in ("doc_id", "path") if c in decisions.columns]
    return decisions.select(*own, F.explode(F.array_distinct(found)).alias("c")).select("doc_id", "c.polarity", "c.subject", *own[1:])


def conflict_clusters(found: DataFrame, pair_score: float = 0.836, overlap: float = 0.08) -> DataFrame:
    """Subjects claimed both ways: documents, pairs and score. Pairs are counted, not formed.

    A pair is two documents of which one is for and the other against. A document that holds both makes
    no pair with itself, and two that both hold both make two pairs. A pair scores ``overlap`` more if the
    last two parts of the documents' paths are equal; the score starts from the mean of the pairs.
    """
    parts = F.split("path", r"[\\/]")
    tail = F.lower(F.when(F.size(parts) > 2, F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1))).otherwise(F.concat_ws("/", parts))) if "path" in found.columns else F.lit(None).cast("string")
    of = lambda side: F.max((F.col("polarity") == side).cast("long"))
    sides = found.withColumn("tail", tail).groupBy("subject", "doc_id").agg(of("for").alias("f"), of("against").alias("a"), F.max("tail").alias("tail"))
    sums = (F.count(F.lit(1)).alias("docs"), F.sum("f").alias("f"), F.sum("a").alias("a"), F.sum(F.col("f") * F.col("a")).alias("b"))
    near = sides.groupBy("subject", "tail").agg(*sums).withColumn("near", F.when(F.col("tail").isNull(), 0).otherwise(F.col("f") * F.col("a") - F.col("b")))
    n = near.groupBy("subject").agg(*(F.sum(c).alias(c) for c in ("docs", "f", "a", "b", "near")))
    out = n.withColumn("pairs", F.col("f") * F.col("a") - F.col("b")).where("pairs > 0")
    bonus = F.least(F.lit(0.12), F.greatest(F.lit(0), F.col("docs") - 2) * 0.05) + F.least(F.lit(0.06), F.greatest(F.lit(0), F.col("pairs") - 1) * 0.02)
    base = F.lit(pair_score) + F.col("near") / F.col("pairs") * overlap
    return out.select("subject", "docs", "pairs", rounded(F.least(F.lit(1.0), base + bonus)).alias("score"))


def branch_rollup(chunks: DataFrame, disabled: DataFrame) -> DataFrame:
    flagged = chunks.join(disabled.withColumn("off", F.lit(True)), "doc_id", "left")
    kinds = [F.sum(F.when(F.col("source_kind") == k, 1).otherwise(0)).alias(f"n_{k}") for k in ("manual", "decision", "diary", "project", "imported", "log")]
    return flagged.groupBy("branch_name").agg(F.countDistinct("doc_id").alias("docs"), F.count(F.lit(1)).alias("chunks"), F.max("updated_at").alias("latest"), F.countDistinct(F.when(F.col("off"), F.col("doc_id"))).alias("disabled_docs"), *kinds)


def expand(edges: DataFrame, seeds: DataFrame, types: tuple[str, ...], limit: int) -> DataFrame:
    """Documents that share targets with the seeds, by the sum of weight products; seeds excluded.

    The seeds' targets are aggregated before the join, so the join makes one row for each other edge.
    """
    of = edges.where(F.col("edge_type").isin(*types))
    own = of.join(seeds.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("edge_type", "target_key").agg(F.sum("weight").alias("seed_weight"))
    hits = of.join(seeds.select("doc_id").distinct(), "doc_id", "left_anti").join(own, ["edge_type", "target_key"])
    return hits.groupBy("doc_id").agg(rounded(F.sum(F.col("weight") * F.col("seed_weight"))).alias("score"), F.count(F.lit(1)).alias("hits")).orderBy(F.desc("score"), "doc_id").limit(limit)


def change_status(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, status of files (path, checksum, size) against manifests of the same columns."""
    o, n = old.alias("o"), new.alias("n")
    status = F.when(F.col("n.path").isNull(), "removed").when(F.col("o.path").isNull(), "new").when(F.col("o.checksum") == F.col("n.checksum"), "unchanged").otherwise("changed")
    return o.join(n, F.col("o.path") == F.col("n.path"), "full_outer").select(F.coalesce("n.path", "o.path").alias("path"), status.alias("status"))


def upsert_latest(old: DataFrame, new: DataFrame, key: str, at: str) -> DataFrame:
    """The latest row of each key; at equal times the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    row = F.struct(*old.columns)
    return both.groupBy(key).agg(F.max_by(row, F.struct(at, "_new")).alias("r")).select("r.*")


def first_arrivals(rows: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """The row of each key that arrived first; null keys are one key."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), arrival).alias("r")).select("r.*")
