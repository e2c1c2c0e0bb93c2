"""Retrieval relations over the test tables: chunks, votes, disabled sources, edges."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

NOW_MS = 1_706_745_600_000  # 2024-02-01T00:00:00Z, injected wherever "now" matters
KINDS = ("manual", "decision", "diary", "project", "imported", "log")
TIERS = ("stable", "stable", "working", "project", "stable", "project")
STABILITY = (0.82, 0.95, 0.46, 0.52, 0.72, 0.52)


#: Symbols of passages, by id.
SYMBOLS = ("remember", "rememberTask", "recall", "Store.remember()", "index", "forget", "rate")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    known = [*os.environ.get("PYTHONPATH", "").split(":"), *env.get("PYTHONPATH", "").split(":")]
    if root not in known:
        env["PYTHONPATH"] = ":".join(x for x in (env.get("PYTHONPATH", ""), root) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk row for each document; kind, tier and age follow from the id."""
    k = F.col("doc_id") % 6
    at = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (k + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", at(KINDS).alias("source_kind"), F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.substring("text", 1, 40).alias("title"), F.col("text").alias("content"),
        F.col("source").alias("module_name"), F.col("lang").alias("language"), F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("feature/"), F.col("lang"))).alias("branch_name"), at(TIERS).alias("memory_tier"), at(STABILITY).alias("stability_score"),
        (F.lit(NOW_MS) - (F.col("doc_id") % 200) * 86_400_000).alias("updated_at"),
    )


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, helpful, noisy, last_ms from the labels."""
    return table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.sum("quality").cast("long").alias("helpful"), F.sum("toxic").cast("long").alias("noisy"), F.max(F.lit(NOW_MS) - F.col("doc_id") % 30 * 86_400_000).alias("last_ms"))


def disabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, edge_type, target_key, weight: module, language and branch edges."""
    made = F.array(*(F.struct(F.lit(t).alias("edge_type"), F.col(c).alias("target_key"), F.lit(w).alias("weight")) for t, c, w in (("module", "module_name", 1.0), ("language", "language", 0.45), ("branch", "branch_name", 0.4))))
    return chunks(spark, sf_dir).select("doc_id", F.explode(made).alias("e")).select("doc_id", "e.*").where("target_key is not null").groupBy("doc_id", "edge_type", "target_key").agg(F.max("weight").alias("weight"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 1200 characters of every document, with symbol, tags and, where there is one, an embedding."""
    cut = chunks(spark, sf_dir).select("*", F.posexplode(T.chunk_texts(F.col("content"))).alias("chunk_index", "cut")).withColumn("content", F.col("cut.content")).drop("cut")
    symbol = F.element_at(F.array(*map(F.lit, SYMBOLS)), (F.col("doc_id") % len(SYMBOLS) + 1).cast("int"))
    named = cut.withColumns({"symbol": symbol, "tags": F.array("source_kind", "language")})
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), T.normalized(F.col("embedding").cast("array<double>")).alias("embedding"))
    return named.join(vectors, "doc_id", "left")
