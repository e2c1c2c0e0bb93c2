"""Benchmark suites: baselines by project, profiles, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Share and milliseconds from which indexing and recall have become slower.
LIMITS = {"index_ms": (0.75, 30.0), "recall_ms": (1.0, 12.0)}


def verdict(now: Column, base: Column, share: float, least: float) -> Column:
    change = now - base
    return F.when(base.isNull() | (base <= 0), "unknown").when((change >= least) & (change / base >= share), "regressed").when((change <= -least) & (change / base <= -0.2), "improved").otherwise("steady")


def project_key(name: Column, root: Column) -> Column:
    return F.concat_ws("|", F.coalesce(name, T.base_name(root)), F.lower(F.replace(root, F.lit("\\"), F.lit("/"))))


def compare_projects(current: DataFrame, history: DataFrame) -> DataFrame:
    """Every project that went well against the median of its own runs: name, and for both times now, base and verdict.

    Both tables: name, root, status, index_ms, recall_ms. Runs that failed or lack a time don't count.
    """
    key = project_key(F.col("name"), F.col("root"))
    good = lambda t: t.where("status = 'ok'").withColumn("key", key)
    base = good(history).where("index_ms is not null and recall_ms is not null").groupBy("key").agg(*(F.median(c).alias(f"base_{c}") for c in LIMITS))
    out = good(current).join(base, "key", "left")
    return out.select("key", "name", *LIMITS, *(f"base_{c}" for c in LIMITS), *(verdict(F.col(c), F.col(f"base_{c}"), *LIMITS[c]).alias(f"{c[:-3]}_status") for c in LIMITS))


def profiles(history: DataFrame) -> DataFrame:
    """Runs (profile, generated_at, projects, failed) by profile: samples and the latest run; runs without a profile don't count."""
    latest = F.max_by(F.struct("projects", "failed"), "generated_at").alias("l")
    got = history.where("profile is not null and profile <> ''").groupBy("profile").agg(F.count(F.lit(1)).alias("samples"), F.max("generated_at").alias("latest"), latest)
    return got.select("profile", "samples", "latest", F.col("l.projects").alias("projects"), F.col("l.failed").alias("failed"))


def append(history: DataFrame, new: DataFrame, keep: int | None = None) -> DataFrame:
    """History with new runs, by time; with ``keep`` only the last runs of each profile."""
    both = history.unionByName(new)
    if keep is None:
        return both.orderBy("generated_at")
    last = F.array_sort(F.collect_list(F.struct("generated_at", F.struct(*both.columns).alias("r"))))
    return both.groupBy("profile").agg(F.slice(F.reverse(last), 1, keep).alias("x")).select(F.explode("x").alias("x")).select("x.r.*")
