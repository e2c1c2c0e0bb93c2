"""Governance of stored notes: rollups, health, stale decisions, cleanup, consolidation, conflict resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from .graph import components
from .lineage import cut
from .note_links import linked

#: Order of priorities.
PRIORITY = {"high": 3, "medium": 2, "low": 1}


def source_rollup(chunks: DataFrame, disabled: DataFrame, votes: DataFrame) -> DataFrame:
    """One row for each source: the largest of its fields, chunk count, disabled flag and votes."""
    fields = ("title", "module_name", "language", "branch_name", "memory_tier", "stability_score", "updated_at")
    own = chunks.groupBy("doc_id", "path", "source_kind").agg(*(F.max(c).alias(c) for c in fields), F.count(F.lit(1)).alias("chunk_count"))
    off = disabled.select("doc_id").distinct().withColumn("is_disabled", F.lit(True))
    return own.join(off, "doc_id", "left").join(votes, "doc_id", "left").fillna(False, ["is_disabled"]).fillna(0, ["helpful", "noisy"])


def _stale(days: int, now_ms: int) -> Column:
    return (F.col("updated_at") <= now_ms - days * S.DAY_MS)


def is_noisy() -> Column:
    return ~F.col("is_disabled") & (F.col("noisy") > F.col("helpful")) & (F.col("source_kind") != "project")


def is_stale(now_ms: int, days: int = 45) -> Column:
    return ~F.col("is_disabled") & F.col("source_kind").isin("diary", "imported") & _stale(days, now_ms)


def health(sources: DataFrame, now_ms: int, days: int = 45) -> DataFrame:
    """One row: active, disabled, cold, stale and noisy sources."""
    return sources.agg(F.count_if(~F.col("is_disabled")).alias("active"), F.count_if("is_disabled").alias("disabled"), F.count_if(F.col("memory_tier") == "cold").alias("cold"), F.count_if(is_stale(now_ms, days)).alias("stale"), F.count_if(is_noisy()).alias("noisy"))


def stale_decisions(sources: DataFrame, subjects: DataFrame, now_ms: int, *, days: int = 60, most_stability: float = 0.42, k: int | None = 8) -> DataFrame:
    """Old decisions with another reason to doubt them, worst first; ``subjects``: doc_id, n (conflict subjects).

    ``superseded`` is read from distill_reason where the sources have it. A null stability counts as 1.
    """
    d = sources.where("source_kind = 'decision'").join(subjects, "doc_id", "left").fillna(0, ["n"])
    superseded = F.coalesce(F.lower("distill_reason").contains("superseded by canonical decision"), F.lit(False)) if "distill_reason" in sources.columns else F.lit(False)
    cold, low, noisy, torn = F.coalesce(F.col("memory_tier") == "cold", F.lit(False)), F.coalesce("stability_score", F.lit(1.0)) <= most_stability, F.col("noisy") > F.col("helpful"), F.col("n") > 0
    d = d.withColumns({"_s": superseded, "_c": cold})
    action = F.when(F.col("_s") & F.col("_c") & F.col("is_disabled"), "keep_cold").when(torn | (~F.col("_s") & F.col("is_disabled")), "mark_superseded").otherwise("review")
    flags = (_stale(days, now_ms), F.col("_s"), F.col("_c"), F.col("is_disabled"), low, noisy, torn)
    d = d.where(_stale(days, now_ms) & (F.col("_s") | F.col("is_disabled") | F.col("_c") | low | noisy | torn))
    d = d.withColumns({"reasons": sum(f.cast("int") for f in flags), "action": action})
    weight = F.col("reasons") + F.col("n") * 0.8 + F.when(F.col("action") == "mark_superseded", 0.6).otherwise(0.0) + F.when(F.col("_c"), 0.2).otherwise(0.0)
    out = d.withColumn("weight", T.rounded(weight)).drop("_s", "_c").orderBy(F.desc("weight"), F.desc("updated_at"), "doc_id")
    return out if k is None else out.limit(k)


def merge_actions(actions: DataFrame) -> DataFrame:
    """One row for each action: largest count and priority, longest reason (the first of equals), all subjects; by priority, then count.

    ``actions``: action, priority, count, reason, seq, subjects. The number of actions is small by definition.
    """
    level = S.lookup(F.col("priority"), PRIORITY, 0)
    got = actions.withColumn("_l", level).groupBy("action").agg(
        F.max("_l").alias("_l"), F.max("count").alias("count"), F.max_by("reason", F.struct(F.length("reason"), -F.col("seq"))).alias("reason"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("subjects")))).alias("subjects")
    )
    name = F.coalesce(*(F.when(F.col("_l") == v, k) for k, v in PRIORITY.items()))
    return got.withColumn("priority", name).orderBy(F.desc("_l"), F.desc("count"), "action").drop("_l")


def archive_stale(sources: DataFrame, now_ms: int, days: int = 45) -> DataFrame:
    """New tier and stability of old diary and imported notes, disabled ones included."""
    old = sources.where(F.col("source_kind").isin("diary", "imported") & _stale(days, now_ms))
    return old.select("doc_id", F.lit("cold").alias("memory_tier"), F.when(F.col("source_kind") == "diary", 0.24).otherwise(0.33).alias("stability_score"))


def mark_superseded(sources: DataFrame, ids: DataFrame, *, cool: bool = True) -> DataFrame:
    """New metadata of the given sources."""
    return sources.join(ids, "doc_id", "left_semi").select("doc_id", F.lit("cold" if cool else "working").alias("memory_tier"), F.lit(0.18 if cool else 0.28).alias("stability_score"), F.lit(0.92).alias("distill_confidence"))


def nearest_times(a: Column, b: Column) -> Column:
    """Smallest difference between a time of the one array and a time of the other: a merge of both."""
    sided = lambda x, side: F.transform(x, lambda t: F.struct(t.alias("t"), F.lit(side).alias("side")))
    start = F.struct(F.lit(None).cast("long").alias("least"), F.lit(None).cast("long").alias("t"), F.lit(-1).alias("side"))
    step = lambda s, x: F.struct(F.least(s["least"], F.when((s["side"] >= 0) & (s["side"] != x["side"]), x["t"] - s["t"])).alias("least"), x["t"].alias("t"), x["side"].alias("side"))
    merged = F.aggregate(F.array_sort(F.concat(sided(a, 0), sided(b, 1))), start, step)["least"]
    return F.when((F.size(a) == 1) & (F.size(b) == 1), F.abs(a[0] - b[0])).otherwise(merged)


def consolidation_classes(sources: DataFrame, least: float = 0.44) -> tuple[DataFrame, DataFrame]:
    """(members: doc_id, class_id; classes: class_id, title tokens t, body tokens b, parent, kind, tier, times at) of sources.

    Sources with equal title and body tokens, parent, kind and tier are one class, where such copies score
    ``least`` at any age (else each source is its own); it keeps its distinct times, and two classes score
    by their nearest ones.
    """
    own = ["t", "b", "parent", "source_kind", "memory_tier"]
    s = sources.select("doc_id", F.array_sort(F.array_distinct(T.match_tokens(F.col("title")))).alias("t"), F.array_sort(F.array_distinct(T.match_tokens(F.col("content")))).alias("b"), T.parent_bucket(F.col("path")).alias("parent"), "source_kind", F.coalesce("memory_tier", F.lit("")).alias("memory_tier"), F.col("updated_at").cast("long").alias("updated_at"))
    among = F.when(F.size("t") > 0, 0.36).otherwise(0.0) + F.when(F.size("b") > 0, 0.34).otherwise(0.0) + 0.24
    keyed = s.withColumn("class_key", F.sha2(F.to_json(F.struct(*own, F.when(T.rounded(among) < least, F.col("doc_id")).alias("alone"))), 256))
    classes = keyed.groupBy("class_key").agg(F.min("doc_id").alias("class_id"), F.array_sort(F.collect_set("updated_at")).alias("at"), *(F.first(c).alias(c) for c in own))
    members = keyed.select("doc_id", "class_key").join(classes.select("class_key", "class_id"), "class_key").select("doc_id", "class_id")
    return members, classes


def consolidation_links(sources: DataFrame, least: float = 0.44) -> tuple[DataFrame, DataFrame]:
    """(members: doc_id, class_id; links: a, b, score) of classes that score ``least`` or more; ``least`` above 0.30.

    Beyond 0.30 of other terms a pair needs titles or bodies that overlap by (least - 0.30) / 0.70, so pairs
    are made only where the rarest tokens of either meet. The links grow with the square of the notes:
    ``consolidation_groups`` doesn't make them.
    """
    need = (least - 0.00005 - 0.30) / 0.70  # scores are rounded before they are compared
    if need <= 0:
        raise ValueError("least must be above 0.30")
    own = ["t", "b", "parent", "source_kind", "memory_tier"]
    members, classes = consolidation_classes(sources, least)
    tokens = classes.select("class_id", F.explode(F.array(F.struct(F.lit("t").alias("of"), F.col("t").alias("l")), F.struct(F.lit("b").alias("of"), F.col("b").alias("l")))).alias("x")).select("class_id", "x.of", F.size("x.l").alias("n"), F.explode("x.l").alias("token"))
    rare = tokens.groupBy("of", "token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    sorted_t = tokens.join(rare, ["of", "token"], "left").groupBy("class_id", "of", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "token"))).alias("l"))
    prefix = sorted_t.select("class_id", "of", "n", F.explode(F.slice("l", F.lit(1), (F.col("n") - F.ceil(F.col("n") * need - 1e-9) + 1).cast("int"))).alias("p")).where("p.df > 1").select("class_id", "of", "n", F.col("p.token").alias("token"))
    x, y = prefix.alias("x"), prefix.alias("y")
    meet = (F.col("x.of") == F.col("y.of")) & (F.col("x.token") == F.col("y.token")) & (F.col("x.class_id") < F.col("y.class_id"))
    pairs = x.join(y, meet & (F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * need - 1e-9)).select(F.col("x.class_id").alias("a"), F.col("y.class_id").alias("b")).distinct()
    l, r = (classes.select(F.col("class_id").alias(k), F.struct(*own, "at").alias(f"_{k}")) for k in ("a", "b"))
    both = pairs.join(l, "a").join(r, "b")
    f = lambda side, c: F.col(f"_{side}")[c]
    score = S.consolidation(T.jaccard(f("a", "t"), f("b", "t")), T.jaccard(f("a", "b"), f("b", "b")), f("a", "parent") == f("b", "parent"), f("a", "source_kind") == f("b", "source_kind"), f("a", "memory_tier") == f("b", "memory_tier"), nearest_times(f("a", "at"), f("b", "at")) / S.DAY_MS)
    return members, both.select("a", "b", T.rounded(score).alias("score")).where(F.col("score") >= least)


def consolidation_groups(sources: DataFrame, least: float = 0.44) -> DataFrame:
    """doc_id, group_id, n, group_score: groups of two sources or more; score: mean of the links between classes (null: copies only).

    Every two classes are compared, but links leave a task as spanning links and sums only. ``least`` above 0.30.
    """
    if least - 0.00005 <= 0.30:  # scores are rounded before they are compared
        raise ValueError("least must be above 0.30")
    members, classes = (cut(x) for x in consolidation_classes(sources, least))
    found = cut(linked(classes, least))
    placed_classes = cut(components(found))
    placed = members.join(placed_classes.withColumnRenamed("doc_id", "class_id"), "class_id", "left").select("doc_id", F.coalesce("component", "class_id").alias("group_id"))
    sums = found.where("links > 0").groupBy(F.col("b").alias("doc_id")).agg(F.sum("links").alias("links"), F.sum("total").alias("total"))
    mean = sums.join(placed_classes, "doc_id").groupBy(F.col("component").alias("group_id")).agg((F.expr("(2 * sum(total) + sum(links)) div (2 * sum(links))") / 10**4).alias("group_score"))  # half up, in integers
    size = placed.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return placed.join(size, "group_id").join(mean, "group_id", "left").select("doc_id", "group_id", "n", "group_score")


def validate_plan(plan: DataFrame, asked: DataFrame, sources: DataFrame) -> DataFrame:
    """Plan rows (plan_id, title, decision, disable_inputs) with found, missing and disabled sources, warnings, executable.

    ``asked``: plan_id, doc_id.
    """
    own = asked.distinct().join(sources.select("doc_id", "source_kind", "is_disabled"), "doc_id", "left")
    n = own.groupBy("plan_id").agg(F.count("source_kind").alias("found"), F.count_if(F.col("source_kind").isNull()).alias("missing"), F.count_if("is_disabled").alias("disabled"), F.count_if(F.col("source_kind") != "decision").alias("others"))
    out = plan.join(n, "plan_id", "left").fillna(0, ["found", "missing", "disabled", "others"])
    warn = F.array(
        F.when(F.col("found") < 2, "too few sources"), F.when(F.col("missing") > 0, "missing sources"), F.when(F.col("others") > 0, "not all are decisions"), F.when(F.trim(F.coalesce("title", F.lit(""))) == "", "empty title"),
        F.when(F.trim(F.coalesce("decision", F.lit(""))) == "", "empty decision"), F.when(F.col("disabled") > 0, "disabled sources"), F.when(~F.coalesce("disable_inputs", F.lit(False)), "inputs stay active"),
    )
    return out.withColumn("warnings", F.array_compact(warn)).withColumn("executable", F.size("warnings") == 0)


def resolutions(clusters: DataFrame, least: float = 0.68, k: int = 6) -> DataFrame:
    """Suggested canonical decisions for conflict clusters (subject, docs, pairs, score), best first."""
    plain = F.trim(F.regexp_replace("subject", "[-_/]+", " "))
    title = F.when(plain != "", F.concat(F.lit("Canonical "), plain, F.lit(" decision"))).otherwise("Canonical conflict resolution decision")
    return clusters.where(F.col("score") >= least).select("subject", title.alias("title"), T.rounded(F.col("score") + 0.04).alias("score")).orderBy(F.desc("score"), "subject").limit(k)


def follow_ups(plan: DataFrame, asked: DataFrame, sources: DataFrame, now_ms: int, days: int = 45) -> DataFrame:
    """What to do after a resolution: plan_id, expected, disabled, ready (disabled and old), verified, action.

    ``plan``: plan_id, canonical_id; ``asked``: plan_id, doc_id of what it supersedes. review: there is no
    canonical decision; disable: something superseded is still active; archive: all of it is disabled and
    old; else keep_both.
    """
    s = sources.select("doc_id", "source_kind", "is_disabled", "updated_at")
    own = asked.distinct().join(s, "doc_id").groupBy("plan_id").agg(F.count(F.lit(1)).alias("expected"), F.count_if("is_disabled").alias("disabled"), F.count_if(F.col("is_disabled") & _stale(days, now_ms)).alias("ready"))
    there = s.where("source_kind = 'decision'").select(F.col("doc_id").alias("canonical_id"), F.lit(True).alias("there"))
    out = plan.join(own, "plan_id", "left").join(there, "canonical_id", "left").fillna(0, ["expected", "disabled", "ready"]).fillna(False, ["there"])
    action = F.when(~F.col("there"), "review").when(F.col("expected") > F.col("disabled"), "disable").when((F.col("expected") > 0) & (F.col("ready") == F.col("expected")), "archive").otherwise("keep_both")
    return out.select("plan_id", "expected", "disabled", "ready", (F.col("there") & (F.col("expected") == F.col("disabled"))).alias("verified"), action.alias("action"))
