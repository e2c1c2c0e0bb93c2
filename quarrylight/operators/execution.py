"""Plans of governance and their execution: recommendations, cleanup, resolutions, follow-ups, consolidation."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import hygiene as H
from . import ingest as I
from . import notes as N

#: Words that name no module.
NO_MODULE = ("prefer", "avoid", "choose", "canonical", "decision", "policy", "do", "not", "use")
NOISY_REASON = "Disabled by a cleanup plan after noisy votes."
MANUAL = " Left for manual review."
ACTION = "action string, priority string, count long, reason string, doc_ids array<long>, subjects array<string>"


def _first(rows: DataFrame, k: int, *by: Column) -> DataFrame:
    """One row: ids of the first ``k`` documents (by ``by``) and the number of all."""
    best = rows.orderBy(*by).limit(k).agg(F.array_sort(F.collect_list(F.struct(F.col("updated_at").alias("at"), "doc_id"))).alias("x"))
    ids = F.transform(F.array_sort("x", lambda a, b: F.when(a["at"] != b["at"], F.when(a["at"] > b["at"], -1).otherwise(1)).otherwise(F.when(a["doc_id"] < b["doc_id"], -1).otherwise(1))), lambda s: s["doc_id"])
    return rows.agg(F.count(F.lit(1)).alias("count")).crossJoin(F.broadcast(best.select(ids.alias("doc_ids"))))


def recommendations(sources: DataFrame, clusters: DataFrame, now_ms: int, *, days: int = 45, k: int = 5) -> DataFrame:
    """What a review finds: stale, noisy and conflicting memories, or one row that all is healthy.

    ``clusters``: the best clusters (subject, doc_ids), a small table. Counts cover all sources; ids are
    the latest ``k``.
    """
    latest = (F.desc("updated_at"), F.col("doc_id"))
    none = F.array().cast("array<string>")
    n = F.col("count").cast("string")
    stale = _first(sources.where(H.is_stale(now_ms, days)), k, *latest).select(F.lit("archive_stale_memories").alias("action"), F.lit("medium").alias("priority"), "count", F.concat(n, F.lit(f" diary or imported memories are older than {days} days.")).alias("reason"), "doc_ids", none.alias("subjects"))
    noisy = _first(sources.where(H.is_noisy()), k, *latest).select(F.lit("disable_noisy_sources").alias("action"), F.when(F.col("count") >= 3, "high").otherwise("medium").alias("priority"), "count", F.concat(n, F.lit(" active memories have more noisy than helpful votes.")).alias("reason"), "doc_ids", none.alias("subjects"))
    of = clusters.agg(F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_list(F.struct("place", "subject", "doc_ids"))).alias("c"))
    torn = of.select(F.lit("review_conflicts").alias("action"), F.lit("high").alias("priority"), "count", F.concat(n, F.lit(" subjects are claimed both ways.")).alias("reason"), F.slice(F.flatten(F.transform("c", lambda x: x["doc_ids"])), 1, max(4, k)).alias("doc_ids"), F.transform("c", lambda x: x["subject"]).alias("subjects"))
    found = stale.unionByName(noisy).unionByName(torn).where(F.col("count") > 0)
    calm = found.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("healthy").alias("action"), F.lit("low").alias("priority"), F.lit(0).cast("long").alias("count"), F.lit("Nothing is stale, noisy or in conflict.").alias("reason"), F.array().cast("array<long>").alias("doc_ids"), none.alias("subjects"))
    return found.unionByName(calm)


def cleanup_plan(reviewed: DataFrame, stale: DataFrame) -> DataFrame:
    """Recommendations and the actions that stale decisions ask for: action, priority, count, reason, doc_ids, subjects.

    ``stale``: the listed decisions (doc_id, action, n, weight, updated_at), a small table.
    """
    rows = stale.where(F.col("action").isin("mark_superseded", "review"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), (-F.col("updated_at")).alias("u"), "doc_id")))
    of = rows.groupBy("action").agg(F.count(F.lit(1)).alias("count"), F.max((F.col("n") > 0).cast("int")).alias("torn"), F.transform(order, lambda x: x["doc_id"]).alias("doc_ids"))
    gone = F.col("action") == "mark_superseded"
    n = F.col("count").cast("string")
    reason = F.when(gone, F.concat(n, F.lit(" old decisions may be superseded."))).otherwise(F.concat(n, F.lit(" old decisions may no longer hold.")))
    more = of.select(F.when(gone, "mark_superseded").otherwise("review_stale_decisions").alias("action"), F.when(gone & (F.col("torn") > 0), "high").otherwise("medium").alias("priority"), "count", reason.alias("reason"), "doc_ids", F.array().cast("array<string>").alias("subjects"))
    return reviewed.unionByName(more)


def apply_cleanup(plan: DataFrame, sources: DataFrame, now_ms: int, *, days: int = 45, allowed: tuple[str, ...] = ("archive_stale_memories", "disable_noisy_sources")) -> dict[str, DataFrame]:
    """Executes what a plan may do by itself: archives stale memories and disables the named noisy ones.

    Returns ``patch`` (doc_id, memory_tier, stability_score), ``disable`` (doc_id, reason; each also a
    noisy vote), ``done`` (action, executed, count, reason) and ``summary``. Other actions, and those that
    are not allowed, are left for a person.
    """
    asked = plan.select("action").distinct()
    may = lambda a: asked.where(F.col("action") == a) if a in allowed else asked.limit(0)
    patch = H.archive_stale(sources, now_ms, days).crossJoin(F.broadcast(may("archive_stale_memories"))).drop("action")
    ids = plan.where(F.col("action") == "disable_noisy_sources").select(F.explode("doc_ids").alias("doc_id")).distinct() if "disable_noisy_sources" in allowed else plan.limit(0).select(F.explode("doc_ids").alias("doc_id"))
    off = sources.where(~F.col("is_disabled")).join(ids, "doc_id", "left_semi").select("doc_id", F.lit(NOISY_REASON).alias("reason"))
    counts = patch.agg(F.count(F.lit(1)).alias("archived")).crossJoin(F.broadcast(off.agg(F.count(F.lit(1)).alias("disabled"))))
    known = plan.crossJoin(F.broadcast(counts))
    executed = F.col("action").isin(*allowed)
    count = F.when(F.col("action") == "archive_stale_memories", F.col("archived")).when(F.col("action") == "disable_noisy_sources", F.col("disabled"))
    reason = F.when(F.col("action") == "healthy", F.col("reason")).when(executed, F.concat_ws(" ", F.lit("Executed for"), count.cast("string"), F.lit("sources."))).otherwise(F.concat("reason", F.lit(MANUAL)))
    done = known.select("action", executed.alias("executed"), F.when(executed, count).otherwise(F.col("count")).alias("count"), reason.alias("reason"))
    both = done.agg(F.count(F.lit(1)).alias("planned"), F.count_if("executed").alias("executed"), F.count_if(~F.col("executed")).alias("skipped"))
    return {"patch": patch, "disable": off, "done": done, "summary": both.crossJoin(F.broadcast(counts))}


# ---------------------------------------------------------------- conflicts


def conflict_pairs(found: DataFrame, k: int = 10, base: float = 0.836, overlap: float = 0.08) -> DataFrame:
    """The ``k`` best pairs (left_id, right_id, subject, score) of decisions that claim a subject both ways.

    ``found``: doc_id, path, polarity, subject. Pairs score more with equal path tails; ties go by ids and
    subject. Of each subject, and of each tail in it, the first ``k`` + 1 documents of a side hold all pairs
    that can be among the best: those of a subject meet across tails, those of a tail in their tail only, so a
    subject that everybody claims makes a bounded number of pairs.
    """
    own = found.withColumn("tail", F.lower(T.path_tail(F.col("path")))).select("doc_id", "subject", "polarity", "tail").distinct()
    alike = F.coalesce(F.col("a.tail") == F.col("b.tail"), F.lit(False))
    pairs = None
    for group, kept in ((["subject"], ~alike), (["subject", "tail"], alike)):
        w = Window.partitionBy(*group, "polarity").orderBy("doc_id")
        few = own.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k + 1)
        a, b = (few.where(F.col("polarity") == p).alias(n) for p, n in (("for", "a"), ("against", "b")))
        met = a.join(b, reduce(and_, (F.col(f"a.{c}") == F.col(f"b.{c}") for c in group)) & (F.col("a.doc_id") != F.col("b.doc_id"))).where(kept)
        score = T.rounded(F.least(F.lit(1.0), F.lit(base) + F.when(alike, overlap).otherwise(0.0)))
        found_here = met.select(F.least("a.doc_id", "b.doc_id").alias("left_id"), F.greatest("a.doc_id", "b.doc_id").alias("right_id"), F.col("a.subject").alias("subject"), score.alias("score"))
        pairs = found_here if pairs is None else pairs.unionByName(found_here)
    return pairs.orderBy(F.desc("score"), "left_id", "right_id", "subject").limit(k)


def best_clusters(clusters: DataFrame, k: int = 8) -> DataFrame:
    """The best clusters in order, with their ``place``: score, documents and pairs descending, then subject."""
    by = (F.desc("score"), F.desc("docs"), F.desc("pairs"), F.col("subject"))
    return clusters.orderBy(*by).limit(k).withColumn("place", F.row_number().over(Window.orderBy(*by)))


def execute_resolutions(plans: DataFrame, asked: DataFrame, sources: DataFrame, root: str, at_ms: int) -> tuple[DataFrame, DataFrame]:
    """(canonical decisions as remembered documents, disabled inputs) of plans (plan_id, title, decision, disable_inputs).

    ``asked``: plan_id, doc_id. A plan without a known source writes nothing. A plan without a title is named by its
    time; plans of one title share a document, and each disables its own inputs.
    """
    known = asked.distinct().join(sources.select("doc_id"), "doc_id")
    n = known.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"))
    tags = F.array(F.lit("conflict-resolution"), F.lit("canonical"))
    impact = F.concat(F.lit("Canonical resolution created from "), F.col("n").cast("string"), F.lit(" conflicting memories."))
    titled = plans.join(n, "plan_id").withColumn("source_kind", F.lit("decision")).withColumn("title", N.note_title(at_ms))
    body = I.decision_note(F.col("title"), F.col("decision"), F.lit(None).cast("string"), impact, tags)
    made = titled.select("plan_id", "title", "n", "disable_inputs", body.alias("content"), tags.alias("tags"), "source_kind")
    docs = N.remember(made, root, at_ms)
    off = known.join(made.where("disable_inputs").select("plan_id", N.note_id(root, at_ms).alias("canonical_id")), "plan_id")
    return docs, off.select("doc_id", F.concat(F.lit("Resolved into canonical decision "), F.col("canonical_id"), F.lit(".")).alias("reason"))


def verify(plans: DataFrame, asked: DataFrame, sources: DataFrame, contents: DataFrame) -> DataFrame:
    """plan_id, exists, is_decision, is_tagged, disabled, expected, verified of canonical documents (plan_id, canonical_id).

    Tagged means that title and text name both canonical marks. ``asked``: plan_id, doc_id of what is superseded.
    """
    blob = F.lower(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))))
    there = sources.select("doc_id", "source_kind", "title").join(contents.select("doc_id", "content"), "doc_id", "left").select(F.col("doc_id").alias("canonical_id"), "source_kind", (F.contains(blob, F.lit("canonical")) & F.contains(blob, F.lit("conflict-resolution"))).alias("is_tagged"))
    own = asked.distinct().join(sources.select("doc_id", "is_disabled"), "doc_id", "left").groupBy("plan_id").agg(F.count(F.lit(1)).alias("expected"), F.count_if("is_disabled").alias("disabled"))
    out = plans.join(there, "canonical_id", "left").join(own, "plan_id", "left").fillna(0, ["expected", "disabled"]).fillna(False, ["is_tagged"])
    kind = F.coalesce(F.col("source_kind") == "decision", F.lit(False))
    return out.select("plan_id", F.col("source_kind").isNotNull().alias("exists"), kind.alias("is_decision"), "is_tagged", "disabled", "expected", (kind & F.col("is_tagged") & (F.col("disabled") >= F.col("expected"))).alias("verified"))


def execute_follow_ups(actions: DataFrame, asked: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(newly disabled, archived patches) of follow-up actions (plan_id, action): ``disable`` and ``archive`` act, the others don't."""
    own = asked.distinct().join(actions, "plan_id").join(sources.select("doc_id", "is_disabled"), "doc_id")
    off = own.where("action = 'disable' and not is_disabled").select("doc_id").distinct()
    cold = own.where("action = 'archive'").select("doc_id").distinct()
    return off, H.mark_superseded(sources, cold)


# ---------------------------------------------------------------- consolidation


def token_mode(titles: DataFrame, key: str = "group_id") -> DataFrame:
    """key, module: the most frequent title token that is no policy word, ties to longer ones, then the first by letters; of 4 characters at least."""
    tokens = titles.select(key, F.explode(T.match_tokens(F.col("title"))).alias("token")).where(~F.col("token").isin(*NO_MODULE))
    n = tokens.groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(key).agg(F.min_by("token", F.struct(-F.col("n"), -F.length("token"), "token")).alias("module"))
    return best.withColumn("module", F.when(F.length("module") >= 4, F.col("module")))


def common_tokens(titles: DataFrame, key: str = "group_id") -> DataFrame:
    """key, tokens: distinct tokens that all titles (doc_id, title, updated_at) of a group have, in the order of its latest one."""
    own = titles.withColumn("tokens", F.array_distinct(T.match_tokens(F.coalesce("title", F.col("doc_id").cast("string")))))
    n = own.groupBy(key).agg(F.count(F.lit(1)).alias("docs"), F.min_by("tokens", F.struct(-F.col("updated_at"), "doc_id")).alias("first"))
    every = own.select(key, F.explode("tokens").alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("docs"))
    shared = every.join(n.select(key, "docs"), [key, "docs"]).groupBy(key).agg(F.collect_list("token").alias("shared"))
    kept = F.filter("first", lambda t: F.array_contains("shared", t))
    return n.join(shared, key, "left").select(key, F.coalesce(kept, F.array().cast("array<string>")).alias("tokens"))


def consolidation_titles(members: DataFrame, key: str = "group_id") -> DataFrame:
    """key, title, kind of groups of documents (doc_id, title, path, source_kind, updated_at)."""
    long = F.slice(F.filter("tokens", lambda t: F.length(t) >= 4), 1, 3)
    parent = members.groupBy(key).agg(F.min_by(T.parent_bucket(F.col("path")), F.struct(-F.col("updated_at"), "doc_id")).alias("parent"), F.max((F.col("source_kind") == "decision").cast("int")).alias("d"))
    title = F.when(F.size(long) > 0, F.concat(F.lit("Consolidated "), F.array_join(long, " "), F.lit(" guidance"))).when(F.coalesce("parent", F.lit(".")) != ".", F.concat(F.lit("Consolidated "), "parent", F.lit(" guidance"))).otherwise("Consolidated related memories")
    return common_tokens(members, key).join(parent, key).select(key, title.alias("title"), F.when(F.col("d") > 0, "decision").otherwise("knowledge").alias("kind"))


def consolidate(members: DataFrame, contents: DataFrame, root: str, at_ms: int, *, points: int = 8, key: str = "group_id") -> DataFrame:
    """One remembered note for each group: its title, what it holds, up to ``points`` first lines and the source titles.

    ``members``: doc_id, title, path, source_kind, updated_at. First lines are those of the latest members;
    an empty text counts with its title.
    """
    first = T.lines(F.coalesce("content", F.lit("")))
    head = F.regexp_replace(F.coalesce(F.try_element_at(first, F.lit(1)), F.col("name")), r"^#+\s*", "")
    own = members.select(key, "doc_id", "title", "updated_at").join(contents.select("doc_id", "content"), "doc_id", "left").withColumn("name", F.coalesce("title", F.col("doc_id").cast("string")))
    w = Window.partitionBy(key).orderBy(F.desc("updated_at"), "doc_id")
    lines = own.withColumns({"point": F.concat_ws(": ", "name", head), "place": F.row_number().over(w)})
    of = lambda c, keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("place", c)))), lambda s: s[c])
    made = lines.groupBy(key).agg(F.count(F.lit(1)).alias("n"), of("point", F.col("place") <= points).alias("points"), of("name", F.lit(True)).alias("names"))
    bullets = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat(F.lit("- "), x)), "\n")
    summary = F.concat(F.lit("This memory consolidates "), F.col("n").cast("string"), F.lit(" related notes into one reusable summary."))
    note = F.concat_ws("\n", F.concat(F.lit("# "), "title"), F.lit(""), F.lit("## Consolidated Knowledge"), summary, F.lit(""), F.lit("## Key Points"), bullets(F.col("points")), F.lit(""), F.lit("## Source Memories"), bullets(F.col("names")))
    decided = I.decision_note(F.col("title"), summary, F.array_join("points", "\n"), F.concat(F.lit("Consolidated from "), F.col("n").cast("string"), F.lit(" memories.")), F.array(F.lit("consolidated")))
    rows = made.join(consolidation_titles(members, key), key)
    is_decision = F.col("kind") == "decision"
    return N.remember(rows.select("title", F.when(is_decision, decided).otherwise(note).alias("content"), F.when(is_decision, "decision").otherwise("manual").alias("source_kind"), F.lit("stable").alias("memory_tier"), F.when(is_decision, 0.95).otherwise(0.88).alias("stability_score")), root, at_ms, each=True)


def governance(sources: DataFrame, clusters: DataFrame, stale: DataFrame, now_ms: int, days: int = 45) -> DataFrame:
    """One row of a governance report: health, conflict clusters and stale decisions by what to do."""
    parts = [
        H.health(sources, now_ms, days),
        clusters.agg(F.count(F.lit(1)).alias("clusters"), F.max("score").alias("worst_conflict")),
        stale.agg(F.count(F.lit(1)).alias("stale_decisions"), F.count_if(F.col("action") == "mark_superseded").alias("to_supersede"), F.count_if(F.col("action") == "review").alias("to_review")),
    ]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)


def link_reasons(title: Column, body: Column, parent: Column, kind: Column, tier: Column) -> Column:
    """Why two sources are linked: similarities from 0.2 and 0.18 on, and what they share."""
    return F.array_compact(F.array(F.when(title >= 0.2, "titles"), F.when(body >= 0.18, "content"), F.when(parent, "folder"), F.when(kind, "kind"), F.when(tier, "tier")))


def group_reasons(links: DataFrame, groups: DataFrame) -> DataFrame:
    """group_id, reasons: distinct reasons of a group's links (a, b, reasons); ``groups``: doc_id, group_id."""
    own = links.join(groups.select(F.col("doc_id").alias("a"), "group_id"), "a").select("group_id", F.explode("reasons").alias("reason")).distinct()
    return own.groupBy("group_id").agg(F.array_sort(F.collect_list("reason")).alias("reasons"))  # five reasons at most
