"""Context for a task: planned waves over one scan of scored chunks, with early stop.

The scan keeps the best ``k`` chunks of each source kind; every wave's best rows are among them, so all
waves are decided on at most six times ``k`` rows without another pass over the chunks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import graph as G
from . import planner as P

ROW = "doc_id long, source_kind string, title string, content string, path string, score double, updated_at long, tokens long"


@dataclass
class Context:
    """Chosen rows (best first), waves that ran with their stop reasons, suppressed documents, tokens used and rows passed over."""

    stage: str
    intent: str
    rows: list = field(default_factory=list)
    waves: list[tuple[str, str | None, float]] = field(default_factory=list)
    suppressed: list[int] = field(default_factory=list)
    used_tokens: int = 0
    omitted: int = 0


def _order(rows):
    best: dict[int, dict] = {}
    for r in rows:  # the first of equal ids stays
        best.setdefault(r["doc_id"], r)
    return sorted(best.values(), key=lambda r: (-r["score"], -r["updated_at"], r["doc_id"]))


def _merge(known, project, budget, reserve):
    known, project = _order(known), _order(project)
    if not known or not project:
        return _order(known + project)[:budget]
    a = min(len(known), max(1, min(reserve, budget - 1)))
    b = min(len(project), max(1, budget - a))
    seats = _order(known[:a] + project[:b])
    taken = {r["doc_id"] for r in seats}
    return (seats + [r for r in _order(known + project) if r["doc_id"] not in taken])[:budget]


def for_task(scored: DataFrame, task: str, *, edges: DataFrame | None = None, budget: int = 6, reserve: int = 2, tokens: int = 1800, min_score: float = 0.2, boost=None) -> Context:
    """Context of a task from scored chunks (doc_id, source_kind, title, content, path, score, updated_at).

    stable memory, conflict gate, one and two hops over ``edges`` (without a threshold), project chunks, recent notes if still
    needed, and a fallback without threshold if all of that is empty. ``boost`` is an optional column added at
    the end to what was chosen. Ties go to the later chunk, then the smaller id.
    """
    spark = scored.sparkSession
    low = F.lower(F.lit(task))
    plan = spark.range(1).select(P.stage_of(low).alias("stage"), P.intent_of(low, P.stage_of(low)).alias("intent"))
    stage, intent = F.col("stage"), F.col("intent")
    plan = plan.select("*", P.recent_optional(stage, intent).alias("optional"), *(c.alias(n) for n, c in (P.policy(stage, intent, budget, reserve, tokens) | P.wave_budgets(stage, intent, budget)).items())).first()
    full = scored.withColumn("tokens", T.estimate_tokens(F.concat_ws("\n", "title", "path", "content"), 24).cast("long")).withColumn("score", T.rounded(F.col("score")))
    names = [p.split()[0] for p in ROW.split(", ")]
    pool = [r.asDict() for r in P.ranked(full.select(*names), ["source_kind"], budget).collect()]  # six kinds of `budget` rows at most
    out = Context(plan.stage, plan.intent)
    take = lambda kinds, k, least: _order(r for r in pool if r["source_kind"] in kinds and r["score"] >= least)[:k]

    stable = take(P.WAVE_KINDS["stable_memory"], plan.stable_budget, min_score)
    if sum(r["source_kind"] == "decision" for r in stable) > 1:
        gate = P.conflict_gate(spark.createDataFrame([tuple(r[c] for c in names) for r in stable], ROW))
        out.suppressed = sorted(r.doc_id for r in gate.where("suppressed").select("doc_id").distinct().collect())
        stable = [r for r in stable if r["doc_id"] not in out.suppressed]
    project: list[dict] = []
    recent: list[dict] = []
    mesh: list[dict] = []
    if edges is not None and stable:
        decisions = [r["doc_id"] for r in stable if r["source_kind"] == "decision"][:2] or [stable[0]["doc_id"]]
        far = 3 if plan.stable_budget >= 4 and (stable[0]["score"] >= 0.55 or (stable[0]["score"] >= 0.46 and any(r["source_kind"] == "decision" for r in stable))) else 0
        hops = G.two_hops(edges, spark.createDataFrame([(x,) for x in decisions], "doc_id long"), max(2, min(plan.stable_budget, 4)), far)
        found = full.select(*names).join(F.broadcast(hops.select("doc_id", "boost")), "doc_id").where(F.col("source_kind").isin("manual", "decision"))
        gone = {r["doc_id"] for r in stable} | set(out.suppressed)
        mesh = [{**{c: r[c] for c in names}, "score": r["boost"]} for r in found.collect() if r["doc_id"] not in gone]  # seven rows at most

    def stop(wave: str, rows: list[dict]) -> str | None:
        m = {
            "selected": len(rows), "stable": sum(r["source_kind"] in P.WAVE_KINDS["stable_memory"] for r in rows), "project": sum(r["source_kind"] == "project" for r in rows), "recent": len(recent),
            "knowledge_reserve": plan.knowledge_reserve, "project_reserve": plan.project_reserve, "docs": len({r["doc_id"] for r in rows}), "top": rows[0]["score"] if rows else 0.0,
            "mean": sum(r["score"] for r in rows) / max(1, len(rows)), "decisions": len({r["doc_id"] for r in rows if r["source_kind"] == "decision"}),
        }
        got = spark.range(1).select(*(c.alias(n) for n, c in P.stop_test(wave, F.lit(plan.stage), F.lit(budget), {k: F.lit(v) for k, v in m.items()}).items())).first()
        out.waves.append((wave, got.reason, got.final_score))
        return got.reason

    merged = _order(stable + mesh)[:budget]
    if not stop("stable_memory", merged):
        project = take(P.WAVE_KINDS["local_project"], plan.local_budget, min_score)
        merged = _merge(stable + mesh, project, budget, plan.knowledge_reserve)
        if not stop("local_project", merged) and (not plan.optional or len(merged) < budget):
            recent = take(P.WAVE_KINDS["recent_history"], plan.recent_budget, max(0.0, min_score - 0.03))
            merged = _merge(stable + recent, project, budget, plan.knowledge_reserve)
            stop("recent_history", merged)
    if not merged:
        merged = take(P.WAVE_KINDS["fallback"], plan.fallback_budget, 0.0)
        out.waves.append(("fallback", None, 0.0))
    if boost is not None and merged:
        frame = spark.createDataFrame([tuple(r[c] for c in names) for r in merged], ROW)
        merged = _order(r.asDict() for r in frame.withColumn("score", T.rounded(F.col("score") + boost)).collect())
    limit = max(64, plan.token_budget)
    for r in merged[:budget]:
        if not out.rows or out.used_tokens + r["tokens"] <= limit:
            out.rows.append(r)
            out.used_tokens += r["tokens"]
        else:
            out.omitted += 1
    return out


def results(spark, context: Context) -> DataFrame:
    """place, doc_id, source_kind, score, tokens."""
    rows = [(i + 1, r["doc_id"], r["source_kind"], float(r["score"]), int(r["tokens"])) for i, r in enumerate(context.rows)]
    return spark.createDataFrame(rows, "place int, doc_id long, source_kind string, score double, tokens long")
