"""Life of an index: rebuild, repair, recovery and what clients may do with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ingest as I
from . import records as R

#: Steps, in order, of each state of an index.
STEPS = {"missing": ("repair_profile_registry", "rebuild_active_profile_index", "index_project"), "rebuild_required": ("rebuild_active_profile_index", "index_project"), "empty": ("index_project",), "ready": ()}
#: What a strategy does by itself; the last one indexes even if nothing asks for it.
STRATEGIES = {"safe": ("repair_profile_registry",), "standard": STEPS["missing"], "aggressive": STEPS["missing"]}
#: Patterns of an error message, the code of the failure, and whether another try may help.
FAILURES = (
    ('^Environment variable [A-Z0-9_]+ is required for embedding profile "[^"]+"\\.', "missing_embedding_api_key", True),
    ('^Embedding profile "[^"]+" is missing model/baseUrl/apiKeyEnv\\.', "invalid_embedding_profile_config", False),
    ('^Unknown embedding profile "[^"]+"\\.', "unknown_embedding_profile", False),
    ("(?i)returned an empty vector", "embedding_provider_empty_vector", True),
    ("(?i)connect|timeout|fetch failed|econnrefused|enotfound|401|403|429", "embedding_provider_request_failed", True),
)
#: Who may reuse notes, and who the index of the active profile if it is ready.
LEVELS = (("same_agent_same_profile", True, True), ("different_agent_same_profile", True, True), ("different_agent_different_profile", True, False))


def rebuild(manifests: DataFrame, documents: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """What a rebuild embeds anew and what it deletes.

    ``embed``: documents (doc_id, path, content) of kinds other than project whose file is there, from the
    file's text, with the time of their last change to order by; ``gone``: doc_ids whose file is missing; ``rescan``:
    project paths, which the project index takes up by itself.
    """
    own = manifests.join(files.select("path", F.col("content").alias("text")), "path", "left")
    notes = own.where("source_kind <> 'project'")
    embed = notes.where("text is not null").join(documents.select("doc_id"), "doc_id", "left_semi").select("doc_id", "path", F.col("text").alias("content"), "updated_at")
    return {"embed": embed, "gone": notes.where("text is null").select("doc_id"), "rescan": own.where("source_kind = 'project'").select("path")}


def rebuilt(tables: dict[str, DataFrame], plan: dict[str, DataFrame], dims: int = 64) -> dict[str, DataFrame]:
    """The tables without what is gone, and the vectors of what was embedded anew (``vectors``)."""
    left = I.cascade_delete(tables, plan["gone"])
    return left | {"vectors": I.hash_embedding(plan["embed"].select("doc_id", "content"), dims, "content").select("doc_id", "embedding")}


def repair(profiles: DataFrame, wanted: DataFrame, today: str) -> DataFrame:
    """Profile descriptors (name, dims, provider, created_at): those that are missing or differ are made again."""
    same = profiles.join(wanted.select("name", "dims", "provider"), ["name", "dims", "provider"], "left_semi").select("name", "dims", "provider", "created_at")
    lost = wanted.join(same.select("name"), "name", "left_anti").select("name", "dims", "provider", F.lit(today).alias("created_at"))
    others = profiles.join(wanted.select("name"), "name", "left_anti").select("name", "dims", "provider", "created_at")
    return same.unionByName(lost).unionByName(others)


def recovery_plan(manifests: DataFrame, profile: str, described: bool = True, strategy: str = "standard") -> DataFrame:
    """state, steps (in order) and auto (which of them the strategy takes) that bring an index back: one row."""
    found = R.profile_state(manifests, profile).withColumn("state", F.when(F.lit(not described), "missing").otherwise(F.col("state")))
    names = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    steps = names(())
    for state, xs in STEPS.items():
        steps = F.when(F.col("state") == state, names(xs)).otherwise(steps)
    if strategy == "aggressive":
        steps = F.array_union(steps, names(("index_project",)))
    return found.select("state", "total", "stale", steps.alias("steps"), names(STRATEGIES[strategy]).alias("auto"))


def failure_code(message: Column) -> Column:
    """Code of an error message: the first pattern that it fits."""
    out = F.when(message.isNull(), "none")
    for pattern, code, _ in FAILURES:
        out = out.when(message.rlike(pattern), code)
    return out.otherwise("unknown_error")


def retryable(code: Column) -> Column:
    return code.isin(*(c for _, c, again in FAILURES if again))


def recover(plan: DataFrame, results: DataFrame, dry_run: bool = False) -> DataFrame:
    """plan_id, step, place, status (planned, executed, failed, skipped) and code of plans' steps (plan_id, steps, auto).

    ``results``: plan_id, step, error of the steps that were tried. What a strategy leaves out is skipped;
    after a failed step the others don't begin. A dry run plans only.
    """
    rows = plan.select("plan_id", "auto", F.posexplode("steps").alias("place", "step")).join(results, ["plan_id", "step"], "left")
    may = F.array_contains("auto", F.col("step"))
    failed = F.min(F.when(may & F.col("error").isNotNull(), F.col("place"))).over(Window.partitionBy("plan_id"))
    out = rows.withColumn("_f", failed).where(F.lit(dry_run) | F.col("_f").isNull() | (F.col("place") <= F.col("_f")))
    status = F.lit("planned") if dry_run else F.when(~may, "skipped").when(F.col("error").isNotNull(), "failed").otherwise("executed")
    code = F.lit("none") if dry_run else F.when(may, failure_code(F.col("error"))).otherwise("none")
    return out.select("plan_id", "step", "place", status.alias("status"), code.alias("code"))


def access_surface(state: DataFrame) -> DataFrame:
    """level, canonical_reuse, index_reuse for each kind of reader; ``state``: one row of ``records.profile_state``."""
    levels = state.sparkSession.createDataFrame(LEVELS, "level string, canonical_reuse boolean, index_reuse boolean")
    return levels.crossJoin(F.broadcast(state.select("state"))).select("level", "canonical_reuse", (F.col("index_reuse") & (F.col("state") == "ready")).alias("index_reuse"))
