"""Checkpoint records, domains and index profiles as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .lineage import cut

CHECKPOINT = "id string, title string, session_goal string, current_status string, working_memory string, next_steps array<string>, blockers array<string>, open_questions array<string>, branch_name string, touched_files array<string>, tags array<string>, created_at long, updated_at long"
LISTS = ("next_steps", "blockers", "open_questions", "touched_files", "tags")
#: Different terms that are broadcast at most.
FEW_TERMS = 100_000
MARKS = ("title", "session_goal", "current_status", "working_memory", "next_steps", "blockers", "touched_files")


def read_checkpoints(records: DataFrame, column: str = "json") -> DataFrame:
    """Checkpoints from JSON; records without id, title, goal or status go, lists are cleaned, missing ones are empty."""
    r = records.select(F.from_json(column, CHECKPOINT).alias("r")).select("r.*")
    needed = [F.coalesce(T.trimmed(F.col(c)), F.lit("")) != "" for c in ("id", "title", "session_goal", "current_status")]
    clean = {c: T.unique_strings(F.coalesce(c, F.array().cast("array<string>"))) for c in LISTS}
    return r.where(needed[0] & needed[1] & needed[2] & needed[3]).withColumns(clean)


def fingerprint() -> Column:
    return F.sha1(F.to_json(F.struct(*MARKS)).cast("binary"))


def checkpoint_id(at_ms: Column, title: Column) -> Column:
    return F.concat_ws("-", F.date_format(F.timestamp_millis(at_ms), "yyyyMMdd'T'HHmmssSSS'Z'"), T.ascii_slug(title, 48))


def resume_prompt(age_hours: Column) -> Column:
    """Labelled lines of a checkpoint; empty parts go."""
    line = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c))
    bars = lambda name, c, sep=" | ": F.when(F.size(c) > 0, F.concat(F.lit(f"{name}: "), F.concat_ws(sep, c)))
    head = F.concat(F.lit("Resume "), T.freshness_label(age_hours), F.lit(" work context: "), F.col("title"))
    return F.concat_ws(
        "\n", head, F.concat(F.lit("Goal: "), "session_goal"), F.concat(F.lit("Status: "), "current_status"), line("Working memory", F.col("working_memory")), bars("Next steps", "next_steps"),
        bars("Blockers", "blockers"), bars("Open questions", "open_questions"), line("Branch", F.col("branch_name")), bars("Touched files", "touched_files", ", "),
    )


def active_checkpoints(history: DataFrame, key: str) -> DataFrame:
    """The latest record of each key."""
    return history.groupBy(key).agg(F.max_by(F.struct(*history.columns), F.struct("updated_at", "id")).alias("r")).select("r.*")


def add_aliases(domains: DataFrame, more: Column) -> DataFrame:
    """Aliases as a set in order, letter case told apart."""
    return domains.withColumn("aliases", F.array_distinct(F.concat("aliases", more)))


def remove_aliases(domains: DataFrame, gone: Column) -> DataFrame:
    """Whatever its letter case."""
    low = F.transform(gone, F.lower)
    return domains.withColumn("aliases", F.filter("aliases", lambda a: ~F.array_contains(low, F.lower(a))))


def resolve_domain(domains: DataFrame, asked: DataFrame) -> DataFrame:
    """The first domain by name of each ``term`` that equals its name, display name or an alias, letter case aside."""
    keys = domains.select("name", F.explode(F.array_distinct(F.transform(F.concat(F.array("name", "display_name"), "aliases"), F.lower))).alias("k"))
    return asked.join(keys, F.lower("term") == F.col("k")).groupBy("term").agg(F.min("name").alias("name"))


def match_terms(texts: DataFrame, terms: DataFrame, key: str, text: str, name: str, term: str, size: int = 3) -> DataFrame:
    """Distinct (``key``, ``name``) of texts that contain a term; null and empty terms match nothing.

    A text that contains a term contains the term's first ``size`` characters, so texts and terms meet
    under that gram (shorter terms under the whole of themselves) and are compared only there. Terms that
    several names share are looked for once; up to ``FEW_TERMS`` different ones are broadcast.
    """
    asked = cut(terms.where(F.coalesce(F.col(term), F.lit("")) != "").groupBy(F.col(term).alias("_t")).agg(F.collect_set(F.struct(name)).alias("_names")).withColumn("_g", F.substring("_t", 1, size)))
    if asked.limit(FEW_TERMS + 1).count() <= FEW_TERMS:  # grams of texts are then probed as they come, not shuffled
        asked = F.broadcast(asked)
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - n + 1)), lambda i: F.substr(F.col(text), i, F.lit(n)))
    every = texts.select(key, text, F.explode(F.array_distinct(F.flatten(F.array(*(grams(n) for n in range(1, size + 1)))))).alias("_g"))
    hits = every.join(asked, "_g").where(F.contains(F.col(text), F.col("_t"))).groupBy(key).agg(F.collect_set("_t").alias("_ts"))
    met = hits.select(key, F.explode("_ts").alias("_t")).join(asked.select("_t", "_names"), "_t")
    return met.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list("_names"))).alias("_all")).select(key, F.explode("_all").alias("_n")).select(key, F.col("_n")[name].alias(name))


def domain_index(domains: DataFrame, files: DataFrame) -> DataFrame:
    """name, section_count, file_count; folders and files that start with an underscore do not count."""
    own = files.where("path rlike '\\\\.md$' and not path rlike '(^|/)_'").groupBy("name").agg(F.count(F.lit(1)).alias("file_count"))
    return domains.select("name", F.size("sections").alias("section_count")).join(own, "name", "left").fillna(0, ["file_count"])


def profile_state(manifests: DataFrame, profile: str) -> DataFrame:
    """total, current, stale, state (empty, ready or rebuild_required) of the manifests against the active profile."""
    n = manifests.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("embedding_profile") == profile).alias("current")).withColumn("stale", F.col("total") - F.col("current"))
    return n.withColumn("state", F.when(F.col("total") == 0, "empty").when(F.col("stale") == 0, "ready").otherwise("rebuild_required"))
