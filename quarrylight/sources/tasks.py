"""Tasks, session notes, decisions and observations over the test tables.

The tables' prose has no cue words, so each row gets one of a few fixed cues by its id; all rows and whole texts are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

TASK_CUES = ("fix the crash and trace why it fails", "verify the benchmark", "rename and simplify this", "readme for the policy", "build and ship it", "inspect and analyze", "migrate the payload", "repair the flaky fixture", "nothing much", "write a guide")
NOTE_CUES = ("- decided the policy: prefer the standard default behavior", "Implemented and tested the branch\nTODO next: verified docs later", "* runbook checklist with a gotcha and reusable pattern", "wip scratch maybe", "")
CLAIM_CUES = ("Prefer sqlite for storage", "avoid sqlite here", "canonical conflict-resolution: adopt sqlite", "use parquet/files", "do not use redis", "nothing", "never use parquet/files")


def cue(index: Column, cues: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, cues)), (index % len(cues) + 1).cast("int"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, task (lower-cased), and which anchors the task has."""
    c = table(spark, sf_dir, "conversations")
    at = F.col("conv_id") + F.col("turn")
    return c.select("conv_id", "turn", F.lower(F.concat_ws(" ", "text", cue(at, TASK_CUES))).alias("task"), (at % 2 == 0).alias("has_file"), (at % 3 > 0).alias("has_module"), (at % 5 > 1).alias("has_related"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, session_text (one sentence a line, then a cue), module_name."""
    c = table(spark, sf_dir, "conversations")
    body = F.concat(F.replace("text", F.lit(". "), F.lit(".\n")), F.lit("\n"), cue(F.col("conv_id") + F.col("turn"), NOTE_CUES))
    return c.select("conv_id", "turn", body.alias("session_text"), F.when(F.col("conv_id") % 3 > 0, F.col("role")).alias("module_name"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a decision or note with a claim at its end."""
    d = table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 3 == 0, "decision").otherwise("manual")
    path = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return d.select("doc_id", kind.alias("source_kind"), path.alias("path"), F.substring("text", 1, 30).alias("title"), F.concat_ws("\n", "text", cue(F.col("doc_id"), CLAIM_CUES)).alias("content"), (F.col("n_chars") % 97 / 97.0).alias("score"), (F.col("doc_id") % 50).alias("updated_at"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, at (ms), seq, mark, major, manual, tokens of the events."""
    e = table(spark, sf_dir, "events")
    return e.select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("mark"), (F.col("event_id") % 4 == 0).alias("major"), (F.col("event_id") % 17 == 0).alias("manual"), (F.col("event_id") % 700 + 1).alias("tokens"))
