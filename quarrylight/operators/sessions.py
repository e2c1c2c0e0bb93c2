"""Session notes: summary, scores of the four kinds, and what would be remembered; columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Cue words of the summary and of the four kinds of note.
KEY_POINT = r"(?i)fixed|added|changed|updated|implemented|decided|refactor|documented|standardized|codified"
FOLLOW_UP = r"(?i)todo|next|follow up|later|remaining|need to|should|plan to"
DECISION = ("decid", "prefer", "choose", "policy", "standard", "rule", "convention", "architecture", "default behavior")
KNOWLEDGE = ("guideline", "runbook", "checklist", "playbook", "pitfall", "gotcha", "reusable", "pattern", "best practice", "tip")
PROGRESS = ("implemented", "added", "changed", "updated", "fixed", "refactor", "wired", "integrat", "tested", "verified")
NOISE = (r"\bwip\b", r"\bscratch\b", r"\btmp\b", r"\bmaybe\b", r"\btrying\b")
TOPICS = ("retrieval", "diagnostics", "context", "indexing", "rerank", "memory", "branch", "docs", "testing", "benchmark", "workflow")
BASE = {"decision": 0.9, "knowledge": 0.8, "diary": 0.46, "discard": 0.12}
PREFIX = {"decision": "Decision:", "knowledge": "Knowledge:", "diary": "Session:"}
EMPTY = "Session summary unavailable."


def summarize(x: Column) -> tuple[Column, Column, Column]:
    """Summary (first four lines), key points and follow-ups (six at most of each)."""
    ls = T.lines(x)
    plain = lambda found: F.slice(F.transform(found, lambda t: F.regexp_replace(t, r"^[-*\s]+", "")), 1, 6)
    head = T.truncate(F.concat_ws(" ", F.slice(ls, 1, 4)), 320)
    points = F.filter(ls, lambda t: t.rlike("^[-*]") | t.rlike(KEY_POINT))
    return F.when(head == "", EMPTY).otherwise(head), plain(points), plain(F.filter(ls, lambda t: t.rlike(FOLLOW_UP)))


def distill(sessions: DataFrame, text: str = "session_text", title: str | None = None, module: str | None = None) -> DataFrame:
    """Adds summary, key_points, follow_ups, the four scores, persist, kind, confidence, tier, stability, suggested_title, tags, reasons.

    A null text counts as empty. Ties between kinds go to the first of decision, knowledge, diary, discard.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    summary, points, ahead = summarize(body)
    df = sessions.withColumns({"summary": summary, "key_points": points, "follow_ups": ahead, "_low": F.lower(body), "_lines": F.size(T.lines(body))})
    df = df.withColumns({f"_{k}": T.count_matches(F.col("_low"), cues) for k, cues in (("d", DECISION), ("k", KNOWLEDGE), ("p", PROGRESS), ("n", NOISE))})
    d, k, p, n, kp, fu = F.col("_d"), F.col("_k"), F.col("_p"), F.col("_n"), F.size("key_points"), F.size("follow_ups")
    has = F.lit(False) if module is None else F.coalesce(F.col(module), F.lit("")) != ""
    given = F.when(has, 0.04).otherwise(0.0)
    yes = lambda test, x: F.when(test, x).otherwise(0.0)
    scores = {
        "decision": 0.22 + d * 0.17 + kp * 0.05 + fu * 0.05 + given,
        "knowledge": 0.18 + k * 0.16 + kp * 0.05 + yes(fu > 0, 0.02) + given,
        "diary": 0.18 + p * 0.1 + fu * 0.08 + kp * 0.04 + F.least(F.lit(0.12), F.col("_lines") / 40),
        "discard": 0.16 + yes(F.col("_lines") <= 2, 0.16) + yes(kp == 0, 0.14) + yes((d == 0) & (p == 0) & (k == 0), 0.18) + n * 0.08,
    }
    df = df.withColumns({f"{s}_score": T.rounded(T.clamp01(x)) for s, x in scores.items()})
    best = F.greatest(*(F.col(f"{s}_score") for s in scores))
    top = F.coalesce(*(F.when(F.col(f"{s}_score") == best, s) for s in scores))
    df = df.withColumns({"confidence": best, "_top": top})
    persist = (F.col("_top") != "discard") & ((F.col("confidence") >= 0.45) | (kp >= 2) | (fu >= 1))
    df = df.withColumn("persist", persist).withColumn("kind", F.when(F.col("persist"), F.col("_top")).otherwise("discard"))
    kind = F.col("kind")
    base, prefix = F.lit(BASE["discard"]), F.lit(PREFIX["diary"])
    for name in ("decision", "knowledge", "diary"):
        base, prefix = F.when(kind == name, BASE[name]).otherwise(base), F.when(kind == name, PREFIX[name]).otherwise(prefix)
    compact = T.trimmed(F.regexp_replace(F.regexp_replace("summary", r"[.#*_`]+", " "), r"\s+", " "))
    made = T.truncate(F.concat_ws(" ", prefix, compact), 80)
    own = F.lit(None).cast("string") if title is None else F.when(T.trimmed(F.col(title)) != "", T.trimmed(F.col(title)))
    named = F.lit(None).cast("string") if module is None else T.ascii_slug(F.col(module))
    tags = F.array(F.when(kind != "discard", kind), named, *(F.when(F.contains(F.col("_low"), F.lit(t)), t) for t in TOPICS))
    why = F.array(F.when(d > 0, "decision language"), F.when(k > 0, "reusable guidance"), F.when(p > 0, "implementation progress"), F.when(fu > 0, "follow-ups"), F.when(kp >= 2, "several concrete points"))
    out = {
        "tier": F.when(kind.isin("decision", "knowledge"), "stable").when(kind == "discard", "cold").otherwise("working"),
        "stability": T.rounded(T.clamp01(base * 0.7 + F.col("confidence") * 0.3)),
        "suggested_title": F.coalesce(own, made),
        "tags": F.slice(F.array_distinct(F.filter(tags, lambda t: t.isNotNull() & (t != ""))), 1, 6),
        "reasons": F.array_compact(why),
    }
    return df.withColumns(out).drop("_low", "_lines", "_d", "_k", "_p", "_n", "_top")


def route(distilled: DataFrame) -> DataFrame:
    """Where a session goes: source_kind, memory_tier and stability of the note it becomes; discarded ones go."""
    kind = F.col("kind")
    kept = F.when(kind == "diary", F.greatest(F.lit(0.4), F.least(F.lit(0.62), F.col("stability")))).when(kind == "knowledge", F.greatest(F.lit(0.76), F.col("stability"))).otherwise(F.col("stability"))
    return distilled.where("persist").withColumns({"source_kind": F.when(kind == "knowledge", "manual").otherwise(kind), "memory_tier": F.col("tier"), "stability_score": kept})
