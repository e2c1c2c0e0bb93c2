"""Score terms of hybrid recall."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clamp01

DAY_MS = 86_400_000
#: Weights and priorities of the default retrieval configuration.
WEIGHTS = {"vector": 0.6, "lexical": 0.3, "priority": 0.1, "freshness": 0.08, "tier": 0.08, "stability": 0.06, "feedback": 0.12, "relation": 0.08}
PRIORITY = {"manual": 1.0, "decision": 0.95, "diary": 0.85, "log": 0.8, "project": 0.75, "imported": 0.7}
TIER = {"stable": 1.0, "working": 0.55, "project": 0.4, "cold": 0.12}


def lookup(x: Column, table: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(x == k, v).otherwise(out)
    return out


def age_days(at_ms: Column, now_ms: int) -> Column:
    return F.greatest(F.lit(0.0), (F.lit(now_ms) - at_ms) / DAY_MS)


def freshness(at_ms: Column, now_ms: int) -> Column:
    return F.exp(-age_days(at_ms, now_ms) / 45)


def feedback(helpful: Column, noisy: Column, last_ms: Column, updated_ms: Column, now_ms: int) -> Column:
    """Votes with recency and staleness weights, a third of their balance clamped to one, weighted."""
    recent = F.when(last_ms.isNull(), 0.0).otherwise(F.exp(-age_days(last_ms, now_ms) / 45))
    stale = 1 - F.exp(-age_days(updated_ms, now_ms) / 90)
    balance = helpful * 0.75 * (0.6 + 0.6 * recent) - noisy * 1.1 * (0.65 + 0.35 * recent + 0.45 * stale)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), balance / 3)) * WEIGHTS["feedback"]


def branch(own: Column, asked: str | None) -> Column:
    """Exact match, sibling by first or last segment, or penalty."""
    if not asked:
        return F.lit(0.0)
    parts, mine = F.split(own, "/"), asked.split("/")
    sibling = (parts[0] == mine[0]) | (F.element_at(parts, -1) == mine[-1])
    return F.when(own.isNull(), 0.0).when(own == asked, 0.03).when(sibling, 0.015).otherwise(-0.02)


def consolidation(title: Column, body: Column, parent: Column, kind: Column, tier: Column, days: Column) -> Column:
    near = F.greatest(F.lit(0.0), 1 - days / 90)
    return title * 0.36 + body * 0.34 + F.when(parent, 0.12).otherwise(0.0) + F.when(kind, 0.08).otherwise(0.0) + F.when(tier, 0.04).otherwise(0.0) + near * 0.06


def stop_score(covered: Column, confidence: Column, redundancy: Column, conflict: Column) -> Column:
    return clamp01(0.5 * covered + 0.35 * confidence + 0.1 * (1 - redundancy) + 0.05 * (1 - conflict))
