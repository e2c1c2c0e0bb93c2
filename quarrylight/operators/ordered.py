"""Operators whose every step depends on the one before: bounded state for each key, rows streamed in order.

A key's rows are sorted by Spark and pass through Python one batch at a time; nothing but the state is kept.
The same step functions run on streams.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Step = Callable[[Any, Any], tuple[Any, tuple | None]]


def fold(rows: DataFrame, keys: list[str], order: list[str], step: Step, schema: str, last: Callable[[Any], tuple | None] | None = None) -> DataFrame:
    """Rows of each key in order through ``step(state, row) -> (state, values or None)``; ``last(state)`` closes a key.

    The state starts as None. Output rows are the key's values and those of the step. Null keys are one key. A
    key is one task's: each step needs the state before it.
    """
    target = to_arrow_schema(StructType.fromDDL(schema))

    def emit(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [()] * len(target)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        state = None
        for batch in batches:
            row_of = namedtuple("row_of", batch.schema.names)
            own = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
            out = []
            for now, values in zip(zip(*own, strict=True), zip(*(c.to_pylist() for c in batch.columns), strict=True), strict=True):
                if now != key:  # null equals null
                    if key is not None and last and (done := last(state)) is not None:
                        out.append((*key, *done))
                    key, state = now, None
                state, made = step(state, row_of(*values))
                if made is not None:
                    out.append((*key, *made))
            yield emit(out)
        if key is not None and last and (done := last(state)) is not None:
            yield emit([(*key, *done)])

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def debounce_step(gap: int, cap: int, items: int, tokens: int) -> Step:
    """Windows that close after a gap, a cap from their first row, or when full; rows have ``at`` and ``tokens``.

    Yields (opened, closed by, rows, tokens) of the window that a row ends; a full one ends with its own row.
    """

    def step(state, row):
        at, t = int(row.at), int(row.tokens)
        done = None
        if state is not None:
            first, prev, n, used = state
            if min(prev + gap, first + cap) <= at:
                done = (first, "cap" if first + cap <= prev + gap else "gap", n, used)
                state = None
        first, _, n, used = state or (at, at, 0, 0)
        state = (first, at, n + 1, used + t)
        if done is None and (state[2] >= items or state[3] >= tokens):
            return None, (first, "full", state[2], state[3])
        return state, done

    return step


def debounce_last(state):
    return None if state is None else (state[0], "end", state[2], state[3])


def debounced_windows(events: DataFrame, key: str, *, gap: int = 500, cap: int = 1200, items: int = 48, tokens: int = 5000) -> DataFrame:
    """Windows of ``events`` (key, at, tokens, seq to break ties), all times in one unit."""
    return fold(events, [key], ["at", "seq"], debounce_step(gap, cap, items, tokens), f"{key} long, opened long, closed string, n long, tokens long", debounce_last)


#: Milliseconds between drafts, between promotions, and of grace for a checkpoint set by hand.
DRAFT_MS, PROMOTE_MS, MANUAL_MS = 20_000, 90_000, 1_800_000


def checkpoint_step(state, row):
    """What an observation (``at``, ``mark``: fingerprint, ``major``, ``manual``) does to the draft and the active checkpoint.

    A draft is written if there is none, its mark differs or 20 s are over. The active one is replaced if there is none, or if
    the mark differs and 90 s are over or the shift is major; one set by hand stays for 30 minutes. An
    observation marked manual sets the active checkpoint itself.
    """
    draft, active = state or (None, None)
    at, mark = int(row.at), row.mark
    if row.manual:
        return (draft, (mark, at, True)), (at, False, True)
    wrote = draft is None or draft[0] != mark or at - draft[1] >= DRAFT_MS
    if wrote:
        draft = (mark, at)
    if active is None:
        promoted = True
    elif active[0] == mark or (active[2] and at - active[1] < MANUAL_MS):
        promoted = False
    else:
        promoted = at - active[1] >= PROMOTE_MS or bool(row.major)
    if promoted:
        active = (mark, at, False)
    return (draft, active), (at, wrote, promoted)


def auto_checkpoints(observations: DataFrame, key: str) -> DataFrame:
    return fold(observations, [key], ["at", "seq"], checkpoint_step, f"{key} long, at long, drafted boolean, promoted boolean")


def batch_step(items: int = 64, tokens: int = 6000) -> Step:
    """Number of the batch that a text joins: a new one if the current is full by items or would be by tokens."""

    def step(state, row):
        batch, n, used = state or (0, 0, 0)
        t = int(row.tokens)
        if n >= items or (n and used + t > tokens):
            batch, n, used = batch + 1, 0, 0
        return (batch, n + 1, used + t), (int(row.seq), batch)

    return step


def request_batches(texts: DataFrame, key: str, *, items: int = 64, tokens: int = 6000) -> DataFrame:
    """Batches of each flush ``key`` in order of ``seq``: key, seq, batch."""
    return fold(texts, [key], ["seq"], batch_step(items, tokens), f"{key} long, seq long, batch long")


def on_stream(rows: DataFrame, keys: list[str], order: list[str], step: Step, schema: str, state: str) -> DataFrame:
    """The same steps on a stream: the state (columns ``state``) is kept by key between batches.

    Rows of one batch are stepped through in ``order``; batches follow each other as they arrive, so a row
    that comes later than its time is taken where it arrives. Windows stay open until a row closes them.
    """
    names = [p.strip().split()[0] for p in schema.split(",")]

    def run(key, frames, held):
        kept = tuple(held.get) if held.exists else None
        out = []
        for row in pd.concat(list(frames)).sort_values(order).itertuples(index=False):
            kept, values = step(kept, row)
            if values is not None:
                out.append((*key, *values))
        if kept is None:
            held.remove()
        else:
            held.update(tuple(kept))
        yield pd.DataFrame(out, columns=names)

    return rows.groupBy(*keys).applyInPandasWithState(run, schema, state, "append", "NoTimeout")
