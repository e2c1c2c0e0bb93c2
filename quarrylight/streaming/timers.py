"""Keyed state with timers and expiry on streams: windows that close by themselves, a cache that forgets, queues that are let go.

The processors run under ``transformWithStateInPandas``; their state lives in the RocksDB store and comes back
from the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ordered import debounce_step

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WINDOWS = "opened long, closed string, seq long, first long, n long, tokens long"


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [p.split()[0] for p in schema.split(", ")]
    return pd.DataFrame(rows, columns=names).astype({n: "int64" for n, kind in zip(names, (p.split()[1] for p in schema.split(", ")), strict=True) if kind == "long"})


class _Row:
    def __init__(self, at: int, tokens: int):
        self.at, self.tokens = at, tokens


class Windows(StatefulProcessor):
    """The windows of ``ordered.debounced_windows``, closed by event time.

    Rows (at in ms, seq, tokens, mark) wait in the state until the watermark has passed them, so rows that come
    out of order, but within the watermark's delay, are taken in order. A window that no further row can join
    closes when the watermark passes its gap or cap. Every item of a closed window gets a row with the ``seq``
    of the first item of its mark: what that one is told holds for all who wait.
    """

    def __init__(self, gap: int, cap: int, items: int, tokens: int):
        self.gap, self.cap, self.items, self.tokens = gap, cap, items, tokens

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, seq long, tokens long, mark string")
        self.window = handle.getValueState("window", "opened long, last long, n long, tokens long")
        self.members = handle.getListState("members", "seq long, mark string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [r for f in rows for r in zip(f["at"].astype(int), f["seq"].astype(int), f["tokens"].astype(int), f["mark"], strict=True)]
        self.waiting.appendList([(int(a), int(s), int(t), m) for a, s, t, m in new])
        self.handle.registerTimer(min(int(r[0]) for r in new))
        yield _frame([], self.schema(key))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(tuple(r) for r in self.waiting.get())
        ready, later = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        state = tuple(self.window.get()) if self.window.exists() else None
        members = [tuple(m) for m in self.members.get()] if self.members.exists() else []
        step, out = debounce_step(self.gap, self.cap, self.items, self.tokens), []
        for at, seq, tokens, mark in ready:
            state, done = step(state, _Row(at, tokens))
            full = done is not None and done[1] == "full"
            if full:
                members.append((seq, mark))
            if done is not None:
                out += self._rows(done, members)
                members = []
            if not full:
                members.append((seq, mark))
        if state is not None and (end := min(state[1] + self.gap, state[0] + self.cap)) <= now:
            out += self._rows((state[0], "cap" if state[0] + self.cap <= state[1] + self.gap else "gap", state[2], state[3]), members)
            state, members = None, []
        elif state is not None:
            self.handle.registerTimer(int(end))
        self._keep(state, members, later)
        yield _frame([(key[0], *r) for r in out], self.schema(key))

    @staticmethod
    def _rows(done: tuple, members: list[tuple]) -> list[tuple]:
        first: dict[str, int] = {}
        return [(done[0], done[1], seq, first.setdefault(mark, seq), done[2], done[3]) for seq, mark in members]

    def _keep(self, state: tuple | None, members: list[tuple], later: list[tuple]) -> None:
        for held, values in ((self.members, members), (self.waiting, later)):
            held.clear()
            if values:
                held.put(values)
        if state is None:
            self.window.clear()
        else:
            self.window.update(tuple(int(x) for x in state))
        if later:
            self.handle.registerTimer(int(later[0][0]))

    def schema(self, key: Any) -> str:
        return f"key {'string' if isinstance(key[0], str) else 'long'}, {WINDOWS}"

    def close(self) -> None:
        return


class Seen(StatefulProcessor):
    """Whether a mark was seen before by its key; what was not seen for ``ttl_ms`` is forgotten."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.marks = handle.getMapState("marks", "mark string", "seq long", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        for f in rows:
            for seq, mark in zip(f["seq"].astype(int), f["mark"], strict=True):
                cached = self.marks.containsKey((mark,))
                self.marks.updateValue((mark,), (int(seq),))
                out.append((key[0], int(seq), mark, cached))
        yield pd.DataFrame(out, columns=["key", "seq", "mark", "cached"])

    def close(self) -> None:
        return


class Idle(StatefulProcessor):
    """Lets a key's queue go when nothing came for ``idle_ms``: one row with the last ``seq`` and the number of items."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getValueState("queue", "seq long, n long, until long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seqs = [int(s) for f in rows for s in f["seq"]]
        n, until = 0, timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
        if self.queue.exists():
            _, n, old = self.queue.get()
            self.handle.deleteTimer(int(old))
        self.queue.update((max(seqs), int(n) + len(seqs), until))
        self.handle.registerTimer(until)
        yield pd.DataFrame({"key": pd.Series([], dtype=object), "seq": pd.Series([], dtype="int64"), "n": pd.Series([], dtype="int64")})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.queue.exists():
            seq, n, _ = self.queue.get()
            self.queue.clear()
            yield pd.DataFrame({"key": [key[0]], "seq": [int(seq)], "n": [int(n)]})

    def close(self) -> None:
        return


def _ready(stream: DataFrame) -> None:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def windows(stream: DataFrame, key: str, *, gap: int = 500, cap: int = 1200, items: int = 48, tokens: int = 5000, late: str = "0 seconds") -> DataFrame:
    """key and ``WINDOWS`` for each item of the closed windows of a stream (``key``, at in ms, seq, tokens, mark)."""
    _ready(stream)
    kind = dict(stream.dtypes)[key]
    kind = "string" if kind == "string" else "long"
    rows = stream.select(F.col(key).cast(kind).alias("key"), F.col("at").cast("long"), F.col("seq").cast("long"), F.col("tokens").cast("long"), "mark", F.timestamp_millis("at").alias("ts"))
    return rows.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(Windows(gap, cap, items, tokens), f"key {kind}, {WINDOWS}", "append", "EventTime")


def seen(stream: DataFrame, key: str, ttl_ms: int) -> DataFrame:
    """key, seq, mark, cached of a stream (``key`` string, seq, mark)."""
    _ready(stream)
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col("seq").cast("long"), "mark")
    return rows.groupBy("key").transformWithStateInPandas(Seen(ttl_ms), "key string, seq long, mark string, cached boolean", "append", "ProcessingTime")


def idle(stream: DataFrame, key: str, idle_ms: int = 120_000) -> DataFrame:
    """key, seq, n of queues that are let go, of a stream (``key`` string, seq)."""
    _ready(stream)
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col("seq").cast("long"))
    return rows.groupBy("key").transformWithStateInPandas(Idle(idle_ms), "key string, seq long, n long", "append", "ProcessingTime")
