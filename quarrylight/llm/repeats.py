"""Repeated windows of fixed length over a whole corpus (operators 7 and 9 share this frame).

A text is a sequence of units: words or bytes. Windows of ``k`` units that share the smallest hash of
the ``m``-grams in them (the minimiser) travel together as one packed string to the minimiser's bucket:
equal windows have equal minimisers, so no pair is missed.

1. One scan of the texts lists the packed strings by minimiser, name (digest and number of windows) and
   place. This narrow table is spilled to the shared folder.
2. A minimiser that occurs once, and once only in its string, can't hold a repeated window; all other
   packed strings are cut from their texts. Equal strings are counted before they are shuffled (their
   bytes are the key), so a group of copies reaches the buckets as one row for each task.
3. The buckets decide: the operator sorts the windows of a bucket's strings, of which one with copies
   stands there twice, and compares bytes. Digests name strings on the way back; a bucket that meets two
   strings of one name refuses to go on.
4. A bucket with more than ``GROUP_ROWS`` different strings is split by longer anchors: of a window's
   units beside the minimiser, at least half lie on one side, so the minimiser with that half is a longer
   gram that equal windows share. Strings are cut at the change of sides, so each falls into two at most,
   and buckets that are still large are split again, until the anchor is the whole window.
5. The verdicts go back to all places of a string by its name, and each text meets its flags.

The texts are shuffled twice by row key: to the strings wanted from them, and to their flags.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, U, buffers, byte_values, col, drop_spill, keyed, mix, partitions, slices, spill, word_bounds

BYTE = byte_values(3)
#: Different strings that a bucket may hold before it is split.
GROUP_ROWS = 1_000
NAME = ["minimiser", "digest", "windows", "anchor"]
STRINGS = "minimiser long, digest long, windows int, anchor int, packed binary, copies long"
RUNS = "minimiser long, digest long, windows int, anchor int, runs array<struct<first:int,n:int>>"
RUN = pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32())]))


@dataclass(frozen=True)
class Units:
    """Words or bytes, windows of ``window`` units, minimisers of ``gram`` units."""

    words: bool
    window: int
    gram: int

    @property
    def width(self) -> int:
        return self.window - self.gram + 1

    def bounds(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray | None, np.ndarray | None, np.ndarray]:
        """Byte starts and ends of the units (None for bytes), and each text's first unit."""
        return word_bounds(data, off) if self.words else (None, None, off)

    def values(self, data: np.ndarray, start: np.ndarray | None, end: np.ndarray | None) -> np.ndarray:
        if not self.words:
            return BYTE[data]
        return Rolling(BYTE[data]).spans(start, end)

    def hashed(self, packed: bytes) -> np.ndarray:
        """One number for each unit of a packed string."""
        data = np.frombuffer(packed, np.uint8)
        start, end, _ = self.bounds(data, np.array([0, len(packed)]))
        return self.values(data, start, end)

    def split(self, text: bytes) -> list[bytes] | bytes:
        """Something whose slices are runs of units."""
        return text.split() if self.words else text

    def join(self, units: list[bytes] | bytes) -> bytes:
        return b" ".join(units) if self.words else units


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values in a row, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def packed_strings(values: np.ndarray, first: np.ndarray, units: Units) -> dict[str, np.ndarray]:
    """Text, first window, number of windows, minimiser, digest and self-repeat mark of each packed string."""
    n, k, w = len(values), units.window, units.width
    sizes = np.diff(first)
    if n < k or not (sizes >= k).any():
        numbers = {c: np.zeros(0, np.int64) for c in ("text", "start", "windows")}
        return numbers | {c: np.zeros(0, np.uint64) for c in ("minimiser", "digest")} | {"again": np.zeros(0, bool)}
    rolling = Rolling(values)
    grams = rolling.fixed(units.gram)
    least = sliding_min(grams, w)  # of the window that starts at each unit
    valid = np.zeros(n + 1, np.int32)
    long = np.flatnonzero(sizes >= k)
    valid[first[long]] += 1
    valid[first[long] + sizes[long] - k + 1] -= 1
    at = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    values_at = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (values_at[1:] != values_at[:-1])
    opens = np.zeros(n, bool)
    opens[first[long]] = True
    new |= opens[at]
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(at)))
    pieces = -(-length // w)  # a run of one minimiser is cut so that strings stay short
    run = np.repeat(np.arange(len(begin)), pieces)
    turn = np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = at[begin[run]] + turn * w
    windows = np.minimum(w, length[run] - turn * w)
    key = values_at[begin[run]]
    # does the minimiser occur twice in the string? exact below a threshold that most minimisers keep
    limit = U(min(2**64 - 1, 8 * 2**64 // w))
    low = np.flatnonzero(grams < limit)
    a, b = np.searchsorted(low, start), np.searchsorted(low, start + windows - 1 + w)
    size = b - a
    owner = np.repeat(np.arange(len(start)), size)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a, size)
    same = np.bincount(owner[grams[low[place]] == key[owner]], minlength=len(start))
    return {
        "text": np.searchsorted(first, start, side="right") - 1,
        "start": start,
        "windows": windows,
        "minimiser": key,
        "digest": rolling.spans(start, start + windows + k - 1),
        "again": (same > 1) | (key >= limit),
    }


def scan(docs: DataFrame, units: Units) -> DataFrame:
    """minimiser, digest, windows, k1, k2, start (unit of the text), again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            data, off = buffers(col(b, "text"))
            start, end, first = units.bounds(data, off)
            p = packed_strings(units.values(data, start, end), first, units)
            text = pa.array(p["text"].astype(np.int64))
            made = {
                "minimiser": pa.array(p["minimiser"].view(np.int64)),
                "digest": pa.array(p["digest"].view(np.int64)),
                "windows": pa.array(p["windows"].astype(np.int32)),
                "k1": col(b, "k1").take(text),
                "k2": col(b, "k2").take(text),
                "start": pa.array((p["start"] - first[p["text"]]).astype(np.int32)),
                "again": pa.array(p["again"]),
            }
            yield pa.RecordBatch.from_pydict(made)

    schema = "minimiser long, digest long, windows int, k1 long, k2 long, start int, again boolean"
    return keyed(docs).select("k1", "k2", "text").mapInArrow(run, schema)


def cut_strings(texts: DataFrame, wanted: DataFrame, units: Units) -> DataFrame:
    """The wanted strings of the texts; words are joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            found: list[bytes] = []
            for text, places in zip(col(b, "text").to_pylist(), col(b, "starts").to_pylist(), strict=True):
                parts = units.split(text.encode("utf-8"))
                found += [units.join(parts[p["start"] : p["start"] + p["windows"] + units.window - 1]) for p in places]
            flat = col(b, "starts").flatten()
            columns = [flat.field(c) for c in ("minimiser", "digest", "windows")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.binary())], names=["minimiser", "digest", "windows", "packed"])

    # a text and its wanted places meet once for each of its rows: that many copies of each string
    rows = texts.join(wanted.hint("shuffle_hash"), ["k1", "k2"]).select("text", "starts")
    cut = rows.mapInArrow(run, "minimiser long, digest long, windows int, packed binary").withColumn("anchor", F.lit(-1))
    return cut.groupBy(*NAME, "packed").agg(F.count(F.lit(1)).alias("copies"))


# ---------------------------------------------------------------- buckets

#: From groups of different strings and whether they have copies to the runs of repeated windows of each string.
Decide = Callable[[Iterator[tuple[list[bytes], list[bool]]]], Iterator[list[list[tuple[int, int]]]]]


def buckets_of(batches: Iterator[pa.RecordBatch], asked: list) -> Iterator[tuple[list[bytes], list[bool]]]:
    """Groups of rows sorted by minimiser and packed string; ``asked`` gets the names of each string of a group."""
    key: int | None = None
    names: list[list[tuple]] = []
    strings: list[bytes] = []
    copies: list[int] = []
    for b in batches:
        for m, d, w, a, s, c in zip(*(col(b, x).to_pylist() for x in (*NAME, "packed", "copies")), strict=True):
            if m != key:
                if strings:
                    asked.append(names)
                    yield strings, [c > 1 for c in copies]
                key, names, strings, copies = m, [], [], []
            if not strings or strings[-1] != s:
                names.append([])
                strings.append(s)
                copies.append(0)
            if (m, d, w, a) not in names[-1]:
                names[-1].append((m, d, w, a))
            copies[-1] += c
    if strings:
        asked.append(names)
        yield strings, [c > 1 for c in copies]


def judged(strings: DataFrame, decide: Decide) -> DataFrame:
    """Runs of repeated windows by name, of the strings that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: list[list[list[tuple]]] = []
        for runs in decide(buckets_of(batches, asked)):
            names = asked.pop(0)
            every = [name for own in names for name in own]
            if len(set(every)) < len(every):
                raise RuntimeError("two different strings have one name: change the salt of the unit hashes")
            flat = [(name, [{"first": a, "n": c} for a, c in r]) for own, r in zip(names, runs, strict=True) if r for name in own]
            if flat:
                m, d, w, a = zip(*(name for name, _ in flat), strict=True)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                columns = [pa.array(x, t) for x, t in zip((m, d, w, a), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([r for _, r in flat], RUN)], names=[*NAME, "runs"])

    n = partitions(strings.sparkSession)
    return strings.repartition(n, "minimiser").sortWithinPartitions("minimiser", "packed").mapInArrow(run, RUNS)


def halves(begin: int, windows: int, anchor: int, length: int, window: int) -> list[tuple[int, int, int, int]]:
    """(first window, windows, anchor, length) of the two parts that a run of windows falls into.

    The run's windows begin at ``begin`` and all hold the units [anchor, anchor + length). With half of
    the other units, rounded up, on its left or else on its right, the anchor grows.
    """
    if length >= window:
        return [(begin, windows, anchor, length)]
    half = (window - length + 1) // 2
    left = min(max(anchor - half - begin + 1, 0), windows)  # windows with half of the rest before the anchor
    parts = [(begin, left, anchor - half, length + half), (begin + left, windows - left, anchor, length + half)]
    return [p for p in parts if p[1]]


def split_string(packed: bytes, windows: int, anchor: int, length: int, minimiser: int, units: Units) -> list[tuple[int, int, int, int]]:
    """Parts of a string by anchors that grow twice; at first the anchor is a window's first minimiser."""
    if anchor >= 0:
        runs = [(0, windows, anchor, length)]
    else:
        grams = Rolling(units.hashed(packed)).fixed(units.gram)
        at = np.flatnonzero(grams == np.int64(minimiser).view(np.uint64))
        first = at[np.searchsorted(at, np.arange(windows))]
        begin = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
        runs = [(i, n, a, units.gram) for i, n, a in zip(begin.tolist(), np.diff(np.append(begin, windows)).tolist(), first[begin].tolist(), strict=True)]
    for _ in range(2):
        runs = [p for r in runs for p in halves(*r, units.window)]
    return runs


def pieces_of(strings: DataFrame, units: Units, length: int) -> DataFrame:
    """Parts of the strings of large buckets, with the name of the string and the place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "packed"):
            owner, rows = [], []
            for i, (m, w, a, s) in enumerate(zip(*(col(b, c).to_pylist() for c in ("minimiser", "windows", "anchor", "packed")), strict=True)):
                rolling, parts = Rolling(units.hashed(s)), units.split(s)
                found = split_string(s, w, a, length, m, units)
                begin, count, anchor, size = (np.array(x) for x in zip(*found, strict=True))
                key = mix(rolling.spans(anchor, anchor + size) + U(m % 2**64))
                digest = rolling.spans(begin, begin + count + units.window - 1)
                owner += [i] * len(found)
                for j, (x, n, y, _) in enumerate(found):
                    rows.append((int(key[j].view(np.int64)), int(digest[j].view(np.int64)), n, y - x, units.join(parts[x : x + n + units.window - 1]), x))
            at = pa.array(owner, pa.int64())
            own = [col(b, c).take(at) for c in (*NAME, "copies")]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32())
            made = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*own, *made], names=[*("own_" + c for c in NAME), "copies", *NAME, "packed", "first"])

    schema = "own_minimiser long, own_digest long, own_windows int, own_anchor int, copies long, minimiser long, digest long, windows int, anchor int, packed binary, first int"
    return strings.mapInArrow(run, schema)


def resolve(strings: DataFrame, units: Units, decide: Decide, length: int) -> DataFrame:
    """Runs of repeated windows by name; large buckets are split first. ``strings`` is a spilled table."""
    spark = strings.sparkSession
    large = spill(spark, strings.groupBy("minimiser").count().where(F.col("count") > GROUP_ROWS).select("minimiser"))
    if length >= units.window or large.isEmpty():
        return judged(strings, decide)
    pieces = spill(spark, pieces_of(strings.join(large, "minimiser", "left_semi"), units, length))
    parts = spill(spark, pieces.groupBy(*NAME, "packed").agg(F.sum("copies").alias("copies")))
    for _ in range(2):
        length += (units.window - length + 1) // 2
    found = resolve(parts, units, decide, length).select(*NAME, F.explode("runs").alias("run"))
    moved = F.struct((F.col("run.first") + F.col("first")).alias("first"), F.col("run.n").alias("n"))
    own = pieces.select(*(F.col("own_" + c) for c in NAME), *NAME, "first").join(found, NAME)
    back = own.groupBy(*(F.col("own_" + c).alias(c) for c in NAME)).agg(F.collect_set(moved).alias("runs"))
    return judged(strings.join(large, "minimiser", "left_anti"), decide).unionByName(back)


def repeated(docs: DataFrame, units: Units, decide: Decide, more: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The texts, dealt by key (k1, k2), and for each text with repeated windows their runs.

    Returns (texts: doc_id, text, k1, k2 and the columns in ``more``; flags: k1, k2, spans array of
    (first window, windows)). ``decide`` gets the strings of one bucket after another.
    """
    spark = docs.sparkSession
    listed = spill(spark, scan(docs, units))
    texts = keyed(docs, *more).repartition(partitions(spark), "k1", "k2")
    often = listed.groupBy("minimiser").agg(F.count(F.lit(1)).alias("all"), F.max("again").alias("again"))
    # written first, so that a frequent minimiser is a large partition of a plain join, which Spark can split
    shared = spill(spark, often.where("all > 1 or again").select("minimiser"))
    place = F.struct("minimiser", "digest", "windows", "start")
    wanted = listed.join(shared, "minimiser").groupBy("k1", "k2").agg(F.collect_set(place).alias("starts"))
    strings = spill(spark, cut_strings(texts, wanted, units))
    found = spill(spark, resolve(strings, units, decide, units.gram)).drop("anchor")
    drop_spill(spark, strings)
    moved = F.transform("runs", lambda r: F.struct((F.col("start") + r["first"]).alias("first"), r["n"].alias("n")))
    flags = listed.join(found, NAME[:3]).groupBy("k1", "k2").agg(F.flatten(F.collect_set(moved)).alias("spans"))
    return texts, flags


def covered(spans: list[dict] | None, units: int, window: int) -> list[tuple[int, int]]:
    """Maximal runs [a, b) of units that repeated windows cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["first"], s["first"] + s["n"] - 1 + window) for s in spans or ()):
        b = min(b, units)
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, length) of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist(), strict=True))
