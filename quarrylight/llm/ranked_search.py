"""Ranked lexical search (operator 11): MaxScore over the shards of an inverted index.

``build_index`` turns documents into segments, one row each: the segment's terms, their posting lists
(document ordinal and term frequency) and the documents' lengths, as packed binaries. A segment holds
about ``SEGMENT_BYTES`` of text and needs no shuffle.

A shard is what one task reads, segment by segment, with a list of the best documents for each item. In a
segment a term's upper bound is its weight times its largest impact. Terms are sorted by that bound; those
whose bounds together stay below the item's threshold are non-essential. Essential lists bring the
candidates; non-essential ones are probed, largest bound first, only for candidates that can still
reach the threshold. A sixteenth of the segments (``SEED``) is searched first and gives every other shard
its first thresholds, so that a shard returns only documents that may be in the result.

Items come to the driver in blocks of at most ``BLOCK_TERMS`` terms, and so do their weights and thresholds.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, prepare, slices, spill

TOP = 50
SEED = 16
BLOCK_TERMS = 1_000_000
SEGMENT_BYTES = 16 << 20
SEGMENT = "segment long, n_docs long, n_terms long, doc_ids binary, bare binary, lengths binary, terms binary, starts binary, ords binary, tfs binary"
NAMES = [x.split()[0] for x in SEGMENT.split(", ")]
HITS = "item_id long, doc_id long, score long"
#: Bytes of terms are those of ASCII letters and digits and of all other characters; only A-Z are lower-cased.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8").translate(_FOLD).split()


class _Segment:
    """Postings of the documents of one segment while it is made."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.lengths = array("q")
        self.vocabulary: dict[bytes, int] = {}
        self.terms, self.tfs, self.sizes = array("I"), array("I"), array("I")
        self.bytes = 0

    def add(self, doc_id: int | None, text: str) -> None:
        tokens = terms_of(text)
        counts = Counter(tokens)
        number = self.vocabulary.setdefault
        self.terms.extend([number(t, len(self.vocabulary)) for t in counts])
        self.tfs.extend(counts.values())
        self.sizes.append(len(counts))
        self.ids.append(doc_id)
        self.lengths.append(len(tokens))
        self.bytes += len(text)

    def row(self, name: int) -> pa.RecordBatch:
        terms, tfs = np.frombuffer(self.terms, np.uint32), np.frombuffer(self.tfs, np.uint32)
        ords = np.repeat(np.arange(len(self.ids), dtype=np.uint32), np.frombuffer(self.sizes, np.uint32))
        order = np.argsort(terms, kind="stable")
        starts = np.zeros(len(self.vocabulary) + 1, np.int64)
        np.cumsum(np.bincount(terms, minlength=len(self.vocabulary)), out=starts[1:])
        bare = np.array([d is None for d in self.ids], bool)
        ids = np.array([d or 0 for d in self.ids], np.int64)
        lengths = np.frombuffer(self.lengths, np.int64)
        packed = [ids, bare, lengths, None, starts, ords[order], tfs[order]]
        blobs = [b" ".join(self.vocabulary) if x is None else x.tobytes() for x in packed]
        numbers = [name, int((lengths > 0).sum()), int(lengths.sum())]
        return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in numbers), *(pa.array([x], pa.binary()) for x in blobs)], names=NAMES)


def build_index(docs: DataFrame) -> DataFrame:
    """Segments of all documents, as a written table. A null text has no terms; further columns are not read."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, name = _Segment(), TaskContext.get().partitionId() << 32
        for b in slices(batches, "text"):
            for doc_id, text in zip(col(b, "doc_id").to_pylist(), col(b, "text").to_pylist(), strict=True):
                own.add(doc_id, text or "")
            if own.bytes >= SEGMENT_BYTES:
                yield own.row(name)
                own, name = _Segment(), name + 1
        if own.ids:
            yield own.row(name)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return spill(docs.sparkSession, plain.mapInArrow(run, SEGMENT))


class _Postings:
    """A segment as it is read back."""

    def __init__(self, row: dict):
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.ids, self.bare, self.lengths = read("doc_ids", np.int64), read("bare", bool), read("lengths", np.int64)
        self.starts, self.ords, self.tfs = read("starts", np.int64), read("ords", np.uint32), read("tfs", np.uint32)
        self.where = {t: k for k, t in enumerate(row["terms"].split(b" "))} if row["terms"] else {}

    def size(self, term: bytes) -> int:
        k = self.where.get(term)
        return 0 if k is None else int(self.starts[k + 1] - self.starts[k])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[_Postings]:
    for b in batches:
        for k in range(b.num_rows):
            yield _Postings(b.slice(k, 1).to_pylist()[0])


def penalties(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """m of each document, in whole numbers of any size."""
    return np.array([50 + 50 * x * n // total for x in lengths.tolist()], np.int64)


class Shard:
    """The best documents of each item over the segments seen so far."""

    def __init__(self, items: list[tuple[int | None, list[tuple[int, int]]]], terms: list[bytes], n: int, total: int, seeds: dict[int, int], top: int):
        self.items, self.terms, self.n, self.total, self.top = items, terms, n, total, top
        self.floor = [seeds.get(k, 1) for k in range(len(items))]  # a score above 0 counts
        none = np.zeros(0, np.int64)
        self.best = [(none, none, none.astype(bool)) for _ in items]
        self.postings = self.scored = 0  # of the items' lists: all, and those that were read

    def search(self, segment: _Postings) -> None:
        if not self.total or not len(segment.ids):
            return
        m = penalties(segment.lengths, self.n, self.total)
        lists: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
        for t, term in enumerate(self.terms):
            k = segment.where.get(term)
            if k is not None:
                a, b = segment.starts[k], segment.starts[k + 1]
                ords, tf = segment.ords[a:b].astype(np.int64), segment.tfs[a:b].astype(np.int64)
                impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[ords])
                lists[t] = ords, impact, int(impact.max())
        score = np.zeros(len(segment.ids), np.int64)
        for k, (_, weights) in enumerate(self.items):
            self._item(k, segment, sorted(((w * lists[t][2], w, *lists[t][:2]) for t, w in weights if t in lists), key=lambda x: x[0]), score)

    def _item(self, k: int, segment: _Postings, own: list[tuple[int, int, np.ndarray, np.ndarray]], score: np.ndarray) -> None:
        least = self.floor[k]
        bounds = np.cumsum([x[0] for x in own])
        self.postings += sum(len(x[2]) for x in own)
        essential = int(np.searchsorted(bounds, least))  # all before it together stay below the threshold
        if essential == len(own):
            return
        for _, w, ords, impact in own[essential:]:
            score[ords] += w * impact
            self.scored += len(ords)
        found = np.flatnonzero(score)
        for j in range(essential - 1, -1, -1):
            found = found[score[found] + bounds[j] >= least]
            if not len(found):
                break
            _, w, ords, impact = own[j]
            at = np.searchsorted(ords, found)
            hit = at < len(ords)
            hit[hit] = ords[at[hit]] == found[hit]
            score[found[hit]] += w * impact[at[hit]]
            self.scored += len(found)
        found = found[score[found] >= least]
        if len(found):
            self._keep(k, score[found], segment.ids[found], segment.bare[found])
        for _, _, ords, _ in own:
            score[ords] = 0

    def _keep(self, k: int, scores: np.ndarray, ids: np.ndarray, bare: np.ndarray) -> None:
        scores, ids, bare = (np.concatenate(x) for x in zip(self.best[k], (scores, ids, bare), strict=True))
        if len(scores) > self.top:
            some = scores >= np.partition(scores, -self.top)[-self.top]
            scores, ids, bare = scores[some], ids[some], bare[some]
        order = np.lexsort((ids, ~bare, -scores))[: self.top]
        self.best[k] = scores[order], ids[order], bare[order]
        if len(order) == self.top:
            self.floor[k] = max(self.floor[k], int(scores[order[-1]]))

    def rows(self) -> pa.RecordBatch:
        names = [self.items[k][0] for k, b in enumerate(self.best) for _ in b[0]]
        scores, ids, bare = (np.concatenate(x) for x in zip(*self.best, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(ids, pa.int64(), mask=bare), pa.array(scores, pa.int64())], names=["item_id", "doc_id", "score"])


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and its distinct terms; texts of one item_id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            found = [(i, t) for i, text in zip(col(b, "item_id").to_pylist(), col(b, "text").to_pylist(), strict=True) for t in set(terms_of(text or ""))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())], names=["item_id", "term"])

    plain = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "item_id long, term binary").groupBy("item_id").agg(F.collect_set("term").alias("terms"))


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Items with their terms, so many at a time that a block has ``BLOCK_TERMS`` terms, or one item."""
    block, size = [], 0
    for row in items.toLocalIterator():
        if block and size + len(row.terms) > BLOCK_TERMS:
            yield block
            block, size = [], 0
        block.append((row.item_id, sorted(map(bytes, row.terms))))
        size += len(row.terms)
    if block:
        yield block


def search(index: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` documents of each item with a score above 0: item_id, rank, doc_id, score.

    Scores are the contract's whole numbers. Equal scores rank by ascending doc_id, a null id first;
    repeated rows rank each. An item without terms, or whose terms no document holds, has no rows.
    """
    spark = index.sparkSession
    n, total = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    out = spark.createDataFrame([], HITS)
    # a written table: an iterator over a shuffle would outlive the shuffle's files
    for block in _blocks(spill(spark, item_terms(items))):
        terms = sorted({t for _, own in block for t in own})
        out = out.unionByName(_search_block(index, block, terms, n or 0, total or 0, top))
    return _ranked(out, top)


def _ranked(hits: DataFrame, top: int) -> DataFrame:
    by_item = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return hits.withColumn("rank", F.row_number().over(by_item)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def _search_block(index: DataFrame, block: list[tuple[int | None, list[bytes]]], terms: list[bytes], n: int, total: int, top: int) -> DataFrame:
    spark = index.sparkSession
    wanted = spark.sparkContext.broadcast(terms)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(wanted.value), np.int64)
        for segment in _segments(batches):
            df += np.fromiter(map(segment.size, wanted.value), np.int64, len(df))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at])], names=["term", "df"])

    counted = index.select("terms", "starts", *(F.lit(b"").alias(c) for c in ("doc_ids", "bare", "lengths", "ords", "tfs"))).mapInArrow(sizes, "term long, df long")
    df = dict(counted.groupBy("term").agg(F.sum("df")).collect())  # a row for each of the block's terms at most
    weight = {terms[t]: (t, math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1)))) for t, d in df.items()}
    plan = spark.sparkContext.broadcast([(i, [weight[t] for t in own if t in weight]) for i, own in block])

    def shards(part: DataFrame, seeds: dict[int, int]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Shard(plan.value, wanted.value, n, total, seeds, top)
            for segment in _segments(batches):
                own.search(segment)
            yield own.rows()

        return part.mapInArrow(run, HITS)

    first = F.pmod(F.xxhash64("segment"), F.lit(SEED)) == 0
    best = spill(spark, _ranked(shards(index.where(first), {}), top))
    worst = {r.item_id: r.score for r in best.where(F.col("rank") == top).collect()}
    seeds = {k: worst[i] for k, (i, _) in enumerate(block) if i in worst}
    return best.select("item_id", "doc_id", "score").unionByName(shards(index.where(~first), seeds))
