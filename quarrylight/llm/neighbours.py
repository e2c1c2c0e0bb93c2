"""Approximate nearest neighbours by cross-polytope hashing (operator 3).

A vector, padded to a power of two, goes through fast pseudo-rotations (three rounds of random signs and
a Hadamard transform); its hash is the nearest signed axis. Every vector is posted in the bucket of its
axis in each table. A query probes the buckets of its nearest axes, skipping empty ones, and candidates
are reranked by exact cosine in double precision. Buckets are dealt out in blocks of bounded size, on the
index side and on the query side, so no bucket has to fit into a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, partitions

TABLES, PROBES, BLOCK, QUERY_BLOCK, SEED = 6, 20, 4096, 4096, 29
RESULT = "query_id long, rank int, vec_id long, score double"


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, orthonormal; the width is a power of two."""
    n, width, step = len(x), x.shape[1], 1
    while step < width:
        y = x.reshape(n, -1, 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


def rotate(x: np.ndarray, table: int) -> np.ndarray:
    """The table's pseudo-rotation of the rows."""
    width = 1 << max(0, (x.shape[1] - 1).bit_length())
    rng = np.random.default_rng([SEED, table, width])
    out = np.zeros((len(x), width))
    out[:, : x.shape[1]] = x
    for _ in range(3):
        out = hadamard(out * rng.choice([-1.0, 1.0], width))
    return out


def axes(x: np.ndarray, table: int) -> np.ndarray:
    """Signed axes of each row, nearest first: axis a is +e(a), width + a is -e(a)."""
    r = rotate(x, table)
    return np.argsort(-np.concatenate([r, -r], axis=1), axis=1, kind="stable")


def nearest_axis(x: np.ndarray, table: int) -> np.ndarray:
    r = rotate(x, table)
    a = np.abs(r).argmax(1)
    return np.where(r[np.arange(len(r)), a] >= 0, a, a + r.shape[1])


def bucket(width: int, table: int, axis: np.ndarray) -> np.ndarray:
    """One number for vector length, table and axis."""
    return (np.int64(width) << 32) + (np.int64(table) << 24) + axis


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Vector length, ids and double matrix of the batch's usable vectors.

    Rows are scaled by a power of two to a largest component below one: exact, without effect on a
    cosine, and squares of very large or small components neither overflow nor vanish.
    """
    vectors = col(batch, "embedding")
    if vectors.null_count:
        keep = vectors.is_valid()
        batch = batch.filter(keep)
        vectors = col(batch, "embedding")
    ids, lengths = col(batch, "vec_id").to_numpy(), np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    first = np.concatenate([[0], np.cumsum(lengths)])
    for n in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == n)
        x = flat[first[at][:, None] + np.arange(n)]
        good = np.isfinite(x).all(1) & (np.abs(x).max(1) > 0)
        if good.any():
            x = x[good]
            yield int(n), ids[at][good], np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def search(vectors: DataFrame, *, every: int = 50, k: int = 5, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """The ``k`` nearest rows, by cosine, of each row whose vec_id is divisible by ``every``.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows
    without an id. Only vectors of one length are compared. A query never meets its own id; repeated
    rows of an id count once if equal. Ties go to the smaller id. Every query probes buckets with at
    least ``k + 1`` ids in its first table, so it finds ``k`` rows, or all where there are fewer.
    """
    spark = vectors.sparkSession
    n = partitions(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null")

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[int, int] = {}
        some: dict[int, set[int]] = {}  # up to k + 1 ids of each bucket
        for b in batches:
            for width, ids, x in by_length(b):
                for t in range(tables):
                    at = bucket(width, t, nearest_axis(x, t))
                    for i, n_rows in zip(*(v.tolist() for v in np.unique(at, return_counts=True)), strict=True):
                        count[i] = count.get(i, 0) + n_rows
                        own = some.setdefault(i, set())
                        if len(own) <= k:
                            own.update(np.unique(ids[at == i])[: k + 1 + len(own)].tolist())
                            some[i] = set(sorted(own)[: k + 1])
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.int64()), pa.array(list(count.values()), pa.int64()), pa.array([list(some[i]) for i in count], pa.list_(pa.int64()))], names=["bucket", "n", "some"])

    # at most tables * 2 * width rows for each vector length, whatever the rows
    held_in = rows.mapInArrow(codes, "bucket long, n long, some array<long>").groupBy("bucket").agg(F.sum("n").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("some")))).alias("ids")).collect()
    sizes, distinct = {r["bucket"]: r["n"] for r in held_in}, {r["bucket"]: r["ids"] for r in held_in}
    n_queries = rows.where(F.col("vec_id") % every == 0).count()
    query_blocks = max(1, -(-n_queries // QUERY_BLOCK))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cells(at, blocks, of, ids, x, query):
            spread = np.repeat(np.arange(len(at)), blocks)
            turn = np.arange(len(spread)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            raw = [v.tobytes() for v in x]
            own = of[spread] if not query else turn
            other = turn if not query else of[spread]
            return pa.RecordBatch.from_arrays([pa.array(at[spread]), pa.array(own.astype(np.int64)), pa.array(other.astype(np.int64)), pa.array(np.full(len(spread), query)), pa.array(ids[spread]), pa.array([raw[i] for i in spread], pa.binary())], names=["bucket", "block", "query_block", "is_query", "vec_id", "vector"])

        for b in batches:
            for width, ids, x in by_length(b):
                asked = np.flatnonzero(ids % every == 0)
                deal = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                for t in range(tables):
                    at = bucket(width, t, nearest_axis(x, t))
                    blocks = np.array([-(-sizes[i] // BLOCK) for i in at.tolist()])
                    yield cells(at, np.full(len(at), query_blocks), (deal % blocks).astype(np.int64), ids, x, False)
                    if not len(asked):
                        continue
                    rows_, probed = [], []
                    for q, order in zip(asked.tolist(), bucket(width, t, axes(x[asked], t)).tolist(), strict=True):
                        used = held = 0
                        for i in order:
                            if i in sizes:
                                rows_.append(q)
                                probed.append(i)
                                used, held = used + 1, held + distinct[i]
                                if used >= probes and held > k:
                                    break
                    probed = np.array(probed)
                    yield cells(probed, np.array([-(-sizes[i] // BLOCK) for i in probed.tolist()]), (deal[rows_] % np.uint64(query_blocks)).astype(np.int64), ids[rows_], x[rows_], True)

    def rerank(group: pa.Table) -> pa.Table:
        asked = group["is_query"].to_numpy()
        raw = np.frombuffer(b"".join(group["vector"].to_pylist()), np.float64).reshape(len(asked), -1)
        ids, units = group["vec_id"].to_numpy(), raw / np.linalg.norm(raw, axis=1, keepdims=True)
        out: list[tuple[int, int, float]] = []
        index, own = np.flatnonzero(~asked), np.flatnonzero(asked)
        # equal rows once; among the nearest k * most rows are then k ids, however the rows of an id repeat
        index = np.array(list({(i, v): at for at, i, v in zip(index.tolist(), ids[index].tolist(), group["vector"].filter(pa.array(~asked)).to_pylist(), strict=True)}.values()), np.int64)
        most = int(np.unique(ids[index], return_counts=True)[1].max()) if len(index) else 1
        for at in range(0, len(own) if len(index) else 0, 256):
            block = own[at : at + 256]
            near = units[block] @ units[index].T
            near[ids[block][:, None] == ids[index][None, :]] = -np.inf
            least = np.partition(near, -k * most, axis=1)[:, -k * most] if len(index) > k * most else np.full(len(block), -np.inf)
            i, j = np.nonzero((near >= least[:, None] - 1e-12) & np.isfinite(near))
            a, b = raw[block[i]], raw[index[j]]
            # row by row and in one order of operations, so that equal vectors have equal scores
            score = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
            order = np.lexsort((ids[index[j]], -score, i))
            hit = np.stack([i[order], ids[index[j[order]]], score[order].view(np.int64)])
            order = order[np.concatenate([[True], (hit[:, 1:] != hit[:, :-1]).any(0)])[: len(order)]]
            first = np.searchsorted(i[order], np.arange(len(block)))
            keep = order[np.arange(len(order)) - first[i[order]] < k]
            out += zip(ids[block[i[keep]]].tolist(), ids[index[j[keep]]].tolist(), score[keep].tolist(), strict=True)
        return pa.table({"query_id": pa.array([o[0] for o in out], pa.int64()), "vec_id": pa.array([o[1] for o in out], pa.int64()), "score": pa.array([o[2] for o in out], pa.float64())})

    posted = rows.mapInArrow(post, "bucket long, block long, query_block long, is_query boolean, vec_id long, vector binary")
    found = posted.repartition(n, "bucket", "block", "query_block").groupBy("bucket", "block", "query_block").applyInArrow(rerank, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "hit")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.far")).alias("score"))
