"""Quality classifier (operator 2): random Fourier features, ridge scores, isotonic calibration.

Each document becomes a row of statistics. Random Fourier features approximate a Gaussian kernel over
the standardised statistics. Tasks sum normal equations by fold; ridge regression is solved on the
driver from those sums, whose size is fixed. Scores of each fold under the model of the other folds are
calibrated by pool-adjacent-violators, so a score is a probability of label 1.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, col, keyed, row_key, slices, word_bounds

#: At most about this many labelled rows are fitted, chosen by a hash of the id; scoring covers all rows.
FIT_ROWS = 20_000
FEATURES, FOLDS, RIDGE, THRESHOLD = 256, 4, 1.0, 0.3
MARKS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "sentence": b".?", "bang": b"!", "comma": b",;:", "symbol": b"#$%&*+<=>@\\^_`|~", "bracket": b"()[]{}\"'/", "line": b"\n", "other": bytes(range(128, 192))}
CLASSES = np.zeros((len(MARKS), 256), np.int64)
for _row, _set in enumerate(MARKS.values()):
    CLASSES[_row, list(_set)] = 1
STATISTICS = [*MARKS, "log_bytes", "log_words", "word_bytes", "distinct_words", "top_word", "repeats", "distinct_lines", "short_words", "shortness"]


def statistics(arr: pa.Array) -> np.ndarray:
    """One row of document statistics for each text; an empty text has zeros."""
    data, off = buffers(arr)
    n = np.diff(off)
    some = np.maximum(n, 1)
    out = np.zeros((len(n), len(STATISTICS)))
    for k in range(len(MARKS)):
        total = np.concatenate([[0], np.cumsum(CLASSES[k][data])])
        out[:, k] = (total[off[1:]] - total[off[:-1]]) / some
    start, end, first = word_bounds(data, off)
    lengths = np.concatenate([[0], np.cumsum(end - start)])
    short = np.concatenate([[0], np.cumsum(end - start <= 2)])
    words = np.diff(first)
    k = len(MARKS)
    out[:, k] = np.log1p(n)
    out[:, k + 1] = np.log1p(words)
    out[:, k + 2] = (lengths[first[1:]] - lengths[first[:-1]]) / np.maximum(words, 1) / 10
    out[:, k + 7] = (short[first[1:]] - short[first[:-1]]) / np.maximum(words, 1)
    out[:, k + 8] = 1 / (1 + words)
    raw = data.tobytes()
    for i in range(len(n)):
        if words[i]:
            text = raw[off[i] : off[i + 1]]
            ws, lines = text.split(), text.split(b"\n")
            counts = Counter(ws)
            out[i, k + 3] = len(counts) / len(ws) ** 0.9
            out[i, k + 4] = max(counts.values()) / len(ws)
            out[i, k + 5] = sum(map(eq, ws, ws[1:])) / len(ws)
            out[i, k + 6] = len(set(lines)) / len(lines)
    return out


@dataclass
class Model:
    """A fitted classifier: a few arrays of fixed size that travel with the task."""

    mean: np.ndarray
    spread: np.ndarray
    waves: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = fourier((stats - self.mean) / self.spread, self.waves, self.shift) @ self.weights
        return np.clip(np.interp(raw, self.knots, self.levels), 0.0, 1.0)


def fourier(x: np.ndarray, waves: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Random Fourier features of a Gaussian kernel, with a constant and the statistics themselves."""
    x = np.clip(x, -8, 8)
    return np.hstack([np.ones((len(x), 1)), x, np.sqrt(2 / waves.shape[1]) * np.cos(x @ waves + shift)])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and levels of the non-decreasing step fit of y on x, by pooling adjacent violators."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum of y, rows, first x, last x
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        pools.append([b, 1, a, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, n, _, last = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += n
            pools[-1][3] = last
    knots = np.array([[p[2], p[3]] for p in pools]).ravel()
    levels = np.repeat([p[0] / p[1] for p in pools], 2)
    return knots, levels


def fold_of(doc_id: int | None, folds: int) -> int:
    return zlib.crc32(b"fold%d" % (doc_id or 0)) % folds


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = FIT_ROWS) -> Model:
    """Fit on documents that have a label.

    ``labels``: doc_id, quality. Labels of a null id, null quality, or of ids that carry both values are
    left out, as are labels without a document. With fewer than two labels or one value only, the score
    is that value everywhere (0.5 without labels). The fit reads at most about ``rows`` labelled rows.
    """
    usable = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("y"), F.max("quality").alias("z")).where("y = z").drop("z")
    total = usable.count()
    if total > rows:
        usable = usable.where((F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 30)) < int(rows / total * (1 << 30))))
    sample = usable.join(keyed(docs).select("doc_id", "text"), "doc_id") if total == 0 else keyed(docs).select("doc_id", "text").join(F.broadcast(usable), "doc_id")
    width = len(STATISTICS)
    rng = np.random.default_rng(11)
    waves, shift = rng.normal(0, 0.35, (width, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            x = statistics(col(b, "text"))
            fold = [fold_of(d, FOLDS) for d in col(b, "doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(fold, pa.int32()), col(b, "y").cast(pa.float64()), pa.array(list(x), pa.list_(pa.float64()))], names=["fold", "y", "x"])

    # the sample is bounded, so its statistics (a few MB) may come to the driver to set the scale and the calibration
    rowset = sample.mapInArrow(stats, "fold int, y double, x array<double>")
    table = rowset.toArrow()
    if table.num_rows == 0 or len(set(table["y"].to_pylist())) < 2:
        level = table["y"][0].as_py() if table.num_rows else 0.5
        zero = np.zeros(1 + width + FEATURES)
        return Model(np.zeros(width), np.ones(width), waves, shift, zero, np.array([0.0, 1.0]), np.array([level, level]))
    x = np.array(table["x"].combine_chunks().flatten().to_numpy()).reshape(-1, width)
    y, fold = table["y"].to_numpy(), table["fold"].to_numpy()
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.ascontiguousarray((x - mean) / spread)

    blocks = docs.sparkSession.createDataFrame(pa.table({"fold": pa.array(fold, pa.int32()), "y": y, "x": pa.array(list(z), pa.list_(pa.float64()))})).coalesce(8)  # no shuffle, whose files might go before the iterator ends

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 + width + FEATURES
        gram, moment = np.zeros((FOLDS, size, size)), np.zeros((FOLDS, size))
        for b in batches:
            p = fourier(np.array(col(b, "x").flatten().to_numpy()).reshape(-1, width), waves, shift)
            t, f = col(b, "y").to_numpy(), col(b, "fold").to_numpy()
            for k in range(FOLDS):
                q = p[f == k]
                gram[k] += q.T @ q
                moment[k] += q.T @ t[f == k]
        yield pa.RecordBatch.from_arrays([pa.array(range(FOLDS), pa.int32()), pa.array([g.tobytes() for g in gram], pa.binary()), pa.array([m.tobytes() for m in moment], pa.binary())], names=["fold", "gram", "moment"])

    size = 1 + width + FEATURES
    gram, moment = np.zeros((FOLDS, size, size)), np.zeros((FOLDS, size))
    for r in blocks.mapInArrow(sums, "fold int, gram binary, moment binary").toLocalIterator():
        gram[r["fold"]] += np.frombuffer(r["gram"]).reshape(size, size)
        moment[r["fold"]] += np.frombuffer(r["moment"])
    p, ridge = fourier(z, waves, shift), RIDGE * np.eye(size)
    ridge[0, 0] = 1e-6
    apart = np.zeros(len(y))
    for k in range(FOLDS):
        apart[fold == k] = p[fold == k] @ np.linalg.solve(gram.sum(0) - gram[k] + ridge, moment.sum(0) - moment[k])
    knots, levels = isotonic(apart, y)
    return Model(mean, spread, waves, shift, np.linalg.solve(gram.sum(0) + ridge, moment.sum(0)), knots, levels)


def score_documents(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out (crc32 of the id mod 5 is 0), score in [0, 1] and predicted for every whole text (null: empty).

    A null id counts as the empty string in held_out. Repeated rows have equal scores.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            s = model.score(statistics(col(b, "text")))
            yield pa.RecordBatch.from_arrays([col(b, "doc_id"), col(b, "held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return keyed(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0
