"""Lines found in many documents (operator 12): levelled sorted runs of line hashes.

A ``LineRuns`` store counts, for each line key, the documents that hold it. Every batch adds one run: a
Parquet table of (hash, documents), bucketed and sorted by the hash. Two runs of one level are merged
into a run of the next level by a full outer merge join, bucket by bucket and without a shuffle. A new
batch is shuffled once by its hashes, merge-joined with each run in turn, and keys that the runs already
know to be frequent are not added again (the anti-join), so hot lines stand in few runs.

A key is named by 128 bits of its BLAKE2b digest. Keys that make up a ``HEAVY``-th of the judged lines
or more, at most ``HEAVY`` of them by counting, are judged once and broadcast; all others go through the
merge joins, so no task gets a hot line's occurrences.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.sources.commits import CommitLog

from .common import col, drop_spill, keyed, partitions, prepare, shared_dir, slices, spill

MIN_DOCS = 10
BATCHES = 4
HEAVY = 10_000
BLANK = b" \t\n\x0b\x0c\r"
HASH = ["h1", "h2"]
LINES = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("line", pa.int32()), ("first", pa.bool_()), ("h1", pa.int64()), ("h2", pa.int64())])


def line_key(line: bytes) -> bytes:
    """The line without blanks at both ends, A-Z lower-cased; bytes of other characters stay."""
    return line.strip(BLANK).lower()


def line_hashes(docs: DataFrame) -> DataFrame:
    """One row for each line whose key isn't empty: row identity k1, k2, its number, whether it is the key's
    first in the row, and the key's hash. ``docs`` as from ``keyed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            row, line, first, digests = [], [], [], []
            for r, text in enumerate(col(b, "text").to_pylist()):
                seen: set[bytes] = set()
                for n, raw in enumerate(text.encode("utf-8").split(b"\n")):
                    if key := line_key(raw):
                        digest = blake2b(key, digest_size=16).digest()
                        row.append(r)
                        line.append(n)
                        first.append(digest not in seen)
                        seen.add(digest)
                        digests.append(digest)
            h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([col(b, "k1").take(at), col(b, "k2").take(at), pa.array(line, pa.int32()), pa.array(first, pa.bool_()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], schema=LINES)

    return docs.select("text", "k1", "k2").mapInArrow(run, "k1 long, k2 long, line int, first boolean, h1 long, h2 long")


class LineRuns:
    """Counts of documents by line hash in ``root``, a folder that driver and executors share.

    Batches may come from several writers: a commit that finds another one in its place is made anew.
    A batch that is committed already changes nothing. Runs that a merge replaced stay until ``vacuum``.
    """

    def __init__(self, spark: SparkSession, root: str, min_docs: int = MIN_DOCS):
        self.spark, self.root, self.min_docs = spark, root.rstrip("/"), min_docs
        self.log = CommitLog(spark, f"{self.root}/log")
        # one file a bucket, sorted: merge joins then need no sort
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")

    def state(self) -> tuple[int, dict]:
        """Number of the last commit; buckets, committed batches and runs by level."""
        version = self.log.latest()
        return version, self.log.read(version) if version >= 0 else {"buckets": partitions(self.spark), "batches": [], "runs": []}

    def add(self, batch: str, lines: DataFrame) -> bool:
        """Add a batch of ``line_hashes``; False, and nothing added, if it is committed already."""
        while True:
            version, state = self.state()
            if batch in state["batches"]:
                return False
            own = lines.where("first").groupBy(*HASH).agg(F.count(F.lit(1)).alias("docs"))
            if state["runs"]:
                own = self._known(own, state).where(F.col("known") < self.min_docs).drop("known")
            run = {"level": 0, "path": self._write(own, state["buckets"])}
            if self.log.append(version + 1, state | {"batches": [*state["batches"], batch], "runs": [*state["runs"], run]}):
                break
        self._compact()
        return True

    def _compact(self) -> None:
        """Merge two runs of one level into one of the next, until each level has one at most."""
        while True:
            version, state = self.state()
            by_level: dict[int, list[dict]] = {}
            for run in state["runs"]:
                by_level.setdefault(run["level"], []).append(run)
            full = next((runs[:2] for _, runs in sorted(by_level.items()) if len(runs) > 1), None)
            if full is None:
                return
            a, b = (self._table(r["path"], state["buckets"]) for r in full)
            both = a.join(b.withColumnRenamed("docs", "more"), HASH, "full_outer")
            docs = F.coalesce(F.col("docs"), F.lit(0)) + F.coalesce(F.col("more"), F.lit(0))
            merged = {"level": full[0]["level"] + 1, "path": self._write(both.select(*HASH, docs.alias("docs")), state["buckets"])}
            rest = [r for r in state["runs"] if r not in full]
            self.log.append(version + 1, state | {"runs": [*rest, merged]})  # lost to another writer: look again

    def _known(self, keys: DataFrame, state: dict) -> DataFrame:
        """``keys`` and ``known``, the documents that the runs count for each; one merge join for each run."""
        out, sums = keys, []
        for n, run in enumerate(state["runs"]):
            out = out.join(self._table(run["path"], state["buckets"]).withColumnRenamed("docs", f"docs_{n}").hint("merge"), HASH, "left")
            sums.append(F.coalesce(F.col(f"docs_{n}"), F.lit(0)))
        known = reduce(lambda x, y: x + y, sums, F.lit(0).cast("long"))
        return out.withColumn("known", known).select(*keys.columns, "known")

    def frequent(self, lines: DataFrame) -> DataFrame:
        """k1, k2 and line of every row of ``lines`` whose key the runs count in ``min_docs`` documents or more.

        ``lines`` is read several times and should be a written table.
        """
        _, state = self.state()
        least = max(1, lines.count() // HEAVY)
        heavy = lines.groupBy(*HASH).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).select(*HASH)
        heavy = spill(self.spark, self._known(heavy, state).select(*HASH, (F.col("known") >= self.min_docs).alias("drop")))
        tagged = lines.join(F.broadcast(heavy), HASH, "left")
        light = self._known(tagged.where("drop is null").select("k1", "k2", "line", *HASH), state).where(F.col("known") >= self.min_docs)
        return light.select("k1", "k2", "line").union(tagged.where("drop").select("k1", "k2", "line"))

    def _write(self, run: DataFrame, buckets: int) -> str:
        path = f"{self.root}/runs/{uuid.uuid4().hex}"
        if partitions(self.spark) != buckets:
            run = run.repartition(buckets, *HASH)
        name = self._name(path)
        run.write.format("parquet").bucketBy(buckets, *HASH).sortBy(*HASH).option("path", path).option("compression", "zstd").saveAsTable(name)
        atexit.register(self._forget, name)
        return path

    @staticmethod
    def _name(path: str) -> str:
        return f"line_run_{path.rsplit('/', 1)[-1]}"

    def _table(self, path: str, buckets: int) -> DataFrame:
        name = self._name(path)
        if not self.spark.catalog.tableExists(name):  # written by another session
            self.spark.sql(f"CREATE TABLE {name} (h1 BIGINT, h2 BIGINT, docs BIGINT) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def _forget(self, name: str) -> None:
        try:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        except Exception:  # the session has ended, and its catalog with it
            return

    def vacuum(self, everything: bool = False) -> None:
        """Delete runs that no merge or batch needs any more; ``everything``: the whole store."""
        if everything:
            return self.log.delete(self.root)
        live = {r["path"] for r in self.state()[1]["runs"]}
        for version in self.log.versions():
            for run in self.log.read(version)["runs"]:
                if run["path"] not in live:
                    self._forget(self._name(run["path"]))
                    self.log.delete(run["path"])


def drop_frequent_lines(docs: DataFrame, *, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """Drop all lines whose key at least ``min_docs`` documents hold: doc_id, n_lines, n_dropped, kept.

    Documents enter the runs in ``batches`` by a hash of their id and are judged when all are in. A null
    or empty text is one empty line; empty keys always stay. Every row is a document, repeated rows
    and rows without id included; further columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = keyed(docs)
    batch = F.pmod(F.xxhash64("k1", "k2"), F.lit(batches))
    lines = spill(spark, line_hashes(rows).withColumn("batch", batch))
    runs = LineRuns(spark, f"{shared_dir(spark)}/quarrylight/lines-{uuid.uuid4().hex}", min_docs)
    atexit.register(_quietly, runs.vacuum, True)
    for b in range(batches):
        runs.add(str(b), lines.where(F.col("batch") == b))
    gone = spill(spark, runs.frequent(lines))
    drop_spill(spark, lines)
    runs.vacuum()
    drops = gone.groupBy("k1", "k2").agg(F.collect_set("line").alias("gone"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(parts, "text"):
            total, dropped, kept = [], [], []
            for text, gone in zip(col(b, "text").to_pylist(), col(b, "gone").to_pylist(), strict=True):
                own = text.split("\n")
                out = set(gone or ())
                total.append(len(own))
                dropped.append(len(out))
                kept.append("\n".join(x for n, x in enumerate(own) if n not in out) if out else text)
            yield pa.RecordBatch.from_arrays([col(b, "doc_id"), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"])

    return rows.join(drops, ["k1", "k2"], "left").select("doc_id", "text", "gone").mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept string")


def _quietly(action, *args) -> None:  # noqa: ANN001
    try:
        action(*args)
    except Exception:  # the session has ended; its folder goes with it
        return
