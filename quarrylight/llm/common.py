"""Shared plumbing of the corpus operators: Arrow views, spill tables, hashing.

Every operator keeps to three rules: text reaches Python only as Arrow batches that are cut into
slices of a few MB (``slices``), state between jobs is a Parquet table in the shared folder
(``spill``), and a row is identified by ``(doc_id, hash of its text)`` so that repeated rows and
null ids stay apart from other documents.
"""

from __future__ import annotations

import atexit
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
U = np.uint64
MIX1, MIX2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_POWERS: list[np.ndarray] = []


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver found it, and keep their batches small."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    known = [*os.environ.get("PYTHONPATH", "").split(":"), *env.get("PYTHONPATH", "").split(":")]
    if root not in known:
        env["PYTHONPATH"] = ":".join(x for x in (env.get("PYTHONPATH", ""), root) if x)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    # shuffle files go when their query ends: what later steps need is in written tables
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    if spark.conf.get(rows) == "10000":  # Spark's default; texts make such batches large
        spark.conf.set(rows, "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


# ---------------------------------------------------------------- shared folder


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors see: spark.checkpoint.dir, or one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarrylight-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; its folder goes with it
        return


def drop_spill(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete spilled tables that nothing reads any more."""
    for f in frames:
        if path := getattr(f, "_spill_path", None):
            _delete(spark, path)


def spill(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and survives lost executors."""
    path = f"{shared_dir(spark)}/quarrylight/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_delete, spark, path)
    gc.collect()  # finished jobs' shuffle files go once nothing on the driver holds their plans
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._spill_path = path
    return out


# ---------------------------------------------------------------- rows and Arrow


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the row identity k1, k2; other columns go."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *more).select(
        "doc_id", "text", *more, row_key(F.col("doc_id")).alias("k1"), F.xxhash64("text").alias("k2")
    )


def row_key(doc_id: Column) -> Column:
    return F.coalesce(doc_id, F.lit(-(2**63)).cast("long"))


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array, joined, and the rows' offsets in them (null: empty)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    large = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offsets, data = arr.buffers()
    if offsets is None or len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], name: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that column ``name`` holds about ``limit`` bytes in each, one row at least."""
    for batch in batches:
        _, off = buffers(batch.column(batch.schema.get_field_index(name)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def col(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


# ---------------------------------------------------------------- vector hashing


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64."""
    x = x ^ (x >> U(30))
    x *= MIX1
    x ^= x >> U(27)
    x *= MIX2
    x ^= x >> U(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n; the arrays are kept and grown."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        inverse = pow(BASE, -1, 2**64)
        _POWERS[:] = [np.cumprod(np.concatenate([[U(1)], np.full(size - 1, U(b), np.uint64)])) for b in (BASE, inverse)]
    return _POWERS[0][:n], _POWERS[1][:n]


class Rolling:
    """Hashes of any span of a uint64 sequence from prefix sums, position independent."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def fixed(self, k: int) -> np.ndarray:
        """Of every k values in a row."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:-k]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def byte_values(salt: int) -> np.ndarray:
    """A fixed random odd uint64 for each byte value."""
    return mix(np.arange(256, dtype=np.uint64) * U(0xD1342543DE82EF95) + U(salt)) | U(1)


SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and each text's first word: words never cross texts."""
    full = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before = np.concatenate([[False], full[:-1]]) if len(full) else full
    after = np.concatenate([full[1:], [False]]) if len(full) else full
    start = np.flatnonzero(full & (~before | edge[:-1]))
    end = np.flatnonzero(full & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, off)
