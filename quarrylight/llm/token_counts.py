"""Delta-maintained token totals (operator 6).

A ``TokenTotals`` store is a folder with one delta table for each batch. A batch turns inserts,
revisions and deletes into signed rows: what a document counted before goes in with a minus, what it
counts now with a plus. Totals by source, language and tokenizer version are the sum of the batches'
small rollups, and never need the documents again. A batch is written under an attempt of its own and
becomes visible by one atomic marker file that names the attempt, so a replayed or half-written batch
changes nothing.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote, unquote
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import library_ids
from .common import col, slices

ROW = "doc_id long, source string, lang string, tokenizer_version string, d_docs long, d_tokens long"
KEYS = ["source", "lang", "tokenizer_version"]


def count_tokens(docs: DataFrame, path: str, version: str) -> DataFrame:
    """doc_id, source, lang, tokenizer_version, n_tokens of every whole text (null: no tokens)."""
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = library_ids(path)
        for b in slices(batches, "text", 2 << 20):
            n = [len(ids) // 4 for ids in source.encode_all(col(b, "text").to_pylist())]
            yield pa.RecordBatch.from_arrays([col(b, "doc_id"), col(b, "source"), col(b, "lang"), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], names=["doc_id", *KEYS, "n_tokens"])

    return kept.mapInArrow(run, "doc_id long, source string, lang string, tokenizer_version string, n_tokens long")


def count_words(docs: DataFrame, version: str = "words") -> DataFrame:
    """The same with the words ``[^\\x20\\x09-\\x0D]+`` as tokens."""
    words = F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(version).alias("tokenizer_version"), F.size(words).cast("long").alias("n_tokens"))


class TokenTotals:
    """Totals kept by signed deltas in ``root``, a folder that driver and executors share.

    A null doc_id counts in the totals but can't be addressed later. Of a doc_id that occurs several
    times in a batch, every row counts, and a later delete or revision takes all of them back. Null
    source or language is a group of its own. Deleting an unknown id does nothing. A batch id is any text but
    the empty one. Batches are meant to come from one writer at a time: a batch that finds another one
    committed while it was made is made anew, but two that commit in the same moment are not told apart.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self) -> dict[str, str]:
        """Committed batches and the attempts that hold their rows."""
        folder = self._path(f"{self.root}/commits")
        if not self._fs.exists(folder):
            return {}
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return {unquote(b): attempt for b, attempt in (n.removeprefix("b-").rsplit("@", 1) for n in names if "@" in n)}

    def _read(self, kind: str) -> DataFrame:
        schema = ROW if kind == "deltas" else ROW.replace("doc_id long, ", "")
        paths = [f"{self.root}/{kind}/{a}" for a in self.batches().values()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def state(self) -> DataFrame:
        """What each document counts now."""
        return self._net(self._read("deltas"))

    @staticmethod
    def _net(deltas: DataFrame) -> DataFrame:
        net = deltas.groupBy("doc_id", *KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))
        return net.where("d_docs <> 0 or d_tokens <> 0")

    def apply(self, batch_id: str, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> bool:
        """Commit a batch of new or revised counts (as from ``count_tokens``) and of doc_ids to delete.

        A doc_id in both is deleted first and then counted anew. Returns False, and does nothing, if
        the batch is committed already.
        """
        if not batch_id:
            raise ValueError("a batch needs an id")
        while True:
            before = self.batches()
            if batch_id in before:
                return False
            attempt = self._write(upserts, deletes, bool(before))
            if self.batches() == before:
                return self._commit(batch_id, attempt)

    def _write(self, upserts: DataFrame | None, deletes: DataFrame | None, known: bool) -> str:
        """Signed rows and rollup of a batch, not yet committed."""
        parts = []
        changed = [x.select("doc_id") for x in (upserts, deletes) if x is not None]
        if changed and known:
            ids = changed[0] if len(changed) == 1 else changed[0].unionByName(changed[1])
            old = self._net(self._read("deltas").join(ids.where("doc_id is not null"), "doc_id", "left_semi"))
            parts.append(old.select("doc_id", *KEYS, (-F.col("d_docs")).alias("d_docs"), (-F.col("d_tokens")).alias("d_tokens")))
        if upserts is not None:
            parts.append(upserts.select("doc_id", *KEYS, F.lit(1).cast("long").alias("d_docs"), F.col("n_tokens").cast("long").alias("d_tokens")))
        attempt = uuid.uuid4().hex
        rows = parts[0] if parts else self.spark.createDataFrame([], ROW)
        for p in parts[1:]:
            rows = rows.unionByName(p)
        rows.write.parquet(f"{self.root}/deltas/{attempt}")
        sums = [F.sum(c).alias(c) for c in ("d_docs", "d_tokens")]
        self.spark.read.schema(ROW).parquet(f"{self.root}/deltas/{attempt}").groupBy(*KEYS).agg(*sums).coalesce(1).write.parquet(f"{self.root}/rollups/{attempt}")
        return attempt

    def _commit(self, batch_id: str, attempt: str) -> bool:
        name = "b-" + quote(batch_id, safe="")  # one file name, whatever the id holds
        claim = self._path(f"{self.root}/claims/{name}")
        if not self._fs.createNewFile(claim) and batch_id in self.batches():
            return False
        return self._fs.createNewFile(self._path(f"{self.root}/commits/{name}@{attempt}"))

    def totals(self) -> DataFrame:
        """n_docs and n_tokens by source, lang and tokenizer_version; groups that are back at zero go."""
        sums = self._read("rollups").groupBy(*KEYS).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")
