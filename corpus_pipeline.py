"""Corpus pipeline: quality, near-duplicates, repeated passages, packing (part of the llm subpackage)."""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import minhash, packing, quality, suffix_dedup
from quarrylight.llm.common import col, keyed, prepare, slices, spill, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes of a passage that counts as repeated: below the length of nearly all texts of 50 words (4 bytes a word).
PASSAGE, PASSAGE_GRAM = 200, 48


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier predicts as low quality; the rest stay as they are.

    The classifier is fitted on the labelled documents outside the held-out fifth. A null text counts
    as empty and is judged like any other.
    """
    prepare(spark)
    labels = table(spark, sf_dir, "labels").where(~quality.held_out(F.col("doc_id"))).select("doc_id", "quality")
    model = quality.fit(docs, labels)
    kept = docs.select(*COLUMNS)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield b.filter(pa.array(model.score(quality.statistics(col(b, "text"))) >= quality.THRESHOLD))

    return kept.mapInArrow(run, kinds)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, the one with the smallest doc_id.

    Five-word shingles, similarity 0.8. Of a group's rows with that doc_id, or without any, the one with
    the least text hash stays. Of rows with equal doc_id and text one stays; a document without words is
    in no group and stays.
    """
    prepare(spark)
    own = F.struct("k1", "k2")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "k1", "k2")).alias("first")
    kept = minhash.near_duplicates(docs).groupBy("part", F.when(F.col("part").isNull(), own).alias("alone")).agg(first).select("first.k1", "first.k2")
    rows = keyed(docs.select(*COLUMNS, F.col("text").alias("original")), "original", "lang", "source", "n_chars")
    single = rows.join(kept.hint("shuffle_hash"), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    return single.select("doc_id", F.col("original").alias("text"), "lang", "source", "n_chars")


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes every byte that a repeated string of ``PASSAGE`` bytes covers; a character that a cut splits goes too.

    Documents stay, even if nothing of their text is left; n_chars follows the text. A null text becomes empty.
    """
    prepare(spark)

    def make(b: pa.RecordBatch, spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
        texts = [suffix_dedup.without(t.encode("utf-8"), s).decode("utf-8", "ignore") if s else t for t, s in zip(col(b, "text").to_pylist(), spans, strict=True)]
        return pa.RecordBatch.from_arrays([col(b, "doc_id"), pa.array(texts, pa.string()), col(b, "lang"), col(b, "source"), pa.array([len(t) for t in texts], pa.int64())], names=COLUMNS)

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return suffix_dedup.map_repeated_bytes(docs, make, schema, window=PASSAGE, gram=PASSAGE_GRAM, more=("lang", "source"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 2048 tokens; one row for each piece, with its ids (little-endian uint32)."""
    prepare(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=True)


STAGES = [("quality classifier", quality_classifier), ("minhash near-dedup", near_duplicates), ("suffix-array dedup", suffix_array_dedup), ("packing", pack_sequences)]

#: Random features, near-duplicate groups and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = spill(spark, docs)
    return docs
