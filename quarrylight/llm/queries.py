"""The registered queries of the corpus operators: op1 to op10, each over its whole table, and their SQL."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprints, line_dedup, merkle, minhash, neighbours, packing, quality, ranked_search, substring_dedup, suffix_dedup, token_counts, url_filters
from .common import shared_dir, table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    return public_tokenizers.path(TOKENIZER)


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~quality.held_out(F.col("doc_id"))).select("doc_id", "quality"))
    return quality.score_documents(docs, model)


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(table(spark, sf_dir, "pages"), url_filters.CONTRACT + url_filters.WORDS)


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches: all documents; takedown of the toxic ones and a recount in words of the
    low-quality ones; a replay of the second batch, which must change nothing. Texts are counted before
    they meet labels, so only ids and counts are joined."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    totals = token_counts.TokenTotals(spark, f"{shared_dir(spark)}/quarrylight/totals-{uuid.uuid4().hex}")
    totals.apply("documents", token_counts.count_tokens(docs, tokenizer_path(), TOKENIZER.removesuffix(".json")))
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    poor = labels.where("quality = 0").select("doc_id").distinct().join(toxic, "doc_id", "left_anti")
    recount = token_counts.count_words(docs).join(poor, "doc_id", "left_semi")
    for _ in ("first", "replay"):
        totals.apply("takedown", recount, toxic)
    return totals.totals()


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and text: the kept words joined by one space."""
    done = substring_dedup.remove_repeated_words(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"), F.col("kept").alias("text"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and text: the remaining bytes, with U+FFFD where a cut splits a character."""
    done = suffix_dedup.remove_repeated_bytes(table(spark, sf_dir, "documents"))
    text = F.make_valid_utf8(F.col("kept").cast("string")).alias("text")
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), text)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = minhash.near_duplicates(table(spark, sf_dir, "documents"), size=2)
    return done.select("doc_id", "n_shingles", "component_id", "kept")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked_search.build_index(table(spark, sf_dir, "documents"))
    return ranked_search.search(index, table(spark, sf_dir, "benchmark"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.drop_frequent_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.prove_documents(table(spark, sf_dir, "documents"), lower_some=True)


QUERIES = {f.__name__: f for f in (op1_document_fingerprints, op2_quality_classifier, op3_nearest_neighbours, op4_url_filters, op5_bpe_round_trip, op6_token_counts, op7_substring_dedup, op8_packing, op9_suffix_array_dedup, op10_minhash_near_dedup, op11_ranked_search, op12_line_dedup, op13_merkle_manifest)}

_WORDS = "casino|porn|xxx|viagra|malware|phishing|torrent|warez"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ORACLE_SQL = {
    "op4_url_filters": rf"""
WITH cut AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM cut
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host || path, '(^|[^a-z0-9])({_WORDS})($|[^a-z0-9])') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled""",
    "op7_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), starts AS (
  SELECT rid, unnest(range(1, len(ws) - 33)) AS i, ws FROM d WHERE len(ws) >= 35
), win AS (
  SELECT rid, i, array_to_string(ws[i : i + 34], ' ') AS w FROM starts
), hit AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY w) AS c FROM win) WHERE c > 1
), gone AS (
  SELECT DISTINCT rid, unnest(range(i, i + 35)) AS p FROM hit
), dropped AS (
  SELECT rid, list(p) AS ps FROM gone GROUP BY rid
)
SELECT doc_id, n_words, n_removed, sha256(text) AS kept_sha256, text FROM (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
    array_to_string(list_filter(ws, lambda w, k: ps IS NULL OR NOT list_contains(ps, k)), ' ') AS text
  FROM d LEFT JOIN dropped USING (rid)
)""",
    "op11_ranked_search": rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}') AS ts FROM documents
), s AS (
  SELECT count(*) FILTER (WHERE len(ts) > 0) AS n, sum(len(ts))::BIGINT AS l FROM d
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS term FROM benchmark
), t AS (
  SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY rid, term
), w AS (
  SELECT term, floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM t CROSS JOIN s GROUP BY term
), m AS (
  SELECT rid, doc_id, 50 + (50 * len(ts) * n) // l AS m FROM d CROSS JOIN s
), r AS (
  SELECT item_id, rid, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM q JOIN t USING (term) JOIN w USING (term) JOIN m USING (rid) GROUP BY item_id, rid
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank FROM r WHERE score > 0
) WHERE rank <= 50""",
    "op12_line_dedup": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT rid, unnest(range(1, len(ls) + 1)) AS n, unnest(ls) AS line FROM d
), k AS (
  SELECT rid, n, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10
), j AS (
  SELECT rid, count(*) AS n_lines, count(f.key) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE f.key IS NULL), '') AS kept
  FROM k LEFT JOIN f ON k.key = f.key GROUP BY rid
)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM j JOIN d USING (rid)""",
}
