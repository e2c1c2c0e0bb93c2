"""A ledger of requests to remote models: what was answered once is never asked again.

``ask`` sends the requests that the ledger doesn't know and returns a plan that only reads answers, so a plan
that is read twice, or computed anew after an executor is lost, asks nothing. A task stores each answered
batch under a name that follows from its requests before it goes on to the next, so a task that is run
again finds what its earlier attempt was told. Only a crash between an answer and its file loses the answer.
Batches keep their requests from run to run, as they are cut from a checkpoint; speculative execution,
where two attempts run at once, should be off.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tree import filesystem
from .broker import Provider, parse_scores
from .lineage import cut

#: Answers of one call, in the order of its bodies.
Call = Callable[[list[str]], list[str]]
ROW = "key string, answer string"
OUT = "key string, error string"
SCHEMA = pa.schema([("key", pa.string()), ("answer", pa.string())])


@dataclass
class Limit:
    """Calls a second over all tasks (None: no limit), calls at once, tries of a call, and the first wait after a failure."""

    rate: float | None = None
    burst: int = 4
    tries: int = 4
    wait: float = 0.5
    longest: float = 30.0


class TokenBucket:
    """Lets ``rate`` calls a second pass after a burst; ``take`` waits as long as it must."""

    def __init__(self, rate: float | None, burst: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.burst, self.clock, self.sleep = rate, max(1, burst), clock, sleep
        self.tokens, self.at = float(self.burst), clock()

    def take(self) -> None:
        if self.rate is None:
            return
        while True:
            now = self.clock()
            self.tokens, self.at = min(self.burst, self.tokens + (now - self.at) * self.rate), now
            if self.tokens >= 1:
                self.tokens -= 1
                return
            self.sleep((1 - self.tokens) / self.rate)


class Refused(Exception):
    """An answer that no further try will change; the batch fails at once."""


def answered(call: Call, bodies: list[str], limit: Limit, bucket: TokenBucket, sleep: Callable[[float], None] = time.sleep) -> list[str]:
    """Answers of a call, with tries that wait twice as long each time."""
    for n in range(limit.tries):
        bucket.take()
        try:
            found = call(bodies)
            if len(found) != len(bodies):
                raise ValueError(f"{len(found)} answers for {len(bodies)} requests")
            return found
        except Refused:
            raise
        except Exception:
            if n == limit.tries - 1:
                raise
            sleep(min(limit.longest, limit.wait * 2**n))
    raise ValueError("a call has one try at least")


class Ledger:
    """Answers by request key below ``root``, a folder that driver and executors share (a path or URL that Arrow knows)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def known(self) -> DataFrame:
        """key, answer of all that was ever answered; one row a key."""
        files, base = filesystem(self.root)
        found = [f.path for f in files.get_file_info(fs.FileSelector(f"{base}/answers", allow_not_found=True)) if f.path.endswith(".parquet")]
        rows = self.spark.read.schema(ROW).parquet(f"{self.root}/answers") if found else self.spark.createDataFrame([], ROW)
        return rows.groupBy("key").agg(F.min("answer").alias("answer"))

    def ask(self, requests: DataFrame, call: Call, *, size: int = 48, concurrent: int = 4, limit: Limit | None = None) -> DataFrame:
        """key, answer, error for each distinct key of ``requests`` (key, body). This runs the calls.

        ``call`` runs on executors, ``concurrent`` calls at a time with ``size`` bodies each. A batch that fails
        after all tries gives its requests an error and no answer; they are asked again the next time. A null
        body is asked as empty text.
        """
        limit = limit or Limit()
        own = requests.groupBy("key").agg(F.min(F.coalesce("body", F.lit(""))).alias("body"))
        missing = cut(own.join(self.known(), "key", "left_anti").repartition(concurrent, "key"))
        root, share = self.root, None if limit.rate is None else limit.rate / concurrent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files, base = filesystem(root)
            files.create_dir(f"{base}/answers")
            bucket = TokenBucket(share, limit.burst)
            held: list[tuple[str, str]] = []
            for b in batches:
                held += zip(b.column("key").to_pylist(), b.column("body").to_pylist(), strict=True)
                while len(held) >= size:
                    yield _settled(files, f"{base}/answers", held[:size], call, limit, bucket)
                    held = held[size:]
            if held:
                yield _settled(files, f"{base}/answers", held, call, limit, bucket)

        failed = cut(missing.mapInArrow(run, OUT).where("error is not null"))  # the calls run here, once
        return own.select("key").join(self.known(), "key", "left").join(failed, "key", "left")


def _settled(files: fs.FileSystem, folder: str, batch: list[tuple[str, str]], call: Call, limit: Limit, bucket: TokenBucket) -> pa.RecordBatch:
    """Answers of a batch in its file; keys, and the error of a batch without any."""
    keys = [k for k, _ in batch]
    path = f"{folder}/{hashlib.sha1(json.dumps(keys).encode()).hexdigest()}.parquet"
    error = None
    if files.get_file_info(path).type == fs.FileType.NotFound:
        try:
            answers = answered(call, [b for _, b in batch], limit, bucket)
            own = f"{folder}/.{uuid.uuid4().hex}"
            with files.open_output_stream(own) as f:
                pq.write_table(pa.table([pa.array(keys), pa.array(answers, pa.string())], schema=SCHEMA), f)
            files.move(own, path)
        except Exception as e:  # noqa: BLE001  whatever the call raises belongs to this batch
            error = f"{type(e).__name__}: {e}"
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array([error] * len(keys), pa.string())], names=["key", "error"])


# ---------------------------------------------------------------- embeddings and reranking through the ledger


def embeddings(ledger: Ledger, texts: DataFrame, provider: Provider, **how) -> DataFrame:  # noqa: ANN003
    """profile_key, content_hash, embedding, error of distinct (profile_key, content_hash, text): one question for each hash."""
    key = F.concat_ws("|", F.lit("embedding"), F.coalesce("profile_key", F.lit("")), "content_hash")
    own = texts.select(F.col("profile_key").cast("string").alias("profile_key"), "content_hash", "text").withColumn("key", key)

    def call(bodies: list[str]) -> list[str]:
        return [json.dumps(v) for v in provider(bodies)]

    got = ledger.ask(own.select("key", F.col("text").alias("body")), call, **how)
    keys = own.select("profile_key", "content_hash", "key").distinct()
    return keys.join(got, "key").select("profile_key", "content_hash", F.from_json("answer", "array<double>").alias("embedding"), "error")


def rerank_requests(rows: DataFrame, depth: int = 6) -> DataFrame:
    """query_id, key, body, n: the request that scores the first ``depth`` rows (query_id, query, rank, title, path, content) of each query.

    A query with one row has nothing to order and no request.
    """
    item = F.struct((F.col("rank") - 1).alias("index"), F.coalesce("title", "path").alias("title"), T.truncate(F.col("content"), 1200).alias("content"))
    one = rows.where(F.col("rank") <= depth).groupBy("query_id").agg(F.min("query").alias("query"), F.array_sort(F.collect_list(item)).alias("items"), F.count(F.lit(1)).cast("int").alias("n"))
    body = F.to_json(F.struct("query", F.col("items").alias("candidates")))
    return one.where("n > 1").select("query_id", body.alias("body"), "n").withColumn("key", F.concat(F.lit("rerank|"), F.sha1(F.col("body").cast("binary"))))


def rerank(ledger: Ledger, rows: DataFrame, call: Call, *, depth: int = 6, weight: float = 0.15, **how) -> DataFrame:  # noqa: ANN003
    """Recalled rows of many queries with the first ``depth`` of each scored anew by a remote model.

    ``rows``: query_id, query, rank (from 1), score, title, path, content and any others; a query has a bounded
    number of rows. An answer is text that holds ``{"scores": [{"index", "score"}]}``. Without a usable answer a
    query's rows stay as they are. Adds ``rerank_model``, what the model gave; score and rank are the new ones.
    """
    asked = cut(rerank_requests(rows, depth))
    got = ledger.ask(asked.select("key", "body"), call, size=1, **how).select("key", "answer")

    def parsed(answer, n):  # noqa: ANN001, ANN202  a row for each query
        try:
            return None if answer is None else parse_scores(answer, n)
        except (ValueError, AttributeError, TypeError):
            return None

    scores = F.udf(parsed, "array<double>")
    given = asked.join(got, "key").select("query_id", scores("answer", "n").alias("_scores"))
    own = rows.join(given, "query_id", "left")
    scored = F.col("_scores").isNotNull() & (F.col("rank") <= depth)
    part = F.when(scored, F.coalesce(F.get("_scores", (F.col("rank") - 1).cast("int")), F.lit(0.0)) * weight).otherwise(0.0)
    own = own.withColumn("rerank_model", part).withColumn("score", F.when(scored, F.col("score") * (1 - weight) + F.col("rerank_model")).otherwise(F.col("score")))
    place = Window.partitionBy("query_id").orderBy(F.when(F.col("rank") <= depth, 0).otherwise(1), F.when(F.col("rank") <= depth, -F.col("score")).otherwise(F.col("rank")), "rank")
    return own.withColumn("rank", F.row_number().over(place)).drop("_scores")
