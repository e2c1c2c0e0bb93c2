"""Requests to a remote model: windows by profile, deduplicated batches, isolated failures, results for everyone who asked."""

from __future__ import annotations

import json
import re
import urllib.request
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Turns the texts of one request into their vectors; it runs on executors.
Provider = Callable[[list[str]], list[list[float]]]
IDLE_MS = 120_000
#: Numbers of answers that a task holds at once.
HELD = 200_000


def windows(items: DataFrame, key: str = "profile_key", span_ms: int = 20) -> DataFrame:
    """Adds ``opened``: the first arrival of the item's window. A window opens with an item and lasts ``span_ms``.

    ``items``: ``key``, at (ms), seq (ties). A window depends on the one before, so rows pass in order,
    one state for each key; a null key is a key.
    """
    names = [c for c in items.columns]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: Any = None
        opened = None
        for f in frames:
            out = []
            for k, at in zip(f[key].tolist(), f["at"].tolist(), strict=True):
                k = None if k is None or k != k else k
                if opened is None or (k,) != own or at >= opened + span_ms:
                    own, opened = (k,), at
                out.append(opened)
            yield f.assign(opened=out)[[*names, "opened"]]

    schema = ", ".join(f"{n} {t}" for n, t in items.dtypes) + ", opened long"
    return items.repartition(key).sortWithinPartitions(key, "at", "seq").mapInPandas(run, schema)


def distinct_requests(windowed: DataFrame, key: str = "profile_key") -> DataFrame:
    """One row (``key``, opened, content_hash, text, waiting) for each distinct text of a window: its first text and who waits."""
    own = windowed.withColumn("content_hash", T.content_hash(F.col("text")))
    return own.groupBy(key, "opened", "content_hash").agg(F.min_by("text", F.struct("at", "seq")).alias("text"), F.min(F.struct("at", "seq")).alias("first"), F.count(F.lit(1)).alias("waiting"))


def batches(requests: DataFrame, size: int = 48, key: str = "profile_key") -> DataFrame:
    """Adds ``batch`` and ``index``: a window's texts in order of arrival, ``size`` of them in each batch."""
    place = F.row_number().over(Window.partitionBy(key, "opened").orderBy("first")) - 1
    return requests.withColumn("_p", place).withColumns({"batch": (F.col("_p") / size).cast("int"), "index": (F.col("_p") % size).cast("int")}).drop("_p")


def flush(batched: DataFrame, provider: Provider, *, concurrent: int = 4, key: str = "profile_key") -> DataFrame:
    """``key``, opened, content_hash, embedding, error: one provider call for each batch, ``concurrent`` of them at a time.

    A call that fails, or that answers with another number of vectors, fails its own batch only: its
    texts have an error and no vector. Order inside a batch is the arrival's.
    """
    schema = f"{key} string, opened long, content_hash string, embedding array<double>, error string"
    asked = pa.schema([(key, pa.string()), ("opened", pa.int64()), ("content_hash", pa.string()), ("embedding", pa.list_(pa.float64())), ("error", pa.string())])

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), asked, strict=True)], schema=asked)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for frame in frames:
            for r in (r for at in range(0, frame.num_rows, 100) for r in frame.slice(at, 100).to_pylist()):
                found, error = _ask(provider, [t["text"] for t in r["texts"]])
                out += [(r[key], r["opened"], t["content_hash"], v, error) for t, v in zip(r["texts"], found, strict=True)]
                held += sum(16 + (0 if v is None else len(v)) for v in found)
                if held >= HELD:
                    yield packed(out)
                    out, held = [], 0
        if out:
            yield packed(out)

    one = F.struct("index", "content_hash", "text")
    rows = batched.select(F.col(key).cast("string").alias(key), "opened", "batch", "index", "content_hash", "text").repartition(concurrent, key, "opened", "batch")
    return rows.groupBy(key, "opened", "batch").agg(F.array_sort(F.collect_list(one)).alias("texts")).mapInArrow(run, schema)


def _ask(provider: Provider, texts: list[str]) -> tuple[list, str | None]:
    try:
        found = list(provider(texts))
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
        return found, None
    except Exception as e:  # noqa: BLE001  whatever the provider raises belongs to this batch
        return [None] * len(texts), f"{type(e).__name__}: {e}"


def fan_out(windowed: DataFrame, answers: DataFrame, key: str = "profile_key") -> DataFrame:
    """Every item with the vector or the error of its text in its window."""
    own = windowed.withColumn("content_hash", T.content_hash(F.col("text"))).withColumn(key, F.col(key).cast("string"))
    same = F.col(f"i.{key}").eqNullSafe(F.col(f"a.{key}")) & (F.col("i.opened") == F.col("a.opened")) & (F.col("i.content_hash") == F.col("a.content_hash"))
    return own.alias("i").join(answers.alias("a"), same, "left").select("i.*", "a.embedding", "a.error")


def idle(items: DataFrame, now_ms: int, key: str = "profile_key") -> DataFrame:
    """``key``, last, release: queues without an item for two minutes are let go."""
    return items.groupBy(key).agg(F.max("at").alias("last")).withColumn("release", F.lit(now_ms) - F.col("last") >= IDLE_MS)


def on_stream(stream: DataFrame, provider: Provider, sink: Callable[[DataFrame, int], None], checkpoint: str, *, every: str = "20 milliseconds", ledger: Any = None):
    """Micro-batches stand for windows: each is deduplicated by profile and text, flushed and fanned out. ``stop`` drains it.

    With a ``ledger.Ledger`` no text is asked twice, however often ``sink`` reads its frame or a batch is run again.
    """

    def work(rows: DataFrame, batch_id: int) -> None:
        own = rows.withColumn("opened", F.lit(batch_id).cast("long"))
        asked = distinct_requests(own)
        if ledger is None:
            answers = flush(batches(asked), provider)
        else:
            from .ledger import embeddings

            got = embeddings(ledger, asked.select("profile_key", "content_hash", "text"), provider)
            answers = got.withColumn("opened", F.lit(batch_id).cast("long"))
        sink(fan_out(own, answers), batch_id)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(work).start()


# ---------------------------------------------------------------- remote models


def remote_embeddings(url: str, model: str, key: str | None = None, timeout: float = 30.0) -> Provider:
    """A provider that asks an ``/embeddings`` service; answers are ordered by their index and counted."""

    def ask(texts: list[str]) -> list[list[float]]:
        found = _post(f"{url.rstrip('/')}/embeddings", {"model": model, "input": texts}, key, timeout).get("data", [])
        if sorted(d.get("index") for d in found) != list(range(len(texts))):
            raise ValueError("vectors are missing")
        return [[float(x) for x in d["embedding"]] for d in sorted(found, key=lambda d: d["index"])]

    return ask


def _post(url: str, body: dict[str, Any], key: str | None, timeout: float) -> dict[str, Any]:
    head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), head), timeout=timeout) as r:
        return json.load(r)


def parse_scores(answer: str, n: int) -> list[float]:
    """Scores from 0 to 1 in a chat answer that holds a JSON object; what is missing or no number is 0."""
    found = re.search(r"\{.*\}", answer, re.S)
    if not found:
        raise ValueError("no JSON in the answer")
    out = [0.0] * n
    for item in json.loads(found.group(0)).get("scores") or []:
        i, s = (item.get("index"), item.get("score")) if isinstance(item, dict) else (None, None)
        if isinstance(i, int) and not isinstance(i, bool) and 0 <= i < n and isinstance(s, int | float) and s == s and abs(s) != float("inf"):
            out[i] = max(0.0, min(1.0, float(s)))
    return out


def rerank(rows: list[dict[str, Any]], answer: Callable[[list[dict[str, Any]]], str], *, weight: float = 0.15, depth: int = 6) -> list[dict[str, Any]]:
    """The first ``depth`` recalled rows (a bounded list, best first) scored anew by a remote answer; any error leaves all as it was."""
    head, tail = rows[:depth], rows[depth:]
    if len(head) <= 1:
        return rows
    try:
        scores = parse_scores(answer(head), len(head))
    except Exception:  # noqa: BLE001  the order stays whatever went wrong
        return rows
    mixed = [r | {"score": r["score"] * (1 - weight) + s * weight} for r, s in zip(head, scores, strict=True)]
    return sorted(mixed, key=lambda r: -r["score"]) + tail


def keyed_state(texts: DataFrame, cache: DataFrame, hashes: Column) -> DataFrame:
    """Adds ``cached``: a persistent cache (profile_key, content_hash) holds the text; profiles that hash locally pass it by."""
    known = cache.select("profile_key", "content_hash", F.lit(True).alias("_c")).distinct()
    return texts.join(known, ["profile_key", "content_hash"], "left").withColumn("cached", ~hashes & F.coalesce("_c", F.lit(False))).drop("_c")
