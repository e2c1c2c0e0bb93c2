"""The request ledger: every distinct text is asked once, whatever fails or is read again."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators import broker as B
from quarrylight.operators import ledger as L
from quarrylight.operators import notes as N
from quarrylight.operators.lineage import folder


@pytest.fixture()
def ledger(spark):
    from quarrylight.sources.tables import ship

    ship(spark)
    return L.Ledger(spark, folder(spark))


def counted(path, fail=lambda texts: None):
    """A provider that notes every text it is asked, one file a call."""

    def provider(texts):
        with open(os.path.join(path, f"{time.time_ns()}-{os.getpid()}"), "w") as f:
            json.dump(texts, f)
        fail(texts)
        return [[float(len(t)), 1.0] for t in texts]

    return provider


def asked(path):
    return sorted(t for f in os.listdir(path) for t in json.load(open(os.path.join(path, f))))


def texts(spark, *values, profile="p"):
    return spark.createDataFrame([(profile, v) for v in values], "profile_key string, text string").withColumn("content_hash", T.content_hash(F.col("text")))


def test_distinct_texts_are_asked_once_over_actions_and_runs(spark, ledger, tmp_path):
    values = [f"text {i}" for i in range(50)]
    own = texts(spark, *values, *values[:20], "TEXT  3")
    got = L.embeddings(ledger, own.dropDuplicates(["content_hash"]), counted(tmp_path), size=7)
    assert got.count() == 50 and got.where("embedding is null").count() == 0 and got.agg(F.sum(F.col("embedding")[0])).first()[0] == sum(map(len, values))
    assert len(asked(tmp_path)) == 50
    again = L.embeddings(ledger, texts(spark, *values, "new"), counted(tmp_path), size=7)
    assert again.count() == 51 and asked(tmp_path) == sorted(values + ["new"])


def test_a_lost_task_asks_only_what_it_had_not_stored(spark, ledger, tmp_path):
    """The third call kills its worker; the next run asks the texts that have no answer yet."""
    calls, marks = tmp_path / "calls", tmp_path / "marks"
    calls.mkdir(), marks.mkdir()

    def die(_):
        if len(os.listdir(calls)) == 3 and not os.listdir(marks):
            (marks / "died").touch()
            os._exit(1)

    values = [f"t{i}" for i in range(40)]
    with pytest.raises(Exception, match="(?i)crash|exit|worker|aborted"):
        L.embeddings(ledger, texts(spark, *values), counted(calls, die), size=10, concurrent=1)
    told = len(asked(calls))
    assert told == 30
    got = L.embeddings(ledger, texts(spark, *values), counted(calls), size=10, concurrent=1)
    assert got.where("embedding is not null").count() == 40
    assert len(asked(calls)) == 50  # the ten of the killed call twice: it never answered


def test_failures_are_tried_again_and_stay_in_their_batch(spark, ledger, tmp_path):
    def fail(found):
        if "bad" in found:
            raise RuntimeError("no")

    limit = L.Limit(tries=3, wait=0.01)
    got = L.embeddings(ledger, texts(spark, "bad", *(f"ok{i}" for i in range(9))), counted(tmp_path, fail), size=1, limit=limit)
    rows = {r.content_hash: r for r in got.collect()}
    assert sum(r.error is not None for r in rows.values()) == 1 and sum(r.embedding is not None for r in rows.values()) == 9
    assert asked(tmp_path).count("bad") == 3 and got.where("error = 'RuntimeError: no'").count() == 1
    assert L.embeddings(ledger, texts(spark, "bad"), counted(tmp_path)).where("embedding is not null").count() == 1  # later it is well


def test_refusals_and_short_answers(spark, ledger):
    def refuse(bodies):
        raise L.Refused("never")

    own = spark.createDataFrame([("a", "x"), ("b", None)], "key string, body string")
    assert {r.error for r in ledger.ask(own, refuse).collect()} == {"Refused: never"}
    assert {r.error for r in ledger.ask(own, lambda b: [], limit=L.Limit(tries=1)).collect()} <= {"ValueError: 0 answers for 1 requests", "ValueError: 0 answers for 2 requests"}
    assert {(r.key, r.answer) for r in ledger.ask(own, lambda b: [x.upper() + "!" for x in b]).collect()} == {("a", "X!"), ("b", "!")}
    assert ledger.ask(own.limit(0), refuse).collect() == []


def test_token_bucket_and_backoff():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    bucket = L.TokenBucket(2.0, 3, lambda: now[0], sleep)
    for _ in range(7):
        bucket.take()
    assert abs(now[0] - 2.0) < 1e-9  # three at once, then two a second
    waits, calls = [], []

    def call(bodies):
        calls.append(1)
        if len(calls) < 4:
            raise OSError("busy")
        return bodies

    assert L.answered(call, ["a"], L.Limit(tries=5, wait=1.0, longest=3.0), L.TokenBucket(None, 1), waits.append) == ["a"]
    assert waits == [1.0, 2.0, 3.0]


def test_cache_fill_and_stream_ask_once(spark, ledger, tmp_path):
    own = spark.createDataFrame([(str(i), f"text {i % 4}") for i in range(9)], "place string, text string")
    cache = spark.createDataFrame([], "profile_key string, content_hash string, embedding array<double>, updated_at long")
    embed = lambda misses: L.embeddings(ledger, misses.withColumn("profile_key", F.lit("p")), counted(tmp_path)).select("content_hash", "embedding")
    filled, new = N.fill_from_cache(own, cache, "p", embed)
    assert filled.where("embedding is not null").count() == 9 and new.count() == 4 and filled.count() == 9
    assert asked(tmp_path) == [f"text {i}" for i in range(4)]
    # a stream over the same texts and two more, whose sink reads its frame three times
    at = tmp_path / "in"
    spark.createDataFrame([("p", n, n, f"text {n % 6}") for n in range(12)], "profile_key string, at long, seq long, text string").coalesce(1).write.json(str(at))
    calls = tmp_path / "calls"
    calls.mkdir()
    seen = []

    def sink(frame, batch):
        assert frame.count() == frame.where("embedding is not null").count()
        seen.extend((r.seq, r.embedding[0]) for r in frame.collect())

    query = B.on_stream(spark.readStream.schema("profile_key string, at long, seq long, text string").json(str(at)), counted(calls), sink, str(tmp_path / "cp"), ledger=ledger)
    query.processAllAvailable()
    query.stop()
    assert sorted(seen) == [(n, 6.0) for n in range(12)] and asked(calls) == ["text 4", "text 5"]


def test_remote_rerank_of_many_queries(spark, ledger, tmp_path):
    rows = [(q, f"query {q}", k, 1 - k / 10, f"title {k}", f"p/{k}.md", f"content {k}") for q in range(4) for k in range(1, 9)] + [(9, "alone", 1, 0.5, None, "p", "c")]
    frame = spark.createDataFrame(rows, "query_id int, query string, rank int, score double, title string, path string, content string")

    def call(bodies):
        with open(tmp_path / f"{time.time_ns()}", "w") as f:
            json.dump(bodies, f)
        q = json.loads(bodies[0])
        if q["query"] == "query 1":
            return ["no json"]
        if q["query"] == "query 2":
            raise OSError("down")
        return ["so: " + json.dumps({"scores": [{"index": c["index"], "score": c["index"] / 5} for c in q["candidates"]]})]

    got = L.rerank(ledger, frame, call, limit=L.Limit(tries=1))
    by = {}
    for r in got.collect():
        by.setdefault(r.query_id, []).append((r["rank"], r.title, round(r.score, 6)))
    for q in (0, 3):
        want = sorted(((1 - k / 10) * 0.85 + (k - 1) / 5 * 0.15, k) for k in range(1, 7))
        assert sorted(by[q]) == [(n, f"title {k}", round(s, 6)) for n, (s, k) in enumerate(sorted(want, key=lambda x: (-round(x[0], 9), x[1])), 1)] + [(7, "title 7", 0.3), (8, "title 8", 0.2)]
    for q in (1, 2):
        assert sorted(by[q]) == [(k, f"title {k}", round(1 - k / 10, 6)) for k in range(1, 9)]
    assert by[9] == [(1, None, 0.5)]
    got.count()
    assert len(os.listdir(tmp_path)) == 4
    # the plain form over a list gives the same
    head = [{"score": 1 - k / 10, "k": k} for k in range(1, 9)]
    plain = B.rerank(head, lambda h: json.dumps({"scores": [{"index": i, "score": i / 5} for i in range(len(h))]}))
    assert [f"title {r['k']}" for r in plain] == [t for _, t, _ in sorted(by[0])]
