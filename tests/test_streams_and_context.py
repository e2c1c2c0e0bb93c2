"""Streams give what batches give; task context on literal notes."""

from pyspark.sql import functions as F

from quarrylight.operators import context as C
from quarrylight.operators import ordered as O
from quarrylight.operators import records as R
from quarrylight.operators.governance import first_arrivals
from quarrylight.streaming import debounce


def test_debounce_on_a_stream(spark, tmp_path):
    kinds = "user_id long, at long, seq long, tokens long"
    rows = [(u, (i * 137 * (u + 1)) % 5000, i, 1000) for u in range(3) for i in range(12)]
    rows.sort(key=lambda r: (r[0], r[1], r[2]))
    src = str(tmp_path / "in")
    for part in (rows[:20], rows[20:]):
        spark.createDataFrame(part, kinds).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 10).parquet(src)
    out = O.on_stream(stream, ["user_id"], ["at", "seq"], O.debounce_step(500, 1200, 4, 5000), "user_id long, opened long, closed string, n long, tokens long", "first long, prev long, n long, used long")
    q = out.writeStream.format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = O.debounced_windows(spark.createDataFrame(rows, kinds), "user_id", items=4).where("closed <> 'end'")
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, want.collect()))


def test_votes_on_a_stream(spark, tmp_path, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    votes = lambda e: debounce.vote_counters(e, "user_id", F.col("event_type") == "purchase", F.col("event_type") == "error", "ts")
    src = str(tmp_path / "in")
    events.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = votes(stream).writeStream.format("memory").queryName("votes").option("checkpointLocation", str(tmp_path / "ck")).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("votes").collect())) == sorted(map(tuple, votes(events).collect()))


def test_first_occurrence_stays(spark):
    df = spark.createDataFrame([("a", 0, 2, "late"), ("a", 0, 1, "early"), ("b", 0, 3, "only"), (None, None, 4, "null"), (None, None, 5, "null2")], "doc_id string, chunk_index int, arrival int, v string")
    assert sorted(r.v for r in first_arrivals(df, ["doc_id", "chunk_index"], "arrival").collect()) == ["early", "null", "only"]


NOTES = [
    (1, "decision", "use sqlite", "Prefer sqlite for storage", "d/1.md", 0.9), (2, "decision", "no sqlite", "avoid sqlite here", "d/2.md", 0.8),
    (3, "decision", "canonical", "canonical conflict-resolution: adopt sqlite", "d/3.md", 0.5), (4, "manual", "note", "plain", "m/4.md", 0.4), (5, "project", "code", "x " * 2000, "p/5.ts", 0.7),
    (6, "project", "code", "short", "p/6.ts", 0.6), (7, "diary", "log", "did things", "l/7.md", 0.3),
]


def test_context_gates_conflicts_and_keeps_the_budget(spark):
    scored = spark.createDataFrame([(*n, 0) for n in NOTES], "doc_id long, source_kind string, title string, content string, path string, score double, updated_at long")
    got = C.for_task(scored, "fix the crash", budget=6, tokens=300)
    assert got.stage == "debug" and got.suppressed == [1, 2]
    assert got.rows[0]["doc_id"] == 5 and got.omitted >= 1 and {1, 2}.isdisjoint(r["doc_id"] for r in got.rows)
    assert [w[0] for w in got.waves][:2] == ["stable_memory", "local_project"]
    low = C.for_task(scored.withColumn("score", F.lit(0.01)), "fix the crash")
    assert low.waves[-1][0] == "fallback" and low.rows
    assert C.for_task(scored.where("false"), "fix the crash").rows == []


def test_checkpoint_records(spark):
    rows = [('{"id":"1","title":" t ","session_goal":"g","current_status":"s","next_steps":[" A","a","","b"]}',), ('{"id":"2","title":"t"}',), ("not json",), (None,)]
    got = R.read_checkpoints(spark.createDataFrame(rows, "json string")).collect()
    assert [(r.id, r.next_steps, r.blockers) for r in got] == [("1", ["A", "b"], [])]


def test_file_mentions(spark):
    from quarrylight.functions import text as T

    df = spark.createDataFrame([("see src\\app\\a.ts, then src/app/a.ts and (b.py). not c.tsv",), ("",)], "t string")
    assert [r[0] for r in df.select(T.file_mentions(F.col("t"))).collect()] == [["src/app/a.ts", "b.py"], []]
