"""Streams with timers and expiry against the batch operators; state from a checkpoint."""

import random
import time

import pytest

from quarrylight.operators.ordered import debounced_windows
from quarrylight.sources.tables import ship
from quarrylight.streaming import timers as S

FORM = "key string, at long, seq long, tokens long, mark string"


def put(spark, folder, n, rows):
    """One file; its name sorts and it is newer than those before."""
    spark.createDataFrame(rows, FORM).coalesce(1).write.json(f"{folder}/{n:03}")


def stream(spark, folder):
    ship(spark)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    return spark.readStream.schema(FORM).option("maxFilesPerTrigger", 1).json(f"{folder}/*")


def start(frame, out, checkpoint):
    return frame.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).start()


def until(spark, frame, out, checkpoint, n):
    """Rows once there are ``n`` of them: a stream with processing time has a batch at every trigger and never ends."""
    query = frame.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(processingTime="500 milliseconds").start()
    form, end, got = frame.schema, time.time() + 60, []
    try:
        while time.time() < end and len(got) < n:
            time.sleep(0.5)
            got = spark.read.schema(form).parquet(str(out)).collect() if (out / "_spark_metadata").exists() else []
    finally:
        query.stop()
    return got


def test_windows_of_a_stream_equal_the_batch(spark, tmp_path):
    """Rows out of order within the delay, in four files, with a restart between; the last windows close by their timers."""
    r = random.Random(3)
    rows, at = [], {k: 0 for k in "abc"}
    for seq in range(120):
        k = r.choice("abc")
        at[k] += r.choice([5, 40, 200, 700])
        rows.append((k, 10_000 + at[k], seq, r.choice([10, 900, 3000]), f"m{r.randrange(3)}"))
    frame = spark.createDataFrame([(ord(k), *x) for k, *x in rows], "key long, at long, seq long, tokens long, mark string")
    want = {(chr(x.key), x.opened): (x.closed, x.n, x.tokens) for x in debounced_windows(frame, "key", gap=300, cap=350, items=4, tokens=6000).collect()}
    late = sorted(rows, key=lambda x: x[1] + r.randrange(2500))  # arrives up to 2.5 s late
    folder, out, cp = tmp_path / "in", tmp_path / "out", tmp_path / "cp"
    for n in range(2):
        put(spark, folder, n, late[n * 30 : n * 30 + 30])
    query = start(S.windows(stream(spark, folder), "key", gap=300, cap=350, items=4, tokens=6000, late="60 seconds"), out, cp)
    query.processAllAvailable()
    query.stop()
    for n in range(2, 4):
        put(spark, folder, n, late[n * 30 : n * 30 + 30])
    put(spark, folder, 9, [("z", 10_000_000, 999, 1, "end")])  # only moves the watermark
    query = start(S.windows(stream(spark, folder), "key", gap=300, cap=350, items=4, tokens=6000, late="60 seconds"), out, cp)
    query.processAllAvailable()
    query.stop()
    got = spark.read.parquet(str(out)).collect()
    assert sorted(x.seq for x in got) == list(range(120))  # every waiter once
    windows = {(x.key, x.opened): (x.closed, x.n, x.tokens) for x in got}
    assert {k: v[1:] for k, v in windows.items()} == {k: v[1:] for k, v in want.items()}
    assert {k: v for k, v in windows.items() if want[k][0] != "end"} == {k: v for k, v in want.items() if v[0] != "end"}
    assert {v[0] for v in windows.values()} == {"gap", "cap", "full"} and sum(v[0] == "end" for v in want.values()) > 0
    marks = {x[2]: x[4] for x in rows}
    for w in windows:
        own = [x for x in got if (x.key, x.opened) == w]
        assert len(own) == own[0].n
        for x in own:
            assert marks[x.first] == marks[x.seq] and x.first == [y for y in sorted(own, key=lambda y: (dict((q[2], q[1]) for q in rows)[y.seq], y.seq)) if marks[y.seq] == marks[x.seq]][0].seq


def test_cache_forgets_and_survives_a_restart(spark, tmp_path):
    folder, out, cp = tmp_path / "in", tmp_path / "out", tmp_path / "cp"
    ttl = 12_000
    put(spark, folder, 0, [("p", 0, 0, 1, "a"), ("p", 0, 1, 1, "a"), ("p", 0, 2, 1, "b"), ("q", 0, 3, 1, "a")])
    began = time.time()
    until(spark, S.seen(stream(spark, folder), "key", ttl), out, cp, 4)
    put(spark, folder, 1, [("p", 0, 4, 1, "a"), ("q", 0, 5, 1, "b")])
    got = until(spark, S.seen(stream(spark, folder), "key", ttl), out, cp, 6)
    soon, cached = time.time() - began, {r.seq: r.cached for r in got}
    assert {k: cached[k] for k in (0, 1, 2, 3, 5)} == {0: False, 1: True, 2: False, 3: False, 5: False}
    assert cached[4] or soon > ttl / 1000  # from the checkpoint, unless this machine was slower than the ttl
    time.sleep(ttl / 1000 + 1)
    put(spark, folder, 2, [("p", 0, 6, 1, "a")])
    got = until(spark, S.seen(stream(spark, folder), "key", ttl), out, cp, 7)
    assert {r.seq: r.cached for r in got}[6] is False


def test_idle_queues_are_let_go_without_a_later_row(spark, tmp_path):
    folder, out, cp = tmp_path / "in", tmp_path / "out", tmp_path / "cp"
    put(spark, folder, 0, [("p", 0, 0, 1, "a"), ("p", 0, 4, 1, "a"), ("q", 0, 3, 1, "a")])
    got = until(spark, S.idle(stream(spark, folder), "key", 1500), out, cp, 2)
    assert sorted(map(tuple, got)) == [("p", 4, 2), ("q", 3, 1)]


@pytest.fixture(autouse=True)
def _restore(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    yield
    if old:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    else:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
