"""The versioned store: crashes, replays, two writers, conflicts, compaction and vacuum; the engine's tables in it."""

import threading

import pytest

from quarrylight.operators import execution as E
from quarrylight.operators import notes as N
from quarrylight.operators.lineage import folder
from quarrylight.operators.memory import Memory
from quarrylight.sources.commits import CommitLog
from quarrylight.sources.store import Conflict, Store


@pytest.fixture()
def store(spark):
    s = Store(spark, folder(spark), buckets=4)
    s.create("t", "k long, v string", ("k",))
    s.create("log", "v string")
    return s


def rows(spark, *pairs):
    return spark.createDataFrame(pairs, "k long, v string")


def content(store, table="t", version=None):
    return sorted(tuple(r) for r in store.read(table, version).collect())


def test_commit_log_gives_a_number_once(spark):
    logs = [CommitLog(spark, folder(spark))] * 2
    assert logs[0].latest() == -1 and logs[0].append(0, {"a": "é"})
    assert not logs[1].append(0, {"a": 2}) and logs[1].read(0) == {"a": "é"} and logs[0].versions() == [0]
    won, log = [], logs[0]
    threads = [threading.Thread(target=lambda n=n: won.append(n) if log.append(1, {"n": n}) else None) for n in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and log.read(1) == {"n": won[0]}


def test_actions_snapshots_and_null_keys(spark, store):
    a = store.commit("a", [("append", "t", rows(spark, (1, "a"), (1, "b"), (2, "c"), (None, "n")))])
    b = store.commit("b", [("replace", "t", rows(spark, (1, "x"), (1, "y"), (3, "d")))])
    c = store.commit("c", [("upsert", "t", rows(spark, (1, "z"), (1, "z"), (None, "m"))), ("append", "log", spark.createDataFrame([("one",)], "v string"))])
    d = store.commit("d", [("delete", "t", rows(spark, (2, "?"), (9, "?")))])
    assert content_safe(store, a) == {(None, "n"), (1, "a"), (1, "b"), (2, "c")}
    assert content_safe(store, b) == {(None, "n"), (1, "x"), (1, "y"), (2, "c"), (3, "d")}
    assert content_safe(store, c) == {(None, "m"), (1, "z"), (2, "c"), (3, "d")} and store.read("t", c).count() == 4
    assert content_safe(store, d) == {(None, "m"), (1, "z"), (3, "d")} and content(store, "log") == [("one",)]
    assert [o for _, o in store.history()] == ["create t", "create log", "a", "b", "c", "d"]
    assert store.commit("e", [("append", "t", rows(spark).limit(0))]) == d + 1 and content_safe(store, d + 1) == content_safe(store, d)
    with pytest.raises(ValueError):
        store.commit("two steps", [("append", "t", rows(spark)), ("delete", "t", rows(spark))])
    with pytest.raises(ValueError):
        store.create("t", "k long, w string", ("k",))


def content_safe(store, version=None, table="t"):
    return {tuple(r) for r in store.read(table, version).collect()}


def test_crash_between_write_and_commit_changes_nothing(spark, store, monkeypatch):
    store.commit("a", [("append", "t", rows(spark, (1, "a")))])
    before, append = store.state(), store.log.append
    monkeypatch.setattr(store.log, "append", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        store.commit("b", [("upsert", "t", rows(spark, (1, "b"))), ("append", "log", spark.createDataFrame([("b",)], "v string"))])
    monkeypatch.setattr(store.log, "append", append)
    other = Store(spark, store.root)  # as a new process sees it
    assert other.state() == before and content(other) == [(1, "a")] and content(other, "log") == []
    assert other.vacuum(keep=10) == 2  # the two folders of the lost commit
    assert content(other) == [(1, "a")]


def test_replays_are_void(spark, store):
    step = [("append", "t", rows(spark, (1, "a")))]
    assert store.commit("a", step, txn=("w", 1)) is not None
    assert store.commit("a", step, txn=("w", 1)) is None and store.commit("a", step, txn=("w", 0)) is None
    assert store.commit("a", step, txn=("other", 1)) is not None and store.read("t").count() == 2


def racing(store, other, monkeypatch):
    """``other`` commits after ``store`` has written its data and before it commits."""
    append, done = store.log.append, []

    def late(version, entry):
        if not done:
            done.append(1)
            other()
        return append(version, entry)

    monkeypatch.setattr(store.log, "append", late)


def test_two_writers_of_one_key_and_of_others(spark, store, monkeypatch):
    store.commit("a", [("append", "t", rows(spark, *((k, "a") for k in range(20))))])
    second = Store(spark, store.root)
    tries, step = [], store._step
    monkeypatch.setattr(store, "_step", lambda *x: tries.append(1) or step(*x))
    racing(store, lambda: second.commit("b", [("upsert", "t", rows(spark, (5, "b")))]), monkeypatch)
    store.commit("c", [("delete", "t", rows(spark, (5, "?"))), ("append", "log", spark.createDataFrame([("c",)], "v string"))])
    assert len(tries) == 4 and (5, "b") not in content(store) and (5, "a") not in content(store) and len(content(store)) == 19
    # appends and other buckets are no conflict
    tries.clear()
    monkeypatch.undo()
    monkeypatch.setattr(store, "_step", lambda *x: tries.append(1) or step(*x))
    racing(store, lambda: second.commit("d", [("append", "log", spark.createDataFrame([("d",)], "v string"))]), monkeypatch)
    store.commit("e", [("upsert", "t", rows(spark, (6, "e")))])
    assert len(tries) == 1 and content(store, "log") == [("c",), ("d",)] and (6, "e") in content(store)


def test_update_reads_what_it_changes(spark, store, monkeypatch):
    """A counter that two writers raise by one: none of the raises is lost."""
    store.commit("a", [("append", "t", rows(spark, (1, "0")))])
    second = Store(spark, store.root)
    raised = lambda table: [("upsert", "t", table("t").selectExpr("k", "cast(cast(v as int) + 1 as string) as v"))]
    racing(store, lambda: second.update("second", raised), monkeypatch)
    store.update("first", raised)
    assert content(store) == [(1, "2")]
    monkeypatch.undo()
    monkeypatch.setattr(store, "_finish", lambda *_: None)
    with pytest.raises(Conflict):
        store.update("never", raised, tries=2)


def test_compaction_keeps_what_others_append_and_vacuum_keeps_versions(spark, store, monkeypatch):
    for i in range(20):  # over the log's whole states, too
        store.commit("a", [("append", "log", spark.createDataFrame([(f"{i:02}",)], "v string"))])
    second = Store(spark, store.root)
    racing(store, lambda: second.commit("b", [("append", "log", spark.createDataFrame([("zz",)], "v string"))]), monkeypatch)
    version = store.compact("log")
    want = [(f"{i:02}",) for i in range(20)] + [("zz",)]
    assert content(store, "log") == want and content(store, "log", 5) == want[:4]
    parts = store.state()["tables"]["log"]["parts"]
    assert sum(map(len, parts.values())) <= 4 + 1 and store.compact("log", most=2) is None
    assert store.vacuum(keep=2) == 0  # the version before the compaction uses all of it
    assert store.vacuum(keep=2) > 10 and content(store, "log", version) == want
    with pytest.raises(ValueError):
        store.read("log", 5)


def test_memory_over_several_commits(spark):
    m = Memory(spark, folder(spark), buckets=2)
    notes = spark.createDataFrame([("A b", "first " * 300, "manual", 1), ("a-b", "second", "manual", 2), ("Use parquet", "we do", "decision", 3)], "title string, content string, source_kind string, seq int")
    m.remember(notes, "memory", 1000, txn=("notes", 1))
    assert m.remember(notes, "memory", 1000, txn=("notes", 1)) is None
    held = {r.path: r for r in m.read("manifests").collect()}
    assert set(held) == {"memory/manual/a-b.md", "memory/decision/use-parquet.md"} and [r.content for r in m.chunks().where("path like '%a-b.md'").collect()] == ["second"]
    first = m.store.state()["version"]
    m.remember(notes.limit(1), "memory", 2000)
    assert m.chunks().where("path like '%a-b.md'").count() == 2 and m.chunks(first).where("path like '%a-b.md'").count() == 1
    ids = {p: r.doc_id for p, r in held.items()}
    a, b = ids["memory/manual/a-b.md"], ids["memory/decision/use-parquet.md"]
    orders = spark.createDataFrame([(a, "disable", "old"), ("?", "disable", "none")], "doc_id string, action string, reason string")
    m.switch(orders, 3000)
    m.rate(spark.createDataFrame([(a, "helpful"), (b, "helpful"), ("?", "helpful")], "doc_id string, signal string"), 4000)
    assert [r.doc_id for r in m.disabled().collect()] == [a] and {r.doc_id: (r.helpful, r.noisy) for r in m.read("votes").collect()} == {a: (1, 1), b: (1, 0)}
    m.switch(spark.createDataFrame([(a, "enable", "")], "doc_id string, action string, reason string"), 5000)
    assert m.disabled().count() == 0
    m.forget(spark.createDataFrame([("memory/manual/a-b.md",), ("nowhere",)], "path string"))
    assert {t: m.read(t).where(f"doc_id = '{a}'").count() for t in ("manifests", "chunks", "edges", "disabled", "votes")} == dict.fromkeys(("manifests", "chunks", "edges", "disabled", "votes"), 0)
    assert m.chunks().count() == 1 and m.edges().count() > 0


def test_memory_checkpoints_cache_and_runs(spark):
    m = Memory(spark, folder(spark), buckets=2)
    saved = lambda *x: spark.createDataFrame(x, "project string, id string, updated_at long, record string")
    m.checkpoint(saved(("p", "1", 10, "{}"), ("p", "2", 20, "{}"), ("q", "3", 5, "{}")))
    m.checkpoint(saved(("p", "4", 15, "{}")))
    assert m.read("checkpoints").count() == 4 and sorted((r.project, r.id) for r in m.read("active_checkpoints").collect()) == [("p", "4"), ("q", "3")]
    m.clear_checkpoints(spark.createDataFrame([("p",)], "project string"))
    assert [r.id for r in m.read("active_checkpoints").collect()] == ["3"]
    cached = lambda *x: spark.createDataFrame(x, "profile_key string, content_hash string, embedding array<double>, updated_at long")
    m.cache(cached(("p", "h", [1.0], 5), ("p", "i", [2.0], 5)))
    m.cache(cached(("p", "h", [9.0], 4), ("p", "i", [3.0], 6)))
    assert sorted((r.content_hash, r.embedding) for r in m.read("cache").collect()) == [("h", [1.0]), ("i", [3.0])]
    m.record_runs(spark.createDataFrame([("a", t, "x", "ok", 1.0, 1.0) for t in range(7)] + [("b", 1, "x", "ok", 1.0, 1.0)], "profile string, at long, project string, status string, index_ms double, recall_ms double"))
    assert sorted((r.profile, r.at) for r in m.runs_by_profile(2).collect()) == [("a", 5), ("a", 6), ("b", 1)]


def test_notes_of_one_path_and_plans_without_a_title(spark):
    notes = spark.createDataFrame([("A b", "x", "manual"), ("a-b", "y", "manual")], "title string, content string, source_kind string")
    assert [r.content for r in N.remember(notes, "m", 1).collect()] == ["y"]
    plans = spark.createDataFrame([(1, None, "use x", True), (2, "Same", "use y", True), (3, "Same", "use z", False)], "plan_id int, title string, decision string, disable_inputs boolean")
    asked = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "plan_id int, doc_id int")
    docs, off = E.execute_resolutions(plans, asked, spark.createDataFrame([(10,), (20,), (30,)], "doc_id int"), "m", 7)
    ids = {r.title: r.doc_id for r in docs.collect()}
    assert set(ids) == {"decision-7", "Same"} and docs.count() == 2
    assert {r.doc_id: r.reason for r in off.collect()} == {10: f"Resolved into canonical decision {ids['decision-7']}.", 20: f"Resolved into canonical decision {ids['Same']}."}


def test_rewriting_rows_by_key_shuffles_them_for_the_join_only(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    store.create("t", "k long, v string", ("k",))
    store.commit("append", [("append", "t", spark.range(40).selectExpr("id AS k", "'a' AS v"))])
    rows = spark.range(50).where("id % 3 = 0").selectExpr("id AS k", "'b' AS v")
    dealt, frame = [], type(rows)
    plain = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, *a: dealt.append(a) or plain(self, *a))
    store.commit("upsert", [("upsert", "t", rows)])
    store.commit("delete", [("delete", "t", spark.range(10).selectExpr("id AS k"))])
    assert not dealt
    want = {k: "b" if k % 3 == 0 else "a" for k in range(50) if k >= 10 and (k < 40 or k % 3 == 0)}
    assert {r.k: r.v for r in store.read("t").collect()} == want
