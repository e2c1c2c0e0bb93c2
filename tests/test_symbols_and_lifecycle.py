"""Symbols of each language, file sources, recovery and request parsing on literal inputs."""

import json
import os

import pytest

from quarrylight.functions import text as T
from quarrylight.operators import broker as B
from quarrylight.operators import ingest as I
from quarrylight.operators import lifecycle as L
from quarrylight.operators import lineage
from quarrylight.operators import notes as N
from quarrylight.operators import recall as R
from quarrylight.operators import suites as U
from quarrylight.sources import files as X
from quarrylight.sources import tables as D

NOW = D.NOW_MS
CODE = {
    "typescript": ("export class Store {\n  async keep(text: string) {\n    if (text) { return text; }\n  }\n}\n// class Ghost {}\nconst s = 'function no() {}';\nexport function recall(q: string): string {\n  return q;\n}\nexport const later = async (x: number) => x;\ntype Id = string;\ninterface Shape { a: number }", ["Store", "keep", "recall", "later", "Id", "Shape"]),
    "go": ("package m\n\ntype Store struct{}\n\n// func Ghost() {}\nfunc Keep(t string) string {\n\treturn t\n}\n\nfunc (s *Store) Recall(q string) string {\n\treturn `func no() {}`\n}\ntype (\n\tPair struct{}\n)", ["Store", "Keep", "Recall", "Pair"]),
    "rust": ("struct Store;\n\ntrait Keeper {\n    fn keep(&self) -> String;\n}\n/* fn ghost() {} */\nimpl Store {\n    pub fn recall<'a>(&self, q: &'a str) -> String {\n        \"fn no() {}\".to_string()\n    }\n}\nenum Kind { A }\npub type Id = u64;", ["Store", "Keeper", "keep", "recall", "Kind", "Id"]),
    "java": ("public class Store {\n    interface Keeper {\n        String keep(String t);\n    }\n    public Store() {\n    }\n    public List<String> recall(String q) throws Bad {\n        return find(q);\n    }\n    // void ghost() {}\n    Runnable sum = () -> {};\n}", ["Store", "Keeper", "keep", "Store", "recall", "sum"]),
    "python": ("class Store:\n    def keep(self):\n        return 'def no(): pass'\n\nasync def recall(q):\n    return q", ["Store", "keep", "recall"]),
}


@pytest.mark.parametrize("language", sorted(CODE))
def test_symbols_of_each_language(language):
    text, names = CODE[language]
    assert [n for n, _ in I.symbols_in(text, language)] == names
    assert all(text[at:].startswith(n) for n, at in I.symbols_in(text, language) if language != "python")
    assert I.inferred_symbol("x.code", text, language=language) == names[0]


def test_inferred_symbols(spark):
    assert I.inferred_symbol("a/notes.v2.md", "nothing here") == "a/notes.v2" and I.inferred_symbol("x.md", "plain", label_too=False) is None
    assert I.inferred_symbol("x.ts", "if (a) {\n}\nconst go = (a) => a") == "go"
    rows = [(1, "src/a.go", CODE["go"][0]), (2, "b.txt", "plain"), (3, "c.py", None), (4, ".md", "")]
    got = {r.doc_id: r.symbol for r in I.inferred_symbols(spark.createDataFrame(rows, "doc_id long, path string, content string")).collect()}
    assert got == {1: "Store", 2: "b", 3: "c", 4: None}


def test_scan_and_globs(spark, tmp_path):
    for path in ("a.md", "src/b c.py", "src/_own/d.md", "_top/e.md", "src/.git/f.md", "node_modules/g.md", "src/dist/h.md", "i.bin", "_j.md", "k+%41.md"):
        os.makedirs(os.path.dirname(tmp_path / path), exist_ok=True)
        (tmp_path / path).write_text(f"text of {path}", encoding="utf-8")
    got = {r.path: r.content for r in X.scan(spark, f"file://{tmp_path}").collect()}
    assert got == {p: f"text of {p}" for p in ("a.md", "src/b c.py", "src/_own/d.md", "_top/e.md", "_j.md", "k+%41.md")}
    assert {r.path for r in X.markdown(spark, str(tmp_path)).collect()} == {"a.md", "_j.md", "k+%41.md", "node_modules/g.md", "src/dist/h.md"}
    assert {r.path for r in X.scan(spark, str(tmp_path), max_bytes=12).where("content is null").collect()} == {p for p in got if len(f"text of {p}") > 12}
    asked = spark.createDataFrame([("a.md",), ("zz.md",)], "path string")
    assert {r.path: r.content for r in X.texts_at(asked, X.scan(spark, str(tmp_path)), None).collect()} == {"a.md": "text of a.md", "zz.md": None}
    made = X.index_documents(X.scan(spark, str(tmp_path)), "p", NOW)
    assert made["manifests"].count() == 6 and made["chunks"].count() == 6 and all(len(r.embedding) == 64 for r in made["chunks"].collect())


def test_small_inputs(tmp_path):
    (tmp_path / "c.toml").write_text('a = 2\nlist = []\n[retrieval]\ntop = 3\n')
    base = {"a": 1, "list": [1], "retrieval": {"top": 8, "least": 0.2}}
    assert X.config(str(tmp_path / "c.toml"), base) == {"a": 2, "list": [1], "retrieval": {"top": 3, "least": 0.2}} and X.config(str(tmp_path / "no"), base) == base
    assert X.branch(str(tmp_path)) is None
    os.makedirs(tmp_path / ".git")
    (tmp_path / ".git/HEAD").write_text("ref: refs/heads/feature/x\n")
    assert X.branch(str(tmp_path)) == "feature/x"
    (tmp_path / ".git/HEAD").write_text("0123abc\n")
    assert X.branch(str(tmp_path)) is None
    (tmp_path / "s.json").write_text(json.dumps({"projects": [{"name": "p", "root": "sub"}]}))
    assert X.suite(str(tmp_path / "s.json")) == [{"name": "p", "root": str(tmp_path / "sub")}]


def test_recovery(spark):
    m = spark.createDataFrame([(1, "old"), (2, "p")], "doc_id long, embedding_profile string")
    plan = L.recovery_plan(m, "p").first()
    assert (plan.state, plan.stale, plan.steps) == ("rebuild_required", 1, list(L.STEPS["rebuild_required"]))
    assert L.recovery_plan(m, "p", described=False).first().steps == list(L.STEPS["missing"])
    assert L.recovery_plan(m.where("doc_id = 2"), "p", strategy="aggressive").first().steps == ["index_project"]
    steps = list(L.STEPS["missing"])
    plans = spark.createDataFrame([(1, steps, steps), (2, steps, steps[:1]), (3, steps, steps)], "plan_id int, steps array<string>, auto array<string>")
    results = spark.createDataFrame([(1, steps[1], "fetch failed"), (3, steps[0], None)], "plan_id int, step string, error string")
    got = {(r.plan_id, r.place): (r.status, r.code) for r in L.recover(plans, results).collect()}
    assert got == {(1, 0): ("executed", "none"), (1, 1): ("failed", "embedding_provider_request_failed"), (2, 0): ("executed", "none"), (2, 1): ("skipped", "none"), (2, 2): ("skipped", "none"), (3, 0): ("executed", "none"), (3, 1): ("executed", "none"), (3, 2): ("executed", "none")}
    assert {r.status for r in L.recover(plans, results, dry_run=True).collect()} == {"planned"}
    state = spark.createDataFrame([("ready",)], "state string")
    assert [r.index_reuse for r in L.access_surface(state).orderBy("level").collect()] == [False, True, True]


def test_rebuild_and_repair(spark):
    m = spark.createDataFrame([(1, "a.md", "manual", 5), (2, "b.md", "diary", 3), (3, "c.py", "project", 4)], "doc_id long, path string, source_kind string, updated_at long")
    files = spark.createDataFrame([("a.md", "new text")], "path string, content string")
    plan = L.rebuild(m, m, files)
    out = L.rebuilt({"manifests": m}, plan)
    assert [r.doc_id for r in out["manifests"].orderBy("doc_id").collect()] == [1, 3] and [r.doc_id for r in out["vectors"].collect()] == [1] and [r.path for r in plan["rescan"].collect()] == ["c.py"]
    schema = "name string, dims int, provider string, created_at string"
    have = spark.createDataFrame([("p", 64, "hash", "d1"), ("q", 8, "hash", "d1"), ("z", 1, "x", "d0")], schema)
    want = spark.createDataFrame([("p", 64, "hash", ""), ("q", 16, "hash", ""), ("r", 4, "hash", "")], schema)
    assert sorted(tuple(r) for r in L.repair(have, want, "d2").collect()) == [("p", 64, "hash", "d1"), ("q", 16, "hash", "d2"), ("r", 4, "hash", "d2"), ("z", 1, "x", "d0")]


def test_remote_rerank():
    rows = [{"id": i, "score": 1.0 - i / 10} for i in range(4)]
    answer = lambda head: 'so: {"scores": [{"index": 2, "score": 7}, {"index": 0, "score": -1}, {"index": 9, "score": 1}, {"index": 1}, 5]}'
    assert B.parse_scores(answer(rows), 3) == [0.0, 0.0, 1.0]
    assert [r["id"] for r in B.rerank(rows, answer, weight=0.5, depth=3)] == [2, 0, 1, 3]
    assert B.rerank(rows, lambda head: "no idea") == rows and B.rerank(rows[:1], answer) == rows[:1]


def test_windows_follow_arrivals(spark):
    items = spark.createDataFrame([("a", 0, 1, "x"), ("a", 19, 2, "x "), ("a", 20, 3, "y"), (None, 5, 4, "x"), (None, 6, 5, "z")], "profile_key string, at long, seq long, text string")
    w = B.windows(items)
    assert sorted((r.seq, r.opened) for r in w.collect()) == [(1, 0), (2, 0), (3, 20), (4, 5), (5, 5)]
    out = B.fan_out(w, B.flush(B.batches(B.distinct_requests(w)), lambda texts: [[float(len(texts))] for _ in texts]))
    assert sorted((r.seq, r.embedding, r.error) for r in out.collect()) == [(1, [1.0], None), (2, [1.0], None), (3, [1.0], None), (4, [2.0], None), (5, [2.0], None)]


def test_recall_of_unknown_kinds_and_dates(spark):
    rows = [(1, "who", "t", "text words", "a.md", "m", "en", "x", None, None, NOW, 0, ["k"], [1.0, 0.0]), (2, "manual", "t", "text words", "b.md", "m", "en", None, "main", "stable", NOW - 86_400_000 * 20, 1, None, [1.0])]
    c = spark.createDataFrame(rows, "doc_id long, source_kind string, title string, content string, path string, module_name string, language string, symbol string, branch_name string, memory_tier string, updated_at long, chunk_index int, tags array<string>, embedding array<double>")
    c = c.selectExpr("*", "cast(null as double) as stability_score")
    votes, off = spark.createDataFrame([], "doc_id long, helpful long, noisy long, last_ms long"), spark.createDataFrame([], "doc_id long")
    asked = R.Asked("text", (1.0, 0.0), last_days=10, min_score=0.0)
    got = R.recall(c, off, votes, asked, NOW).collect()
    assert [(r.doc_id, r.source_priority, r.vector) for r in got] == [(1, 0.0, 0.6)]
    assert R.recall(c, off, votes, R.Asked("text", date_to="2023-01-01", min_score=0.0), NOW).count() == 0
    assert R.recall(c, off, votes, R.Asked("text", date_from="never", min_score=0.0), NOW).count() == 2
    assert R.recall(c.limit(0), off, votes, asked, NOW).count() == 0


def test_notes_round_trip(spark):
    rows = [("build", "t1", "m", None, "ok", None, ["a"]), ("run", "t2", None, "go", None, "all\n## Details of it", [])]
    df = spark.createDataFrame(rows, "event string, time string, model string, action string, result string, notes string, tags array<string>")
    note = N.log_note(*(df[c] for c in ("event", "time", "model", "action", "result", "notes", "tags")))
    got = [tuple(r) for r in df.select(*(c.alias(n) for n, c in N.log_fields(note).items())).collect()]
    assert got == [("t1", "m", None, "ok", "No additional notes provided.\n## Tags\n- a"), ("t2", None, "go", None, "all\n## Details of it")]
    assert spark.range(1).select(N.profile_key(*(T.F.lit(x) for x in ("n", "k", None, "u", 8)))).first()[0] == "n|k||u|8"


def test_suite_history_keeps_the_last_runs(spark):
    h = spark.createDataFrame([("p", i) for i in range(6)], "profile string, generated_at long")
    assert [r.generated_at for r in U.append(h.limit(0), h, 2).orderBy("generated_at").collect()] == [4, 5]


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="share"):
        lineage.folder(Session())
