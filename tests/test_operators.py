"""Literal scenarios of the planner, sessions, symbols, ordered operators and the graph."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarrylight.operators import graph as G
from quarrylight.operators import ingest as I
from quarrylight.operators import ordered as O
from quarrylight.operators import planner as P
from quarrylight.operators import sessions as N


def test_kinds_of_session(spark):
    texts = {
        "decision": "- Decided the default behavior policy: prefer the standard convention\n- Architecture rule stays\nNext: document it",
        "knowledge": "- runbook checklist with a reusable pattern\n- pitfall and gotcha guideline",
        "diary": "Implemented the parser\nFixed and tested the cache\nUpdated and verified docs\nAdded logs\nTODO later: remaining work",
        "discard": "wip scratch maybe",
    }
    rows = [*texts.items(), ("discard", None), ("discard", "")]
    got = N.distill(spark.createDataFrame(rows, "want string, session_text string")).collect()
    assert [r.kind for r in got] == [r.want for r in got]
    assert {r.kind: r.tier for r in got} == {"decision": "stable", "knowledge": "stable", "diary": "working", "discard": "cold"}
    assert got[-1].summary == N.EMPTY and got[-2].key_points == []


def test_stage_has_no_word_boundaries(spark):
    df = spark.createDataFrame([("choose a prefix",), ("qa run",), ("hello",)], "t string")
    stage = P.stage_of(F.col("t"))
    assert [r[0] for r in df.select(stage).collect()] == ["debug", "verify", "general"]
    assert [r[0] for r in df.select(P.intent_of(F.col("t"), stage)).collect()] == ["bug_fix", "general", "general"]


def test_symbols_of_languages():
    assert [n for n, _ in I.symbols_in("class A:\n    def b(self):\n        pass\n\nasync def c():\n    pass\n", "python")] == ["A", "b", "c"]
    assert [n for n, _ in I.symbols_in("export class Foo {\n  remember(x) {\n    if (x) { return 1 }\n  }\n}\nconst go = (a) => a", "typescript")][:1] == ["Foo"]
    assert "remember" in [n for n, _ in I.symbols_in("class Foo {\n  remember(x) {\n  }\n}")]
    assert I.symbols_in("def broken(:\n", "python")[0][0] == "broken" and I.symbols_in("", "python") == []


def test_symbol_of_chunk_against_brute_force(spark):
    rng = np.random.default_rng(5)
    spans = [(int(d), f"s{i}", int(rng.integers(0, 60)), i) for d in (1, 2) for i in range(12)]
    chunks = [(d, i, 10 * i, 10 * i + 10) for d in (1, 2, 3) for i in range(7)]
    got = I.symbol_for_chunk(spark.createDataFrame(chunks, "doc_id long, chunk_index int, start int, end int"), spark.createDataFrame(spans, "doc_id long, name string, at long, turn int"))

    def want(doc, start, end):
        own = sorted((at, turn, name) for d, name, at, turn in spans if d == doc)
        inside = [n for at, _, n in own if start <= at < end]
        before = [n for at, _, n in own if at <= start]
        return (inside or before or [None])[-1]

    assert {(r.doc_id, r.chunk_index): r.symbol for r in got.collect()} == {(d, i): want(d, s, e) for d, i, s, e in chunks}


def test_hash_embedding_edges():
    counts = I.HashCounts(16)
    n = counts(pd.Series(["a a b", "", None, "A"]))
    assert n[1].tolist() == n[2].tolist() == [0] * 16 and (n[0] == 2 * n[3] + counts(pd.Series(["b"]))[0]).all()
    small = I.HashCounts(16, keep=1, block=1)  # forgets all the time
    assert (small(pd.Series(["a a b", "", None, "A"])) == n).all()


def test_debounce_windows(spark):
    rows = [(1, 0, 1, 10), (1, 400, 2, 10), (1, 800, 3, 10), (1, 1190, 4, 10), (1, 1250, 5, 10), (1, 5000, 6, 10), (2, 0, 1, 6000), (2, 1, 2, 1)]
    got = O.debounced_windows(spark.createDataFrame(rows, "user_id long, at long, seq long, tokens long"), "user_id").collect()
    assert sorted((r.user_id, r.opened, r.closed, r.n) for r in got) == [(1, 0, "cap", 4), (1, 1250, "gap", 1), (1, 5000, "end", 1), (2, 0, "full", 1), (2, 1, "end", 1)]


def test_token_budget_passes_over_and_keeps_first(spark):
    rows = [("a", 1, 500), ("a", 2, 10), ("b", 1, 30), ("b", 2, 50), ("b", 3, 30)]
    got = P.token_budget(spark.createDataFrame(rows, "k string, rank int, tokens int"), ["k"], 10, 9).collect()
    assert {r.k: (r.used_tokens, r.omitted, r.kept) for r in got} == {"a": (500, 1, [1]), "b": (60, 1, [1, 3])}


def test_components_of_chains_stars_and_loops(spark):
    rng = np.random.default_rng(7)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(300, 300)] + [tuple(map(int, p)) for p in rng.integers(500, 560, (40, 2))]
    parent = {x: x for p in links for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.doc_id: r.component for r in G.components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}
    assert G.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("strict, keys", [(False, {"ts"}), (True, {"app/a.ts", "a.ts"})])
def test_path_keys(spark, strict, keys):
    doc = spark.createDataFrame([(1, "app/a.ts", None, "", None, None, ["x.Y()"])], "doc_id long, path string, module_name string, language string, branch_name string, tags array<string>, symbols array<string>")
    got = G.build_edges(doc, strict_path_keys=strict).collect()
    assert {r.target_key for r in got if r.edge_type == "path"} == keys and [r.target_key for r in got if r.edge_type == "symbol"] == ["y"]
