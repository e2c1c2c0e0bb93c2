"""Registered queries over the whole of their tables, held against plain re-computations."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarrylight.operators import governance, planner
from quarrylight.operators import graph as G
from quarrylight.operators import hygiene
from quarrylight.plans import upkeep
from quarrylight.plans.registry import QUERIES


def test_components_link_all_lineitem_rows(spark, sf):
    links = {(r[0], r[1] + 10_000_000) for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey").collect()}
    parent = {x: x for p in links for x in p}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in links:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    assert {r.component: r.n for r in QUERIES["part_components"](spark, sf).collect()} == Counter(map(root, parent))


def test_two_hops_walk_module_edges(spark, sf):
    edges = [tuple(r) for r in G.build_edges(upkeep._graph_docs(spark, sf)).collect()]

    def hop(seeds, known, types, limit):
        own = defaultdict(float)
        for doc, kind, key, weight in edges:
            if doc in seeds and kind in types:
                own[kind, key] += weight
        score = defaultdict(float)
        for doc, kind, key, weight in edges:
            if doc not in known and kind in types and (kind, key) in own:
                score[doc] += weight * own[kind, key]
        best = sorted((-math.floor(v * 10**4 + 0.5) / 10**4, doc) for doc, v in score.items())[:limit]
        return {doc: -v for v, doc in best}

    one = hop({0, 1}, {0, 1}, {"module", "symbol", "tag", "branch"}, 4)
    two = hop(set(one), {0, 1} | set(one), {"module", "symbol", "tag"}, 3)
    assert {(r.doc_id, r.hop): r.score for r in QUERIES["graph_two_hops"](spark, sf).collect()} == {(d, h): v for h, got in ((1, one), (2, two)) for d, v in got.items()}


def plain_claims(text):
    """The reference's two patterns."""
    low = text.lower()
    pro = re.findall(r"\b(?:prefer|use|choose|adopt|enable|default to|standardize on)\s+([a-z0-9_/-]+)", low)
    con = re.findall(r"\b(?:avoid|disable|deprecate|reject|do not use|don't use|never use|not use)\s+([a-z0-9_/-]+)", low)
    return {("for", s) for s in pro} | {("against", s) for s in con}


def test_conflicts_of_all_verbs_pairs_and_paths(spark):
    verbs = ("prefer", "use", "choose", "adopt", "enable", "default to", "standardize on", "avoid", "disable", "deprecate", "reject", "do not use", "don't use", "never use", "not use")
    rows = [(i, "decision", f"d{i}/x/{i}.md", "t", f"{v.capitalize()} item{i % 4}.", i / 20, i) for i, v in enumerate(verbs)]
    both = "choose sqlite, disable sqlite"
    rows += [(20, "decision", "a/notes/one.md", "t", both, 0.1, 1), (21, "decision", "b\\Notes\\ONE.md", "t", both, 0.2, 1), (22, "decision", "one.md", "t", "reject sqlite", 0.3, 1), (23, "decision", "c/solo.md", "t", "choose solo and reject solo", 0.3, 1)]
    df = spark.createDataFrame(rows, "doc_id long, source_kind string, path string, title string, content string, score double, updated_at long")
    found = governance.claims(df)
    said = {r[0]: plain_claims(r[4]) for r in rows}
    assert {(r.doc_id, r.polarity, r.subject) for r in found.collect()} == {(d, *c) for d, cs in said.items() for c in cs}

    pairs = defaultdict(list)
    tail = lambda p: "/".join(re.split(r"[\\/]", p)[-2:]).lower()
    for x in rows:
        for y in rows:
            if x[0] < y[0]:
                for p, s in said[x[0]]:
                    for q, t in said[y[0]]:
                        if s == t and p != q:
                            pairs[s].append((x[0], y[0], 0.916 if tail(x[2]) == tail(y[2]) else 0.836))
    want = {}
    for s, ps in pairs.items():
        docs = len({d for p in ps for d in p[:2]})
        want[s] = (docs, len(ps), round(min(1, sum(p[2] for p in ps) / len(ps) + min(0.12, (docs - 2) * 0.05) + min(0.06, (len(ps) - 1) * 0.02)), 4))
    assert want["sqlite"][:2] == (3, 4) and "solo" not in want
    assert {r.subject: (r.docs, r.pairs, r.score) for r in governance.conflict_clusters(found).collect()} == want

    gated = planner.conflict_gate(df.where(F.col("doc_id").isin(2, 10))).collect()  # choose item2, reject item2
    assert {r.doc_id: r.suppressed for r in gated} == {2: True, 10: False}


DAY = 86_400_000
NOTES = "doc_id long, title string, content string, path string, source_kind string, memory_tier string, updated_at long"


def plain_groups(rows, least):
    """Groups of two or more, from all pairs of notes."""
    tok = lambda x: {t for t in [t for t in re.split(r"[^\w-]+", x.lower()) if len(t) >= 3][:64]}
    jac = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(rows):
        for y in rows[:i]:
            score = jac(tok(x[1]), tok(y[1])) * 0.36 + jac(tok(x[2]), tok(y[2])) * 0.34 + 0.12 * (x[3].split("/")[-2] == y[3].split("/")[-2]) + 0.08 * (x[4] == y[4]) + 0.04 * (x[5] == y[5]) + 0.06 * max(0, 1 - abs(x[6] - y[6]) / DAY / 90)
            if math.floor(score * 10**4 + 0.5) / 10**4 >= least:
                a, b = root(x[0]), root(y[0])
                parent[max(a, b)] = min(a, b)
    size = Counter(root(x) for x in parent)
    return {x: (root(x), size[root(x)]) for x in parent if size[root(x)] > 1}


def grouped(spark, rows, least):
    return {r.doc_id: (r.group_id, r.n) for r in hygiene.consolidation_groups(spark.createDataFrame(rows, NOTES), least).collect()}


@pytest.mark.parametrize("least", [0.44, 0.6, 0.8])
def test_consolidation_against_all_pairs(spark, least):
    r = random.Random(11)
    words = [f"word{i}" for i in range(400)]
    rows = [(1, "alpha", "same body of two notes", "a/x/1.md", "manual", "stable", 0), (2, "omega", "same body of two notes", "a/x/2.md", "manual", "stable", 0)]  # 0.64
    rows += [(i, "", "a b", "a/x/3.md", "manual", "stable", 0) for i in (3, 4)]  # no tokens: 0.30 among themselves
    for g in range(60):
        base = [r.choice(words) for _ in range(r.choice([3, 8, 20]))]
        for _ in range(r.choice([1, 2, 3])):
            text = [w if r.random() < 0.7 else r.choice(words) for w in base]
            for _ in range(r.choice([1, 1, 3])):
                rows.append((len(rows) + 10, " ".join(text[: r.choice([2, 4])]), " ".join(text), f"p/{r.choice('uv')}/x.md", r.choice(["manual", "diary"]), r.choice(["stable", None]), r.randrange(200) * DAY))
    want = plain_groups(rows, least)
    assert grouped(spark, rows, least) == want and (1 in want) == (least < 0.64)


def test_consolidation_of_copies_of_many_ages(spark):
    """Base score 0.77; only the old copy of the group is near the other text's old note."""
    note = lambda i, body, at: (i, "shared title here", body, "a/x/n.md", "manual", "stable", at * DAY)
    body = [f"word{i}" for i in range(34)]
    first, other = " ".join(body), " ".join(body[:22] + [f"else{i}" for i in range(10)])
    rows = [note(1, first, 199), note(2, first, 100), note(3, first, 3), note(4, other, 1), note(5, other, 60)]
    want = plain_groups(rows, 0.8)
    assert grouped(spark, rows, 0.8) == want and want[4] == (1, 5)
    assert spark.range(1).select(hygiene.nearest_times(F.array(F.lit(9).cast("long"), F.lit(1).cast("long")), F.array(F.lit(4).cast("long"), F.lit(20).cast("long")))).first()[0] == 3


def test_consolidation_hands_on_no_row_for_each_link(spark):
    """300 notes of one kind with 5 words of 12: nearly all are linked; rows handed on grow with the notes, the mean is that of all links."""
    from quarrylight.operators.note_links import PARTS, linked

    r, words = random.Random(5), [f"word{i}" for i in range(12)]
    rows = [(i, " ".join(r.sample(words, 5)), " ".join(r.sample(words, 5)) + f" own{i}", "a/x/n.md", "manual", "stable", r.randrange(100) * DAY) for i in range(1, 301)]
    sources = spark.createDataFrame(rows, NOTES)
    _, pairs = hygiene.consolidation_links(sources)
    score = [round(x.score * 10**4) for x in pairs.collect()]
    found = linked(hygiene.consolidation_classes(sources)[1], 0.44).collect()
    assert len(score) > 20_000 and len(found) <= (PARTS + 1) * 300
    assert sum(x.links for x in found) == len(score) and sum(x.total for x in found) == sum(score)
    got = hygiene.consolidation_groups(sources).collect()
    assert {(x.group_id, x.n, x.group_score) for x in got} == {(1, 300, (2 * sum(score) + len(score)) // (2 * len(score)) / 10**4)}


def test_consolidation_without_tokens_times_or_paths(spark):
    rows = [(1, None, "same body here now", None, "manual", None, None), (2, None, "same body here and", None, "manual", None, 5), (3, "same title", "same body here now", "a/x/n.md", None, "stable", None), (4, "same title", "same body here and", "a/x/n.md", None, "stable", 7), (5, None, None, None, None, None, None), (6, None, "", "a/x/n.md", None, "stable", 9)]
    sources = spark.createDataFrame(rows, NOTES)
    members, pairs = hygiene.consolidation_links(sources)
    links = sorted((x.a, x.b, x.score) for x in pairs.collect())
    assert links and {r.doc_id: r.group_id for r in hygiene.consolidation_groups(sources).collect()} == {x: min(y for y in (a, b)) for a, b, _ in links for x in (a, b)}
