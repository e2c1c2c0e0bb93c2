"""Operators 11, 12 and 13 against plain re-computations, with awkward rows, empty tables and very long texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarrylight.llm import line_dedup, merkle, ranked_search
from quarrylight.llm.common import keyed, shared_dir, spill, table
from quarrylight.llm.queries import QUERIES

from .fixtures import documents, empty, rows


def key(row):
    return tuple((x is not None, str(x)) for x in row)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# ---------------------------------------------------------------- ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, top=50):
    """Every document scored for every item."""
    bags = [(d, Counter(TERM.findall(lower(t or "")))) for d, t in docs]
    n, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out, words = [], {}
    for i, t in items:
        words.setdefault(i, set()).update(TERM.findall(lower(t or "")))
    for i, own in words.items():
        found = []
        for d, bag in bags:
            s = 0
            for t in own & bag.keys():
                m = 50 + 50 * sum(bag.values()) * n // total
                s += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * bag[t] // (1000 * bag[t] + 20 * m))
            if s > 0:
                found.append((-s, d is not None, d or 0, d))
        out += [(i, k, x[3], -x[0]) for k, x in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=key)


ITEMS = [(1, "the naïve über-test of ONE two words"), (2, None), (3, ""), (4, "nowhere zzzqqq"), (5, "again and spam"), (5, "blanks odd"), (None, "the the THE of"), (7, "漢字 İ x $$$ a_b")]


def items_of(spark, items):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in items], "item_id long, text string, doc_id string, rank int")


def found(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=key)


@pytest.mark.parametrize("size", [200, 16 << 20])
def test_ranked_search_over_awkward_rows(spark, monkeypatch, size):
    monkeypatch.setattr(ranked_search, "SEGMENT_BYTES", size)
    monkeypatch.setattr(ranked_search, "SEED", 2)
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", 8)
    docs = [(d, t) for d, t, *_ in rows()]
    for top in (2, 50):
        got = found(ranked_search.search(ranked_search.build_index(documents(spark)), items_of(spark, ITEMS), top))
        assert got == ranked(docs, ITEMS, top)


def test_ranked_search_over_empty_tables(spark):
    index = ranked_search.build_index(documents(spark))
    assert found(ranked_search.search(index, items_of(spark, []))) == []
    assert found(ranked_search.search(ranked_search.build_index(empty(spark)), items_of(spark, ITEMS))) == []


def test_ranked_search_over_very_long_texts(spark):
    one_word, r = "a" * 4_000_000, random.Random(3)
    many = " ".join(r.choice(["the", "of", "spam", "x1"]) for _ in range(600_000))
    docs = [(1, one_word), (2, many), (3, "spam"), (4, one_word + "b")]
    items = [(1, "spam the"), (2, one_word)]
    got = found(ranked_search.search(ranked_search.build_index(spark.createDataFrame(docs, "doc_id long, text string")), items_of(spark, items)))
    assert got == ranked(docs, items)


def test_max_score_skips_postings_and_keeps_the_result():
    """Rare and frequent terms over 40 segments: the same top rows as the full scan from part of the postings."""
    r = random.Random(5)
    docs = [(d, " ".join(["the", "of"] * r.randrange(1, 9) + [f"w{min(int(r.expovariate(0.02)), 400)}" for _ in range(60)])) for d in range(8000)]
    items = [(i, " ".join(["the", "of"] + [f"w{r.randrange(400)}" for _ in range(6)])) for i in range(10)]
    bags = [Counter(t.split()) for _, t in docs]
    n, total, df = len(docs), sum(sum(b.values()) for b in bags), Counter(t for b in bags for t in b)
    terms = sorted({t.encode() for _, x in items for t in x.split()})
    weight = [math.floor(1000 * math.log((2 * n + 2) / (2 * df[t.decode()] + 1))) for t in terms]
    plan = [(i, [(k, weight[k]) for k, t in enumerate(terms) if t.decode() in set(x.split())]) for i, x in items]
    shard = ranked_search.Shard(plan, terms, n, total, {}, 50)
    for at in range(0, len(docs), 200):
        segment = ranked_search._Segment()
        for d, t in docs[at : at + 200]:
            segment.add(d, t)
        shard.search(ranked_search._Postings(segment.row(at).to_pylist()[0]))
    got = shard.rows().to_pylist()
    places = Counter()
    for row in got:
        places[row["item_id"]] += 1
        row["rank"] = places[row["item_id"]]
    assert sorted(((x["item_id"], x["rank"], x["doc_id"], x["score"]) for x in got), key=key) == ranked(docs, items)
    assert shard.scored < 0.7 * shard.postings


# ---------------------------------------------------------------- lines


def lines_dropped(texts, least=10):
    keys = [[lower(x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")] for t in texts]
    df = Counter(k for own in keys for k in set(own) if k)
    out = []
    for t, own in zip(texts, keys, strict=True):
        kept = [x for x, k in zip((t or "").split("\n"), own, strict=True) if df[k] < least]
        out.append((len(own), len(own) - len(kept), "\n".join(kept)))
    return out


def line_texts(seed=0):
    r = random.Random(seed)
    common = ["  Sign UP here ", "sign up HERE", "\tSIGN UP HERE\r", "İstanbul", "istanbul", "ÉA", "éa", "x" * 500, " nbsp", "\x1cfs", ""]
    out = [None, "", "\n", "\n\n", " \n\t", "only"]
    for _ in range(70):
        out.append("\n".join(r.choice(common) if r.random() < 0.4 else f"own {r.randrange(60)}" for _ in range(r.randrange(1, 9))))
    return out + [out[-1]] * 4


@pytest.mark.parametrize("heavy", [3, 10_000])
def test_lines_over_awkward_rows(spark, monkeypatch, heavy):
    monkeypatch.setattr(line_dedup, "HEAVY", heavy)
    texts = line_texts()
    data = [(None if i % 9 == 0 else i // 2, t, "k", 1, True) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(data, "doc_id long, text string, k1 string, line int, first boolean").repartition(3)
    got = sorted(map(tuple, line_dedup.drop_frequent_lines(docs).collect()), key=key)
    assert got == sorted(((d[0], *x) for d, x in zip(data, lines_dropped(texts), strict=True)), key=key)
    assert any(x[2] for x in got)


def test_lines_of_the_shared_fixture_and_of_an_empty_table(spark):
    got = sorted(map(tuple, line_dedup.drop_frequent_lines(documents(spark), min_docs=2).collect()), key=key)
    texts = [t for _, t, *_ in rows()]
    assert got == sorted(((d[0], *x) for d, x in zip(rows(), lines_dropped(texts, 2), strict=True)), key=key)
    assert line_dedup.drop_frequent_lines(empty(spark)).collect() == []


def test_lines_of_very_long_texts(spark):
    one, many = "z" * 3_000_000, "\n".join(f"l{i % 90_000}" for i in range(200_000))
    texts = [one, many] + [many[-70_000:]] * 10 + [one + "\nz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, line_dedup.drop_frequent_lines(docs).collect()))
    assert got == [(i, *x) for i, x in enumerate(lines_dropped(texts))]


def test_line_runs_are_levelled_idempotent_and_kept_by_the_folder(spark):
    root = f"{shared_dir(spark)}/lines-test-{random.random()}"
    runs = line_dedup.LineRuns(spark, root, 3)
    batches = [[(10 * b + i, f"common\nb{b}\n{'pair' if b % 2 else 'odd'}") for i in range(1 + b % 2)] for b in range(6)]
    tables = [spill(spark, line_dedup.line_hashes(keyed(spark.createDataFrame(x, "doc_id long, text string")))) for x in batches]
    for b, lines in enumerate(tables):
        assert runs.add(str(b), lines)
        assert not runs.add(str(b), lines)
    state = runs.state()[1]
    assert sorted(r["level"] for r in state["runs"]) == [1, 2]
    again = line_dedup.LineRuns(spark, root, 3)
    for run in state["runs"]:
        runs._forget(runs._name(run["path"]))  # as another session sees it
    again.vacuum()
    every = tables[0]
    for x in tables[1:]:
        every = every.union(x)
    assert sorted({r.line for r in again.frequent(spill(spark, every)).collect()}) == [0, 2]
    # "common" reached three documents with batch 1, so later batches did not add it again
    top = again._table(state["runs"][1]["path"], state["buckets"])
    assert top.agg(F.max("docs")).first()[0] <= 4
    runs.vacuum(True)


def test_line_runs_of_two_writers(spark, monkeypatch):
    root = f"{shared_dir(spark)}/lines-test-{random.random()}"
    lines = [spill(spark, line_dedup.line_hashes(keyed(spark.createDataFrame([(b, "same\nline")], "doc_id long, text string")))) for b in range(2)]
    first, second = line_dedup.LineRuns(spark, root, 2), line_dedup.LineRuns(spark, root, 2)
    write = first._write

    def slow(run, buckets):
        monkeypatch.setattr(first, "_write", write)
        assert second.add("b", lines[1])  # commits while the first one still writes
        return write(run, buckets)

    monkeypatch.setattr(first, "_write", slow)
    assert first.add("a", lines[0])
    assert first.state()[1]["batches"] == ["b", "a"]
    assert first.frequent(lines[0]).count() == 2
    first.vacuum(True)


# ---------------------------------------------------------------- manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, low=False):
    text = lower(row[4]) if low and row[4] is not None else row[4]
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (*row[:4], text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def manifest(data):
    """Rows of (doc_id, source, lang, n_chars, text) to the operator's rows, one by one."""
    trees = {}
    for lang in sorted({r[2] for r in data}, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted((r for r in data if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = own, levels([leaf(r) for r in own])
    top = levels([t[-1][0] for _, t in trees.values()]) if trees else []
    out = []
    for k, (own, tree) in enumerate(trees.values()):
        for i, r in enumerate(own):
            way = []
            for nodes, at in ((tree, i), (top, k)):
                for level in nodes[:-1]:
                    way.append((level[at // 8 * 8 : at // 8 * 8 + 8], at % 8))
                    at //= 8
            digest = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0)
            for run, s in way:
                digest = h(*run[:s], digest, *run[s + 1 :])
            proof = h(*(d for run, s in way for j, d in enumerate(run) if j != s))
            out.append((r[0], leaf(r), tree[-1][0], top[-1][0], proof, digest, digest == top[-1][0]))
    return sorted(out, key=key)


def proofs(spark, data, parts=3):
    docs = spark.createDataFrame([(*r, "k", 1) for r in data], "doc_id long, source string, lang string, n_chars long, text string, tree string, idx int")
    return sorted(map(tuple, merkle.prove_documents(docs.repartition(parts), lower_some=True).collect()), key=key)


def test_manifest_over_awkward_rows(spark):
    data = [(d, source, lang, n, t) for d, t, lang, source, n, *_ in rows()] + [(5, None, "", 0, ""), (6, "s", "né", None, "Q"), (9, "s", "N", 1, None)]
    assert proofs(spark, data) == manifest(data)
    assert proofs(spark, data[:1]) == manifest(data[:1])
    assert merkle.prove_documents(empty(spark)).collect() == []


@pytest.mark.parametrize("stride", [1, 2, 4])
def test_manifest_of_every_size(spark, monkeypatch, stride):
    """Trees that end at, before and behind a full run, over several regions, with ties and many langs."""
    monkeypatch.setattr(merkle, "STRIDE", stride)
    monkeypatch.setattr(merkle, "REGION", 3 * stride)
    data = [(i, "s", f"l{n}", 1, f"Text {i % 7}") for n in (1, 2, 7, 8, 9, 63, 64, 65, 600) for i in range(n)] + [(None, "s", "many", 1, "Same")] * 40
    assert proofs(spark, data, 5) == manifest(data)


def test_manifest_of_very_long_texts(spark):
    data = [(i, "s", "en", 1, c * 2_000_000) for i, c in enumerate(["A", "É", "a\n", " b"])]
    assert proofs(spark, data) == manifest(data)


def test_changed_text_is_found_and_only_there(spark, sf):
    got = QUERIES["op13_merkle_manifest"](spark, sf).collect()
    data = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert sorted(map(tuple, got), key=key) == manifest(data)
    changed = {d for d, *_, t in data if t and zlib.crc32(str(d).encode()) % 3 == 0 and lower(t) != t}
    assert {r.doc_id for r in got if not r.verified} == changed
