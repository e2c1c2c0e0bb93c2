"""Retrieval queries against their SQL, and ordering and claim scenarios on literal rows."""

import glob
import os

import duckdb
import pytest

from quarrylight.functions import text as T
from quarrylight.operators import governance as G
from quarrylight.plans.registry import QUERIES, SQL


def plain(frame):
    rows = frame[sorted(frame.columns)].astype(object).where(frame[sorted(frame.columns)].notna(), None).values.tolist()
    return sorted(repr([float(f"{x:.9g}") if isinstance(x, float) else x for x in map(lambda v: v.item() if hasattr(v, "item") else v, r)]) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, want = QUERIES[name](spark, sf).toPandas(), con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) > 0
    assert plain(got) == plain(want)


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and entry.entry(spark).count() > 0


def test_claims_and_clusters(spark):
    rows = [(1, "Prefer sqlite for this"), (2, "avoid sqlite, it locks"), (3, "do not use sqlite"), (4, "adopt parquet")]
    found = G.claims(spark.createDataFrame(rows, "doc_id long, content string"))
    assert {(r.doc_id, r.polarity, r.subject) for r in found.collect()} == {(1, "for", "sqlite"), (2, "against", "sqlite"), (3, "against", "sqlite"), (3, "for", "sqlite"), (4, "for", "parquet")}
    got = G.conflict_clusters(found).collect()
    pairs = {(a, b) for a in (1, 3) for b in (2, 3) if a != b} | {(1, 3)}
    assert [(r.subject, r.docs, r.pairs) for r in got] == [("sqlite", 3, len({frozenset(p) for p in pairs}))]


def test_key_and_chunk_functions(spark):
    df = spark.createDataFrame([("src\\app\\Graph.ts", " " + "abcdefghij" * 250 + " ")], "p string, t string")
    r = df.select(T.normalize_key(df.p).alias("k"), T.chunk_texts(df.t).alias("c"), T.rounded(df.t.isNull().cast("int") - 0.00005).alias("x")).first()
    assert r.k == "ts" and r.x == 0.0
    assert [c.start for c in r.c] == [0, 1050, 2100] and r.c[0].content == ("abcdefghij" * 250)[:1200] and r.c[-1].content.endswith("j")
