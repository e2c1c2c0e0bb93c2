"""Terms in texts against a plain search."""

import random

import pytest

from quarrylight.operators import records
from quarrylight.plans.registry import QUERIES


@pytest.mark.parametrize("few", [0, 100])
def test_terms_that_names_share(spark, monkeypatch, few):
    monkeypatch.setattr(records, "FEW_TERMS", few)
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abé") for _ in range(n))
    texts = [(i if i % 10 else None, word(rng.randrange(12))) for i in range(80)] + [(81, None), (82, "")]
    terms = [(f"n{i % 7}" if i % 9 else None, word(rng.randrange(5))) for i in range(60)] + [("x", None), ("n1", "ab"), ("n2", "ab")]
    got = records.match_terms(spark.createDataFrame(texts, "k int, x string"), spark.createDataFrame(terms, "name string, t string"), "k", "x", "name", "t").collect()
    assert len(got) == len(set(got)) and set(got) == {(k, n) for k, x in texts for n, t in terms if x and t and t in x}


def test_domain_matches_shuffle_no_grams(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["domain_matches"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
