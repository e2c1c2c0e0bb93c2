"""Answers of the request broker, call by call."""

from collections import defaultdict

from quarrylight.operators import broker


def test_broker_calls_without_a_pandas_group_for_each_batch(spark):
    rows = [(None if i % 3 else "p", i // 7 * 1000, f"h{i}", f"t{i % 5}", i % 7 // 3, i % 7 % 3) for i in range(700)]
    asked = spark.createDataFrame(rows, "profile_key string, opened long, content_hash string, text string, batch int, index int")

    def provider(texts):
        if len(texts) == 1:
            raise RuntimeError("alone")
        return [[float(len(t)), float(i)] for i, t in enumerate(texts)]

    out = broker.flush(asked, provider)
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
    calls = defaultdict(list)
    for k, opened, digest, text, batch, index in rows:
        calls[k, opened, batch].append((index, digest, text))
    want = {(k, opened, h): (None, "RuntimeError: alone") if len(own) == 1 else ([float(len(t)), float(i)], None) for (k, opened, _), own in calls.items() for i, (_, h, t) in enumerate(sorted(own))}
    assert {(r.profile_key, r.opened, r.content_hash): (r.embedding, r.error) for r in out.collect()} == want
