"""The best conflict pairs against all pairs."""

import random
import re

from quarrylight.operators import execution


def test_conflict_pairs_meet_across_tails_or_in_one(spark):
    rng = random.Random(5)
    rows = [(i, f"a/{i % 9}/x/{rng.randrange(40)}.md" if i % 5 else None, rng.choice(("for", "against")), f"s{i % 2}") for i in range(300)]
    found = spark.createDataFrame(rows, "doc_id long, path string, polarity string, subject string")
    out = execution.conflict_pairs(found)
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
    assert len(joins) == 2 and any(re.search(r"\(tail#\d+ = tail#\d+\)", x) and "NOT" not in x.replace("NOT (doc_id", "") for x in joins)
    tail = lambda p: p and "/".join(p.split("/")[-2:])
    every = [(-0.916 if x[1] and tail(x[1]) == tail(y[1]) else -0.836, min(x[0], y[0]), max(x[0], y[0]), x[3]) for x in rows for y in rows if x[2] == "for" and y[2] == "against" and x[3] == y[3] and x[0] != y[0]]
    assert [(-r.score, r.left_id, r.right_id, r.subject) for r in out.collect()] == sorted(every)[:10]
