"""Components under change: equal to a full recomputation after every batch, replays, crashes, what is written."""

import random

import pytest

from quarrylight.operators import graph as G
from quarrylight.operators.lineage import folder
from quarrylight.operators.live_components import LiveComponents
from quarrylight.plans.registry import QUERIES

FORM = "a long, b long, present boolean"


@pytest.fixture()
def live(spark):
    return LiveComponents(spark, folder(spark), buckets=2)


def put(live, batch, *changes):
    return live.apply(batch, live.spark.createDataFrame(changes, FORM))


def labels(live, version=None):
    got = live.components(version).collect()
    assert len({r.doc_id for r in got}) == len(got)
    return {r.doc_id: r.component for r in got}


def plain(links):
    """Smallest id reachable of each id in a link."""
    of = {x: x for link in links for x in link}
    for _ in of:
        for a, b in links:
            of[a] = of[b] = min(of[a], of[b])
    return of


def written(live, table, batch):
    return live.store.read(table).where(f"batch = {batch}").count()


def test_ten_random_batches_equal_the_full_recomputation(spark, live):
    rng, links = random.Random(7), set()
    for batch in range(10):
        gone = rng.sample(sorted(links), len(links) // 4)
        new = {tuple(sorted(rng.sample(range(60), 2), reverse=True)) for _ in range(14)} - set(gone)
        links = links - set(gone) | new
        turned = [(b, a, True) if rng.random() < 0.5 else (a, b, True) for a, b in sorted(new)]
        put(live, batch, *turned, *((a, b, False) for a, b in gone))
        assert labels(live) == plain(links), batch
        if batch == 5:
            live.fold()
            assert labels(live) == plain(links)
    assert {(r.u, r.v) for r in live.links().collect()} == links
    full = G.components(spark.createDataFrame(sorted(links), "a long, b long"))
    assert labels(live) == {r.doc_id: r.component for r in full.collect()}


def test_a_merge_renames_fragments_and_writes_no_members(live):
    put(live, 1, *((10, n, True) for n in range(11, 40)), *((50, n, True) for n in range(51, 60)))
    put(live, 2, (30, 55, True))
    assert set(labels(live).values()) == {10}
    assert (written(live, "labels", 2), written(live, "merges", 2)) == (0, 1)
    put(live, 3, (1, 59, True), (2, 70, True))  # a smaller id gives its own to the whole
    assert set(labels(live).values()) == {1, 2} and labels(live)[39] == 1
    assert written(live, "labels", 3) == 3


def test_a_removed_link_with_a_common_neighbour_changes_no_label(live):
    put(live, 1, *((a, b, True) for a in range(6) for b in range(a)))
    before = labels(live)
    put(live, 2, (3, 4, False), (0, 5, False))
    assert labels(live) == before
    assert (written(live, "links", 2), written(live, "labels", 2), written(live, "merges", 2)) == (2, 0, 0)


def test_only_the_touched_component_is_labelled_anew(live):
    put(live, 1, (1, 2, True), (2, 3, True), (3, 4, True), (10, 11, True))
    put(live, 2, (2, 3, False))
    assert labels(live) == {1: 1, 2: 1, 3: 3, 4: 3, 10: 10, 11: 10}
    assert written(live, "labels", 2) == 4
    put(live, 3, (1, 2, False), (2, 10, True))  # 1 has no link any more; 2 goes to the others
    assert labels(live) == {2: 2, 10: 2, 11: 2, 3: 3, 4: 3}
    put(live, 4, (1, 11, True))
    assert labels(live) == {1: 1, 2: 1, 10: 1, 11: 1, 3: 3, 4: 3}


def test_awkward_batches(live):
    put(live, 1, (None, 1, True), (5, None, True), (4, 4, True), (8, 9, False), (1, 2, None))
    assert labels(live) == {} and live.links().count() == 0
    put(live, 2, (1, 2, True), (2, 1, True), (1, 2, False))  # added and removed at once: there
    assert labels(live) == {1: 1, 2: 1}
    assert put(live, 2, (1, 2, False)) is None and labels(live) == {1: 1, 2: 1}
    put(live, 3)
    put(live, 4, (1, 2, False), (-9_000_000_000, 9_000_000_000, True))
    assert labels(live) == {-9_000_000_000: -9_000_000_000, 9_000_000_000: -9_000_000_000}
    put(live, 5, (-9_000_000_000, 9_000_000_000, False))
    live.fold()
    assert labels(live) == {}


def test_a_crash_before_the_commit_leaves_nothing_and_is_repeated(live, monkeypatch):
    put(live, 1, (1, 2, True), (2, 3, True))
    version = live.store.state()["version"]
    with monkeypatch.context() as m:
        m.setattr(live.store.log, "append", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            put(live, 2, (2, 3, False))
    assert labels(live) == {1: 1, 2: 1, 3: 1}
    put(live, 2, (2, 3, False))
    assert labels(live) == {1: 1, 2: 1} and labels(live, version) == {1: 1, 2: 1, 3: 1}


def test_a_batch_between_reading_and_committing_is_taken_into_account(live):
    put(live, 1, (1, 2, True), (5, 6, True))
    own, first = live.store._append, []

    def late(state, entry):
        if not first:
            first.append(True)
            other = LiveComponents(live.spark, live.store.root, buckets=2)
            other.store.commit("other", [("append", "links", live.spark.createDataFrame([(6, 2, True, 2)], "u long, v long, present boolean, batch long")), ("append", "merges", live.spark.createDataFrame([(5, 1, 2)], "fragment long, component long, batch long"))])
        return own(state, entry)

    live.store._append = late
    put(live, 3, (6, 7, True))
    assert labels(live) == {1: 1, 2: 1, 5: 1, 6: 1, 7: 1}


def test_thread_components_query_against_plain_runs(spark, sf):
    turns = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        turns[r.conv_id * 1_000_000 + r.turn] = (r.role, len(r.text))
    every = [(t, t + 1) for t in turns if t + 1 in turns]
    border = lambda a, b: turns[a][0] == "assistant" and turns[b][0] == "user"
    whole, now = plain(every), plain([(a, b) for a, b in every if not border(a, b) or turns[b][1] < turns[a][1]])
    got = {r.turn_id: (r.whole, r.exchange) for r in QUERIES["thread_components"](spark, sf).collect()}
    assert got == {t: (w, now.get(t)) for t, w in whole.items()} and got
