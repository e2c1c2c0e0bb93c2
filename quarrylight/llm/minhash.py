"""MinHash near-dedup by a signature-coordinate inverted join (operator 10).

Documents with equal shingle sets are one class; only one representative of each goes on. A signature
has ``COORDINATES`` values. Representatives are posted under each (coordinate, value) pair. Pairs that
agree in at least ``MATCHES`` coordinates must meet under one of the rarest ones of each document, so a
document is posted under that prefix only, and values that occur once are skipped: they use up the
prefix without a posting. Two sets with Jaccard similarity 0.8 agree in fewer than ``MATCHES``
coordinates with probability below 1e-5, and less above it; sets of a few shingles are no exception.

Collisions are counted in the posting lists, never for all pairs of a list at once. First each list has
one hub, and a document's collisions with the hubs of its lists are counted; with the hub it collides
with most often it becomes a pair. The longer lists that the prefix skips aren't merged but probed: the
signature tells whether a document is in them. Pairs at the match threshold whose full sets confirm the
link are contracted to components. Lists that still span components are settled group by group, a group
being the lists whose hub lies in one component: the members outside that component meet all members in
blocks of bounded size. A block is a small inverted join: the shorter lists of each document are merged
into collision counts, the ``MATCHES`` - 1 longest are probed for the pairs that have met so far, and
pairs that can't reach the threshold any more are left. The intersections of what remains are counted by
a matrix product, and one link for each pair of components leaves the task. Of two documents in
different components that meet in a list, one lies outside its hub's component, so no pair is left out,
and no pairs are written as rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U, Rolling, buffers, byte_values, col, drop_spill, keyed, mix, slices, spill, word_bounds
from .components import components

COORDINATES, MATCHES = 48, 24
#: Documents of a block, bytes of their full sets, and postings of a list that one task takes from a join.
BLOCK, BLOCK_BYTES, SALT = 1024, 32 << 20, 1024
LOWERED = byte_values(5)
LOWERED[65:91] = LOWERED[97:123]  # A-Z count as a-z
SEEDS = mix(np.arange(COORDINATES, dtype=np.uint64) + U(77))
TIMES = mix(np.arange(COORDINATES, dtype=np.uint64) + U(7777)) | U(1)


def shingle_sets(arr: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, joined, and the texts' offsets in them."""
    data, off = buffers(arr)
    start, end, first = word_bounds(data, off)
    words = Rolling(LOWERED[data]).spans(start, end) if len(data) else np.zeros(0, np.uint64)
    grams = Rolling(words).fixed(size) if len(words) else np.zeros(0, np.uint64)
    sets, at = [], [0]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            s = np.unique(grams[a : b - size + 1])
        elif b > a:  # fewer words than a shingle: the whole sequence is one
            s = mix(Rolling(words[a:b]).fixed(b - a) + U(b - a))
        else:
            s = np.zeros(0, np.uint64)
        sets.append(s)
        at.append(at[-1] + len(s))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.array(at)


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, k1, k2, n (set size), d1, d2 (set digest), signature (little-endian uint32) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            flat, at = shingle_sets(col(b, "text"), size)
            n = np.diff(at)
            some = np.flatnonzero(n)
            d = np.zeros((2, len(n)), np.uint64)
            signature = np.zeros((len(n), COORDINATES), np.uint32)
            if len(some):
                for k in (0, 1):
                    d[k, some] = np.add.reduceat(mix(flat + U(k + 1)), at[some])
                for k in range(COORDINATES):
                    signature[some, k] = np.minimum.reduceat((flat ^ SEEDS[k]) * TIMES[k] >> U(32), at[some])
            yield pa.RecordBatch.from_arrays(
                [*(col(b, c) for c in ("doc_id", "k1", "k2")), pa.array(n), pa.array(d[0].view(np.int64)), pa.array(d[1].view(np.int64)), pa.array([s.tobytes() for s in signature], pa.binary())],
                names=["doc_id", "k1", "k2", "n", "d1", "d2", "signature"],
            )

    return keyed(docs).select("doc_id", "k1", "k2", "text").mapInArrow(run, "doc_id long, k1 long, k2 long, n long, d1 long, d2 long, signature binary")


def coordinate_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        values = np.frombuffer(b"".join(col(b, "signature").to_pylist()), np.uint32).reshape(-1, COORDINATES).astype(np.int64)
        keys = values + (np.arange(COORDINATES) << 32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * COORDINATES, pa.int32()), pa.array(keys.ravel()))
        yield pa.RecordBatch.from_arrays([col(b, "node"), col(b, "n"), lists], names=["node", "n", "keys"])


def matching(least: int):
    """Keep the pairs that agree in at least ``least`` coordinates: their counted collisions, or those with the lists probed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, two = (np.frombuffer(b"".join(col(b, c).to_pylist()), np.uint32).reshape(-1, COORDINATES) for c in ("sig_u", "sig_v"))
            enough = col(b, "met").to_numpy() >= least
            enough[~enough] = (one[~enough] == two[~enough]).sum(1) >= least
            keep = pa.array(enough)
            yield pa.RecordBatch.from_arrays([col(b, "u").filter(keep), col(b, "v").filter(keep)], names=["u", "v"])

    return run


def alike(percent: int):
    """Keep the pairs whose full sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for one, two in zip(col(b, "set_u"), col(b, "set_v"), strict=True):
                x, y = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(two.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([col(b, "u").filter(keep), col(b, "v").filter(keep)], names=["u", "v"])

    return run


def intersections(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each of ``one`` with each of ``two``, by products of 0/1 columns."""
    flat, rows, out = [], [], np.zeros((len(one), len(two)), np.float32)
    common = np.intersect1d(np.concatenate(one), np.concatenate(two))
    for sets in (one, two):
        x, r = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(common, x)
        at[at == len(common)] = 0
        keep = common[at] == x if len(common) else np.zeros(len(x), bool)
        at, r = at[keep], r[keep]
        order = np.argsort(at, kind="stable")
        flat.append(at[order])
        rows.append(r[order])
    for first in range(0, len(common), 2048):
        parts = []
        for at, r, sets in zip(flat, rows, (one, two), strict=True):
            x, y = np.searchsorted(at, (first, first + 2048))
            m = np.zeros((len(sets), min(2048, len(common) - first)), np.float32)
            m[r[x:y], at[x:y] - first] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def collisions(outer: np.ndarray, inner: np.ndarray, part_outer: np.ndarray, part_inner: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of ``outer``, row of ``inner``) of different parts that agree in at least ``least`` coordinates.

    The inner rows are posted under their (coordinate, value) keys. Of each outer row the ``least`` - 1
    longest lists are skipped; the others are merged, one list of each row at a time. Then the skipped
    lists are probed for the pairs that have met, as long as these can still reach ``least``. Lists
    without a row of another part are empty.
    """
    base = np.arange(COORDINATES, dtype=np.int64) << 32
    keys = (inner.astype(np.int64) + base).ravel()
    by_key = np.argsort(keys, kind="stable")
    row = by_key // COORDINATES
    names, start, size = np.unique(keys[by_key], return_index=True, return_counts=True)
    low, high = (f.reduceat(part_inner[row], start) for f in (np.minimum, np.maximum))
    asked = outer.astype(np.int64) + base
    at = np.minimum(np.searchsorted(names, asked), len(names) - 1)
    other = (low[at] != part_outer[:, None]) | (high[at] != part_outer[:, None])
    length = np.where((names[at] == asked) & other, size[at], 0)
    order = np.argsort(length, axis=1, kind="stable")
    merged = COORDINATES - least + 1
    met = np.zeros((len(outer), len(inner)), np.uint8)
    for k in order[:, :merged].T:  # no pair twice: one list of each row
        i = np.flatnonzero(length[np.arange(len(k)), k])
        n = length[i, k[i]]
        turn = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        met[np.repeat(i, n), row[np.repeat(start[at[i, k[i]]], n) + turn]] += 1
    i, j = np.nonzero(met)
    keep = part_outer[i] != part_inner[j]
    i, j = i[keep], j[keep]
    count = met[i, j].astype(np.int64)
    for turn in range(merged, COORDINATES):
        keep = count + (COORDINATES - turn) >= least
        i, j, count = i[keep], j[keep], count[keep]
        k = order[i, turn]
        count += outer[i, k] == inner[j, k]
    keep = count >= least
    return i[keep], j[keep]


def promising(percent: int, least: int):
    """The documents of a cell that agree with one of another component in at least ``least`` coordinates."""

    def run(cell: pa.Table) -> pa.Table:
        part, outer, n = (cell[c].to_numpy() for c in ("part", "outer", "n"))
        signature = np.frombuffer(b"".join(cell["signature"].to_pylist()), np.uint32).reshape(-1, COORDINATES)
        a, b = np.flatnonzero(outer), np.flatnonzero(~outer)
        keep = np.zeros(len(part), bool)
        if len(a) and len(b):
            i, j = collisions(signature[a], signature[b], part[a], part[b], least)
            i, j = a[i], b[j]
            near = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
            keep[i[near]] = keep[j[near]] = True
        return pa.table({c: cell[c].combine_chunks().filter(pa.array(keep)) for c in ("home", "node", "part", "n")})

    return run


def across(percent: int):
    """One link (u, v) for each pair of components that the documents of a cell link."""

    def run(cell: pa.Table) -> pa.Table:
        part, node, outer = (cell[c].to_numpy() for c in ("part", "node", "outer"))
        sets = [np.frombuffer(x, np.uint64) for x in cell["shingles"].to_pylist()]
        n = np.array([len(x) for x in sets])
        a, b = np.flatnonzero(outer), np.flatnonzero(~outer)
        u = v = np.zeros(0, np.int64)
        if len(a) and len(b):
            both = intersections([sets[i] for i in a], [sets[i] for i in b]).astype(np.int64)
            i, j = np.nonzero((100 * both >= percent * (n[a][:, None] + n[b][None, :] - both)) & (part[a][:, None] != part[b][None, :]))
            i, j = a[i], b[j]
            if len(i):
                _, first = np.unique(np.stack([part[i], part[j]]), axis=1, return_index=True)
                u, v = node[i[first]], node[j[first]]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, and k1, k2, part, for every document.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text with A-Z lower-cased. A document's set holds its
    distinct shingles of ``size`` words; with fewer words the whole sequence is one, and without words
    (or with a null text) the set is empty and linked with nothing. Documents are linked if their sets'
    Jaccard similarity is at least ``percent`` / 100. component_id is the smallest doc_id reachable. A
    null doc_id is the smallest only among nulls. Repeated rows are linked with each other. part numbers
    the component itself, whatever its ids (null: no words).
    """
    spark = docs.sparkSession
    base = spill(spark, sketch(docs, size))
    kind = ["d1", "d2", "n"]
    classes = base.where("n > 0").groupBy(*kind).agg(
        F.min("doc_id").alias("least"), F.min(F.struct("k1", "k2")).alias("at"), F.first("signature").alias("signature")
    )
    reps = spill(spark, classes.withColumn("node", F.monotonically_increasing_id()))

    posted = reps.select("node", "n", "signature").mapInArrow(coordinate_keys, "node long, n long, keys array<long>")
    posted = posted.select("node", "n", F.explode("keys").alias("key"))
    common = spill(spark, posted.groupBy("key").agg(F.count(F.lit(1)).alias("often")).where("often > 1"))
    shared = F.sort_array(F.collect_list(F.struct("often", "key"))).alias("keys")
    ranked = posted.join(common, "key").groupBy("node").agg(shared, F.first("n").alias("n"))
    # all COORDINATES keys in ascending frequency would have a prefix of COORDINATES - MATCHES + 1; the single ones come first
    prefix = F.explode(F.expr(f"slice(keys, 1, size(keys) - {MATCHES - 1})")).alias("posting")
    lists = spill(spark, ranked.where(F.size("keys") >= MATCHES).select("node", "n", prefix).select("node", "n", "posting.key", "posting.often"))

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # repeated rows come to one task
        for b in slices(batches, "text"):
            new = [i for i, x in enumerate(col(b, "node").to_pylist()) if x not in seen and not seen.add(x)]
            b = b.take(pa.array(new, pa.int64()))
            flat, at = shingle_sets(col(b, "text"), size)
            sets = [flat[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([col(b, "node"), pa.array(sets, pa.binary())], names=["node", "shingles"])

    def full_sets(nodes: DataFrame) -> DataFrame:
        """node, shingles of the given nodes, from their texts."""
        place = ("node", F.col("at.k1").alias("k1"), F.col("at.k2").alias("k2"))
        chosen = reps.join(nodes.distinct(), "node", "left_semi").select(*place)
        rows = keyed(docs).select("k1", "k2", "text").join(chosen.hint("shuffle_hash"), ["k1", "k2"])
        return spill(spark, rows.select("node", "text").mapInArrow(full, "node long, shingles binary"))

    known = reps.select("node", "signature")

    # collisions of everyone with the hubs of its lists, a list's hub being its least member by a fixed hash;
    # a long list meets its hub in several tasks
    order = F.xxhash64(F.lit(5), "node")
    deal = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "node"), n).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    salts = F.ceil(F.col("often") / SALT).cast("int")
    hubs = lists.groupBy("key", "often").agg(F.min(F.struct(order.alias("order"), "node", "n")).alias("hub")).select("key", "hub", spread(salts).alias("salt"))
    meets = lists.select("node", "n", "key", deal(2, salts).alias("salt")).join(hubs, ["key", "salt"])
    counted = meets.where("node <> hub.node").groupBy("node", "n", "hub").agg(F.count(F.lit(1)).alias("met"))
    best = counted.groupBy("node", "n").agg(F.max(F.struct("met", "hub")).alias("best")).select("node", "n", "best.met", F.col("best.hub.node").alias("hub"), F.col("best.hub.n").alias("n_hub"))
    near = best.where(f"100 * least(n, n_hub) >= {percent} * greatest(n, n_hub)")
    pairs = near.select(F.greatest("node", "hub").alias("u"), F.least("node", "hub").alias("v"), F.col("met").cast("int").alias("met"))
    for end in ("u", "v"):
        pairs = pairs.join(known.select(F.col("node").alias(end), F.col("signature").alias(f"sig_{end}")), end)
    close = spill(spark, pairs.select("u", "v", "met", "sig_u", "sig_v").mapInArrow(matching(MATCHES), "u long, v long"))
    sets = full_sets(close.select(F.col("u").alias("node")).union(close.select("v")))
    both = close
    for end in ("u", "v"):
        both = both.join(sets.select(F.col("node").alias(end), F.col("shingles").alias(f"set_{end}")), end)
    links = spill(spark, both.mapInArrow(alike(percent), "u long, v long"))
    labels = spill(spark, components(links))
    drop_spill(spark, common, close, sets)

    # lists that still span components, by the component of their hub
    here = lists.join(labels, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("part"))
    mixed = here.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.min_by("part", order).alias("home"))
    mixed = spill(spark, mixed.where("low <> high").select("key", "home"))
    members = spill(spark, here.join(mixed, "key").select("home", "node", "part", "n").distinct())

    def cells(members: DataFrame, values: DataFrame, sets: bool) -> DataFrame:
        """Blocks of the members outside their home (outer) against blocks of all its members.

        For signatures, homes of one block share a cell with others, about ``BLOCK`` members in each: what
        meets there by chance is only compared once more, and none of a home's own pairs is lost.
        """

        def count(mine) -> Column:
            rows = F.ceil(F.count(F.when(mine, 1)) / BLOCK)
            size = F.ceil(F.coalesce(F.sum(F.when(mine, F.col("n"))), F.lit(0)) * 8 / BLOCK_BYTES) if sets else F.lit(1)
            return F.greatest(F.lit(1), rows, size).cast("int")

        sizes = spill(spark, members.groupBy("home").agg(count(F.lit(True)).alias("all"), count(F.col("part") != F.col("home")).alias("out")))
        bundles = -(-members.count() // BLOCK) or 1
        shared = F.lit(not sets) & (F.col("all") == 1) & (F.col("out") == 1)
        bundle = F.pmod(F.xxhash64(F.lit(6), "home"), F.lit(bundles))
        placed = members.join(sizes, "home").withColumn("shared", shared).withColumn("cell", F.when(F.col("shared"), bundle).otherwise(F.col("home")))
        shape = ("home", "node", "part", "n", "shared", "cell")
        outer = placed.where("part <> home").select(*shape, F.lit(True).alias("outer"), deal(3, F.col("out")).alias("i"), spread(F.col("all")).alias("j"))
        inner = placed.select(*shape, F.lit(False).alias("outer"), deal(4, F.col("all")).alias("j"), spread(F.col("out")).alias("i"))
        return outer.unionByName(inner).join(values, "node").groupBy("shared", "cell", "i", "j")

    hopeful = cells(members, known, False).applyInArrow(promising(percent, MATCHES), "home long, node long, part long, n long")
    close = spill(spark, hopeful.distinct())
    sets = full_sets(close.select("node"))
    more = spill(spark, cells(close, sets, True).applyInArrow(across(percent), "u long, v long"))
    labels = spill(spark, components(links.unionByName(more)))
    drop_spill(spark, lists, mixed, members, close, sets, links, more)

    parts = reps.join(labels, "node", "left").select(*kind, "least", F.coalesce("component", "node").alias("part"))
    lowest = spill(spark, parts.groupBy("part").agg(F.min("least").alias("component_id")))  # so that a large part can be split
    result = base.select("doc_id", "k1", "k2", *kind).join(parts.join(lowest, "part").select(*kind, "component_id", "part"), kind, "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return result.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "k1", "k2", "part")
