"""Merkle manifest of a documents table (operator 13).

Leaves are numbered within their tree by a range partitioning and the counts of its parts. Then an
event-driven combine by key runs: a combiner holds, for each parent, the indexed digests of the children
it has seen. A parent's arity follows from the tree's size; when it is met, the parent's digest is an
event for its own parent, and so on upwards in the same task. Parents that a task can't complete are its
frontier. It is shuffled by the aligned region of 8 ** ``STRIDE`` nodes that the parent stands in and
combined again; every such round completes ``STRIDE`` levels more, so the number of rounds is the tree's
height by ``STRIDE``.

Each completed run keeps its children, the links back. Proofs go down the same regions: a region's runs
and the path above it meet the region's leaves, at most 8 ** ``STRIDE`` of them, in one group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, drop_spill, prepare, slices, spill

ARITY, BITS = 8, 3
STRIDE = 4
REGION = BITS * STRIDE
RUN, PARTIAL, TOP = 0, 1, 2
NODES = "kind int, tree string, size long, level int, idx long, slots binary, digest binary, children binary"
FIELDS = pa.schema([("kind", pa.int32()), ("tree", pa.string()), ("size", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("slots", pa.binary()), ("digest", pa.binary()), ("children", pa.binary())])
PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def field(value: object) -> bytes:
    """``-`` for null, else the length in UTF-8 bytes, ``:`` and the value."""
    if value is None:
        return b"-"
    raw = str(value).encode("utf-8")
    return b"%d:%b" % (len(raw), raw)


def parent_digest(children: list[bytes]) -> bytes:
    """sha256 of the children's digests as hex text."""
    return sha256("".join(map(bytes.hex, children)).encode()).digest()


def tampered(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0


def leaf_digests(docs: DataFrame, lower_some: bool = False) -> DataFrame:
    """doc_id, tree, leaf and claimed of every row; tree is ``n`` for a null lang, else ``v`` and the lang.

    claimed is the digest of the row with A-Z of its text lower-cased, where ``tampered`` picks the id and
    ``lower_some`` is set, else null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            leaf, claimed = [], []
            for doc_id, source, lang, n_chars, text in zip(*(col(b, c).to_pylist() for c in ("doc_id", "source", "lang", "n_chars", "text")), strict=True):
                head, body = b"".join(map(field, (doc_id, source, lang, n_chars))), field(text)
                leaf.append(sha256(head + body).digest())
                # bytes.lower() knows A-Z only and no field's length changes
                claimed.append(sha256(head + body.lower()).digest() if lower_some and tampered(doc_id) else None)
            yield pa.RecordBatch.from_arrays([col(b, "doc_id"), col(b, "tree"), pa.array(leaf, pa.binary()), pa.array(claimed, pa.binary())], names=["doc_id", "tree", "leaf", "claimed"])

    tree = F.coalesce(F.concat(F.lit("v"), F.col("lang").cast("string")), F.lit("n"))
    kinds = {"doc_id": "long", "source": "string", "lang": "string", "n_chars": "long", "text": "string"}
    plain = docs.select(*(F.col(c).cast(kind).alias(c) for c, kind in kinds.items())).withColumn("tree", tree)
    return plain.mapInArrow(run, "doc_id long, tree string, leaf binary, claimed binary")


def numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves``, a written table, with idx (from 0 within the tree, by ``order``) and the tree's size.

    Rows that are equal in ``order`` may stand in any order; a salt keeps many such rows out of one part.
    """
    columns = leaves.columns
    salted = spill(leaves.sparkSession, leaves.withColumn("salt", F.monotonically_increasing_id()))
    keys = ["tree", *order, "salt"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at = TaskContext.get().partitionId(), None, 0
        for b in batches:
            places = []
            for tree in col(b, "tree").to_pylist():
                at = at + 1 if tree == last else 0
                last = tree
                places.append(at)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(places, pa.int64())], names=[*b.schema.names, "part", "place"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in leaves.schema)
    sorted_parts = salted.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*columns)
    placed = spill(leaves.sparkSession, sorted_parts.mapInArrow(run, f"{kinds}, part int, place long"))
    drop_spill(leaves.sparkSession, salted)
    by_tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("rows").over(by_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = placed.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("rows"))
    parts = parts.select("tree", "part", before.alias("before"), F.sum("rows").over(by_tree).alias("size"))
    return placed.join(parts, ["tree", "part"]).select(*columns, (F.col("before") + F.col("place")).alias("idx"), "size")


class Combiner:
    """Partial parents of one task; rows of ``NODES`` come out."""

    def __init__(self) -> None:
        self.held: dict[tuple[str, int, int], tuple[int, dict[int, bytes]]] = {}
        self.rows: list[tuple] = []

    def event(self, tree: str, size: int, level: int, idx: int, digest: bytes) -> None:
        """The node ``idx`` of a level (0: leaves) is known."""
        while (width := -(-size // ARITY**level)) > 1:
            level, parent = level + 1, idx // ARITY
            key = (tree, level, parent)
            children = self.held.setdefault(key, (size, {}))[1]
            children[idx % ARITY] = digest
            if len(children) < min(ARITY, width - ARITY * parent):
                return
            del self.held[key]
            run = [children[s] for s in sorted(children)]
            digest, idx = parent_digest(run), parent
            self.rows.append((RUN, tree, size, level, idx, None, digest, b"".join(run)))
        self.rows.append((TOP, tree, size, level, idx, None, digest, None))

    def batch(self, done: bool = False) -> pa.RecordBatch:
        """Rows so far; with ``done`` the frontier as well."""
        if done:
            for (tree, level, idx), (size, children) in self.held.items():
                self.rows.append((PARTIAL, tree, size, level, idx, bytes(children), None, b"".join(children.values())))
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), FIELDS, strict=True)] if rows else [pa.array([], f.type) for f in FIELDS], schema=FIELDS)


def _from_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = Combiner()
    for b in batches:
        for tree, size, idx, leaf in zip(*(col(b, c).to_pylist() for c in ("tree", "size", "idx", "leaf")), strict=True):
            own.event(tree, size, 0, idx, leaf)
        yield own.batch()
    yield own.batch(done=True)


def _from_frontier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = Combiner()
    for b in batches:
        for tree, size, level, idx, slots, children in zip(*(col(b, c).to_pylist() for c in ("tree", "size", "level", "idx", "slots", "children")), strict=True):
            for k, slot in enumerate(slots):
                own.event(tree, size, level - 1, idx * ARITY + slot, children[32 * k : 32 * (k + 1)])
        yield own.batch()
    yield own.batch(done=True)


def region(level: Column, idx: Column, bits: int) -> Column:
    """Number of the region of 2 ** ``bits`` leaves in which a node of a level begins."""
    return F.call_function("shiftright", idx, F.greatest(F.lit(bits) - level * BITS, F.lit(0)))


def height(size: int) -> int:
    """Levels above the leaves of a tree."""
    levels = 0
    while size > 1:
        size, levels = -(-size // ARITY), levels + 1
    return levels


def build(leaves: DataFrame, rounds: int) -> DataFrame:
    """All runs and tops of the trees of ``leaves`` (tree, size, idx, leaf), as a written table's rows."""
    spark = leaves.sparkSession
    now = spill(spark, leaves.select("tree", "size", "idx", "leaf").mapInArrow(_from_leaves, NODES))
    out = now
    for r in range(1, rounds + 1):
        where = region(F.col("level"), F.col("idx"), REGION * r)
        frontier = now.where(F.col("kind") == PARTIAL).withColumn("region", where)
        now = spill(spark, frontier.repartition("tree", "region").drop("region").mapInArrow(_from_frontier, NODES))
        out = out.unionByName(now)
    return out.where(F.col("kind") != PARTIAL)


# ---------------------------------------------------------------- proofs


class Paths:
    """Ways from the nodes of one region to the root: for each run above, the siblings before and after."""

    def __init__(self, runs: pa.Table):
        self.runs, self.above, self.subroot, self.root = {}, b"", None, None
        for level, idx, digest, children, root in zip(*(runs.column(c).to_pylist() for c in ("level", "idx", "digest", "children", "root")), strict=True):
            if root is not None:
                self.above, self.subroot, self.root = children, digest, root
            else:
                self.runs[level, idx] = children
        self.known: dict[tuple[int, int], bytes] = {}

    def of(self, level: int, idx: int) -> bytes:
        """For each run from here to the root: slot, number of children and their digests."""
        found = self.known.get((level, idx))
        if found is None:
            run = self.runs.get((level + 1, idx // ARITY))
            found = self.above if run is None else bytes([idx % ARITY, len(run) // 32]) + run + self.of(level + 1, idx // ARITY)
            if level:  # leaves come once each
                self.known[level, idx] = found
        return found


def siblings(path: bytes) -> list[tuple[bytes, bytes]]:
    """Hex text of the siblings before and after, run by run, of a path."""
    out, at = [], 0
    while at < len(path):
        slot, n = path[at], path[at + 1]
        start, end, at = at + 2, at + 2 + 32 * n, at + 2 + 32 * n
        own = start + 32 * slot
        out.append((path[start:own].hex().encode(), path[own + 32 : end].hex().encode()))
    return out


def fold(leaf: bytes, way: list[tuple[bytes, bytes]]) -> bytes:
    """Root that follows from a leaf and its siblings."""
    digest = leaf
    for before, after in way:
        digest = sha256(before + digest.hex().encode() + after).digest()
    return digest


def _step(level: int):  # noqa: ANN202
    """Paths of a region's nodes of ``level`` from the path above the region."""

    def run(key: tuple, runs: pa.Table) -> pa.Table:
        paths = Paths(runs)
        tree = runs.column("tree")[0].as_py()
        nodes = [idx * ARITY + s for (lv, idx), run in paths.runs.items() if lv == level + 1 for s in range(len(run) // 32)]
        nodes = nodes or [0]  # a tree that ends below
        n = len(nodes)
        return pa.table({"tree": pa.array([tree] * n), "idx": pa.array(nodes, pa.int64()), "children": pa.array([paths.of(level, i) for i in nodes], pa.binary()), "digest": pa.array([paths.subroot] * n, pa.binary()), "root": pa.array([paths.root] * n, pa.binary())})

    return run


def _proofs(key: tuple, leaves: pa.Table, runs: pa.Table) -> pa.Table:
    """Rows of ``PROOFS`` for the leaves of a region."""
    paths, out = Paths(runs), []
    for doc_id, idx, leaf, claimed in zip(*(leaves.column(c).to_pylist() for c in ("doc_id", "idx", "leaf", "claimed")), strict=True):
        way = siblings(paths.of(0, idx))
        folded = fold(leaf if claimed is None else claimed, way)
        proof = sha256(b"".join(before + after for before, after in way)).hexdigest()
        out.append((doc_id, leaf.hex(), paths.subroot.hex(), paths.root.hex(), proof, folded.hex(), folded == paths.root))
    kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
    names = [x.split()[0] for x in PROOFS.split(", ")]
    return pa.table({n: pa.array(c, k) for n, k, c in zip(names, kinds, zip(*out, strict=True) if out else [[]] * 7, strict=True)})


def _paths(key: tuple, leaves: pa.Table, runs: pa.Table) -> pa.Table:
    """For the leaves of a region: tree, their digest and their path, as the top of a tree below needs it."""
    paths = Paths(runs)
    idx = leaves.column("idx").to_pylist()
    return pa.table({"tree": leaves.column("below"), "children": pa.array([paths.of(0, i) for i in idx], pa.binary()), "digest": leaves.column("leaf"), "root": pa.array([paths.root] * len(idx), pa.binary())})


def descend(leaves: DataFrame, nodes: DataFrame, tops: DataFrame, rounds: int, finish, schema: str) -> DataFrame:  # noqa: ANN001
    """Carry the paths above the ``tops`` (tree, children, digest, root) down to the leaves, ``STRIDE`` levels
    at a time, and hand each region's leaves and runs to ``finish``."""
    columns = ["tree", "region", "level", "idx", "digest", "children", "root"]
    runs = nodes.where(F.col("kind") == RUN).withColumn("root", F.lit(None).cast("binary"))
    above = tops.withColumn("idx", F.lit(0).cast("long"))
    for r in range(max(rounds, 1), 0, -1):
        low, high = STRIDE * (r - 1), STRIDE * r
        own = runs.where(F.col("level").between(low + 1, high)).withColumn("region", region(F.col("level"), F.col("idx"), BITS * high))
        right = own.select(*columns).unionByName(above.select("tree", F.col("idx").alias("region"), F.lit(high).alias("level"), "idx", "digest", "children", "root"))
        if r > 1:
            step = right.groupBy("tree", "region").applyInArrow(_step(low), "tree string, idx long, children binary, digest binary, root binary")
            above = spill(leaves.sparkSession, step)
        else:
            left = leaves.withColumn("region", F.call_function("shiftright", "idx", F.lit(REGION)))
            above = left.groupBy("tree", "region").cogroup(right.groupBy("tree", "region")).applyInArrow(finish, schema)
    return above


def prove_documents(docs: DataFrame, *, lower_some: bool = False) -> DataFrame:
    """A manifest over ``docs`` and every row's proof against it: the columns of ``PROOFS``.

    Leaves of a lang ascend by doc_id (null first; equal ids by digest). Repeated rows are a leaf each.
    Null fields are part of the digest; further columns are not read. Without rows there is no root and
    no proof. ``lower_some`` checks altered texts in place of the original ones, see ``leaf_digests``.
    """
    spark = docs.sparkSession
    prepare(spark)
    leaves = spill(spark, numbered(leaf_digests(docs, lower_some), ["doc_id", "leaf"]))
    rounds = -(-height(leaves.agg(F.max("size")).first()[0] or 0) // STRIDE)
    nodes = build(leaves, rounds)
    tops = nodes.where(F.col("kind") == TOP)
    upper = tops.select(F.lit("").alias("tree"), F.col("tree").alias("below"), F.col("digest").alias("leaf"))
    upper = spill(spark, numbered(upper, ["below"]))
    levels = -(-height(upper.agg(F.max("size")).first()[0] or 0) // STRIDE)
    over = build(upper, levels)
    root = over.where(F.col("kind") == TOP).select("tree", F.lit(b"").alias("children"), "digest", F.col("digest").alias("root"))
    paths = spill(spark, descend(upper, over, root, levels, _paths, "tree string, children binary, digest binary, root binary"))
    return descend(leaves, nodes, paths, rounds, _proofs, PROOFS)
