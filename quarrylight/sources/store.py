"""A versioned store of tables: snapshots, atomic commits over several tables, conflict detection, compaction.

A store is a folder that driver and executors share. Rows are Parquet files in parts; a part belongs to a
bucket of its table, the hash of the row's key. A commit names, for each table, the parts that go and
the parts that come, and becomes visible by one entry of the ``CommitLog``: what several tables need together
(a note's chunks, manifest and edges) is never seen half. Data written by a commit that never came, after a
crash or a lost race, is in no snapshot and goes with ``vacuum``.

A commit that finds others before it goes on if they touched other buckets, and is made anew on the new
snapshot if they touched the same. An application's sequence number (``txn``) makes replays of a commit void.
Every ``FULL`` entries the log holds the whole state, so a reader opens a few entries only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .commits import CommitLog

FULL = 16
#: Tasks that write one bucket.
SPREAD = 4
BUCKET = "_bucket"
EMPTY: dict = {"tables": {}, "txns": {}, "floor": 0}


class Conflict(RuntimeError):
    """Another writer kept changing the same rows."""


class Store:
    """Tables under ``root``. ``buckets`` holds for tables created by this object."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.log = CommitLog(spark, f"{self.root}/log")

    # ------------------------------------------------------------ snapshots

    def state(self, version: int | None = None) -> dict:
        """Tables (schema, key, buckets, parts by bucket) and transactions at a version; the newest without one."""
        last = self.log.latest() if version is None else version
        entries, at = [], last
        while at >= 0:
            entry = self.log.read(at)
            entries.append(entry)
            if "state" in entry:
                break
            at -= 1
        out = {"tables": {}, "txns": {}, "floor": 0}
        for entry in reversed(entries):
            out = entry["state"] if "state" in entry else _applied(out, entry)
        return out | {"version": last}

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table's rows in a snapshot; versions that were vacuumed can't be read."""
        state = self.state(version)
        if state["version"] < self.state()["floor"]:
            raise ValueError(f"version {state['version']} was vacuumed")
        return self._rows(state["tables"][table], None)

    def history(self) -> list[tuple[int, str]]:
        """(version, operation) of every commit."""
        return [(v, self.log.read(v)["operation"]) for v in self.log.versions()]

    def _rows(self, table: dict, only: set[str] | None) -> DataFrame:
        schema = StructType.fromJson(table["schema"])
        paths = [f"{self.root}/data/{p}" for b, parts in sorted(table["parts"].items()) if only is None or b in only for p in parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # ------------------------------------------------------------ commits

    def create(self, table: str, schema: str, key: tuple[str, ...] = ()) -> None:
        """A new table; rows without a key are dealt by their whole content. Nothing if it is there with the same form."""
        kind = self.spark.createDataFrame([], schema).schema
        form = {"schema": kind.jsonValue(), "key": list(key), "buckets": self.buckets}
        while True:
            state = self.state()
            known = state["tables"].get(table)
            if known is not None:
                if {k: known[k] for k in ("schema", "key")} != {k: form[k] for k in ("schema", "key")}:
                    raise ValueError(f"{table} has another form")
                return
            if self._append(state, {"operation": f"create {table}", "create": {table: form}, "changes": {}}):
                return

    def commit(self, operation: str, steps: list[tuple[str, str, DataFrame]], txn: tuple[str, int] | None = None, tries: int = 8) -> int | None:
        """Apply (action, table, rows) to the newest snapshot; returns the version, None if ``txn`` was committed.

        Actions: ``append`` adds rows; ``replace`` adds rows and drops all rows of their keys; ``upsert`` does
        so with one row for each key (of equal keys any one stays, so give one); ``delete`` drops the rows
        of the keys; ``overwrite`` drops every row that was there. A table has one step. The rows are read once for each try and should not depend on this
        store's newest state: use ``update`` for that.
        """
        return self.update(operation, lambda _: steps, txn, tries)

    def update(self, operation: str, make: Callable[[Callable[[str], DataFrame]], list[tuple[str, str, DataFrame]]], txn: tuple[str, int] | None = None, tries: int = 8) -> int | None:
        """As ``commit`` with steps made from the snapshot: ``make`` gets a function that reads its tables.

        What it reads counts as touched as a whole: a commit of another writer to these tables makes it anew.
        """
        for _ in range(tries):
            state, seen = self.state(), set()
            if txn is not None and state["txns"].get(txn[0], -1) >= txn[1]:
                return None

            def table(name: str, state=state, seen=seen) -> DataFrame:
                seen.add(name)
                return self._rows(state["tables"][name], None)

            steps = make(table)
            if len({t for _, t, _ in steps}) < len(steps):
                raise ValueError("a table has one step in a commit")
            changes = {name: self._step(action, state["tables"][name], rows) for action, name, rows in steps}
            entry = {"operation": operation, "changes": changes, "txn": list(txn) if txn else None}
            done = self._finish(state, entry, seen)
            if done is not None:
                return done
        raise Conflict(operation)

    def _finish(self, state: dict, entry: dict, seen: set[str]) -> int | None:
        """Append the entry behind what others have committed; None if one of them touched the same."""
        while True:
            if self._append(state, entry):
                return state["version"] + 1
            for v in range(state["version"] + 1, self.log.latest() + 1):
                other = self.log.read(v)
                if _clash(entry, other, seen):
                    return None
            state = self.state()
            txn = entry.get("txn")
            if txn and state["txns"].get(txn[0], -1) >= txn[1]:
                return None

    def _append(self, state: dict, entry: dict) -> bool:
        version = state["version"] + 1
        if version % FULL == FULL - 1:
            base = {k: state[k] for k in EMPTY}
            entry = entry | {"state": _applied(base, entry)}
        return self.log.append(version, entry)

    def _step(self, action: str, table: dict, rows: DataFrame) -> dict:
        """Parts that go and come for one table, with the new ones written."""
        schema, key = StructType.fromJson(table["schema"]), table["key"]
        bucket = self._bucket(table)
        if action == "append":
            return {"drop": {}, "add": self._write(_as(rows, schema), bucket, table), "blind": True}
        if action == "overwrite":
            return {"drop": dict(table["parts"]), "add": self._write(_as(rows, schema), bucket, table)}
        if not key:
            raise ValueError("only keyed tables can be changed by key")
        keys = rows.select(*key).distinct()
        touched = {str(r[0]) for r in keys.select(bucket).distinct().collect()}  # a row for each bucket at most
        kept = self._rows(table, touched).alias("o")
        same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key]
        left = kept.join(keys.alias("n"), same, "left_anti")
        if action == "upsert":
            first = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))
            rows = _as(rows, schema).withColumn("_n", first).where("_n = 1").drop("_n")
        new = left if action == "delete" else left.unionByName(_as(rows, schema))
        return {"drop": {b: table["parts"].get(b, []) for b in touched}, "add": self._write(new, bucket, table, spread=False)}  # the join has spread them by key

    @staticmethod
    def _bucket(table: dict) -> Column:
        names = table["key"] or [f["name"] for f in table["schema"]["fields"]]
        return F.pmod(F.xxhash64(*names), F.lit(table["buckets"])).cast("int")

    def _write(self, rows: DataFrame, bucket: Column, table: dict, spread: bool = True) -> dict[str, list[str]]:
        """Write rows by bucket; a bucket's rows are spread over a few tasks, so a hot key doesn't stop one.

        Without ``spread`` rows stay where they are, which saves a shuffle, and each task writes a file for each bucket.
        """
        name = uuid.uuid4().hex
        path = f"{self.root}/data/{name}"
        whole = F.xxhash64(*[f["name"] for f in table["schema"]["fields"] if f["type"] in ("string", "long", "integer", "double")] or [F.lit(0)])
        dealt = rows.withColumn(BUCKET, bucket)
        if spread:
            dealt = dealt.withColumn("_s", F.pmod(whole, F.lit(SPREAD))).repartition(BUCKET, "_s").drop("_s")
        dealt.write.partitionBy(BUCKET).option("compression", "zstd").parquet(path)
        fs, at = self.log._fs, self.log._path
        found = [f.getPath().getName() for f in fs.listStatus(at(path)) if f.isDirectory()] if fs.exists(at(path)) else []
        return {f.split("=")[1]: [f"{name}/{f}"] for f in sorted(found) if f.startswith(f"{BUCKET}=")}

    # ------------------------------------------------------------ upkeep

    def compact(self, table: str, most: int = 1) -> int | None:
        """Write the buckets that have more than ``most`` parts as one part each; None if there are none.

        Rows that others append meanwhile stay: only the parts that were read go.
        """
        for _ in range(8):
            state = self.state()
            own = state["tables"][table]
            many = {b for b, parts in own["parts"].items() if len(parts) > most}
            if not many:
                return None
            add = self._write(self._rows(own, many), self._bucket(own), own)
            entry = {"operation": f"compact {table}", "changes": {table: {"drop": {b: own["parts"][b] for b in many}, "add": add}}, "txn": None}
            done = self._finish(state, entry, set())
            if done is not None:
                return done
        raise Conflict(f"compact {table}")

    def vacuum(self, keep: int = 1, running: set[str] = frozenset()) -> int:
        """Delete data that none of the last ``keep`` versions uses, and return the number of folders.

        Data of a commit that is still being written looks like that of a crashed one: name its folders in
        ``running``, or call this while nobody writes.
        """
        newest = self.state()
        floor = max(0, newest["version"] - keep + 1)
        live = {p.split("/")[0] for v in range(floor, newest["version"] + 1) for t in self.state(v)["tables"].values() for parts in t["parts"].values() for p in parts} | set(running)
        if not self._append(newest, {"operation": "vacuum", "changes": {}, "floor": floor, "txn": None}):
            return 0
        fs, at = self.log._fs, self.log._path
        data = at(f"{self.root}/data")
        gone = [n for n in (f.getPath().getName() for f in fs.listStatus(data)) if n not in live] if fs.exists(data) else []
        for n in gone:
            self.log.delete(f"{self.root}/data/{n}")
        return len(gone)


def _as(rows: DataFrame, schema: StructType) -> DataFrame:
    """Rows in the table's form; a column that is missing is an error, further columns are not kept."""
    return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))


def _applied(state: dict, entry: dict) -> dict:
    tables = {n: t | {"parts": dict(t["parts"])} for n, t in state["tables"].items()}
    for n, form in (entry.get("create") or {}).items():
        tables[n] = form | {"parts": {}}
    for n, change in entry["changes"].items():
        parts = tables[n]["parts"]
        for b in {*change["drop"], *change["add"]}:
            gone = set(change["drop"].get(b, []))
            left = [p for p in parts.get(b, []) if p not in gone] + change["add"].get(b, [])
            parts.pop(b, None)
            if left:
                parts[b] = left
    txns = state["txns"] | ({entry["txn"][0]: entry["txn"][1]} if entry.get("txn") else {})
    return {"tables": tables, "txns": txns, "floor": entry.get("floor", state["floor"])}


def _clash(entry: dict, other: dict, seen: set[str]) -> bool:
    """Whether ``other`` changed what ``entry`` read: a bucket that it rewrites, or a table that it was made from."""
    for n, change in other["changes"].items():
        if n in seen:
            return True
        own = entry["changes"].get(n)
        if own is None or own.get("blind"):
            continue  # appended rows stand beside whatever came
        mine, theirs = set(own["drop"]), {*change["drop"], *change["add"]}
        compacted = entry["operation"].startswith("compact ") and change.get("blind")
        if mine & theirs and not compacted:
            return True
    return bool(entry.get("txn") and other.get("txn") and entry["txn"][0] == other["txn"][0] and other["txn"][1] >= entry["txn"][1])
