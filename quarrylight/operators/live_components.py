"""Connected components of links that come and go in batches, kept in the versioned store.

A label is kept in two steps: ids belong to a fragment, fragments to a component. A batch that only adds
links looks at the components of their ends, contracts those to components of a small graph and renames
fragments; no member of a large component is written again. A removed link whose ends still have a common
neighbour changes nothing. Only the components of the other removed links are labelled anew, from their own
remaining links.

All three tables are appended to and the newest batch of a key counts; ``fold`` writes what counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import Store
from .graph import components
from .lineage import cut

#: Tables and their keys. A null fragment: the id has no link; a null component: the fragment is one itself.
TABLES = {
    "links": ("u long, v long, present boolean, batch long", ("u", "v")),
    "labels": ("doc_id long, fragment long, batch long", ("doc_id",)),
    "merges": ("fragment long, component long, batch long", ("fragment",)),
}


def _newest(rows: DataFrame, key: tuple[str, ...], value: str) -> DataFrame:
    """key, value of the newest batch."""
    return rows.groupBy(*key).agg(F.max(F.struct("batch", value)).alias("_m")).select(*key, F.col(f"_m.{value}").alias(value))


class LiveComponents:
    """Components of the links that ``apply`` was told of. Batches have rising numbers; a replay changes nothing."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.store = spark, Store(spark, root, buckets)
        for name, (schema, key) in TABLES.items():
            self.store.create(name, schema, key)

    def components(self, version: int | None = None) -> DataFrame:
        """doc_id, component (smallest id reachable); one row for each id in a link."""
        own = _newest(self.store.read("labels", version), ("doc_id",), "fragment").where("fragment is not null")
        to = _newest(self.store.read("merges", version), ("fragment",), "component").where("component is not null")
        return own.join(to, "fragment", "left").select("doc_id", F.coalesce("component", "fragment").alias("component"))

    def links(self, version: int | None = None) -> DataFrame:
        return _newest(self.store.read("links", version), ("u", "v"), "present").where("present").select("u", "v")

    def apply(self, batch: int, changes: DataFrame) -> int | None:
        """Add (present) and remove (not present) undirected links a, b; returns the store's version, None for a replay.

        Links with a null or to the same id are left out, as are removals of unknown links. A link that a
        batch both adds and removes is there after it. Everything becomes visible as a whole.
        """
        named = changes.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"), F.coalesce("present", F.lit(False)).alias("present"), "a", "b")
        wanted = cut(named.where("a <> b").groupBy("u", "v").agg(F.max("present").alias("present")))

        def steps(table):  # noqa: ANN001, ANN202
            links, labels, merges = (table(n) for n in TABLES)
            was = _newest(links.join(wanted.select("u", "v"), ["u", "v"], "left_semi"), ("u", "v"), "present").withColumnRenamed("present", "was")
            news = cut(wanted.join(was, ["u", "v"], "left").where("present <> coalesce(was, false)").select("u", "v", "present"))
            added, gone = news.where("present"), news.where("not present")
            live = _newest(merges, ("fragment",), "component").where("component is not null")

            def placed(ids: DataFrame) -> DataFrame:
                """doc_id, component of the ids that have one."""
                own = _newest(labels.join(ids, "doc_id", "left_semi"), ("doc_id",), "fragment").where("fragment is not null")
                return own.join(live, "fragment", "left").select("doc_id", F.coalesce("component", "fragment").alias("component"))

            def fragments(of: DataFrame) -> DataFrame:
                """fragment, component of the given components: those that were renamed to them, and they themselves."""
                renamed = live.join(of, "component", "left_semi").select("fragment", "component")
                return renamed.unionByName(of.select(F.col("component").alias("fragment"), "component")).distinct()

            old, torn = placed(_ends(added)), None
            relabelled, forgotten = [], []
            if not gone.isEmpty():
                torn = cut(_torn(links, gone))
                broken = cut(placed(_ends(torn)).select("component").distinct())
                pieces = cut(fragments(broken).select("fragment"))
                members = cut(_members(labels, pieces))
                # both ends of a link are in one component, so either finds it
                inside = _newest(links.join(members.select(F.col("doc_id").alias("u")), "u", "left_semi"), ("u", "v"), "present").where("present")
                left = inside.join(gone, ["u", "v"], "left_anti")
                fresh = cut(members.join(components(left, "u", "v"), "doc_id", "left"))
                relabelled.append(fresh.select("doc_id", F.col("component").alias("fragment")))
                forgotten.append(pieces)
                now = fresh.where("component is not null").join(_ends(added), "doc_id", "left_semi")
                old = old.join(members, "doc_id", "left_anti").unionByName(now)
            old = cut(old)

            met = added
            for end in ("u", "v"):
                at = old.select(F.col("doc_id").alias(end), F.col("component").alias(f"at_{end}"))
                met = met.join(at, end, "left").withColumn(f"at_{end}", F.coalesce(f"at_{end}", end))
            joined = cut(components(met.select("at_u", "at_v"), "at_u", "at_v").withColumnRenamed("component", "into").withColumnRenamed("doc_id", "component"))
            newcomers = _ends(added).join(old, "doc_id", "left_anti")
            arrived = newcomers.join(joined.withColumnRenamed("component", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("into", "doc_id").alias("fragment"))
            moved = joined.where("component <> into").join(newcomers.select(F.col("doc_id").alias("component")), "component", "left_anti")
            # fragments of a broken component are gone; a fresh component is its only fragment
            names = fragments(moved.select("component"))
            if forgotten:
                stale = forgotten[0]
                names = names.where("fragment <> component").join(stale, "fragment", "left_anti").unionByName(names.where("fragment = component"))
            renamed = names.join(moved, "component").select("fragment", F.col("into").alias("component"))

            own = arrived
            for rows in relabelled:
                own = own.unionByName(rows.join(arrived, "doc_id", "left_anti"))
            to = renamed
            for rows in forgotten:
                none = rows.join(renamed, "fragment", "left_anti")
                to = to.unionByName(none.select("fragment", F.lit(None).cast("long").alias("component")))
            number = F.lit(batch).cast("long").alias("batch")
            return [("append", "links", news.select("*", number)), ("append", "labels", own.select("*", number)), ("append", "merges", to.select("*", number))]

        return self.store.update(f"links {batch}", steps, txn=("links", batch))

    def fold(self) -> int | None:
        """Write what counts of each table and forget the rest; older versions stay readable until ``vacuum``."""

        def steps(table):  # noqa: ANN001, ANN202
            out = []
            for name, (_, key) in TABLES.items():
                value = {"links": "present", "labels": "fragment", "merges": "component"}[name]
                rows = table(name).groupBy(*key).agg(F.max(F.struct("batch", value)).alias("_m")).select(*key, "_m.*")
                out.append(("overwrite", name, rows.where("present" if name == "links" else f"{value} is not null")))
            return out

        return self.store.update("fold links", steps)


def _ends(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()


def _members(labels: DataFrame, fragments: DataFrame) -> DataFrame:
    """doc_id of all that belong to the fragments now, of all their labels only those that ever named one are compared."""
    ever = labels.join(fragments, "fragment", "left_semi").select("doc_id").distinct()
    now = _newest(labels.join(ever, "doc_id", "left_semi"), ("doc_id",), "fragment")
    return now.join(fragments, "fragment", "left_semi").select("doc_id")


def _torn(links: DataFrame, gone: DataFrame) -> DataFrame:
    """Removed links whose ends have no common neighbour by what remains.

    A link's ends bring their own neighbours, so rows grow with their degrees, not with the degrees' product.
    """
    ends = _ends(gone)
    near = links.join(ends.withColumnRenamed("doc_id", "u"), "u", "left_semi").unionByName(links.join(ends.withColumnRenamed("doc_id", "v"), "v", "left_semi"))
    alive = _newest(near, ("u", "v"), "present").where("present").join(gone, ["u", "v"], "left_anti").select("u", "v")
    both = cut(alive.select(F.col("u").alias("end"), F.col("v").alias("next")).unionByName(alive.select(F.col("v").alias("end"), F.col("u").alias("next"))))
    sides = [gone.select("u", "v", F.col(s).alias("end")).join(both, "end").select("u", "v", "next", F.lit(s).alias("side")) for s in ("u", "v")]
    common = sides[0].unionByName(sides[1]).groupBy("u", "v", "next").agg(F.min("side").alias("low"), F.max("side").alias("high")).where("low <> high")
    return gone.join(common, ["u", "v"], "left_anti").select("u", "v")
