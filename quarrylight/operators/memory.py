"""The engine's tables as a versioned store: what notes, checkpoints, exports and suites write, committed as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import Store
from . import graph as G
from . import notes as N

#: Tables and their keys. A document's chunks and edges are replaced together, by its id.
TABLES = {
    "manifests": ("doc_id string, path string, source_kind string, title string, checksum string, memory_tier string, stability_score double, updated_at long", ("doc_id",)),
    "chunks": ("doc_id string, chunk_index int, source_kind string, path string, title string, content string, tags array<string>, module_name string, updated_at long", ("doc_id",)),
    "edges": ("doc_id string, edge_type string, target_key string, weight double", ("doc_id",)),
    "disabled": ("doc_id string, reason string", ("doc_id",)),
    "votes": ("doc_id string, helpful long, noisy long, last_ms long", ("doc_id",)),
    "cache": ("profile_key string, content_hash string, embedding array<double>, updated_at long", ("profile_key", "content_hash")),
    "checkpoints": ("project string, id string, updated_at long, record string", ()),
    "active_checkpoints": ("project string, id string, updated_at long, record string", ("project",)),
    "exports": ("export_id string, doc_id string, source_kind string, path string, content string", ()),
    "suite_runs": ("profile string, at long, project string, status string, index_ms double, recall_ms double", ()),
}


class Memory:
    """Reads and writes of a project's memory. Every write is one commit; ``txn`` (writer, number) makes a replay void."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.store = Store(spark, root, buckets)
        for name, (schema, key) in TABLES.items():
            self.store.create(name, schema, key)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self.store.read(table, version)

    def remember(self, notes: DataFrame, root: str, at_ms: int, txn: tuple[str, int] | None = None) -> int | None:
        """Documents of ``notes.remember`` with their chunks and edges."""
        docs = N.remember(notes, root, at_ms)
        docs = docs.withColumn("updated_at", F.col("updated_at").cast("long"))
        cut = docs.select("*", F.posexplode(T.chunk_texts(F.col("content"))).alias("chunk_index", "c")).withColumn("content", F.col("c.content"))
        whole = docs.withColumns({"language": F.lit("markdown"), "branch_name": F.lit(None).cast("string"), "symbols": F.array().cast("array<string>")})
        # a document may have no chunk or edge now that had some: its old rows go by the key table
        gone = docs.select("doc_id")
        return self.store.commit("remember", [("upsert", "manifests", docs), ("replace", "chunks", _or_key(cut, gone, TABLES["chunks"][0])), ("replace", "edges", _or_key(G.build_edges(whole), gone, TABLES["edges"][0]))], txn)

    def forget(self, paths: DataFrame, txn: tuple[str, int] | None = None) -> int | None:
        """Drop the documents at ``paths`` from every table that holds them."""

        def steps(table):  # noqa: ANN001, ANN202
            found = N.find_by_path(paths, table("manifests"), _present(table("chunks"))).where("doc_id is not null").select("doc_id")
            return [("delete", t, found) for t in ("manifests", "chunks", "edges", "disabled", "votes")]

        return self.store.update("forget", steps, txn)

    def switch(self, orders: DataFrame, at_ms: int, txn: tuple[str, int] | None = None) -> int | None:
        """Orders (doc_id, action, reason) to disable or enable; disabling adds a noisy vote."""

        def steps(table):  # noqa: ANN001, ANN202
            known = table("manifests")
            off, votes, answers = N.switch(table("disabled"), table("votes"), orders, known, at_ms)
            asked = answers.where("answer <> 'unknown'").select("doc_id")
            kept = off.join(asked, "doc_id", "left_semi")
            gone = asked.join(kept.select("doc_id"), "doc_id", "left_anti").withColumn("reason", F.lit(None).cast("string"))
            return [("upsert", "disabled", kept.unionByName(gone)), ("upsert", "votes", votes.join(asked, "doc_id", "left_semi"))]

        return self.store.update("switch", steps, txn)

    def disabled(self, version: int | None = None) -> DataFrame:
        """Disabled documents: those whose row has a reason."""
        return self.read("disabled", version).where("reason is not null")

    def chunks(self, version: int | None = None) -> DataFrame:
        return _present(self.read("chunks", version))

    def edges(self, version: int | None = None) -> DataFrame:
        return self.read("edges", version).where("edge_type is not null")

    def rate(self, signals: DataFrame, at_ms: int, txn: tuple[str, int] | None = None) -> int | None:
        """Signals (doc_id, signal) added to the votes of known documents."""

        def steps(table):  # noqa: ANN001, ANN202
            own = N.rate(table("votes"), signals, table("manifests"), at_ms)
            return [("upsert", "votes", own.join(signals.select("doc_id").distinct(), "doc_id", "left_semi"))]

        return self.store.update("rate", steps, txn)

    def cache(self, rows: DataFrame, txn: tuple[str, int] | None = None) -> int | None:
        """New vectors; of equal keys the latest stays."""
        return self.store.update("cache", lambda table: [("upsert", "cache", N.upsert_cache(table("cache").join(rows.select("profile_key", "content_hash"), ["profile_key", "content_hash"], "left_semi"), rows))], txn)

    def checkpoint(self, records: DataFrame, txn: tuple[str, int] | None = None) -> int | None:
        """Records (project, id, updated_at, record) into the history, and each project's newest as its active one."""
        latest = records.groupBy("project").agg(F.max_by(F.struct(*records.columns), F.struct("updated_at", "id")).alias("r")).select("r.*")
        return self.store.commit("checkpoint", [("append", "checkpoints", records), ("upsert", "active_checkpoints", latest)], txn)

    def clear_checkpoints(self, projects: DataFrame, txn: tuple[str, int] | None = None) -> int | None:
        return self.store.commit("clear checkpoints", [("delete", "active_checkpoints", projects)], txn)

    def export(self, export_id: str, rows: DataFrame, txn: tuple[str, int] | None = None) -> int | None:
        """Rows of ``notes.export`` under a name."""
        return self.store.commit("export", [("append", "exports", rows.select(F.lit(export_id).alias("export_id"), F.col("doc_id").cast("string").alias("doc_id"), "source_kind", "path", "content"))], txn)

    def record_runs(self, runs: DataFrame, txn: tuple[str, int] | None = None) -> int | None:
        return self.store.commit("suite runs", [("append", "suite_runs", runs)], txn)

    def runs_by_profile(self, keep: int = 5) -> DataFrame:
        """The last ``keep`` runs of each profile and project, with their place from the newest."""
        from pyspark.sql import Window

        place = F.row_number().over(Window.partitionBy("profile", "project").orderBy(F.desc("at")))
        return self.read("suite_runs").withColumn("place", place).where(F.col("place") <= keep)


def _present(chunks: DataFrame) -> DataFrame:
    return chunks.where("chunk_index is not null")


def _or_key(rows: DataFrame, keys: DataFrame, schema: str) -> DataFrame:
    """Rows of a table, and for each key without one a row of nulls that stands for none."""
    form = keys.sparkSession.createDataFrame([], schema).schema
    own = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in form))
    none = keys.join(own.select("doc_id").distinct(), "doc_id", "left_anti")
    return own.unionByName(none.select(*(F.col("doc_id") if f.name == "doc_id" else F.lit(None).cast(f.dataType).alias(f.name) for f in form)))

