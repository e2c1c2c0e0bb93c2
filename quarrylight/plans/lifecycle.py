"""Queries of symbols, index life, marks and first occurrences, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import execution as E
from ..operators import hygiene as H
from ..operators import ingest as I
from ..operators import lifecycle as L
from ..operators import notes as N
from ..operators import records as R
from ..sources import tables as D
from .queries import _CHUNKS, _TOK, _r

NOW, DAY = D.NOW_MS, 86_400_000
#: One file of each language; {0} is a number.
CODE = (
    ("py", "class Store{0}:\n    def keep(self):\n        return 'def no(): pass'\n\nasync def recall{0}(q):\n    return q\n"),
    ("ts", "export class Store{0} {{\n  async keep(text: string) {{\n    if (text) {{ return text; }}\n  }}\n}}\n// class Ghost {{}}\nexport function recall{0}(q: string) {{\n  return q;\n}}\n"),
    ("go", "package m\n\ntype Store{0} struct{{}}\n\n// func Ghost() {{}}\nfunc (s *Store{0}) keep(t string) string {{\n\treturn t\n}}\n\nfunc recall{0}(q string) string {{\n\treturn q\n}}\n"),
    ("rs", "struct Store{0};\n/* fn ghost() {{}} */\nimpl Store{0} {{\n    fn keep(&self) -> u8 {{ 1 }}\n}}\npub fn recall{0}(q: &str) -> u8 {{\n    2\n}}\n"),
    ("java", "public class Store{0} {{\n    // void ghost() {{}}\n    public String keep(String t) {{\n        return find(t);\n    }}\n    String recall{0}(String q) {{\n        return q;\n    }}\n}}\n"),
)


def _code(spark, d):
    """A code file of one of five languages for each document, with its whole text as a comment at the end."""
    k = (F.col("doc_id") % len(CODE)).cast("int") + 1
    at = lambda xs: F.element_at(F.array(*map(F.lit, xs)), k)
    body = F.replace(at([c.replace("{{", "{").replace("}}", "}") for _, c in CODE]), F.lit("{0}"), F.col("doc_id").cast("string"))
    note = F.concat(F.when(F.col("doc_id") % len(CODE) == 0, "# ").otherwise("// "), F.regexp_replace("text", r"[\r\n]+", " "))
    path = F.concat_ws(".", F.concat_ws("/", F.lit("src"), "doc_id"), at([e for e, _ in CODE]))
    return D.table(spark, d, "documents").select("doc_id", path.alias("path"), F.concat(body, note).alias("content"), T.language_of(path).alias("language"))


def symbol_extraction(spark, d):
    """All symbols of all files."""
    return I.symbol_spans(_code(spark, d)).select("doc_id", "name", "turn")


def file_symbols(spark, d):
    """The first symbol of each file."""
    return I.inferred_symbols(_code(spark, d))


def _manifests(spark, d):
    c = D.chunks(spark, d)
    return c.select("doc_id", "path", "source_kind", "updated_at", F.when(F.col("doc_id") % 4 > 0, "p").otherwise("old").alias("embedding_profile"))


def recovery_steps(spark, d):
    """Plans of three strategies over one index, whose rebuild fails in the last."""
    m = _manifests(spark, d)
    rows = None
    for i, s in enumerate(L.STRATEGIES):
        one = L.recovery_plan(m, "p", described=i > 0, strategy=s).select(F.lit(i).alias("plan_id"), "steps", "auto")
        rows = one if rows is None else rows.unionByName(one)
    results = spark.createDataFrame([(2, "rebuild_active_profile_index", "Error: 429 too many")], "plan_id int, step string, error string")
    out = L.recover(rows, results)
    return out.withColumn("again", L.retryable(F.col("code")))


def access_levels(spark, d):
    return L.access_surface(R.profile_state(_manifests(spark, d), "p"))


def rebuild_plan(spark, d):
    """Files of all paths but every ninth; what is embedded, deleted and left to the scan, by kind."""
    m = _manifests(spark, d)
    files = D.chunks(spark, d).where("doc_id % 9 > 0").select("path", "content")
    plan = L.rebuild(m, m, files)
    left = L.rebuilt({"manifests": m}, plan)
    n = F.count(F.lit(1)).alias("n")
    rows = [t.agg(n).select(F.lit(k).alias("part"), "n") for k, t in (plan | left).items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def profile_repair(spark, d):
    """Descriptors by part type; a third has another number of dimensions, a third is missing."""
    p = D.table(spark, d, "part").groupBy("p_type").agg(F.min("p_partkey").alias("k")).select(F.col("p_type").alias("name"), F.lit(64).alias("dims"), F.lit("hash").alias("provider"), F.lit("d0").alias("created_at"), "k")
    have = p.where("k % 3 > 0").withColumn("dims", F.when(F.col("k") % 3 == 1, 8).otherwise(64)).drop("k")
    return L.repair(have, p.drop("k"), "d1")


def superseded_marks(spark, d):
    s = H.source_rollup(D.chunks(spark, d), D.disabled(spark, d), D.votes(spark, d))
    return H.mark_superseded(s, D.disabled(spark, d))


def checkpoint_ids(spark, d):
    c = D.table(spark, d, "conversations")
    at = F.lit(NOW) + F.col("conv_id") * 977 + F.col("turn")
    return c.select("conv_id", "turn", R.checkpoint_id(at, F.substring("text", 1, 60)).alias("id"), T.subject(F.substring("text", 1, 20)).alias("subject"))


def first_occurrences(spark, d):
    """Of the passages of two ordered lists the first occurrence of each chunk, with its place."""
    p = D.passages(spark, d).select("doc_id", "chunk_index")
    stable = p.where("doc_id % 3 < 2").withColumn("place", F.col("doc_id") * 100 + F.col("chunk_index"))
    recent = p.where("doc_id % 3 > 0").withColumn("place", F.lit(10_000_000) + F.col("doc_id") * 100 + F.col("chunk_index"))
    return N.in_order(stable.unionByName(recent), ["doc_id", "chunk_index"], "place")


def link_reasons(spark, d):
    """Reasons of the links between neighbours by id, collected by folder."""
    c = D.chunks(spark, d).select("doc_id", "source_kind", "memory_tier", "module_name", T.tokenize(F.col("title")).alias("t"), F.slice(T.tokenize(F.col("content")), 1, 64).alias("b"))
    a, b = c.alias("a"), c.alias("b")
    same = lambda x: F.col(f"a.{x}") == F.col(f"b.{x}")
    links = a.join(b, F.col("b.doc_id") == F.col("a.doc_id") + 6).select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b"), E.link_reasons(T.jaccard(F.col("a.t"), F.col("b.t")), T.jaccard(F.col("a.b"), F.col("b.b")), same("module_name"), same("source_kind"), same("memory_tier")).alias("reasons"))
    groups = D.chunks(spark, d).select("doc_id", F.col("module_name").alias("group_id"))
    return E.group_reasons(links, groups).select("group_id", F.concat_ws(",", "reasons").alias("reasons"))


_M = f"{_CHUNKS}, m AS (SELECT doc_id, path, source_kind, doc_id % 4 > 0 AS fresh FROM chunks)"
_J = "CASE WHEN len({0}) > 0 AND len({1}) > 0 THEN len(list_distinct(list_intersect({0}, {1})))::DOUBLE / len(list_distinct(list_concat({0}, {1}))) ELSE 0.0 END"
SQL = {
    "symbol_extraction": "WITH n AS (SELECT doc_id, unnest(range(0, 3)) AS turn FROM documents) SELECT doc_id, CASE turn WHEN 0 THEN 'Store' || doc_id WHEN 1 THEN 'keep' ELSE 'recall' || doc_id END AS name, turn::INT AS turn FROM n",
    "file_symbols": "SELECT doc_id, 'Store' || doc_id AS symbol FROM documents",
    "access_levels": f"WITH {_M}, s AS (SELECT count(*) > 0 AND count(*) FILTER (NOT fresh) = 0 AS ready FROM m) SELECT level, true AS canonical_reuse, reuse AND ready AS index_reuse FROM (VALUES ('same_agent_same_profile', true), ('different_agent_same_profile', true), ('different_agent_different_profile', false)) l(level, reuse), s",
    "rebuild_plan": f"WITH {_M}, f AS (SELECT *, doc_id % 9 > 0 AS there FROM m), c AS (SELECT count(*) FILTER (source_kind <> 'project' AND there) AS embed, count(*) FILTER (source_kind <> 'project' AND NOT there) AS gone, count(*) FILTER (source_kind = 'project') AS rescan, count(*) AS n FROM f) SELECT 'embed' AS part, embed AS n FROM c UNION ALL SELECT 'gone', gone FROM c UNION ALL SELECT 'rescan', rescan FROM c UNION ALL SELECT 'manifests', n - gone FROM c UNION ALL SELECT 'vectors', embed FROM c",
    "profile_repair": "WITH p AS (SELECT p_type AS name, min(p_partkey) AS k FROM part GROUP BY 1) SELECT name, 64 AS dims, 'hash' AS provider, CASE WHEN k % 3 = 2 THEN 'd0' ELSE 'd1' END AS created_at FROM p",
    "superseded_marks": "SELECT DISTINCT doc_id, 'cold' AS memory_tier, 0.18::DOUBLE AS stability_score, 0.92::DOUBLE AS distill_confidence FROM labels WHERE toxic = 1 AND doc_id IN (SELECT doc_id FROM documents)",
    "checkpoint_ids": rf"WITH c AS (SELECT conv_id, turn, text, {NOW} + conv_id * 977 + turn AS ms FROM conversations), s AS (SELECT *, substring(regexp_replace(regexp_replace(lower(trim(substring(text, 1, 60))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48) AS slug FROM c) SELECT conv_id, turn, strftime(epoch_ms(ms), '%Y%m%dT%H%M%S') || lpad((ms % 1000)::VARCHAR, 3, '0') || 'Z-' || slug AS id, lower(regexp_replace(substring(text, 1, 20), '[^\w/-]', '', 'g')) AS subject FROM s",
    "first_occurrences": "WITH t AS (SELECT doc_id, trim(text, ' ') AS t FROM documents), c AS (SELECT doc_id, t, unnest(range(0, greatest(0, ceil((length(t) - 1200) / 1050.0))::INT + 1)) AS k FROM t), p AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS chunk_index FROM c WHERE trim(substring(t, k * 1050 + 1, 1200), ' ') <> ''), u AS (SELECT *, doc_id * 100 + chunk_index AS place FROM p WHERE doc_id % 3 < 2 UNION ALL SELECT *, 10000000 + doc_id * 100 + chunk_index FROM p WHERE doc_id % 3 > 0) SELECT doc_id, chunk_index, min(place) AS place FROM u GROUP BY 1, 2",
    "link_reasons": f"WITH {_CHUNKS}, c AS (SELECT doc_id, source_kind, memory_tier, module_name, {_TOK.format('title')} AS t, ({_TOK.format('content')})[1:64] AS b FROM chunks), l AS (SELECT x.module_name AS g, {_J.format('x.t', 'y.t')} >= 0.2 AS r1, {_J.format('x.b', 'y.b')} >= 0.18 AS r2, x.module_name = y.module_name AS r3, x.source_kind = y.source_kind AS r4, x.memory_tier = y.memory_tier AS r5 FROM c x JOIN c y ON y.doc_id = x.doc_id + 6), s AS (SELECT g, bool_or(r1) AS r1, bool_or(r2) AS r2, bool_or(r3) AS r3, bool_or(r4) AS r4, bool_or(r5) AS r5 FROM l GROUP BY 1) SELECT g AS group_id, concat_ws(',', CASE WHEN r2 THEN 'content' END, CASE WHEN r3 THEN 'folder' END, CASE WHEN r4 THEN 'kind' END, CASE WHEN r5 THEN 'tier' END, CASE WHEN r1 THEN 'titles' END) AS reasons FROM s WHERE r1 OR r2 OR r3 OR r4 OR r5",
}
QUERIES = {f.__name__: f for f in (symbol_extraction, file_symbols, recovery_steps, access_levels, rebuild_plan, profile_repair, superseded_marks, checkpoint_ids, first_occurrences, link_reasons)}
