"""Queries of ingest, graph, governance and reranking, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..operators import graph as G
from ..operators import hygiene as H
from ..operators import ingest as I
from ..operators import rerank as R
from ..operators.governance import claims, conflict_clusters
from ..operators.records import match_terms
from ..sources import tables as D
from ..sources import tasks as K
from .planning import _cue
from .queries import _CHUNKS, _COV, _JAC, _OFF, _TOK, _VOTES, _r

NOW, DAY = D.NOW_MS, S.DAY_MS
ASKED = "the and of then, recent work in example"


def _sources(spark, d):
    return H.source_rollup(D.chunks(spark, d), D.disabled(spark, d), D.votes(spark, d))


def source_rollup(spark, d):
    return _sources(spark, d).select("doc_id", "source_kind", "memory_tier", "updated_at", "chunk_count", "is_disabled", "helpful", "noisy")


def health_summary(spark, d):
    return H.health(_sources(spark, d), NOW)


def stale_decisions(spark, d):
    found = claims(K.decisions(spark, d).select("doc_id", "content"))
    torn = found.groupBy("subject").agg(F.countDistinct("polarity").alias("w")).where("w > 1")
    subjects = found.join(torn, "subject", "left_semi").groupBy("doc_id").agg(F.countDistinct("subject").alias("n"))
    return H.stale_decisions(_sources(spark, d), subjects, NOW, k=None).select("doc_id", "reasons", "action", "weight")


def archive_plan(spark, d):
    return H.archive_stale(_sources(spark, d), NOW)


def metadata_patch(spark, d):
    """All sources after the archive's patch."""
    s = _sources(spark, d).select("doc_id", "memory_tier", "stability_score")
    return I.patch(s, H.archive_stale(_sources(spark, d), NOW), ["memory_tier", "stability_score"]).groupBy("memory_tier").agg(F.count(F.lit(1)).alias("n"), T.rounded(F.avg("stability_score")).alias("stability"))


def cleanup_actions(spark, d):
    s = _sources(spark, d)
    rows = s.select(F.explode(F.array_compact(F.array(
        F.when(H.is_stale(NOW), F.struct(F.lit("archive_stale_memories").alias("action"), F.lit("medium").alias("priority"))),
        F.when(H.is_noisy(), F.struct(F.lit("disable_noisy_sources").alias("action"), F.lit("medium").alias("priority"))),
        F.when(H.is_noisy() & (F.col("source_kind") == "decision"), F.struct(F.lit("disable_noisy_sources").alias("action"), F.lit("high").alias("priority"))),
    ))).alias("x"), "language").groupBy("x.action", "x.priority", "language").agg(F.count(F.lit(1)).alias("count"), F.min(F.lit(0)).alias("seq"))
    return H.merge_actions(rows.select("action", "priority", "count", F.concat_ws(" ", "priority", "language").alias("reason"), F.ascii("language").alias("seq"), F.array("language").alias("subjects"))).select("action", "priority", "count", F.concat_ws(",", "subjects").alias("subjects"))


def consolidation_groups(spark, d):
    return H.consolidation_groups(D.chunks(spark, d), 0.44)


def conflict_resolutions(spark, d):
    return H.resolutions(conflict_clusters(claims(K.decisions(spark, d).select("doc_id", "path", "content"))))


def plan_validation(spark, d):
    """A plan for each customer; its sources are the customer's orders, some beyond the documents."""
    o = D.table(spark, d, "orders").select(F.col("o_custkey").alias("plan_id"), F.col("o_orderkey").alias("doc_id"))
    c = D.table(spark, d, "customer")
    plan = c.select(F.col("c_custkey").alias("plan_id"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_name")).alias("title"), F.col("c_mktsegment").alias("decision"), (F.col("c_acctbal") > 0).alias("disable_inputs"))
    return H.validate_plan(plan, o, _sources(spark, d)).select("plan_id", "found", "missing", "disabled", "executable", F.concat_ws("|", "warnings").alias("warnings"))


def resolution_follow_ups(spark, d):
    """For each customer a canonical note with its own number, which supersedes its orders' numbers."""
    o = D.table(spark, d, "orders").select(F.col("o_custkey").alias("plan_id"), F.col("o_orderkey").alias("doc_id"))
    plan = D.table(spark, d, "customer").select(F.col("c_custkey").alias("plan_id"), F.col("c_custkey").alias("canonical_id"))
    return H.follow_ups(plan, o, _sources(spark, d), NOW)


def symbol_mentions(spark, d):
    cues = ("at app.run (x)", "function foo and method Foo.bar()", "baz is not defined", "nothing")
    x = F.concat_ws(" ", "text", K.cue(F.col("conv_id") + F.col("turn"), cues))
    return D.table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws(",", T.symbol_mentions(x)).alias("symbols"))


def _graph_docs(spark, d):
    return D.chunks(spark, d).select("doc_id", "path", "module_name", "language", "branch_name", F.array("source_kind").alias("tags"), F.array(F.concat(F.lit("app.fn_"), (F.col("doc_id") % 40).cast("string"), F.lit("()"))).alias("symbols"))


def edge_build(spark, d):
    return G.build_edges(_graph_docs(spark, d)).groupBy("edge_type", "target_key").agg(F.count(F.lit(1)).alias("n"), T.rounded(F.sum("weight")).alias("weight"))


def relation_scores(spark, d):
    q = spark.createDataFrame([(1, "decision about fn_3 and manual tables", "web", "fn_7", None, "en", None), (2, "diary", None, None, "feature/fr", None, "x.md")], "query_id long, query string, module_name string, symbol string, branch_name string, language string, path string")
    got = G.relation_scores(G.build_edges(_graph_docs(spark, d)), G.hints(q))
    return got.select("query_id", "doc_id", "score", "hits", "boost")


def graph_two_hops(spark, d):
    return G.two_hops(G.build_edges(_graph_docs(spark, d)), spark.createDataFrame([(0,), (1,)], "doc_id long"), 4, 3)


def part_components(spark, d):
    """Parts that orders with the same part link: components of the order keys and parts of all rows."""
    li = D.table(spark, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("a"), (F.col("l_partkey") + 10_000_000).cast("long").alias("b"))
    return G.components(li).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


def scan_changes(spark, d):
    p = D.table(spark, d, "pages").select(F.concat_ws("#", "url", "page_id").alias("path"), (F.col("page_id") * 1000).alias("mtime_ms"), F.length("html").cast("long").alias("size_bytes"), F.sha1(F.col("html").cast("binary")).alias("checksum"), "page_id")
    k = F.col("page_id") % 7
    old = p.where(k != 1).withColumns({"path": F.when(k == 2, F.concat("path", F.lit("#old"))).otherwise(F.col("path")), "mtime_ms": F.when(k.isin(3, 4), 1).otherwise(F.col("mtime_ms")), "checksum": F.when(k == 4, "x").otherwise(F.col("checksum")), "embedding_profile": F.when(k == 5, "other").otherwise("hash")})
    return I.scan_changes(p, old, "hash", 4000).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def replace_documents(spark, d):
    new = D.chunks(spark, d).where("memory_tier = 'working'").withColumn("memory_tier", F.lit("cold"))
    return I.replace_rows(D.chunks(spark, d), new).groupBy("source_kind", "memory_tier").agg(F.count(F.lit(1)).alias("n"))


def disable_log(spark, d):
    return I.last_state(D.table(spark, d, "events"), "user_id", "event_type", "ts", "event_id").select("user_id", "event_type")


def symbol_asof(spark, d):
    docs = D.table(spark, d, "documents")
    spans = docs.select("doc_id", F.posexplode(F.sequence(F.lit(0), F.expr("n_chars div 700"))).alias("turn", "k")).select("doc_id", F.concat(F.lit("s"), F.col("k").cast("string")).alias("name"), (F.col("k") * 700 + F.col("doc_id") % 500).cast("long").alias("at"), "turn")
    chunks = docs.select("doc_id", F.posexplode(T.chunk_texts(F.col("text"))).alias("chunk_index", "c")).select("doc_id", "chunk_index", F.col("c.start").alias("start"), (F.col("c.start") + 1200).alias("end"))
    return I.symbol_for_chunk(chunks, spans)


def hash_embedding(spark, d):
    e = I.hash_embedding(D.table(spark, d, "documents"))
    weighted = F.aggregate(F.transform("raw", lambda x, i: x * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return e.select("doc_id", weighted.alias("checksum"), T.rounded(T.dot(F.col("embedding"), F.col("embedding"))).alias("square"))


def embedding_cache(spark, d):
    c = D.table(spark, d, "conversations")
    cache = c.where("turn = 0").select(F.lit("hash").alias("profile_key"), T.content_hash(F.col("text")).alias("content_hash"))
    resolved, _ = I.resolve_cache(c, cache, "hash")
    return I.embedding_metrics(resolved, "role")


def query_time_windows(spark, d):
    since, until = R.time_window(F.col("q"), NOW)
    cues = ("recent changes", "what came today", "yesterday's notes", "last week", "this week", "last 12 days", "nothing", "近3天")
    return D.table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws(" ", "text", K.cue(F.col("conv_id") + F.col("turn"), cues)).alias("q")).select("conv_id", "turn", F.coalesce(since, F.lit(0)).alias("since"), F.coalesce(until, F.lit(0)).alias("until"))


def rerank_signals(spark, d):
    """Signals of both passes, boosts and windowed freshness for every chunk."""
    c = D.chunks(spark, d).withColumns({"tags": F.array("source_kind", "language"), "symbol": F.concat(F.lit("fn_"), (F.col("doc_id") % 40).cast("string"))})
    q, x = F.lit(ASKED), {k: F.col(k) for k in ("content", "title", "symbol", "path", "tags")}
    head = R.head_signal(q, F.lit(2), content=x["content"], title=x["title"], tags=x["tags"], module=F.col("module_name"))
    model = R.model_signal(q, NOW, **x, module=F.col("module_name"), kind=F.col("source_kind"), updated_ms=F.col("updated_at"))
    return c.select(
        "doc_id", T.rounded(head).alias("head"), T.rounded(model).alias("model"), T.rounded(R.path_boost(F.col("path"), "/EN/", ("x/7.md",))).alias("path_boost"), T.rounded(R.symbol_boost(F.col("symbol"), F.lit("fn_3"))).alias("symbol_boost"),
        T.rounded(R.freshness_in(F.col("updated_at"), F.lit(NOW - 14 * DAY), F.lit(None).cast("long"), NOW)).alias("fresh"), T.rounded(R.task_boost(F.col("path"), F.col("symbol"), current="5.md", related=("6.md", "7.md"), symbols=("fn_9",))).alias("task_boost"),
    )


def rolling_baseline(spark, d):
    """Median of the last five values of each series, and whether a value is worse or better than it."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id").rowsBetween(-5, -1)
    e = D.table(spark, d, "events").withColumn("l", F.array_sort(F.collect_list("value").over(w)))
    mid = lambda k: F.try_element_at("l", k)
    n = F.size("l")
    base = F.floor((mid(F.expr("int(size(l) + 1) div 2").cast("int")) + mid(F.expr("int(size(l) + 2) div 2").cast("int"))) / 2 * 100 + 0.5) / 100
    e = e.withColumn("baseline", F.when(n > 0, base)).withColumn("delta", F.col("value") - F.col("baseline"))
    verdict = F.when(F.col("baseline").isNull() | (F.col("baseline") <= 0), "none").when((F.col("delta") >= 8) & (F.col("delta") / F.col("baseline") >= 0.6), "regressed").when((F.col("delta") <= -8) & (F.col("delta") / F.col("baseline") <= -0.2), "improved").otherwise("steady")
    return e.select("event_id", "baseline", verdict.alias("verdict"))


def suite_summary(spark, d):
    e = D.table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("runs"), T.rounded(F.sum("value"), 2).alias("total"), F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("slowest"), F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"))


def domain_matches(spark, d):
    """Domains (one for each part type) that a task names, by name or alias."""
    domains = D.table(spark, d, "part").select(F.lower("p_type").alias("name")).distinct().withColumns({"slug": T.domain_slug(F.col("name")), "alias": F.lower(F.element_at(F.split("name", " "), -1))})
    tasks = D.table(spark, d, "part").select("p_partkey", F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("task"))
    terms = domains.select("slug", F.explode(F.array("name", "alias")).alias("term"))
    hit = match_terms(tasks, terms, "p_partkey", "task", "slug", "term")
    return hit.groupBy("slug").agg(F.count(F.lit(1)).alias("n"))


_SRC = f"{_CHUNKS}, {_VOTES}, {_OFF}, src AS (SELECT c.*, 1::BIGINT AS chunk_count, doc_id IN (SELECT doc_id FROM off) AS is_disabled, coalesce(helpful, 0) AS helpful, coalesce(noisy, 0) AS noisy FROM chunks c LEFT JOIN votes v USING (doc_id))"
_STALE = f"NOT is_disabled AND source_kind IN ('diary','imported') AND updated_at <= {NOW - 45 * DAY}"
_NOISY = "NOT is_disabled AND noisy > helpful AND source_kind <> 'project'"
_DEC = f"dec AS (SELECT doc_id, lower(text || chr(10) || {_cue('doc_id', K.CLAIM_CUES)}) AS low FROM documents)"
_CL = r"claims AS (SELECT DISTINCT doc_id, 'for' AS pol, unnest(regexp_extract_all(low, '\b(?:prefer|use|adopt)\s+([\w/-]+)', 1)) AS subject FROM dec UNION SELECT DISTINCT doc_id, 'against', unnest(regexp_extract_all(low, '\b(?:avoid|do not use|never use)\s+([\w/-]+)', 1)) FROM dec)"
_KEY = r"lower(regexp_replace(regexp_replace(replace(trim({0}), '\', '/'), '^.*[.:]', ''), '[()]', '', 'g'))"
_EDGES = f"""{_CHUNKS}, raw AS (SELECT doc_id, 'path' AS edge_type, {_KEY.format('path')} AS target_key, 0.9::DOUBLE AS weight FROM chunks UNION ALL SELECT doc_id, 'module', {_KEY.format('module_name')}, 1.0 FROM chunks UNION ALL SELECT doc_id, 'language', {_KEY.format('language')}, 0.45 FROM chunks
  UNION ALL SELECT doc_id, 'branch', {_KEY.format('branch_name')}, 0.4 FROM chunks UNION ALL SELECT doc_id, 'tag', source_kind, 0.55 FROM chunks UNION ALL SELECT doc_id, 'symbol', 'fn_' || (doc_id % 40), 0.95 FROM chunks), edges AS (SELECT * FROM raw WHERE target_key <> '')"""
_MT = r"list_sort(list_distinct(list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}_-]+'), lambda t: length(t) >= 3)[1:64]))"
_Q = _TOK.format(f"'{ASKED}'")

SQL = {
    "source_rollup": f"WITH {_SRC} SELECT doc_id, source_kind, memory_tier, updated_at, chunk_count, is_disabled, helpful, noisy FROM src",
    "health_summary": f"WITH {_SRC} SELECT count(*) FILTER (NOT is_disabled) AS active, count(*) FILTER (is_disabled) AS disabled, count(*) FILTER (memory_tier = 'cold') AS cold, count(*) FILTER ({_STALE}) AS stale, count(*) FILTER ({_NOISY}) AS noisy FROM src",
    "stale_decisions": f"WITH {_SRC}, {_DEC}, {_CL}, torn AS (SELECT subject FROM claims GROUP BY 1 HAVING count(DISTINCT pol) > 1), sub AS (SELECT doc_id, count(DISTINCT subject) AS n FROM claims WHERE subject IN (SELECT subject FROM torn) GROUP BY 1), x AS (SELECT s.*, coalesce(n, 0) AS n FROM src s LEFT JOIN sub USING (doc_id) WHERE source_kind = 'decision' AND updated_at <= {NOW - 60 * DAY}), y AS (SELECT doc_id, n, (1 + is_disabled::INT + (memory_tier = 'cold')::INT + (stability_score <= 0.42)::INT + (noisy > helpful)::INT + (n > 0)::INT)::INT AS reasons, CASE WHEN n > 0 OR is_disabled THEN 'mark_superseded' ELSE 'review' END AS action FROM x) SELECT doc_id, reasons, action, {_r('reasons + n * 0.8::DOUBLE + CASE WHEN action = ' + chr(39) + 'mark_superseded' + chr(39) + ' THEN 0.6::DOUBLE ELSE 0 END')} AS weight FROM y WHERE reasons > 1",
    "archive_plan": f"WITH {_CHUNKS} SELECT doc_id, 'cold' AS memory_tier, CASE source_kind WHEN 'diary' THEN 0.24::DOUBLE ELSE 0.33 END AS stability_score FROM chunks WHERE source_kind IN ('diary','imported') AND updated_at <= {NOW - 45 * DAY}",
    "metadata_patch": f"WITH {_CHUNKS}, p AS (SELECT source_kind IN ('diary','imported') AND updated_at <= {NOW - 45 * DAY} AS old, * FROM chunks) SELECT CASE WHEN old THEN 'cold' ELSE memory_tier END AS memory_tier, count(*) AS n, {_r('avg(CASE WHEN NOT old THEN stability_score WHEN source_kind = ' + chr(39) + 'diary' + chr(39) + ' THEN 0.24::DOUBLE ELSE 0.33::DOUBLE END)')} AS stability FROM p GROUP BY 1",
    "cleanup_actions": f"WITH {_SRC}, a AS (SELECT 'archive_stale_memories' AS action, 2 AS lv, language FROM src WHERE {_STALE} UNION ALL SELECT 'disable_noisy_sources', 2, language FROM src WHERE {_NOISY} UNION ALL SELECT 'disable_noisy_sources', 3, language FROM src WHERE {_NOISY} AND source_kind = 'decision'), g AS (SELECT action, lv, language, count(*) AS n FROM a GROUP BY ALL) SELECT action, CASE max(lv) WHEN 3 THEN 'high' ELSE 'medium' END AS priority, max(n) AS count, array_to_string(list_sort(list_distinct(list(language))), ',') AS subjects FROM g GROUP BY 1",
    "conflict_resolutions": rf"WITH {_DEC}, {_CL}, s AS (SELECT subject, doc_id, max((pol = 'for')::INT) AS f, max((pol = 'against')::INT) AS a FROM claims GROUP BY 1, 2), n AS (SELECT subject, count(*) AS docs, sum(f) AS f, sum(a) AS a, sum(f * a) AS b FROM s GROUP BY 1), p AS (SELECT subject, docs, (f * a - b - b * (b - 1) // 2)::BIGINT AS pairs FROM n WHERE f > 0 AND a > 0) SELECT subject, 'Canonical ' || trim(regexp_replace(subject, '[-_/]+', ' ', 'g')) || ' decision' AS title, {_r(_r('least(1.0::DOUBLE, 0.836::DOUBLE + (least(0.12::DOUBLE, greatest(0, docs - 2) * 0.05::DOUBLE) + least(0.06::DOUBLE, greatest(0, pairs - 1) * 0.02::DOUBLE)))') + ' + 0.04::DOUBLE')} AS score FROM p WHERE pairs > 0 ORDER BY score DESC, subject LIMIT 6",
    "plan_validation": f"WITH {_SRC}, n AS (SELECT o_custkey AS plan_id, count(s.doc_id) AS found, count(*) FILTER (s.doc_id IS NULL) AS missing, count(*) FILTER (is_disabled) AS disabled, count(*) FILTER (source_kind <> 'decision') AS others FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders) o LEFT JOIN src s ON s.doc_id = o_orderkey GROUP BY 1), p AS (SELECT c_custkey AS plan_id, coalesce(found, 0) AS found, coalesce(missing, 0) AS missing, coalesce(disabled, 0) AS disabled, coalesce(others, 0) AS others, c_acctbal FROM customer LEFT JOIN n ON plan_id = c_custkey), w AS (SELECT *, list_filter([CASE WHEN found < 2 THEN 'too few sources' END, CASE WHEN missing > 0 THEN 'missing sources' END, CASE WHEN others > 0 THEN 'not all are decisions' END, CASE WHEN plan_id % 4 = 0 THEN 'empty title' END, CASE WHEN disabled > 0 THEN 'disabled sources' END, CASE WHEN NOT c_acctbal > 0 THEN 'inputs stay active' END], lambda x: x IS NOT NULL) AS l FROM p) SELECT plan_id, found, missing, disabled, len(l) = 0 AS executable, array_to_string(l, '|') AS warnings FROM w",
    "resolution_follow_ups": f"WITH {_SRC}, n AS (SELECT o_custkey AS plan_id, count(*) AS expected, count(*) FILTER (is_disabled) AS disabled, count(*) FILTER (is_disabled AND updated_at <= {NOW - 45 * DAY}) AS ready FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders) o JOIN src s ON s.doc_id = o_orderkey GROUP BY 1), p AS (SELECT c_custkey AS plan_id, coalesce(expected, 0) AS expected, coalesce(disabled, 0) AS disabled, coalesce(ready, 0) AS ready, c_custkey IN (SELECT doc_id FROM src WHERE source_kind = 'decision') AS there FROM customer LEFT JOIN n ON plan_id = c_custkey) SELECT plan_id, expected, disabled, ready, there AND expected = disabled AS verified, CASE WHEN NOT there THEN 'review' WHEN expected > disabled THEN 'disable' WHEN expected > 0 AND ready = expected THEN 'archive' ELSE 'keep_both' END AS action FROM p",
    "symbol_mentions": rf"""WITH x AS (SELECT conv_id, turn, text || ' ' || (['at app.run (x)', 'function foo and method Foo.bar()', 'baz is not defined', 'nothing'])[(conv_id + turn) % 4 + 1] AS x FROM conversations),
  m AS (SELECT conv_id, turn, list_concat(list_concat(regexp_extract_all(x, '{T.MENTIONS[0]}', 1), regexp_extract_all(x, '{T.MENTIONS[1]}', 1)), list_concat(regexp_extract_all(x, '{T.MENTIONS[2]}', 1), regexp_extract_all(x, '{T.MENTIONS[3]}', 1))) AS f FROM x),
  n AS (SELECT conv_id, turn, list_filter(list_transform(f, lambda s: regexp_replace(regexp_replace(trim(s), '^.*[.:]', ''), '[()]', '', 'g')), lambda s: s <> '' AND lower(s) NOT IN ('if', 'for', 'while', 'switch', 'catch', 'return', 'async')) AS f FROM m),
  u AS (SELECT conv_id, turn, f, list_transform(f, lambda s: lower(s)) AS lows FROM n)
  SELECT conv_id, turn, array_to_string(list_filter(f, lambda s, i: NOT list_contains(lows[1:i - 1], lower(s)))[1:5], ',') AS symbols FROM u""",
    "edge_build": f"WITH {_EDGES} SELECT edge_type, target_key, count(*) AS n, {_r('sum(weight)')} AS weight FROM edges GROUP BY 1, 2",
    "relation_scores": f"WITH {_EDGES}, h AS (SELECT * FROM (VALUES (1, 'tag', 'decision'), (1, 'symbol', 'decision'), (1, 'tag', 'about'), (1, 'symbol', 'about'), (1, 'tag', 'manual'), (1, 'symbol', 'manual'), (1, 'tag', 'tables'), (1, 'symbol', 'tables'), (1, 'module', 'web'), (1, 'symbol', 'fn_7'), (1, 'language', 'en'), (2, 'tag', 'diary'), (2, 'symbol', 'diary'), (2, 'branch', 'feature/fr'), (2, 'path', 'md')) t(query_id, edge_type, target_key)), s AS (SELECT query_id::BIGINT AS query_id, doc_id, sum(weight) AS s, count(*) AS hits FROM edges JOIN h USING (edge_type, target_key) GROUP BY 1, 2) SELECT query_id, doc_id, {_r('s')} AS score, hits, {_r('least(0.08::DOUBLE, ' + _r('s') + ' * 0.08::DOUBLE * 0.4::DOUBLE)')} AS boost FROM s",
    "graph_two_hops": f"WITH {_EDGES}, ed AS (SELECT * FROM edges), one AS (SELECT b.doc_id, {_r('sum(a.weight * b.weight)')} AS score FROM ed a JOIN ed b USING (edge_type, target_key) WHERE edge_type IN ('module','symbol','tag','branch') AND a.doc_id IN (0, 1) AND b.doc_id NOT IN (0, 1) GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 4), two AS (SELECT b.doc_id, {_r('sum(a.weight * b.weight)')} AS score FROM ed a JOIN ed b USING (edge_type, target_key) WHERE edge_type IN ('module','symbol','tag') AND a.doc_id IN (SELECT doc_id FROM one) AND b.doc_id NOT IN (0, 1) AND b.doc_id NOT IN (SELECT doc_id FROM one) GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 3) SELECT doc_id, 1 AS hop, score, {_r('least(0.18::DOUBLE, score * 0.08::DOUBLE)')} AS boost FROM one UNION ALL SELECT doc_id, 2, score, {_r('least(0.11::DOUBLE, score * 0.045::DOUBLE)')} FROM two",
    "scan_changes": "WITH p AS (SELECT url || '#' || page_id AS path, page_id * 1000 AS m, length(html) AS s, sha1(html) AS c, page_id % 7 AS k FROM pages), o AS (SELECT CASE WHEN k = 2 THEN path || '#old' ELSE path END AS path, CASE WHEN k IN (3, 4) THEN 1 ELSE m END AS m, s, CASE WHEN k = 4 THEN 'x' ELSE c END AS c, CASE WHEN k = 5 THEN 'other' ELSE 'hash' END AS pr FROM p WHERE k <> 1) SELECT CASE WHEN p.path IS NULL THEN 'removed' WHEN p.s > 4000 THEN 'too_large' WHEN o.path IS NULL THEN 'new' WHEN pr = 'hash' AND p.m = o.m AND p.s = o.s THEN 'unchanged' WHEN pr = 'hash' AND p.c = o.c THEN 'refreshed' ELSE 'changed' END AS status, count(*) AS n FROM p FULL JOIN o ON p.path = o.path GROUP BY 1",
    "replace_documents": f"WITH {_CHUNKS}, n AS (SELECT doc_id, source_kind, 'cold' AS memory_tier FROM chunks WHERE memory_tier = 'working'), k AS (SELECT doc_id, source_kind, memory_tier FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT * FROM n) SELECT source_kind, memory_tier, count(*) AS n FROM k GROUP BY 1, 2",
    "disable_log": "SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1",
    "symbol_asof": "WITH t AS (SELECT doc_id, n_chars, trim(text, ' ') AS t FROM documents), c AS (SELECT doc_id, t, unnest(range(0, greatest(0, ceil((length(t) - 1200) / 1050.0))::INT + 1)) AS k FROM t), ch AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS chunk_index, k * 1050 + 1200 AS e FROM c WHERE trim(substring(t, k * 1050 + 1, 1200), ' ') <> ''), sp AS (SELECT doc_id, unnest(range(0, n_chars // 700 + 1)) AS k FROM documents) SELECT ch.doc_id, chunk_index, 's' || max(k) AS symbol FROM ch LEFT JOIN sp ON sp.doc_id = ch.doc_id AND sp.k * 700 + sp.doc_id % 500 < e GROUP BY 1, 2",
    "query_time_windows": None,
    "embedding_cache": r"WITH h AS (SELECT role, text, turn, sha1(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS h FROM conversations), k AS (SELECT DISTINCT h FROM h WHERE turn = 0) SELECT role, count(*) AS items, sum(length(text))::BIGINT AS chars, sum(CASE WHEN text = '' THEN 0 ELSE greatest(1, ceil(length(text) / 4.0)) END)::BIGINT AS tokens, count(DISTINCT h) AS unique_items, count(*) FILTER (h IN (SELECT h FROM k)) AS hits, count(*) - count(DISTINCT h) AS duplicates, count(*) FILTER (h NOT IN (SELECT h FROM k)) AS misses, floor((count(*) - count(DISTINCT h)) / count(*)::DOUBLE * 10000 + 0.5) / 10000 AS duplicate_ratio FROM h GROUP BY 1",
    "hash_embedding": r"WITH t AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[\s\x0b]+'), lambda x: x <> '')) AS tok FROM documents), n AS (SELECT doc_id, tok, count(*) AS c FROM t GROUP BY 1, 2), v AS (SELECT tok, sha256(tok) AS h FROM (SELECT DISTINCT tok FROM n)), b AS (SELECT tok, ('0x' || h[2 * i + 1:2 * i + 2])::INT % 64 AS idx, CASE WHEN ('0x' || h[2 * ((i + 1) % 32) + 1:2 * ((i + 1) % 32) + 2])::INT % 2 = 0 THEN 1 ELSE -1 END AS s FROM v, range(32) r(i)), x AS (SELECT doc_id, idx, sum(s * c) AS w FROM n JOIN b USING (tok) GROUP BY 1, 2), z AS (SELECT doc_id, sum(w * (idx + 1))::BIGINT AS checksum, CASE WHEN sum(w * w) > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS square FROM x GROUP BY 1) SELECT doc_id, coalesce(checksum, 0)::BIGINT AS checksum, coalesce(square, 0.0::DOUBLE) AS square FROM documents LEFT JOIN z USING (doc_id)",
    "rerank_signals": f"""WITH {_CHUNKS}, x AS (SELECT *, {_COV.format(q=_Q, c=_TOK.format('content'))} AS cc, {_COV.format(q=_Q, c=_TOK.format('title'))} AS ct, {_COV.format(q=_Q, c="list_concat(" + _TOK.format('source_kind') + ", " + _TOK.format('language') + ")")} AS cg, {_COV.format(q=_Q, c=_TOK.format('module_name'))} AS cm, {_COV.format(q=_Q, c=_TOK.format('path'))} AS cp, CASE WHEN contains(lower(content), 'recent work in example') THEN 1.0::DOUBLE ELSE 0.0 END AS ph, len(list_filter({_Q}, lambda t: contains(lower(module_name), t))) > 0 AS md, ({NOW} - updated_at) / 86400000.0::DOUBLE AS age FROM chunks)
  SELECT doc_id, {_r('ph * 0.35::DOUBLE + cc * 0.3::DOUBLE + cg * 0.15::DOUBLE + CASE WHEN md THEN 0.5::DOUBLE ELSE 0 END * 0.1::DOUBLE + ct * 0.05::DOUBLE + 0.025::DOUBLE')} AS head, {_r("greatest(0.0::DOUBLE, least(1.0::DOUBLE, ph * 0.25::DOUBLE + cc * 0.25::DOUBLE + ct * 0.13::DOUBLE + cm * 0.07::DOUBLE + cp * 0.03::DOUBLE + cg * 0.04::DOUBLE + CASE WHEN source_kind IN ('decision','manual') THEN 0.06::DOUBLE WHEN source_kind = 'project' THEN 0.02::DOUBLE ELSE 0 END + CASE WHEN age <= 7 THEN 0.04::DOUBLE WHEN age <= 30 THEN 0.02::DOUBLE ELSE 0 END))")} AS model,
  {_r("CASE WHEN contains(lower(path), '/en/') THEN 0.04::DOUBLE ELSE 0 END + CASE WHEN contains(lower(path), 'x/7.md') OR lower(path) LIKE '%/7.md' THEN 0.07::DOUBLE ELSE 0 END")} AS path_boost, {_r("CASE WHEN doc_id % 40 = 3 THEN 0.09::DOUBLE WHEN contains((doc_id % 40)::VARCHAR, '3') AND starts_with((doc_id % 40)::VARCHAR, '3') THEN 0.045::DOUBLE ELSE 0 END")} AS symbol_boost, {_r(f'CASE WHEN updated_at >= {NOW - 14 * DAY} THEN least(1.0::DOUBLE, exp(-age / 45) + 0.15::DOUBLE) ELSE exp(-age / 45) * 0.5::DOUBLE END')} AS fresh,
  {_r("CASE WHEN doc_id = 5 THEN 0.12::DOUBLE ELSE 0 END + CASE WHEN doc_id IN (6, 7) THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN doc_id % 40 = 9 THEN 0.12::DOUBLE ELSE 0 END")} AS task_boost FROM x""",
    "rolling_baseline": "WITH b AS (SELECT *, median(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS m FROM events), c AS (SELECT event_id, value, floor(m * 100 + 0.5) / 100 AS baseline FROM b) SELECT event_id, baseline, CASE WHEN baseline IS NULL OR baseline <= 0 THEN 'none' WHEN value - baseline >= 8 AND (value - baseline) / baseline >= 0.6::DOUBLE THEN 'regressed' WHEN value - baseline <= -8 AND (value - baseline) / baseline <= -0.2::DOUBLE THEN 'improved' ELSE 'steady' END AS verdict FROM c",
    "suite_summary": f"SELECT event_type, count(*) AS runs, {_r('sum(value)', 2)} AS total, max_by(event_id, (value, -event_id)) AS slowest, max_by(event_id, (ts, event_id)) AS latest FROM events GROUP BY 1",
    "domain_matches": r"WITH d AS (SELECT DISTINCT lower(p_type) AS name FROM part), x AS (SELECT name, regexp_replace(name, '[\s/]+', '-', 'g') AS slug, lower(string_split(name, ' ')[-1]) AS alias FROM d), t AS (SELECT lower(p_name || ' ' || p_type) AS task FROM part) SELECT slug, count(*) AS n FROM t JOIN x ON contains(task, name) OR contains(task, alias) GROUP BY 1",
}
_WHEN = "'recent changes','what came today','yesterday''s notes','last week','this week','last 12 days','nothing','近3天'"
SQL["query_time_windows"] = rf"WITH q AS (SELECT conv_id, turn, lower(text || ' ' || ([{_WHEN}])[(conv_id + turn) % 8 + 1]) AS q FROM conversations), n AS (SELECT *, {NOW} - {NOW} % {DAY} AS today, regexp_extract(q, '(?:近|last\s+)(\d+)\s*(?:天|days?)', 1) AS n FROM q) SELECT conv_id, turn, CASE WHEN regexp_matches(q, '\brecent\b|最近') THEN {NOW - 14 * DAY} WHEN regexp_matches(q, '\btoday\b|今天') THEN today WHEN regexp_matches(q, '\byesterday\b|昨天') THEN today - {DAY} WHEN regexp_matches(q, '\blast week\b|上周') THEN {NOW - 7 * DAY} WHEN regexp_matches(q, '\bthis week\b|本周') THEN {NOW - 6 * DAY} WHEN n <> '' THEN {NOW} - n::BIGINT * {DAY} ELSE 0 END AS since, CASE WHEN NOT regexp_matches(q, '\brecent\b|最近|\btoday\b|今天') AND regexp_matches(q, '\byesterday\b|昨天') THEN today ELSE 0 END AS until FROM n"
QUERIES = {f.__name__: f for f in (source_rollup, health_summary, stale_decisions, archive_plan, metadata_patch, cleanup_actions, consolidation_groups, conflict_resolutions, plan_validation, resolution_follow_ups, symbol_mentions, edge_build, relation_scores, graph_two_hops, part_components, scan_changes, replace_documents, disable_log, symbol_asof, hash_embedding, embedding_cache, query_time_windows, rerank_signals, rolling_baseline, suite_summary, domain_matches)}
