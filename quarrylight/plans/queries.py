"""Registered queries of the retrieval engine with their SQL for the oracle."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..operators import governance as G
from ..operators import recall as R
from ..sources import tables as D
from ..streaming import debounce

NOW, QUERY = D.NOW_MS, "the of and that then"

_CHUNKS = f"""chunks AS (SELECT doc_id, (['manual','decision','diary','project','imported','log'])[doc_id % 6 + 1] AS source_kind,
  source || '/' || lang || '/' || doc_id::VARCHAR || '.md' AS path, substring(text, 1, 40) AS title, text AS content, source AS module_name, lang AS language,
  CASE WHEN doc_id % 4 > 0 THEN 'feature/' || lang END AS branch_name, (['stable','stable','working','project','stable','project'])[doc_id % 6 + 1] AS memory_tier,
  ([0.82::DOUBLE,0.95,0.46,0.52,0.72,0.52])[doc_id % 6 + 1] AS stability_score, {NOW} - (doc_id % 200) * 86400000 AS updated_at FROM documents)"""
_VOTES = f"votes AS (SELECT doc_id, sum(quality)::BIGINT AS helpful, sum(toxic)::BIGINT AS noisy, max({NOW} - doc_id % 30 * 86400000) AS last_ms FROM labels GROUP BY doc_id)"
_OFF = "off AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1)"
_EDGES = "edges AS (SELECT DISTINCT doc_id, 'module' AS edge_type, module_name AS target_key, 1.0::DOUBLE AS weight FROM chunks UNION ALL SELECT DISTINCT doc_id, 'language', language, 0.45::DOUBLE FROM chunks UNION ALL SELECT DISTINCT doc_id, 'branch', branch_name, 0.4::DOUBLE FROM chunks WHERE branch_name IS NOT NULL)"
_TOK = "list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: t <> '')"
_COV = "(len(list_filter({q}, lambda t: list_contains({c}, t)))::DOUBLE / len({q}))"


def _r(x: str, n: int = 4) -> str:
    return f"floor(({x}) * {10**n} + 0.5) / {10**n}"


_Q = _TOK.format(f"'{QUERY}'")
_PASSAGES = f"""{_CHUNKS}, {_VOTES}, {_OFF}, {_EDGES}, t0 AS (SELECT doc_id, trim(content, ' ') AS t FROM chunks),
  c0 AS (SELECT doc_id, t, unnest(range(0, greatest(0, ceil((length(t) - 1200) / 1050.0))::INT + 1)) AS k FROM t0),
  p0 AS (SELECT doc_id, k, trim(substring(t, k * 1050 + 1, 1200), ' ') AS part FROM c0),
  passages AS (SELECT c.doc_id, (row_number() OVER (PARTITION BY c.doc_id ORDER BY k) - 1)::INT AS chunk_index, part, source_kind, path, title, module_name, language, branch_name, memory_tier, stability_score, updated_at,
    (['remember','rememberTask','recall','Store.remember()','index','forget','rate'])[c.doc_id % 7 + 1] AS symbol, e.embedding::DOUBLE[] AS e
    FROM p0 JOIN chunks c USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = c.doc_id WHERE part <> '')"""
_AGE = f"(({NOW} - updated_at) / 86400000.0::DOUBLE)"
_LAST = f"coalesce(exp(-(({NOW} - last_ms) / 86400000.0::DOUBLE) / 45), 0)"


def _scored_sql(kinds: str, least: float, depth: int) -> str:
    """The passages of the asked query with their terms, the best ``depth`` of them by place."""
    cov = lambda c: "(" + _COV.format(q=_Q, c=_TOK.format(c)) + ")"
    total = "vector + lexical + source_priority + freshness + tier_boost + stability_boost + path_boost + symbol_boost + branch_boost + title_boost + feedback_boost + relation_boost"
    return f"""WITH {_PASSAGES}, q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
cand AS (
  SELECT p.*, coalesce(helpful, 0) AS h, coalesce(noisy, 0) AS z, last_ms FROM passages p LEFT JOIN votes v USING (doc_id)
  WHERE doc_id NOT IN (SELECT doc_id FROM off) AND contains(lower(path), '/en/') AND language = 'en' AND contains(lower(symbol), 'remember')
    AND updated_at >= {NOW} - 150 * 86400000::BIGINT AND source_kind IN ({kinds})
), rel AS (SELECT doc_id, {_r("sum(weight)")} AS r FROM edges WHERE (edge_type = 'branch' AND target_key = 'feature/en') OR (edge_type = 'language' AND target_key = 'en') GROUP BY 1),
term AS (SELECT cand.*,
  CASE WHEN e IS NULL THEN 0.0::DOUBLE ELSE list_dot_product(e, q.v) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q.v, q.v))) END * 0.6::DOUBLE AS vector,
  {cov("part")} * 0.3::DOUBLE AS lexical,
  (([1.0::DOUBLE,0.95,0.85,0.75,0.7,0.8])[doc_id % 6 + 1]) * 0.1::DOUBLE AS source_priority, least(1.0::DOUBLE, exp(-{_AGE} / 45) + 0.15::DOUBLE) * 0.08::DOUBLE AS freshness,
  (CASE memory_tier WHEN 'stable' THEN 1.0::DOUBLE WHEN 'working' THEN 0.55 ELSE 0.4 END) * 0.08::DOUBLE AS tier_boost, stability_score * 0.06::DOUBLE AS stability_boost,
  0.04::DOUBLE + CASE WHEN contains(lower(path), 'src1/x/7.md') OR lower(path) LIKE '%/7.md' OR contains(lower(path), '12.md') THEN 0.07::DOUBLE ELSE 0 END AS path_boost,
  CASE symbol WHEN 'rememberTask' THEN 0.045::DOUBLE ELSE 0.09::DOUBLE END AS symbol_boost,
  CASE WHEN branch_name IS NULL THEN 0.0::DOUBLE WHEN branch_name = 'feature/en' THEN 0.03 ELSE 0.015 END AS branch_boost,
  {cov("title")} * 0.06::DOUBLE AS title_boost,
  greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (h * 0.75 * (0.6 + 0.6 * {_LAST}) - z * 1.1 * (0.65 + 0.35 * {_LAST} + 0.45 * (1 - exp(-{_AGE} / 90)))) / 3)) * 0.12::DOUBLE AS feedback_boost,
  least(0.08::DOUBLE, coalesce(r, 0.0::DOUBLE) * 0.08::DOUBLE * 0.4::DOUBLE) AS relation_boost
  FROM cand LEFT JOIN rel USING (doc_id), q
), scored AS (SELECT *, {total} AS s0 FROM term), best AS (
  SELECT *, row_number() OVER (ORDER BY {_r("s0")} DESC, updated_at DESC, chunk_index, doc_id) AS r0 FROM scored WHERE s0 >= {least}::DOUBLE ORDER BY r0 LIMIT {depth})"""


def _reranked_sql(kinds: str, least: float, depth: int, top_k: int) -> str:
    """Both passes: scores s1 and s2, parts m1 and m2, places r1 and r2."""
    cov = lambda c: "(" + _COV.format(q=_Q, c=c if c.startswith("list") else _TOK.format(c)) + ")"
    tags = "list_concat(" + _TOK.format("source_kind") + ", " + _TOK.format("language") + ")"
    phrase = f"CASE WHEN contains(lower(part), '{QUERY}') THEN 1.0::DOUBLE ELSE 0.0 END"
    module = f"CASE WHEN len(list_filter({_Q}, lambda t: contains(lower(module_name), t))) > 0 THEN 0.05::DOUBLE ELSE 0 END"
    head = f"{phrase} * 0.35::DOUBLE + {cov('part')} * 0.3::DOUBLE + {cov(tags)} * 0.15::DOUBLE + {module} + {cov('title')} * 0.05::DOUBLE + 0.05::DOUBLE / r0"
    fresh = f"CASE WHEN {_AGE} <= 7 THEN 0.04::DOUBLE WHEN {_AGE} <= 30 THEN 0.02::DOUBLE ELSE 0 END"
    steady = "CASE WHEN source_kind IN ('decision','manual') THEN 0.06::DOUBLE WHEN source_kind = 'project' THEN 0.02::DOUBLE ELSE 0 END"
    model = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {phrase} * 0.25::DOUBLE + {cov('part')} * 0.25::DOUBLE + {cov('title')} * 0.13::DOUBLE + {cov('symbol')} * 0.13::DOUBLE + {cov('module_name')} * 0.07::DOUBLE + {cov('path')} * 0.03::DOUBLE + {cov(tags)} * 0.04::DOUBLE + {steady} + {fresh}))"
    place = lambda tail, s: f"row_number() OVER (ORDER BY {tail} {_r(s)} DESC, updated_at DESC, chunk_index, doc_id)"
    one, two = max(12, top_k), max(6, top_k)
    return f"""{_scored_sql(kinds, least, depth)}, a AS (SELECT *, CASE WHEN r0 <= {one} THEN ({head}) * 0.2::DOUBLE ELSE 0.0 END AS m1 FROM best),
b AS (SELECT *, CASE WHEN r0 <= {one} THEN s0 * 0.8::DOUBLE + m1 ELSE s0 END AS s1 FROM a), c AS (SELECT *, {place(f"CASE WHEN r0 > {one} THEN r0 ELSE 0 END,", "s1")} AS r1 FROM b),
f AS (SELECT *, CASE WHEN r1 <= {two} THEN ({model}) * 0.15::DOUBLE ELSE 0.0 END AS m2 FROM c), g AS (SELECT *, CASE WHEN r1 <= {two} THEN s1 * 0.85::DOUBLE + m2 ELSE s1 END AS s2 FROM f),
ranked AS (SELECT *, {place(f"CASE WHEN r1 > {two} THEN r1 ELSE 0 END,", "s2")}::INT AS r2 FROM g)"""


def _explained_sql(kinds: str, least: float, top_k: int) -> str:
    fields = {**{t: t for t in R.TERMS}, "rerank_model": "m2", "rerank": "m1 + m2", "total": "s2"}
    tests = [f"CASE WHEN {test} THEN '{{}}' END" for test, *_ in R.REASONS]
    lists = [", ".join(t.format(text) for t, text in zip(tests, texts, strict=True)) for texts in ([r for _, r, *_ in R.REASONS], [f"{k}:{t}" for *_, k, t in R.REASONS])]
    joined = [f"array_to_string(list_filter([{x}], lambda x: x IS NOT NULL)[1:4], '; ')" for x in lists]
    return f"""{_reranked_sql(kinds, least, max(12, top_k), top_k)}, x AS (SELECT doc_id, chunk_index, r2 AS rank, {", ".join(f"{_r(c)} AS {n}" for n, c in fields.items())} FROM ranked WHERE r2 <= {top_k})
  SELECT *, {joined[0]} AS reasons, {joined[1]} AS cards FROM x"""


_ALL = "'manual','decision','diary','project','imported','log'"


def _probe(spark: SparkSession, d: str) -> tuple[float, ...]:
    """The query's vector, one row of the embeddings, at length one."""
    row = D.table(spark, d, "embeddings").where("vec_id = 0").select(T.normalized(F.col("embedding").cast("array<double>")).alias("v")).first()
    return tuple(row.v) if row else ()


def _asked(spark: SparkSession, d: str) -> R.Asked:
    return R.Asked(QUERY, _probe(spark, d), path="/EN/", related=("src1/x/7.md", "12.md"), symbol="remember", branch="feature/en", language="en", last_days=150, top_k=20)


def _scored(spark: SparkSession, d: str, asked: R.Asked) -> DataFrame:
    return R.score(R.found(D.passages(spark, d), D.disabled(spark, d), D.votes(spark, d), asked, NOW), asked, NOW, D.edges(spark, d))


def recall_hybrid_topk(spark, d):
    """All twelve terms, without reranking."""
    asked = _asked(spark, d)
    best = R.top(_scored(spark, d, asked), asked.top_k, asked.min_score)
    return best.select("doc_id", "chunk_index", "source_kind", "path", *(T.rounded(F.col(t)).alias(t) for t in ("vector", "symbol_boost", "path_boost", "relation_boost", "freshness", "score")))


def recall_rerank_head(spark, d):
    """Both rerank passes over 20 rows of which the first takes 12 and the second 8."""
    asked = replace(_asked(spark, d), top_k=8)
    best = R.rerank_head(R.top(_scored(spark, d, asked), 20, asked.min_score), asked, NOW)
    return best.select("doc_id", "chunk_index", "rank", "in_tail", T.rounded(F.col("rerank")).alias("rerank"), T.rounded(F.col("rerank_model")).alias("rerank_model"), T.rounded(F.col("score")).alias("score"))


def _explained(spark, d, asked):
    rows = R.recall(D.passages(spark, d), D.disabled(spark, d), D.votes(spark, d), asked, NOW, D.edges(spark, d))
    return R.explained(rows).select("doc_id", "chunk_index", "rank", "score_details.*", F.array_join("reasons", "; ").alias("reasons"), F.array_join(F.transform("cards", lambda c: F.concat_ws(":", c["kind"], c["title"])), "; ").alias("cards"))


def recall_explained(spark, d):
    """Eight rows with their fifteen score fields, reasons and cards."""
    return _explained(spark, d, replace(_asked(spark, d), top_k=8))


def recall_fast(spark, d):
    return _explained(spark, d, replace(_asked(spark, d), top_k=8).preset("fast"))


def recall_deep(spark, d):
    return _explained(spark, d, replace(_asked(spark, d), top_k=8).preset("deep"))


def recall_passages(spark, d):
    """Candidates by module, part of a symbol and stated dates, one of which can't be read."""
    asked = R.Asked(QUERY, module="src1", symbol="task", date_from="2023-10-01", date_to="no date")
    rows = R.found(D.passages(spark, d), D.disabled(spark, d), D.votes(spark, d), asked, NOW)
    return rows.select("doc_id", "chunk_index", "symbol", "helpful")


def recall_filtered_candidates(spark, d):
    found = R.candidates(D.chunks(spark, d), D.disabled(spark, d), D.votes(spark, d), kinds=("manual", "decision"), path="/EN/", language="en", since=NOW - 60 * S.DAY_MS)
    return found.select("doc_id", "path", "helpful", "noisy")


def vector_topk(spark, d):
    e = D.table(spark, d, "embeddings")
    probe = e.where("vec_id = 0").select(F.col("embedding").alias("probe"))
    score = T.rounded(T.dot(F.col("embedding"), F.col("probe")), 5)
    return e.crossJoin(F.broadcast(probe)).select("vec_id", score.alias("score")).orderBy(F.desc("score"), "vec_id").limit(8)


def tokenize_counts(spark, d):
    t = T.tokenize(F.col("text"))
    return D.table(spark, d, "documents").select("doc_id", F.size(t).alias("tokens"), F.size(F.array_distinct(t)).alias("distinct_tokens"), T.estimate_tokens(F.col("text"), 24).alias("estimate"))


def chunk_documents(spark, d):
    c = T.chunk_texts(F.col("text"))
    return D.table(spark, d, "documents").select("doc_id", F.posexplode(c).alias("chunk_index", "c")).select("doc_id", "chunk_index", F.col("c.start").alias("start_at"), F.sha1(F.col("c.content").cast("binary")).alias("checksum"))


def text_normalisers(spark, d):
    p = F.col("url")
    return D.table(spark, d, "pages").select("page_id", T.normalize_key(p).alias("key"), T.truncate(p, 20).alias("short"), T.slugify(p).alias("slug"), T.top_level_module(F.regexp_replace(p, "^[a-z]+://", "")).alias("module"), F.sha1(T.normalize_embedding_text(p)).alias("hash"))


def branch_rollup(spark, d):
    return G.branch_rollup(D.chunks(spark, d), D.disabled(spark, d))


def kind_summary(spark, d):
    kinds = spark.createDataFrame([(k,) for k in D.KINDS[:5]], "source_kind string")
    agg = D.chunks(spark, d).groupBy("source_kind").agg(F.count(F.lit(1)).alias("n"), F.max("updated_at").alias("latest"))
    return kinds.join(agg, "source_kind", "left").fillna(0, ["n"])


def tier_summary(spark, d):
    return D.chunks(spark, d).groupBy(F.coalesce("memory_tier", F.lit("unknown")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


def feedback_totals(spark, d):
    e = D.table(spark, d, "events")
    out = debounce.vote_counters(e, "user_id", F.col("event_type").isin("purchase", "signup"), F.col("event_type") == "error", "ts")
    return out.select("user_id", F.col("helpful").cast("long"), F.col("noisy").cast("long"), (F.col("helpful") - F.col("noisy")).cast("long").alias("net"))


def graph_one_hop(spark, d):
    return G.expand(D.edges(spark, d), spark.createDataFrame([(0,), (1,)], "doc_id long"), ("module", "branch"), 12)


def conflict_clusters(spark, d):
    return G.conflict_clusters(G.claims(D.chunks(spark, d).select("doc_id", "path", "content"), positive=r"\bthe ([a-z]+)", negative=r"\bof ([a-z]+)"))


def change_detection(spark, d):
    """All pages before and after: some moved, some changed."""
    pages = D.table(spark, d, "pages")
    moved = F.when(F.col("page_id") % 5 == 0, F.concat("url", F.lit("#old"))).otherwise(F.col("url"))
    old = pages.select(moved.alias("path"), F.when(F.col("page_id") % 3 == 0, F.lit("old")).otherwise(F.sha1(F.col("html").cast("binary"))).alias("checksum"))
    new = pages.select(F.col("url").alias("path"), F.sha1(F.col("html").cast("binary")).alias("checksum"))
    return G.change_status(old, new).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def upsert_latest(spark, d):
    """All orders against revisions of all of them, every other one of which is older."""
    o = D.table(spark, d, "orders")
    shift = F.when(F.col("o_orderkey") % 2 == 0, F.expr("interval 1 day")).otherwise(F.expr("interval -1 day"))
    new = o.withColumns({"o_totalprice": F.col("o_totalprice") + 1, "o_orderdate": F.col("o_orderdate") + shift})
    return G.upsert_latest(o, new, "o_orderkey", "o_orderdate").select("o_orderkey", T.rounded(F.col("o_totalprice"), 2).alias("total"))


def debounce_sessions(spark, d):
    e = D.table(spark, d, "events")
    out = debounce.debounced(e, "user_id", "ts", "event_type", "1 hour")
    return out.select("user_id", "items", "texts", F.unix_micros(F.col("opened").cast("timestamp")).alias("opened_us"))


def title_jaccard(spark, d):
    """Pairs of neighbours by id with their title and body similarity and consolidation score."""
    c = D.chunks(spark, d).select("doc_id", "source_kind", "memory_tier", "module_name", T.tokenize(F.col("title")).alias("t"), F.slice(T.tokenize(F.col("content")), 1, 64).alias("b"), "updated_at")
    a, b = c.alias("a"), c.alias("b")
    j = a.join(b, F.col("b.doc_id") == F.col("a.doc_id") + 8)
    score = S.consolidation(T.jaccard(F.col("a.t"), F.col("b.t")), T.jaccard(F.col("a.b"), F.col("b.b")), F.col("a.module_name") == F.col("b.module_name"), F.col("a.source_kind") == F.col("b.source_kind"), F.col("a.memory_tier") == F.col("b.memory_tier"), F.abs(F.col("a.updated_at") - F.col("b.updated_at")) / S.DAY_MS)
    return j.select(F.col("a.doc_id").alias("left_id"), F.col("b.doc_id").alias("right_id"), T.rounded(score).alias("score"))


_SIDES = "sides AS (SELECT subject, doc_id, max((pol = 'for')::INT) AS f, max((pol = 'against')::INT) AS a FROM claims GROUP BY subject, doc_id)"
_JAC = "CASE WHEN len({0}) > 0 AND len({1}) > 0 THEN len(list_distinct(list_intersect({0}, {1})))::DOUBLE / len(list_distinct(list_concat({0}, {1}))) ELSE 0.0 END"

SQL = {
    "recall_hybrid_topk": f"{_scored_sql(_ALL, 0.2, 20)} SELECT doc_id, chunk_index, source_kind, path, {', '.join(_r(t) + ' AS ' + t for t in ('vector', 'symbol_boost', 'path_boost', 'relation_boost', 'freshness'))}, {_r('s0')} AS score FROM best",
    "recall_rerank_head": f"{_reranked_sql(_ALL, 0.2, 20, 8)} SELECT doc_id, chunk_index, r2 AS rank, r1 > 8 AS in_tail, {_r('m1')} AS rerank, {_r('m2')} AS rerank_model, {_r('s2')} AS score FROM ranked",
    "recall_explained": _explained_sql(_ALL, 0.2, 8),
    "recall_fast": _explained_sql("'manual','decision','project'", 0.24, 5),
    "recall_deep": _explained_sql("'manual','decision','diary','project','imported'", 0.15, 14),
    "recall_passages": f"WITH {_PASSAGES} SELECT doc_id, chunk_index, symbol, coalesce(helpful, 0) AS helpful FROM passages LEFT JOIN votes USING (doc_id) WHERE module_name = 'src1' AND contains(lower(symbol), 'task') AND updated_at >= epoch_ms(TIMESTAMP '2023-10-01 00:00:00') AND doc_id NOT IN (SELECT doc_id FROM off)",
    "recall_filtered_candidates": f"WITH {_CHUNKS}, {_VOTES}, {_OFF} SELECT doc_id, path, coalesce(helpful, 0) AS helpful, coalesce(noisy, 0) AS noisy FROM chunks LEFT JOIN votes USING (doc_id) WHERE source_kind IN ('manual', 'decision') AND path ILIKE '%/EN/%' AND language = 'en' AND updated_at >= {NOW - 60 * S.DAY_MS} AND doc_id NOT IN (SELECT doc_id FROM off)",
    "vector_topk": f"SELECT e.vec_id, {_r('list_dot_product(e.embedding::DOUBLE[], p.embedding::DOUBLE[])', 5)} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) p ORDER BY score DESC, e.vec_id LIMIT 8",
    "tokenize_counts": f"SELECT doc_id, len({_TOK.format('text')})::INT AS tokens, len(list_distinct({_TOK.format('text')}))::INT AS distinct_tokens, (greatest(1, ceil(length(text) / 4.0)) + 24)::INT AS estimate FROM documents",
    "chunk_documents": "WITH t AS (SELECT doc_id, trim(text, ' ') AS t FROM documents), c AS (SELECT doc_id, t, unnest(range(0, greatest(0, ceil((length(t) - 1200) / 1050.0))::INT + 1)) AS k FROM t), p AS (SELECT doc_id, k, (k * 1050)::INT AS start_at, trim(substring(t, k * 1050 + 1, 1200), ' ') AS content FROM c) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS chunk_index, start_at, sha1(content) AS checksum FROM p WHERE content <> ''",
    "text_normalisers": r"SELECT page_id, lower(regexp_replace(regexp_replace(replace(trim(url), '\', '/'), '^.*[.:]', ''), '[()]', '', 'g')) AS key, CASE WHEN length(url) > 20 THEN substring(url, 1, 20) || '...' ELSE url END AS short, substring(regexp_replace(regexp_replace(lower(trim(url)), '[^\p{L}\p{N}_-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) AS slug, CASE WHEN len(list_filter(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), lambda p: p <> '')) > 1 THEN list_filter(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), lambda p: p <> '')[1] END AS module, sha1(lower(trim(regexp_replace(url, '\s+', ' ', 'g')))) AS hash FROM pages",
    "branch_rollup": f"WITH {_CHUNKS}, {_OFF} SELECT branch_name, count(DISTINCT doc_id) AS docs, count(*) AS chunks, max(updated_at) AS latest, count(DISTINCT CASE WHEN doc_id IN (SELECT doc_id FROM off) THEN doc_id END) AS disabled_docs, {', '.join(f'count(*) FILTER (source_kind = {k!r}) AS n_{k}' for k in D.KINDS)} FROM chunks GROUP BY branch_name",
    "kind_summary": f"WITH {_CHUNKS} SELECT k.source_kind, count(c.doc_id) AS n, max(updated_at) AS latest FROM (SELECT unnest(['manual','decision','diary','project','imported']) AS source_kind) k LEFT JOIN chunks c USING (source_kind) GROUP BY 1",
    "tier_summary": f"WITH {_CHUNKS} SELECT coalesce(memory_tier, 'unknown') AS tier, count(*) AS n FROM chunks GROUP BY 1",
    "feedback_totals": "SELECT user_id, count(*) FILTER (event_type IN ('purchase','signup')) AS helpful, count(*) FILTER (event_type = 'error') AS noisy, count(*) FILTER (event_type IN ('purchase','signup')) - count(*) FILTER (event_type = 'error') AS net FROM events GROUP BY 1",
    "graph_one_hop": f"WITH {_CHUNKS}, {_EDGES} SELECT b.doc_id, {_r('sum(a.weight * b.weight)')} AS score, count(DISTINCT (b.edge_type, b.target_key)) AS hits FROM edges a JOIN edges b USING (edge_type, target_key) WHERE edge_type IN ('module','branch') AND a.doc_id IN (0, 1) AND b.doc_id NOT IN (0, 1) GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 12",
    "conflict_clusters": rf"WITH claims AS (SELECT DISTINCT doc_id, 'for' AS pol, unnest(regexp_extract_all(lower(text), '\bthe ([a-z]+)', 1)) AS subject FROM documents UNION SELECT DISTINCT doc_id, 'against', unnest(regexp_extract_all(lower(text), '\bof ([a-z]+)', 1)) FROM documents), {_SIDES}, n AS (SELECT subject, count(*) AS docs, sum(f) AS f, sum(a) AS a, sum(f * a) AS b FROM sides GROUP BY 1), p AS (SELECT *, (f * a - b)::BIGINT AS pairs FROM n WHERE f > 0 AND a > 0) SELECT subject, docs, pairs, {_r('least(1.0::DOUBLE, 0.836::DOUBLE + (least(0.12::DOUBLE, greatest(0, docs - 2) * 0.05::DOUBLE) + least(0.06::DOUBLE, greatest(0, pairs - 1) * 0.02::DOUBLE)))')} AS score FROM p WHERE pairs > 0",
    "change_detection": "WITH n AS (SELECT url AS path, sha1(html) AS c FROM pages), o AS (SELECT CASE WHEN page_id % 5 = 0 THEN url || '#old' ELSE url END AS path, CASE WHEN page_id % 3 = 0 THEN 'old' ELSE sha1(html) END AS c FROM pages) SELECT CASE WHEN n.path IS NULL THEN 'removed' WHEN o.path IS NULL THEN 'new' WHEN o.c = n.c THEN 'unchanged' ELSE 'changed' END AS status, count(*) AS n FROM o FULL JOIN n ON o.path = n.path GROUP BY 1",
    "upsert_latest": f"WITH b AS (SELECT o_orderkey, o_totalprice, o_orderdate, 0 AS new FROM orders UNION ALL SELECT o_orderkey, o_totalprice + 1, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate - INTERVAL 1 DAY END, 1 FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY o_orderdate DESC, new DESC) AS k FROM b) SELECT o_orderkey, {_r('o_totalprice', 2)} AS total FROM r WHERE k = 1",
    "debounce_sessions": "WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS o FROM events), s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts) AS w FROM g) SELECT user_id, count(*) AS items, count(DISTINCT event_type)::INT AS texts, epoch_us(min(ts)) AS opened_us FROM s GROUP BY user_id, w",
    "title_jaccard": f"WITH {_CHUNKS}, c AS (SELECT doc_id, source_kind, memory_tier, module_name, {_TOK.format('title')} AS t, ({_TOK.format('content')})[1:64] AS b, updated_at FROM chunks) SELECT x.doc_id AS left_id, y.doc_id AS right_id, {_r('(' + _JAC.format('x.t', 'y.t') + ') * 0.36 + (' + _JAC.format('x.b', 'y.b') + ') * 0.34 + CASE WHEN x.module_name = y.module_name THEN 0.12::DOUBLE ELSE 0 END + CASE WHEN x.source_kind = y.source_kind THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN x.memory_tier = y.memory_tier THEN 0.04::DOUBLE ELSE 0 END + greatest(0.0::DOUBLE, 1 - abs(x.updated_at - y.updated_at) / 86400000.0::DOUBLE / 90) * 0.06')} AS score FROM c x JOIN c y ON y.doc_id = x.doc_id + 8",
}
QUERIES = {f.__name__: f for f in (recall_hybrid_topk, recall_rerank_head, recall_explained, recall_fast, recall_deep, recall_passages, recall_filtered_candidates, vector_topk, tokenize_counts, chunk_documents, text_normalisers, branch_rollup, kind_summary, tier_summary, feedback_totals, graph_one_hop, conflict_clusters, change_detection, upsert_latest, debounce_sessions, title_jaccard)}
