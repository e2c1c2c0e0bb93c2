"""Queries of task context, checkpoints, domains and profiles, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import context as C
from ..operators import ingest as I
from ..operators import records as R
from ..operators import recall
from ..sources import tables as D
from .queries import QUERY, _CHUNKS, _r

NOW, HOUR = D.NOW_MS, 3_600_000


def context_for_task(spark, d):
    found = recall.candidates(D.chunks(spark, d), D.disabled(spark, d), D.votes(spark, d)).withColumns({"symbol": F.lit(None).cast("string"), "chunk_index": F.lit(0)})
    scored = recall.score(found, recall.Asked(QUERY, branch="feature/en"), NOW)
    return C.results(spark, C.for_task(scored, "fix the crash in the parser", edges=D.edges(spark, d), budget=6, tokens=6000))


def _checkpoints(spark, d):
    """One record for each turn; every seventh has no goal and is no checkpoint."""
    c = D.table(spark, d, "conversations")
    at = F.lit(NOW) - (F.col("conv_id") * 9 + F.col("turn")) * HOUR
    rec = F.struct(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.substring("text", 1, 30).alias("title"), F.when((F.col("conv_id") + F.col("turn")) % 7 > 0, F.col("role")).alias("session_goal"), F.lit("open").alias("current_status"),
        F.array(F.lit(" a "), F.lit("A"), F.col("role"), F.lit("")).alias("next_steps"), at.alias("created_at"), at.alias("updated_at"),
    )
    return R.read_checkpoints(c.select(F.to_json(rec).alias("json")))


def checkpoint_resume(spark, d):
    hours = (F.lit(NOW) - F.col("updated_at")) / HOUR
    return _checkpoints(spark, d).select("id", T.freshness_label(hours).alias("freshness"), F.sha1(R.resume_prompt(hours).cast("binary")).alias("prompt_sha1"))


def checkpoint_active(spark, d):
    h = _checkpoints(spark, d).withColumn("conv", F.substring_index("id", "-", 1))
    return R.active_checkpoints(h, "conv").select("conv", "id", "updated_at")


def _domains(spark, d):
    n = D.table(spark, d, "nation")
    return n.select(F.lower("n_name").alias("name"), F.col("n_name").alias("display_name"), F.array(F.substring("n_name", 1, 3), F.lit("All")).alias("aliases"), F.array(F.col("n_regionkey").cast("string")).alias("sections"), "n_nationkey")


def domain_aliases(spark, d):
    more = R.add_aliases(_domains(spark, d), F.array(F.lit("ALL"), F.col("name")))
    return R.remove_aliases(more, F.array(F.lit("aLL"))).select("name", F.concat_ws(",", "aliases").alias("aliases"))


def domain_resolve(spark, d):
    asked = D.table(spark, d, "nation").select(F.explode(F.array(F.upper(F.substring("n_name", 1, 3)), F.lower("n_name"), F.lit("all"))).alias("term")).distinct()
    return R.resolve_domain(_domains(spark, d), asked)


def domain_index(spark, d):
    files = D.table(spark, d, "customer").join(F.broadcast(_domains(spark, d)), F.col("c_nationkey") == F.col("n_nationkey")).select("name", F.concat(F.when(F.col("c_custkey") % 5 == 0, "_drafts/").otherwise("notes/"), "c_name", F.when(F.col("c_custkey") % 3 == 0, ".txt").otherwise(".md")).alias("path"))
    return R.domain_index(_domains(spark, d), files)


def profile_state(spark, d):
    m = D.table(spark, d, "pages").select(F.when(F.col("page_id") % 4 == 0, "old").otherwise("hash").alias("embedding_profile"))
    return R.profile_state(m, "hash")


def language_rollup(spark, d):
    p = F.concat_ws(".", F.regexp_replace("url", r"[?#].*$", ""), F.element_at(F.array(*map(F.lit, ("py", "TS", "rs", "bin"))), (F.col("page_id") % 4 + 1).cast("int")))
    return D.table(spark, d, "pages").groupBy(T.language_of(p).alias("language")).agg(F.count(F.lit(1)).alias("n"))


def path_functions(spark, d):
    p = F.regexp_replace("url", "^[a-z]+://", "")
    return D.table(spark, d, "pages").select("page_id", T.parent_bucket(p).alias("parent"), T.base_name(p).alias("base"), T.path_tail(p).alias("tail"), T.ascii_slug(p, 24).alias("slug"), T.domain_slug(p).alias("domain"), T.symbol_name(p).alias("symbol"), T.truncate_line(p, 20).alias("line"))


def interesting_phrases(spark, d):
    return D.table(spark, d, "documents").select("doc_id", F.sha1(F.coalesce(T.interesting_phrase(F.col("text")), F.lit("")).cast("binary")).alias("phrase_sha1"))


def decision_notes(spark, d):
    note = I.decision_note(F.col("title"), F.col("content"), F.col("branch_name"), F.col("module_name"), F.array("source_kind", "language"))
    return D.chunks(spark, d).where("source_kind = 'decision'").select("doc_id", F.sha1(note.cast("binary")).alias("note_sha1"))


_CP = f"cp AS (SELECT conv_id || '-' || turn AS id, conv_id::VARCHAR AS conv, substring(text, 1, 30) AS title, role, {NOW} - (conv_id * 9 + turn) * {HOUR} AS updated_at, conv_id * 9 + turn AS hours FROM conversations WHERE (conv_id + turn) % 7 > 0 AND regexp_matches(substring(text, 1, 30), '\\S'))"
_P = "p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS p FROM pages)"
SQL = {
    "checkpoint_resume": f"WITH {_CP} SELECT id, CASE WHEN hours <= 72 THEN 'fresh' WHEN hours <= 336 THEN 'recent' ELSE 'stale' END AS freshness, sha1('Resume ' || CASE WHEN hours <= 72 THEN 'fresh' WHEN hours <= 336 THEN 'recent' ELSE 'stale' END || ' work context: ' || title || chr(10) || 'Goal: ' || role || chr(10) || 'Status: open' || chr(10) || 'Next steps: a | ' || role) AS prompt_sha1 FROM cp",
    "checkpoint_active": f"WITH {_CP} SELECT conv, max_by(id, (updated_at, id)) AS id, max(updated_at) AS updated_at FROM cp GROUP BY 1",
    "domain_aliases": "WITH a AS (SELECT lower(n_name) AS name, [substring(n_name, 1, 3), 'All', 'ALL', lower(n_name)] AS l FROM nation) SELECT name, array_to_string(list_filter(l, lambda x, i: NOT list_contains(l[1:i - 1], x) AND lower(x) NOT IN ('all')), ',') AS aliases FROM a",
    "domain_resolve": "WITH k AS (SELECT lower(n_name) AS name, unnest([lower(n_name), lower(substring(n_name, 1, 3)), 'all']) AS k FROM nation), a AS (SELECT DISTINCT unnest([upper(substring(n_name, 1, 3)), lower(n_name), 'all']) AS term FROM nation) SELECT term, min(name) AS name FROM a JOIN k ON lower(term) = k GROUP BY 1",
    "domain_index": "SELECT lower(n_name) AS name, 1::INT AS section_count, count(c_custkey) AS file_count FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_custkey % 5 > 0 AND c_custkey % 3 > 0 GROUP BY 1",
    "profile_state": "SELECT count(*) AS total, count(*) FILTER (page_id % 4 > 0) AS \"current\", count(*) FILTER (page_id % 4 = 0) AS stale, CASE WHEN count(*) = 0 THEN 'empty' WHEN count(*) FILTER (page_id % 4 = 0) = 0 THEN 'ready' ELSE 'rebuild_required' END AS state FROM pages",
    "language_rollup": r"WITH p AS (SELECT regexp_replace(url, '[?#].*$', '') || '.' || (['py', 'TS', 'rs', 'bin'])[page_id % 4 + 1] AS path FROM pages), e AS (SELECT lower(regexp_extract(path, '\.([A-Za-z0-9]+)$', 1)) AS ext FROM p) SELECT CASE " + " ".join(f"WHEN ext = '{k}' THEN '{v}'" for k, v in T.LANGUAGES.items()) + " ELSE 'text' END AS language, count(*) AS n FROM e GROUP BY 1",
    "path_functions": rf"WITH {_P}, f AS (SELECT *, string_split(p, '/') AS s, trim(regexp_replace(p, '\s+', ' ', 'g')) AS l FROM p) SELECT page_id, CASE WHEN len(s) > 1 THEN s[-2] ELSE '.' END AS parent, s[-1] AS base, array_to_string(s[-2:], '/') AS tail, substring(regexp_replace(regexp_replace(lower(p), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 24) AS slug, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(p), '[\s/]+', '-', 'g'), '[^a-z0-9_-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS domain, regexp_replace(regexp_replace(p, '^.*[.:]', ''), '[()]', '', 'g') AS symbol, CASE WHEN length(l) > 20 THEN rtrim(substring(l, 1, 17)) || '...' ELSE l END AS line FROM f",
    "interesting_phrases": r"WITH x AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[,\n]'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: len(string_split_regex(p, '\s+')) >= 3) AS l FROM documents), y AS (SELECT doc_id, l, list_max(list_transform(l, lambda p: length(p))) AS m FROM x) SELECT doc_id, sha1(coalesce(list_filter(l, lambda p: length(p) = m)[1], '')) AS phrase_sha1 FROM y",
    "decision_notes": f"WITH {_CHUNKS} SELECT doc_id, sha1('# ' || title || chr(10) || chr(10) || '## Decision' || chr(10) || content || coalesce(chr(10) || chr(10) || '## Rationale' || chr(10) || branch_name, '') || chr(10) || chr(10) || '## Impact' || chr(10) || module_name || chr(10) || chr(10) || 'Tags: decision, ' || language) AS note_sha1 FROM chunks WHERE source_kind = 'decision'",
}
QUERIES = {f.__name__: f for f in (context_for_task, checkpoint_resume, checkpoint_active, domain_aliases, domain_resolve, domain_index, profile_state, language_rollup, path_functions, interesting_phrases, decision_notes)}
