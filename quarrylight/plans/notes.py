"""Queries of note writing, file ingest, exports, checkpoints and domains, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import hygiene as H
from ..operators import ingest as I
from ..operators import lineage
from ..operators import notes as N
from ..sources import files as X
from ..sources import tables as D
from ..sources.tree import filesystem
from .queries import _CHUNKS, _OFF, _VOTES

NOW, DAY, TODAY = D.NOW_MS, 86_400_000, "2024-02-01"
EVENTS = ("purchase", "signup")


def _sources(spark, d):
    return H.source_rollup(D.chunks(spark, d), D.disabled(spark, d), D.votes(spark, d))


def _logs(spark, d):
    """Each turn as a log; some parts are null or empty."""
    c = D.table(spark, d, "conversations")
    some = lambda k, v: F.when((F.col("conv_id") + F.col("turn")) % k > 0, v)
    note = N.log_note(F.concat_ws("-", "conv_id", "turn"), F.lit("2024-02-01 00:00"), some(2, F.col("role")), some(3, F.lit("build")), F.lit(""), some(5, F.col("text")), F.when(F.col("turn") % 2 == 0, F.array("role", F.lit("x"))).otherwise(F.array().cast("array<string>")))
    return c.select("conv_id", "turn", note.alias("content"))


def log_notes(spark, d):
    return _logs(spark, d).select("conv_id", "turn", F.md5(F.col("content").cast("binary")).alias("digest"))


def log_fields(spark, d):
    """Read back from the Markdown."""
    fields = N.log_fields(F.col("content"))
    return _logs(spark, d).select("conv_id", "turn", *(c.alias(n) for n, c in fields.items() if n != "details"), F.md5(fields["details"].cast("binary")).alias("details"))


def remember_notes(spark, d):
    """All turns remembered, of six kinds; those without a title share one path by kind, where the last one stays."""
    c = D.table(spark, d, "conversations")
    kind = F.element_at(F.array(*map(F.lit, D.KINDS)), (F.col("conv_id") % 6 + 1).cast("int"))
    notes = c.select(F.when(F.col("turn") % 4 > 0, F.concat_ws(" ", F.lit("Note:"), "conv_id", "turn")).alias("title"), F.concat(F.lit("  "), "text", F.lit("\n")).alias("content"), kind.alias("source_kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"))
    return N.remember(notes, "memory", NOW).select("doc_id", "path", "memory_tier", "stability_score", "checksum", "chunk_count")


def forget_paths(spark, d):
    """Every third document's path and some that don't exist; what stays, by kind."""
    c = D.chunks(spark, d)
    asked = c.where("doc_id % 3 = 0").select("path").unionByName(c.where("doc_id % 50 = 1").select(F.concat("path", F.lit("x")).alias("path")))
    left, found = N.forget({"manifests": c.where("doc_id % 2 = 0").select("doc_id", "path", "source_kind"), "chunks": c.select("doc_id", "path", "source_kind")}, asked)
    n = F.count(F.lit(1)).alias("n")
    rows = [t.groupBy("source_kind").agg(n).select(F.lit(k).alias("part"), "source_kind", "n") for k, t in left.items()]
    return rows[0].unionByName(rows[1]).unionByName(found.groupBy(F.coalesce("source_kind", F.lit("none")).alias("source_kind")).agg(n).select(F.lit("found").alias("part"), "source_kind", "n"))


def source_switches(spark, d):
    """Every fifth document is disabled, every seventh enabled, some are unknown; votes and answers after it."""
    c = D.chunks(spark, d)
    asked = c.where("doc_id % 5 = 0 or doc_id % 7 = 0").select((F.col("doc_id") + F.when(F.col("doc_id") % 35 == 0, 10**9).otherwise(0)).alias("doc_id"), F.when(F.col("doc_id") % 5 == 0, "disable").otherwise("enable").alias("action"), F.lit("asked").alias("reason"))
    off = D.disabled(spark, d).withColumn("reason", F.lit("toxic"))
    kept, votes, answers = N.switch(off, D.votes(spark, d), asked, c, NOW)
    rows = votes.join(kept, "doc_id", "full_outer").join(answers, "doc_id", "full_outer")
    return rows.select("doc_id", "helpful", "noisy", "net", "last_ms", "reason", "answer").fillna(-99, ["helpful", "noisy", "net", "last_ms"])


def rated_sources(spark, d):
    e = D.table(spark, d, "events").select((F.col("event_id") % 1500).alias("doc_id"), F.when(F.col("event_type").isin(*EVENTS), "helpful").when(F.col("event_type") == "error", "noisy").otherwise("none").alias("signal"))
    return N.rate(D.votes(spark, d), e, D.chunks(spark, d), NOW)


def canonical_export(spark, d):
    rows = N.export(_sources(spark, d), D.chunks(spark, d), kinds=("decision", "project", "diary"), content=True, limit=60)
    return rows.select("doc_id", "source_kind", "path", "is_disabled", "helpful", "content_included", F.md5(F.col("content").cast("binary")).alias("content"), "superseded_by", F.size("conflict_subjects").alias("subjects"))


def recent_sources(spark, d):
    totals, recent = N.inspection(_sources(spark, d))
    return recent.crossJoin(F.broadcast(totals)).select("doc_id", "source_kind", "updated_at", "is_disabled", "total", "active", "disabled")


def touched_manifests(spark, d):
    ids = D.table(spark, d, "labels").select("doc_id", (F.lit(NOW) + F.col("doc_id")).alias("updated_at"))
    return N.touch(D.chunks(spark, d).select("doc_id", "updated_at"), ids)


def cache_upserts(spark, d):
    """A cache of the first turns, and all turns later, of two profiles."""
    c = D.table(spark, d, "conversations").select((F.col("conv_id") % 2).cast("string").alias("profile_key"), T.content_hash(F.col("text")).alias("content_hash"), F.col("conv_id").alias("embedding"), (F.col("turn") + F.col("conv_id") * 100).alias("updated_at"))
    return N.upsert_cache(c.where("updated_at % 100 = 0"), c)


def cache_fill(spark, d):
    """Every text gets a vector: the cache's, or that of its hash's first text."""
    c = D.table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("place"), "text", "turn")
    cache = c.where("turn = 0").groupBy(T.content_hash(F.col("text")).alias("content_hash")).agg(F.lit(-1).alias("embedding")).withColumn("profile_key", F.lit("p"))
    out, new = N.fill_from_cache(c, cache, "p", lambda m: m.select("content_hash", F.length("text").alias("embedding")))
    return out.select("place", "hit", "embedding").unionByName(new.agg(F.count(F.lit(1)).cast("int").alias("embedding")).select(F.lit("misses").alias("place"), F.lit(False).alias("hit"), "embedding"))


def path_lookup(spark, d):
    c = D.chunks(spark, d).select("doc_id", "path", "source_kind")
    asked = c.select("path").unionByName(c.select(F.concat("path", F.lit("?")).alias("path")))
    return N.find_by_path(asked, c.where("doc_id % 2 = 0").withColumn("source_kind", F.lit("manifest")), c).fillna(-1, ["doc_id"])


def _checkpoints(spark, d):
    c = D.table(spark, d, "conversations")
    return c.select((F.col("conv_id") % 20).alias("project"), F.concat_ws("-", "conv_id", "turn").alias("id"), (F.col("turn") * 10 + F.col("conv_id") % 7).alias("updated_at"), "turn")


def checkpoint_writes(spark, d):
    """Later turns saved after the first ones, then a third of the projects (and one unknown) cleared."""
    c = _checkpoints(spark, d)
    history, active = N.save_checkpoints(c.where("turn = 0"), c.where("turn > 0"))
    left, cleared = N.clear_checkpoints(active, c.where("project % 3 = 0").select("project").unionByName(spark.createDataFrame([(999,)], "project long")))
    n = history.groupBy("project").agg(F.count(F.lit(1)).alias("saved"))
    return n.join(left.select("project", "id"), "project", "left").join(cleared, "project", "full_outer").fillna(0, ["saved"])


DOMAIN = "name string, display_name string, aliases array<string>, description string, tags array<string>, sections array<struct<dir:string,label:string>>, created_at string, updated_at string"


def domain_changes(spark, d):
    """Domains of all part types created, updated, extended and partly deleted."""
    p = D.table(spark, d, "part").select("p_type").distinct()
    new = p.select(F.col("p_type").alias("name"), F.lit("").alias("display_name"), F.array(F.split("p_type", " ")[0]).alias("aliases"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("array<string>").alias("tags"), F.lit(None).cast("array<struct<dir:string,label:string>>").alias("sections"))
    out = N.create_domains(spark.createDataFrame([], DOMAIN), new, "2024-01-01")
    named = out.select("name", "display_name")
    long = named.where("length(name) % 2 = 0")
    out = N.update_domains(out, long.select("name", F.lit(None).cast("string").alias("display_name"), F.lit(None).cast("array<string>").alias("aliases"), F.upper("name").alias("description"), F.lit(None).cast("array<string>").alias("tags")), TODAY)
    one = long.select("name", F.lit("notes").alias("dir"), F.lit("Notes").alias("label"))
    out = N.add_sections(N.add_sections(out, one), one)
    out = N.delete_domains(out, named.where("length(name) % 5 = 0"))
    return out.select("name", "display_name", F.concat_ws(",", "aliases").alias("aliases"), "description", F.size("sections").alias("sections"), "created_at", "updated_at")


def text_parameters(spark, d):
    """Names, relative paths and optional parameters from urls and ids."""
    p = D.table(spark, d, "pages")
    n = F.concat(F.when(F.col("page_id") % 3 == 0, F.lit(" ")).otherwise(F.lit("x")), F.col("page_id").cast("string"), F.lit("px"))
    when = F.concat(F.lit("2024-01-"), F.lpad((F.col("page_id") % 40).cast("string"), 2, "0"))
    return p.select("page_id", N.profile_directory("url").alias("directory"), N.relative_to(F.lit("https://www.example.com/"), F.col("url")).alias("relative"), F.coalesce(N.optional_int(n), F.lit(-1)).alias("number"), N.optional_bool(F.when(F.col("page_id") % 2 == 0, "true").otherwise("yes")).alias("flag"), N.optional_string(F.when(F.col("page_id") % 4 == 0, "  ").otherwise(F.col("url"))).alias("word"), F.coalesce(N.parse_date(when), F.lit(-1)).alias("at"))


# ---------------------------------------------------------------- files


def _tree(spark, d):
    """A folder with one file for each page: Markdown, some of it excluded, hidden, of another kind or with underscores before its name."""
    at = lineage.folder(spark)
    k = F.col("page_id")
    place = F.when(k % 11 == 0, "node_modules/x").when(k % 13 == 0, "src/.cache").when(k % 17 == 0, "_drafts").otherwise(F.concat(F.lit("m"), (k % 5).cast("string"), F.lit("/sub")))
    rows = D.table(spark, d, "pages").select(F.concat_ws("/", place, F.concat(F.when(k % 19 == 0, "__p ").otherwise("p "), k.cast("string"), F.when(k % 7 == 0, ".png").otherwise(".md"))).alias("path"), "html")

    def write(part):
        files, base = filesystem(at)
        for r in part:
            files.create_dir(f"{base}/{r.path}".rsplit("/", 1)[0])
            with files.open_output_stream(f"{base}/{r.path}") as f:
                f.write((r.html or "").encode())

    rows.foreachPartition(write)
    return at


def project_scan(spark, d):
    return X.scan(spark, _tree(spark, d)).select("path", "size_bytes", "checksum")


def markdown_files(spark, d):
    return X.markdown(spark, _tree(spark, d)).select("path", F.length("content").alias("length"))


def indexed_files(spark, d):
    """Manifests, chunks and edges of a scanned tree, counted by module."""
    made = X.index_documents(X.scan(spark, _tree(spark, d)), "p", NOW, max_bytes=40_000)
    chunks = made["chunks"].groupBy("path").agg(F.count(F.lit(1)).alias("chunks"), F.sum("start").alias("starts"), F.sum(F.size("embedding")).alias("numbers"))
    edges = made["edges"].groupBy("doc_id").agg(F.count(F.lit(1)).alias("edges"))
    return made["manifests"].join(chunks, "path", "left").join(edges, "doc_id", "left").select("path", "size_bytes", "chunks", "starts", "numbers", "edges").fillna(0, ["chunks", "starts", "numbers", "edges"])


def index_summary(spark, d):
    """The scan against manifests of which some are older, some gone and some of another size."""
    files = X.scan(spark, _tree(spark, d))
    known = files.select("path", "mtime_ms", (F.col("size_bytes") + F.when(F.length("path") % 4 == 0, 1).otherwise(0)).alias("size_bytes"), F.when(F.length("path") % 8 == 0, "old").otherwise(F.col("checksum")).alias("checksum"), F.lit("p").alias("embedding_profile"))
    gone = known.limit(0).unionByName(spark.createDataFrame([("gone.md", 1, 1, "x", "p")], known.schema))
    return N.index_summary(I.scan_changes(files, known.unionByName(gone), "p", 40_000))


def missing_texts(spark, d):
    files = X.scan(spark, _tree(spark, d))
    asked = D.table(spark, d, "pages").select(F.concat(F.lit("m"), (F.col("page_id") % 5).cast("string"), F.lit("/sub/p "), F.col("page_id").cast("string"), F.lit(".md")).alias("path"))
    return X.texts_at(asked, files).select("path", F.length("content").alias("length"))


_PLACE = "CASE WHEN page_id % 11 = 0 THEN 'node_modules/x' WHEN page_id % 13 = 0 THEN 'src/.cache' WHEN page_id % 17 = 0 THEN '_drafts' ELSE 'm' || (page_id % 5)::VARCHAR || '/sub' END || CASE WHEN page_id % 19 = 0 THEN '/__p ' ELSE '/p ' END || page_id::VARCHAR || CASE WHEN page_id % 7 = 0 THEN '.png' ELSE '.md' END"
_FILES = f"files AS (SELECT page_id, {_PLACE} AS path, html, strlen(html)::BIGINT AS size_bytes FROM pages WHERE page_id % 11 <> 0 AND page_id % 13 <> 0 AND page_id % 7 <> 0)"
_KIND = "['manual','decision','diary','project','imported','log'][conv_id % 6 + 1]"
_LOG = "SELECT conv_id, turn, '# Log: ' || conv_id || '-' || turn || chr(10) || '**Time**: 2024-02-01 00:00' || CASE WHEN (conv_id + turn) % 2 > 0 THEN chr(10) || '**Model**: ' || role ELSE '' END || CASE WHEN (conv_id + turn) % 3 > 0 THEN chr(10) || '**Action**: build' ELSE '' END || chr(10) || '## Details' || chr(10) || CASE WHEN (conv_id + turn) % 5 > 0 AND text <> '' THEN text ELSE 'No additional notes provided.' END || CASE WHEN turn % 2 = 0 THEN chr(10) || '## Tags' || chr(10) || '- ' || role || chr(10) || '- x' ELSE '' END AS content, role, text FROM conversations"
_TITLE = "CASE WHEN turn % 4 > 0 THEN 'Note: ' || conv_id || ' ' || turn ELSE kind || '-' || {0} END".format(NOW)
_FOUND = "SELECT path, CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE doc_id END AS doc_id, source_kind FROM chunks"
SQL = {
    "log_notes": f"SELECT conv_id, turn, md5(content) AS digest FROM ({_LOG})",
    "log_fields": rf"SELECT conv_id, turn, '2024-02-01 00:00' AS time, CASE WHEN (conv_id + turn) % 2 > 0 THEN role END AS model, CASE WHEN (conv_id + turn) % 3 > 0 THEN 'build' END AS action, NULL::VARCHAR AS test_result, md5(regexp_replace(regexp_replace(split_part(content, '## Details' || chr(10), 2), '^\s+', ''), '\s+$', '')) AS details FROM ({_LOG})",
    "remember_notes": rf"WITH k AS (SELECT *, {_KIND} AS kind, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS body FROM conversations), t AS (SELECT *, {_TITLE} AS title FROM k), p AS (SELECT *, 'memory/' || kind || '/' || substring(regexp_replace(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}_-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) || '.md' AS path FROM t) SELECT 'manual:' || sha1(path) AS doc_id, path, CASE WHEN kind IN ('decision', 'manual', 'imported') THEN 'stable' WHEN kind = 'diary' THEN 'working' ELSE 'project' END AS memory_tier, CASE kind WHEN 'decision' THEN 0.95::DOUBLE WHEN 'manual' THEN 0.82 WHEN 'imported' THEN 0.72 WHEN 'diary' THEN 0.46 ELSE 0.52 END AS stability_score, sha1(body) AS checksum, CASE WHEN body = '' THEN 0 ELSE greatest(0, ceil((length(body) - 1200) / 1050.0))::INT + 1 END AS chunk_count FROM p QUALIFY row_number() OVER (PARTITION BY path ORDER BY conv_id * 1000 + turn DESC) = 1",
    "forget_paths": f"WITH {_CHUNKS}, l AS (SELECT * FROM chunks WHERE doc_id % 3 <> 0) SELECT 'manifests' AS part, source_kind, count(*) AS n FROM l WHERE doc_id % 2 = 0 GROUP BY 2 UNION ALL SELECT 'chunks', source_kind, count(*) FROM l GROUP BY 2 UNION ALL SELECT 'found', source_kind, count(*) FROM chunks WHERE doc_id % 3 = 0 GROUP BY 2 UNION ALL SELECT 'found', 'none', count(*) FROM chunks WHERE doc_id % 50 = 1 HAVING count(*) > 0",
    "source_switches": f"WITH {_VOTES}, {_OFF}, o AS (SELECT CASE WHEN doc_id % 35 = 0 THEN doc_id + 1000000000 ELSE doc_id END AS doc_id, CASE WHEN doc_id % 5 = 0 THEN 'disable' ELSE 'enable' END AS action, doc_id % 35 > 0 AS known FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0), a AS (SELECT o.doc_id, CASE WHEN NOT known THEN 'unknown' WHEN action = 'disable' THEN 'disabled' WHEN f.doc_id IS NOT NULL THEN 'enabled' ELSE 'already enabled' END AS answer FROM o LEFT JOIN off f USING (doc_id)), k AS (SELECT doc_id, 'toxic' AS reason FROM off WHERE doc_id NOT IN (SELECT doc_id FROM o WHERE known) UNION ALL SELECT doc_id, 'asked' FROM a WHERE answer = 'disabled'), w AS (SELECT doc_id, sum(helpful)::BIGINT AS helpful, sum(noisy)::BIGINT AS noisy, max(last_ms) AS last_ms FROM (SELECT doc_id, helpful, noisy, last_ms FROM votes UNION ALL SELECT doc_id, 0, 1, {NOW} FROM a WHERE answer = 'disabled') GROUP BY 1) SELECT coalesce(w.doc_id, k.doc_id, a.doc_id) AS doc_id, coalesce(helpful, -99) AS helpful, coalesce(noisy, -99) AS noisy, coalesce(helpful - noisy, -99) AS net, coalesce(last_ms, -99) AS last_ms, reason, answer FROM w FULL JOIN k ON w.doc_id = k.doc_id FULL JOIN a ON a.doc_id = coalesce(w.doc_id, k.doc_id)",
    "rated_sources": f"WITH {_VOTES}, s AS (SELECT event_id % 1500 AS doc_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS h, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS z FROM events), n AS (SELECT doc_id, helpful, noisy, last_ms FROM votes UNION ALL SELECT doc_id, sum(h), sum(z), {NOW} FROM s WHERE h + z > 0 AND doc_id IN (SELECT doc_id FROM documents) GROUP BY 1) SELECT doc_id, sum(helpful)::BIGINT AS helpful, sum(noisy)::BIGINT AS noisy, max(last_ms) AS last_ms, (sum(helpful) - sum(noisy))::BIGINT AS net FROM n GROUP BY 1",
    "canonical_export": f"WITH {_CHUNKS}, {_VOTES}, {_OFF}, s AS (SELECT c.*, coalesce(helpful, 0) AS helpful, doc_id IN (SELECT doc_id FROM off) AS is_disabled FROM chunks c LEFT JOIN votes v USING (doc_id) WHERE source_kind IN ('decision', 'project', 'diary') ORDER BY updated_at DESC, doc_id LIMIT 60) SELECT doc_id, source_kind, path, is_disabled, helpful, source_kind <> 'project' AS content_included, CASE WHEN source_kind <> 'project' THEN md5(content) END AS content, NULL::VARCHAR AS superseded_by, 0 AS subjects FROM s",
    "recent_sources": f"WITH {_CHUNKS}, {_OFF}, s AS (SELECT doc_id, source_kind, updated_at, doc_id IN (SELECT doc_id FROM off) AS is_disabled FROM chunks), t AS (SELECT count(*) AS total, count(*) FILTER (NOT is_disabled) AS active, count(*) FILTER (is_disabled) AS disabled FROM s) SELECT * FROM (SELECT * FROM s ORDER BY updated_at DESC, doc_id LIMIT 8) CROSS JOIN t",
    "touched_manifests": f"WITH {_CHUNKS} SELECT c.doc_id, coalesce(t.at, c.updated_at) AS updated_at FROM chunks c LEFT JOIN (SELECT DISTINCT doc_id, {NOW} + doc_id AS at FROM labels) t USING (doc_id)",
    "cache_upserts": r"SELECT (conv_id % 2)::VARCHAR AS profile_key, sha1(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS content_hash, max_by(conv_id, turn + conv_id * 100) AS embedding, max(turn + conv_id * 100) AS updated_at FROM conversations GROUP BY 1, 2",
    "cache_fill": r"WITH h AS (SELECT *, sha1(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS h FROM conversations), k AS (SELECT DISTINCT h FROM h WHERE turn = 0), f AS (SELECT h, length(min(text))::INT AS n FROM h WHERE h NOT IN (SELECT h FROM k) GROUP BY 1) SELECT conv_id || '-' || turn AS place, f.h IS NULL AS hit, coalesce(n, -1)::INT AS embedding FROM h LEFT JOIN f USING (h) UNION ALL SELECT 'misses', false, count(*)::INT FROM f",
    "path_lookup": f"WITH {_CHUNKS} SELECT path, doc_id, CASE WHEN doc_id % 2 = 0 THEN 'manifest' ELSE source_kind END AS source_kind FROM chunks UNION ALL SELECT path || '?', -1, NULL FROM chunks",
    "checkpoint_writes": "WITH c AS (SELECT conv_id % 20 AS project, conv_id || '-' || turn AS id, turn * 10 + conv_id % 7 AS saved_at FROM conversations), n AS (SELECT project, count(*) AS saved, max_by(id, (saved_at, id)) AS id FROM c GROUP BY 1) SELECT project, saved, CASE WHEN project % 3 > 0 THEN id END AS id, CASE WHEN project % 3 = 0 THEN true END AS cleared FROM n UNION ALL SELECT 999, 0, NULL, false",
    "domain_changes": r"WITH t AS (SELECT DISTINCT p_type, regexp_replace(lower(p_type), '[\s/]+', '-', 'g') AS name FROM part), u AS (SELECT *, length(name) % 2 = 0 AS even FROM t) SELECT name, p_type AS display_name, split_part(p_type, ' ', 1) AS aliases, CASE WHEN even THEN upper(name) ELSE '' END AS description, CASE WHEN even THEN 1 ELSE 0 END AS sections, '2024-01-01' AS created_at, CASE WHEN even THEN '2024-02-01' ELSE '2024-01-01' END AS updated_at FROM u WHERE length(name) % 5 <> 0",
    "text_parameters": r"SELECT page_id, regexp_replace(trim(url), '[^a-zA-Z0-9._-]+', '_', 'g') AS directory, CASE WHEN starts_with(url, 'https://www.example.com/') THEN substring(url, 25) ELSE url END AS relative, CASE WHEN page_id % 3 = 0 THEN page_id ELSE -1 END AS number, CASE WHEN page_id % 2 = 0 THEN true END AS flag, CASE WHEN page_id % 4 <> 0 THEN url END AS word, CASE WHEN page_id % 40 BETWEEN 1 AND 31 THEN epoch_ms(TIMESTAMP '2024-01-01 00:00:00') + (page_id % 40 - 1) * 86400000 ELSE -1 END AS at FROM pages",
    "project_scan": f"WITH {_FILES} SELECT path, size_bytes, sha1(html) AS checksum FROM files",
    "markdown_files": f"WITH f AS (SELECT {_PLACE} AS path, html FROM pages WHERE (page_id % 11 = 0 OR page_id % 13 <> 0) AND page_id % 7 <> 0) SELECT path, length(html)::INT AS length FROM f WHERE NOT starts_with(path, '_')",
    "indexed_files": rf"WITH {_FILES}, t0 AS (SELECT path, size_bytes, trim(html, ' ') AS t FROM files WHERE size_bytes <= 40000), c0 AS (SELECT path, t, unnest(range(0, greatest(0, ceil((length(t) - 1200) / 1050.0))::INT + 1)) AS k FROM t0), p0 AS (SELECT path, k FROM c0 WHERE trim(substring(t, k * 1050 + 1, 1200), ' ') <> ''), n AS (SELECT path, count(*) AS chunks, sum(k * 1050)::BIGINT AS starts, count(*) * 64 AS numbers FROM p0 GROUP BY 1) SELECT t0.path, size_bytes, coalesce(chunks, 0) AS chunks, coalesce(starts, 0) AS starts, coalesce(numbers, 0)::BIGINT AS numbers, 3::BIGINT AS edges FROM t0 LEFT JOIN n USING (path)",
    "index_summary": f"WITH {_FILES} SELECT count(*) FILTER (size_bytes <= 40000 AND length(path) % 8 = 0) AS indexed, count(*) FILTER (size_bytes > 40000) AS skipped, count(*) FILTER (size_bytes <= 40000 AND length(path) % 8 <> 0) AS unchanged, 1::BIGINT AS removed FROM files",
    "missing_texts": f"WITH {_FILES}, a AS (SELECT 'm' || (page_id % 5)::VARCHAR || '/sub/p ' || page_id::VARCHAR || '.md' AS path FROM pages) SELECT path, coalesce(length(html), 0)::INT AS length FROM a LEFT JOIN files USING (path)",
}
QUERIES = {f.__name__: f for f in (log_notes, log_fields, remember_notes, forget_paths, source_switches, rated_sources, canonical_export, recent_sources, touched_manifests, cache_upserts, cache_fill, path_lookup, checkpoint_writes, domain_changes, text_parameters, project_scan, markdown_files, indexed_files, index_summary, missing_texts)}
