"""Queries of planning, sessions and ordered operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ordered as O
from ..operators import planner as P
from ..operators import sessions as N
from ..sources import tables as D
from ..sources import tasks as K
from .queries import _CHUNKS, _OFF, _r

BUDGET, RESERVE, TOKENS = 6, 2, 1800


def _list(xs) -> str:
    return "[" + ", ".join("'" + x.replace("\n", "' || chr(10) || '") + "'" for x in xs) + "]"


def _cue(index: str, xs) -> str:
    return f"({_list(xs)})[{index} % {len(xs)} + 1]"


def _pick(key: str, table: dict, other) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in table.items()) + f" ELSE {other}::DOUBLE END"


_TASKS = f"tasks AS (SELECT conv_id, turn, lower(text || ' ' || {_cue('(conv_id + turn)', K.TASK_CUES)}) AS task, (conv_id + turn) % 2 = 0 AS has_file, (conv_id + turn) % 3 > 0 AS has_module, (conv_id + turn) % 5 > 1 AS has_related FROM conversations)"
_STAGED = f"""{_TASKS}, staged AS (SELECT *, CASE {' '.join(f"WHEN regexp_matches(task, '{p}') THEN '{s}'" for s, p in P.STAGES.items())} ELSE 'general' END AS stage FROM tasks),
intents AS (SELECT *, CASE WHEN regexp_matches(task, '{P.MIGRATION}') THEN 'migration' WHEN regexp_matches(task, '{P.API}') THEN 'api_change' WHEN regexp_matches(task, '{P.TESTS}') AND regexp_matches(task, '{P.BROKEN}') THEN 'test_repair'
  WHEN stage = 'document' AND regexp_matches(task, '{P.DESIGN}') THEN 'architecture_review' WHEN stage = 'document' THEN 'docs_update' WHEN stage = 'refactor' THEN 'refactor_safety'
  WHEN stage = 'debug' AND regexp_matches(task, '{P.CAUSE}') THEN 'bug_root_cause' WHEN stage = 'debug' AND regexp_matches(task, 'test|spec|assert|fixture|snapshot|flaky') THEN 'test_repair' WHEN stage = 'debug' THEN 'bug_fix' ELSE 'general' END AS intent FROM staged)"""


def _staged(spark, d):
    t = K.tasks(spark, d).withColumn("stage", P.stage_of(F.col("task")))
    return t.withColumn("intent", P.intent_of(F.col("task"), F.col("stage")))


def task_stage_intent(spark, d):
    return _staged(spark, d).select("conv_id", "turn", "stage", "intent", P.recent_optional(F.col("stage"), F.col("intent")).alias("recent_optional"))


def task_policy(spark, d):
    return _staged(spark, d).select("conv_id", "turn", *(c.alias(n) for n, c in P.policy(F.col("stage"), F.col("intent"), BUDGET, RESERVE, TOKENS).items()))


def task_wave_budgets(spark, d):
    return _staged(spark, d).select("conv_id", "turn", *(c.cast("int").alias(n) for n, c in P.wave_budgets(F.col("stage"), F.col("intent"), 7).items()))


def task_project_order(spark, d):
    order = P.project_order(*(F.col(c) for c in ("stage", "intent", "has_file", "has_module", "has_related")))
    return _staged(spark, d).select("conv_id", "turn", F.concat_ws(">", order).alias("query_order"))


def session_distill(spark, d):
    out = N.distill(K.sessions(spark, d), module="module_name")
    bar = lambda c: F.concat_ws("|", c).alias(c)
    return out.select("conv_id", "turn", "persist", "kind", "confidence", "tier", "stability", "suggested_title", bar("tags"), bar("key_points"), bar("follow_ups"), F.sha1(F.col("summary").cast("binary")).alias("summary_sha1"), F.size("reasons").alias("reasons"))


def session_routes(spark, d):
    out = N.route(N.distill(K.sessions(spark, d), module="module_name"))
    return out.groupBy("source_kind", "memory_tier").agg(F.count(F.lit(1)).alias("n"), T.rounded(F.max("stability_score")).alias("most_stable"))


def _scored(spark, d):
    """Chunks that are not disabled, scored by age, by language."""
    c = D.chunks(spark, d).join(D.disabled(spark, d), "doc_id", "left_anti")
    return c.select("doc_id", "source_kind", "language", "updated_at", (F.col("doc_id") * 37 % 101 / 101.0).alias("score"), T.estimate_tokens(F.concat_ws("\n", "title", "path", "content"), 24).alias("tokens"))


def quota_merge(spark, d):
    s = _scored(spark, d)
    out = P.quota_merge(s.where("source_kind != 'project'"), s.where("source_kind = 'project'"), ["language"], 8, 3)
    return out.select("language", "doc_id", "seated", "place")


def token_budget_fill(spark, d):
    top = P.ranked(_scored(spark, d), ["language", "source_kind"], 12)
    return P.token_budget(top, ["language", "source_kind"], 1500, 12).select("language", "source_kind", "used_tokens", "omitted", F.concat_ws(",", F.transform("kept", lambda x: x.cast("string"))).alias("kept"))


def wave_stop(spark, d):
    top = P.ranked(_scored(spark, d), ["language", "source_kind"], 6)
    m = P.stop_metrics(top, "language", "source_kind").withColumns({"stable": F.least("selected", F.lit(2)), "project": F.lit(1), "recent": F.lit(0), "knowledge_reserve": F.lit(3), "project_reserve": F.lit(3)})
    out = P.stop_test("local_project", F.lit("debug"), F.lit(6), {c: F.col(c) for c in m.columns})
    return m.select("language", "source_kind", *(c.alias(n) for n, c in out.items()))


def conflict_gate(spark, d):
    return P.conflict_gate(K.decisions(spark, d)).groupBy("source_kind", "suppressed").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


def debounce_capped(spark, d):
    return O.debounced_windows(K.observations(spark, d), "user_id", gap=21_600_000, cap=54_000_000, items=5, tokens=1500)


def auto_checkpoints(spark, d):
    """Times in minutes stand for seconds, as the events are far apart."""
    e = K.observations(spark, d).withColumn("at", F.expr("at div 600"))
    return O.auto_checkpoints(e, "user_id").groupBy("user_id").agg(F.count_if("drafted").alias("drafts"), F.count_if("promoted").alias("promotions"), F.count(F.lit(1)).alias("n"))


def request_batches(spark, d):
    """A flush is 256 consecutive documents."""
    t = D.table(spark, d, "documents").select(F.expr("doc_id div 256").alias("flush"), F.col("doc_id").alias("seq"), T.estimate_tokens(F.col("text")).alias("tokens"))
    return O.request_batches(t, "flush")


_NOTES = f"notes AS (SELECT conv_id, turn, replace(text, '. ', '.' || chr(10)) || chr(10) || {_cue('(conv_id + turn)', K.NOTE_CUES)} AS session_text, CASE WHEN conv_id % 3 > 0 THEN role END AS module_name FROM conversations)"
_PLAIN = r"lambda t: regexp_replace(t, '^[-*\s]+', '')"
_COUNT = lambda cues: "(" + " + ".join(f"len(regexp_extract_all(low, '{p}'))" for p in cues) + ")"
_DISTILL = rf"""{_NOTES}, lined AS (SELECT *, lower(session_text) AS low, list_filter(list_transform(string_split_regex(session_text, '\r?\n'), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), lambda l: l <> '') AS ls FROM notes),
counted AS (SELECT *, array_to_string(ls[1:4], ' ') AS head, list_transform(list_filter(ls, lambda l: regexp_matches(l, '^[-*]') OR regexp_matches(l, '{N.KEY_POINT}')), {_PLAIN})[1:6] AS kps,
  list_transform(list_filter(ls, lambda l: regexp_matches(l, '{N.FOLLOW_UP}')), {_PLAIN})[1:6] AS fus, {_COUNT(N.DECISION)} AS d, {_COUNT(N.KNOWLEDGE)} AS k, {_COUNT(N.PROGRESS)} AS p, {_COUNT(N.NOISE)} AS z FROM lined),
s AS (SELECT *, CASE WHEN head = '' THEN '{N.EMPTY}' WHEN length(head) > 320 THEN substring(head, 1, 320) || '...' ELSE head END AS summary, CASE WHEN coalesce(module_name, '') <> '' THEN 0.04::DOUBLE ELSE 0 END AS g, len(kps) AS kp, len(fus) AS fu FROM counted),
raw AS (SELECT *, 0.22::DOUBLE + d * 0.17::DOUBLE + kp * 0.05::DOUBLE + fu * 0.05::DOUBLE + g AS r1, 0.18::DOUBLE + k * 0.16::DOUBLE + kp * 0.05::DOUBLE + CASE WHEN fu > 0 THEN 0.02::DOUBLE ELSE 0 END + g AS r2,
  0.18::DOUBLE + p * 0.1::DOUBLE + fu * 0.08::DOUBLE + kp * 0.04::DOUBLE + least(0.12::DOUBLE, len(ls) / 40.0::DOUBLE) AS r3,
  0.16::DOUBLE + CASE WHEN len(ls) <= 2 THEN 0.16::DOUBLE ELSE 0 END + CASE WHEN kp = 0 THEN 0.14::DOUBLE ELSE 0 END + CASE WHEN d = 0 AND p = 0 AND k = 0 THEN 0.18::DOUBLE ELSE 0 END + z * 0.08::DOUBLE AS r4 FROM s),
sc AS (SELECT *, {', '.join(f"{_r(f'greatest(0.0::DOUBLE, least(1.0::DOUBLE, r{i}))')} AS s{i}" for i in (1, 2, 3, 4))} FROM raw),
best AS (SELECT *, greatest(s1, s2, s3, s4) AS confidence, CASE WHEN s1 = greatest(s1, s2, s3, s4) THEN 'decision' WHEN s2 = greatest(s1, s2, s3, s4) THEN 'knowledge' WHEN s3 = greatest(s1, s2, s3, s4) THEN 'diary' ELSE 'discard' END AS top FROM sc),
kept AS (SELECT *, top <> 'discard' AND (confidence >= 0.45::DOUBLE OR kp >= 2 OR fu >= 1) AS persist FROM best), kinds AS (SELECT *, CASE WHEN persist THEN top ELSE 'discard' END AS kind FROM kept),
distilled AS (SELECT *, CASE WHEN kind IN ('decision', 'knowledge') THEN 'stable' WHEN kind = 'discard' THEN 'cold' ELSE 'working' END AS tier, {_r(f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({_pick('kind', N.BASE, 0.12)}) * 0.7::DOUBLE + confidence * 0.3::DOUBLE))")} AS stability,
  CASE kind WHEN 'decision' THEN 'Decision:' WHEN 'knowledge' THEN 'Knowledge:' ELSE 'Session:' END || ' ' || regexp_replace(regexp_replace(regexp_replace(summary, '[.#*_`]+', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS made,
  list_filter([CASE WHEN kind <> 'discard' THEN kind END, module_name, {', '.join(f"CASE WHEN contains(low, '{t}') THEN '{t}' END" for t in N.TOPICS)}], lambda t: t IS NOT NULL) AS tg FROM kinds)"""
_SC = f"{_CHUNKS}, {_OFF}, sc AS (SELECT doc_id, source_kind, language, updated_at, (doc_id * 37 % 101) / 101.0::DOUBLE AS score, greatest(1, ceil((length(title) + 1 + length(path) + 1 + length(content)) / 4.0))::BIGINT + 24 AS tokens FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM off))"
_RANK = "rk AS (SELECT *, row_number() OVER (PARTITION BY language, source_kind ORDER BY score DESC, updated_at DESC, doc_id) AS rank FROM sc)"
_up = lambda share, least: f"least(7, greatest({least}, ceil(round(7 * {share}, 9))))"
_ST0 = f"CASE stage WHEN 'document' THEN {_up(0.75, 2)} WHEN 'explore' THEN {_up(0.5, 2)} ELSE {_up(0.55, 1)} END"
_LO0 = f"CASE stage WHEN 'document' THEN {_up(0.5, 1)} WHEN 'explore' THEN {_up(0.95, 2)} ELSE {_up(0.85, 2)} END"
_RE0 = "CASE WHEN stage = 'document' THEN 1 ELSE 2 END"
_CLAIMS = r"""claims AS (SELECT DISTINCT doc_id, 'for' AS pol, unnest(regexp_extract_all(low, '\b(?:prefer|use|adopt)\s+([\w/-]+)', 1)) AS subject FROM dec UNION SELECT DISTINCT doc_id, 'against', unnest(regexp_extract_all(low, '\b(?:avoid|do not use|never use)\s+([\w/-]+)', 1)) FROM dec)"""

SQL = {
    "task_stage_intent": f"WITH {_STAGED} SELECT conv_id, turn, stage, intent, stage NOT IN ('debug','verify','explore') AND intent NOT IN ('bug_root_cause','migration','architecture_review') AS recent_optional FROM intents",
    "task_policy": f"WITH {_STAGED}, p AS (SELECT *, least({BUDGET - 1}, {RESERVE} + {_pick('stage', {k: v[0] for k, v in P.STAGE_POLICY.items()}, 0)} + {_pick('intent', {k: v[0] for k, v in P.INTENT_POLICY.items()}, 0)})::INT AS knowledge_reserve, floor(round({TOKENS} * ({_pick('stage', {k: v[1] for k, v in P.STAGE_POLICY.items()}, 1)}), 6) + 0.5) AS f FROM intents) SELECT conv_id, turn, knowledge_reserve, greatest(1, {BUDGET} - knowledge_reserve)::INT AS project_reserve, floor(round(f * ({_pick('intent', {k: v[1] for k, v in P.INTENT_POLICY.items()}, 1)}), 6) + 0.5)::INT AS token_budget FROM p",
    "task_wave_budgets": f"WITH {_STAGED}, b AS (SELECT *, {_ST0} AS st, {_LO0} AS lo, {_RE0} AS re FROM intents) SELECT conv_id, turn, (CASE WHEN intent IN ('bug_root_cause','api_change') THEN greatest(st, {_up(0.6, 1)}) WHEN intent = 'migration' THEN greatest(st, {_up(0.7, 1)}) WHEN intent = 'refactor_safety' THEN greatest(st, {_up(0.65, 1)}) WHEN intent IN ('architecture_review','docs_update') THEN greatest(st, {_up(0.75, 1)}) ELSE st END)::INT AS stable_budget, (CASE WHEN intent IN ('bug_root_cause','test_repair') THEN greatest(lo, {_up(0.95, 1)}) WHEN intent = 'api_change' THEN greatest(lo, {_up(0.9, 1)}) WHEN intent = 'migration' THEN {_up(0.75, 2)} WHEN intent = 'refactor_safety' THEN {_up(0.8, 2)} WHEN intent = 'architecture_review' THEN {_up(0.55, 1)} WHEN intent = 'docs_update' THEN {_up(0.5, 1)} ELSE lo END)::INT AS local_budget, (CASE WHEN intent IN ('bug_root_cause','migration') THEN 2 ELSE re END)::INT AS recent_budget, 7::INT AS fallback_budget FROM b",
    "task_project_order": f"WITH {_STAGED}, o AS (SELECT conv_id, turn, [CASE WHEN has_file THEN 'current_file' END, CASE WHEN (stage = 'explore' OR intent = 'architecture_review') AND has_module THEN 'module' END, CASE WHEN has_related OR intent IN ('migration','api_change') THEN 'related_files' END, CASE WHEN intent IN ('migration','api_change') AND has_module OR intent = 'architecture_review' THEN 'module' END, CASE WHEN intent = 'architecture_review' THEN 'broad_project' END, CASE WHEN has_module THEN 'module' END, 'broad_project'] AS l FROM intents) SELECT conv_id, turn, array_to_string(list_filter(l, lambda x, i: x IS NOT NULL AND NOT list_contains(l[1:i - 1], x)), '>') AS query_order FROM o",
    "session_distill": f"WITH {_DISTILL} SELECT conv_id, turn, persist, kind, confidence, tier, stability, CASE WHEN length(made) > 80 THEN substring(made, 1, 80) || '...' ELSE made END AS suggested_title, array_to_string(tg[1:6], '|') AS tags, array_to_string(kps, '|') AS key_points, array_to_string(fus, '|') AS follow_ups, sha1(summary) AS summary_sha1, ((d > 0)::INT + (k > 0)::INT + (p > 0)::INT + (fu > 0)::INT + (kp >= 2)::INT)::INT AS reasons FROM distilled",
    "session_routes": f"WITH {_DISTILL} SELECT CASE kind WHEN 'knowledge' THEN 'manual' ELSE kind END AS source_kind, tier AS memory_tier, count(*) AS n, {_r('max(CASE kind WHEN ' + chr(39) + 'diary' + chr(39) + ' THEN greatest(0.4::DOUBLE, least(0.62::DOUBLE, stability)) WHEN ' + chr(39) + 'knowledge' + chr(39) + ' THEN greatest(0.76::DOUBLE, stability) ELSE stability END)')} AS most_stable FROM distilled WHERE persist GROUP BY 1, 2",
    "quota_merge": f"WITH {_SC}, n AS (SELECT *, (source_kind = 'project')::INT AS side, row_number() OVER (PARTITION BY language, source_kind = 'project' ORDER BY score DESC, updated_at DESC, doc_id) AS rank FROM sc), t AS (SELECT language, least(8, sum(1 - side)) AS nk, least(8, sum(side)) AS np FROM n GROUP BY 1), m AS (SELECT n.*, CASE WHEN nk = 0 OR np = 0 THEN true WHEN side = 0 THEN rank <= least(nk, 3) ELSE rank <= least(np, greatest(1, 8 - least(nk, 3))) END AS seated FROM n JOIN t USING (language) WHERE rank <= 8), p AS (SELECT language, doc_id, seated, row_number() OVER (PARTITION BY language ORDER BY seated DESC, score DESC, updated_at DESC, doc_id, side)::INT AS place FROM m) SELECT * FROM p WHERE place <= 8",
    "token_budget_fill": f"WITH RECURSIVE {_SC}, {_RANK}, f AS (SELECT language, source_kind, rank, tokens AS used, 0 AS omitted, rank::VARCHAR AS kept FROM rk WHERE rank = 1 UNION ALL SELECT f.language, f.source_kind, r.rank, CASE WHEN f.used + r.tokens <= 1500 THEN f.used + r.tokens ELSE f.used END, CASE WHEN f.used + r.tokens <= 1500 THEN f.omitted ELSE f.omitted + 1 END, CASE WHEN f.used + r.tokens <= 1500 THEN f.kept || ',' || r.rank ELSE f.kept END FROM f JOIN rk r ON r.language = f.language AND r.source_kind = f.source_kind AND r.rank = f.rank + 1 AND r.rank <= 12) SELECT language, source_kind, max_by(used, rank)::BIGINT AS used_tokens, max_by(omitted, rank)::INT AS omitted, max_by(kept, rank) AS kept FROM f GROUP BY 1, 2",
    "wave_stop": f"WITH {_SC}, {_RANK}, m AS (SELECT language, source_kind, count(*) AS selected, count(DISTINCT doc_id) AS docs, max_by(score, -rank) AS top, {_r('avg(score)')} AS mean, count(DISTINCT CASE WHEN source_kind = 'decision' THEN doc_id END) AS decisions FROM rk WHERE rank <= 6 GROUP BY 1, 2), a AS (SELECT *, least(2, selected) AS stable FROM m), c AS (SELECT *, {_r('0.4::DOUBLE * least(1.0::DOUBLE, stable / 3.0::DOUBLE) + 0.35::DOUBLE * (1 / 3.0::DOUBLE) + 0.25::DOUBLE * least(1.0::DOUBLE, selected / 6.0::DOUBLE)')} AS coverage_score, {_r('greatest(0.0::DOUBLE, least(1.0::DOUBLE, top / 0.75::DOUBLE)) * 0.6::DOUBLE + greatest(0.0::DOUBLE, least(1.0::DOUBLE, mean / 0.55::DOUBLE)) * 0.4::DOUBLE')} AS confidence_score, {_r('CASE WHEN selected <= 1 THEN 0.0::DOUBLE ELSE 1 - docs / selected::DOUBLE END')} AS redundancy_score, {_r('CASE WHEN decisions >= 2 THEN 0.18::DOUBLE + least(0.18::DOUBLE, (decisions - 2) * 0.08::DOUBLE) ELSE 0.0::DOUBLE END')} AS conflict_score FROM a), x AS (SELECT *, {_r('coverage_score * 0.5::DOUBLE + confidence_score * 0.35::DOUBLE + (1 - redundancy_score) * 0.1::DOUBLE + (1 - conflict_score) * 0.05::DOUBLE')} AS final_score, CASE WHEN selected >= 6 THEN 'budget_satisfied_after_local_project' END AS ready FROM c) SELECT language, source_kind, coverage_score, confidence_score, redundancy_score, conflict_score, final_score, CASE WHEN ready IS NOT NULL AND final_score >= greatest(0.55::DOUBLE, 0.68::DOUBLE - 0.12::DOUBLE) OR final_score >= 0.68::DOUBLE AND coverage_score >= 0.64::DOUBLE AND conflict_score <= 0.55::DOUBLE THEN coalesce(ready, 'confidence_stop_after_local_project') END AS reason FROM x",
    "conflict_gate": f"WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'decision' ELSE 'manual' END AS source_kind, lower(substring(text, 1, 30) || chr(10) || text || chr(10) || {_cue('doc_id', K.CLAIM_CUES)}) AS low, n_chars % 97 / 97.0::DOUBLE AS score, doc_id % 50 AS updated_at FROM documents), dec AS (SELECT * FROM d WHERE source_kind = 'decision'), {_CLAIMS}, torn AS (SELECT subject FROM claims GROUP BY 1 HAVING count(DISTINCT pol) > 1), inside AS (SELECT *, contains(low, 'canonical') AND contains(low, 'conflict-resolution') AS canonical FROM dec WHERE doc_id IN (SELECT doc_id FROM claims WHERE subject IN (SELECT subject FROM torn))), best AS (SELECT doc_id FROM inside ORDER BY score DESC, updated_at DESC, doc_id LIMIT 1), lost AS (SELECT doc_id FROM inside WHERE CASE WHEN (SELECT bool_or(canonical) FROM inside) THEN NOT canonical ELSE doc_id NOT IN (SELECT doc_id FROM best) END) SELECT source_kind, doc_id IN (SELECT doc_id FROM lost) AS suppressed, count(*) AS n, min(doc_id) AS first_doc FROM d GROUP BY 1, 2",
    "debounce_capped": "WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS tm, event_id % 700 + 1 AS tok, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS r FROM events), f AS (SELECT user_id, r, tm AS first, tm AS prev, 1 AS n, tok AS used, 1 >= 5 OR tok >= 1500 AS isfull, 0 AS w FROM e WHERE r = 1 UNION ALL SELECT f.user_id, e.r, CASE WHEN s THEN e.tm ELSE f.first END, e.tm, CASE WHEN s THEN 1 ELSE f.n + 1 END, CASE WHEN s THEN e.tok ELSE f.used + e.tok END, CASE WHEN s THEN e.tok >= 1500 ELSE f.n + 1 >= 5 OR f.used + e.tok >= 1500 END, CASE WHEN s THEN f.w + 1 ELSE f.w END FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1, LATERAL (SELECT f.isfull OR least(f.prev + 21600000, f.first + 54000000) <= e.tm AS s)), w AS (SELECT user_id, w, first AS opened, max(prev) AS prev, max(n) AS n, max_by(used, r) AS tokens, bool_or(isfull) AS isfull, max(w) OVER (PARTITION BY user_id) AS lastw FROM f GROUP BY user_id, w, first) SELECT user_id, opened, CASE WHEN isfull THEN 'full' WHEN w = lastw THEN 'end' WHEN opened + 54000000 <= prev + 21600000 THEN 'cap' ELSE 'gap' END AS closed, n::BIGINT AS n, tokens FROM w",
    "auto_checkpoints": "WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 // 600 AS tm, event_type AS mark, event_id % 4 = 0 AS major, event_id % 17 = 0 AS manual, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000 // 600, event_id) AS r FROM events), f AS (SELECT user_id, r, CASE WHEN NOT manual THEN mark END AS dm, CASE WHEN NOT manual THEN tm END AS dt, mark AS am, tm AS at0, manual AS ah, NOT manual AS dr, true AS pr FROM e WHERE r = 1 UNION ALL SELECT f.user_id, e.r, CASE WHEN d THEN e.mark ELSE f.dm END, CASE WHEN d THEN e.tm ELSE f.dt END, CASE WHEN p THEN e.mark ELSE f.am END, CASE WHEN p THEN e.tm ELSE f.at0 END, CASE WHEN p THEN e.manual ELSE f.ah END, d, p FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1, LATERAL (SELECT NOT e.manual AND (f.dm IS NULL OR f.dm <> e.mark OR e.tm - f.dt >= 20000) AS d, e.manual OR (f.am <> e.mark AND NOT (f.ah AND e.tm - f.at0 < 1800000) AND (e.tm - f.at0 >= 90000 OR e.major)) AS p)) SELECT user_id, count(*) FILTER (dr) AS drafts, count(*) FILTER (pr) AS promotions, count(*) AS n FROM f GROUP BY 1",
    "request_batches": "WITH RECURSIVE t AS (SELECT doc_id // 256 AS flush, doc_id AS seq, greatest(1, ceil(length(text) / 4.0))::BIGINT AS tok, row_number() OVER (PARTITION BY doc_id // 256 ORDER BY doc_id) AS r FROM documents), f AS (SELECT flush, seq, r, 0::BIGINT AS batch, 1 AS n, tok AS used FROM t WHERE r = 1 UNION ALL SELECT f.flush, t.seq, t.r, CASE WHEN s THEN f.batch + 1 ELSE f.batch END, CASE WHEN s THEN 1 ELSE f.n + 1 END, CASE WHEN s THEN t.tok ELSE f.used + t.tok END FROM f JOIN t ON t.flush = f.flush AND t.r = f.r + 1, LATERAL (SELECT f.n >= 64 OR f.used + t.tok > 6000 AS s)) SELECT flush, seq, batch FROM f",
}
QUERIES = {f.__name__: f for f in (task_stage_intent, task_policy, task_wave_budgets, task_project_order, session_distill, session_routes, quota_merge, token_budget_fill, wave_stop, conflict_gate, debounce_capped, auto_checkpoints, request_batches)}
