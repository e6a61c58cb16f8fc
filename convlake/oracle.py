"""DuckDB SQL for the engine's queries, on the same Parquet tables. Folds (windows, segments, resolution, quotas) have none and are
held against brute-force versions in the tests."""

from __future__ import annotations

from convlake.functions.routing import CANDIDATES, OTHERS, PERMANENT_CODES, SPACE_PHRASE, SPACE_REPLY, TEMPORARY_CODES
from convlake.functions.text import ACTION_PATTERNS, ACTION_VERBS, ACTIONABLE, ENTITY_PATTERNS, STOPWORDS
from convlake.operators.artifacts import TYPE_GROUPS
from convlake.operators.chunks import STATUSES, TRANSITIONS
from convlake.sources.tables import ROUTES


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def among(values: list[str]) -> str:
    return "(" + ", ".join(map(q, values)) + ")"


def squash(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g'))"


def strip(x: str) -> str:
    return rf"regexp_replace(coalesce({x}, ''), '^\s+|\s+$', '', 'g')"


def tokens(x: str) -> str:
    return rf"list_filter(list_distinct(string_split(trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9\s]+', ' ', 'g'), '\s+', ' ', 'g')), ' ')), lambda w: w <> '' AND w NOT IN {among(STOPWORDS)})"


def verb(x: str) -> str:
    ws = rf"list_filter(string_split(trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9\s]+', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: w <> '')"
    return f"coalesce(list_filter({ws}, lambda w: w IN {among(ACTION_VERBS)})[1], ({ws})[1])"


def jaccard(a: str, b: str) -> str:
    return f"(len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))))"


CHUNKS = """c0 AS (SELECT conv_id AS conversation_id, CAST(turn AS INTEGER) AS sequence_number, role, text FROM conversations),
lst AS (SELECT conversation_id, max(sequence_number) AS expected_last FROM c0 GROUP BY 1),
c1 AS (SELECT c0.*, expected_last, (conversation_id * 3 + sequence_number * 5) % 17 AS s FROM c0 JOIN lst USING (conversation_id)
  WHERE NOT ((conversation_id * 31 + sequence_number * 7) % 13 = 5 AND sequence_number > 0)),
chunks AS (SELECT conversation_id, sequence_number, expected_last, role,
  CASE WHEN (conversation_id + sequence_number) % 5 = 3 THEN '' ELSE text END AS raw_text,
  CASE s WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' WHEN 2 THEN 'processing' ELSE 'completed' END AS stt_status,
  (conversation_id + sequence_number) % 7 AS stt_attempts,
  CASE WHEN s = 0 THEN CASE WHEN sequence_number % 2 = 0 THEN 'Invalid audio: HTTP 415' ELSE 'HTTP 503 try again' END END AS last_error,
  CASE WHEN (conversation_id + sequence_number) % 11 = 4 THEN 'empty_transcript' END AS exclusion_reason,
  CASE WHEN (conversation_id * 5 + sequence_number) % 3 > 0 THEN 'win_' || (sequence_number // 2) END AS processing_window_id FROM c1),
cl AS (SELECT *, stt_status = 'completed' AND """ + squash("raw_text") + """ <> '' AS useful,
  stt_status = 'failed' AND (coalesce(lower(last_error) LIKE '%invalid audio%', FALSE) OR stt_attempts >= 5) AS terminal FROM chunks),
k AS (SELECT *, (stt_status = 'completed' AND NOT useful) OR exclusion_reason IS NOT NULL OR terminal AS skippable FROM cl)"""

ARTIFACTS = """a AS (SELECT p_partkey // 100 AS conversation_id, p_partkey AS id, p_partkey AS position,
  ['task', 'note', 'decision', 'risk', 'question', 'task', 'fact', 'follow_up', 'blocker', 'idea'][p_partkey % 10 + 1] AS artifact_type,
  p_name AS title, p_type AS content, p_brand AS owner, CASE WHEN p_partkey % 19 = 0 THEN 'rejected' ELSE 'provisional' END AS status,
  CAST((p_partkey % 100) // 20 AS INTEGER) AS window_index, p_size AS sequence_start, p_size + p_partkey % 3 AS sequence_end, lower(p_brand) AS topic FROM part)"""
GROUPS = "CASE " + " ".join(f"WHEN artifact_type IN {among(g)} THEN {i}" for i, g in enumerate(TYPE_GROUPS)) + " END"
NAMES = [*ROUTES, "unknown.type"]
ENVELOPES = f"""e AS (SELECT event_id, 'evt-' || (event_id // 3) AS idempotency_key, [{', '.join(map(q, NAMES))}][event_id % 9 + 1] AS event_type, CAST(event_id % 7 AS INTEGER) AS attempt,
  ts AS created_at, user_id, event_id % 23 <> 0 AS readable, event_id % 5 <> 0 AS retryable FROM events)"""
TASKS = """t AS (SELECT o_orderkey AS task_id, o_custkey AS user_id, c_nationkey AS space_id,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'pending' ELSE 'in_progress' END AS status, o_orderdate AS updated_at, o_orderpriority AS due_text
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
WORDS = """w AS (SELECT conv_id, turn, u.word, u.pos, ((conv_id * 7 + turn * 11 + u.pos * 13) % 100) / 100 AS confidence, (conv_id + u.pos // 5) % 3 AS speaker
  FROM (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws FROM conversations), LATERAL (SELECT unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos) u)"""
STAMP = "'%Y-%m-%d %H:%M:%S'"
PARTS = f"list_filter(list_transform(range(0, CAST(length({strip('text')}) AS BIGINT), 750), lambda s: {strip('substring(' + strip('text') + ', s + 1, 900)')}), lambda x: x <> '')"
TERMS = r"list_distinct(list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}\p{{M}}_]+'), lambda w: length(w) > 2))"
SCORES = """v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
n AS (SELECT id, x, sqrt(list_dot_product(x, x)) AS l FROM v),
s AS (SELECT a.id AS query_id, b.id AS id, round(CASE WHEN a.l * b.l > 0 THEN list_dot_product(a.x, b.x) / (a.l * b.l) ELSE 0 END, 6) AS score FROM n a, n b WHERE a.id % 20 = 0),
top AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, score FROM s QUALIFY rank <= 8)"""

ITEMS = ARTIFACTS + """, i AS (SELECT conversation_id, id, window_index,
  CASE WHEN artifact_type IN ('task', 'follow_up') THEN 'tasks' WHEN artifact_type IN ('note', 'fact') THEN 'notes' WHEN artifact_type IN ('decision', 'idea') THEN 'decisions' ELSE 'issues' END AS collection,
  CASE WHEN id % 31 <> 0 THEN a.title END AS title, CASE WHEN id % 7 <> 0 THEN content END AS body, a.title AS quote,
  CASE WHEN id % 29 = 0 THEN 'NO_ACTION' WHEN id % 17 = 0 THEN 'COMPLETE' WHEN id % 13 = 0 THEN 'UPDATE' END AS operation, CASE artifact_type WHEN 'idea' THEN 'idea' END AS status,
  CASE WHEN artifact_type = 'question' THEN 'open_question' WHEN artifact_type IN ('risk', 'blocker') THEN artifact_type END AS kind, CASE WHEN id % 3 = 0 THEN lower(a.title) END AS fingerprint,
  CASE WHEN id % 11 <> 0 THEN sequence_start || ':' || sequence_end ELSE '' END AS span, CASE WHEN id % 5 <> 0 THEN id % 10 / 10 END AS confidence FROM a),
m AS (SELECT *, CASE WHEN collection <> 'issues' THEN collection WHEN kind IN ('blocker', 'risk') THEN 'blockers' ELSE 'questions' END AS section,
  coalesce(nullif(fingerprint, ''), lower(concat_ws('|', coalesce(title, ''), left(coalesce(body, ''), 300), coalesce(operation, ''), coalesce(status, ''), coalesce(kind, ''), span))) AS identity
  FROM i WHERE collection <> 'tasks' OR coalesce(operation, '') <> 'NO_ACTION')"""
OUTCOMES = """o AS (SELECT conv_id, turn, text, (conv_id + turn) % 3 = 0 AS tasks, turn % 4 = 1 AS notes, conv_id % 5 = 0 AS decisions, turn % 2 = 1 AS facts,
  greatest(1, length(left(coalesce(text, ''), 150)) // 4) AS told FROM conversations)"""


def one_of(values: list[str], at: str) -> str:
    return f"[{', '.join(map(q, values))}][{at} + 1]"


def says(x: str, *markers: str) -> str:
    return "(" + " OR ".join(f"contains(lower(coalesce({x}, '')), {q(m)})" for m in markers) + ")"


ACTS = " OR ".join(f"regexp_matches(lower(normalized), {q('(?i)' + p)})" for p in ACTION_PATTERNS[:23])

SQL: dict[str, str] = {
    "chunk_predicates": f"""WITH {CHUNKS} SELECT conversation_id, sequence_number, useful, terminal, skippable,
  CASE WHEN last_error LIKE 'Invalid audio%' THEN 'permanent' ELSE 'temporary' END AS error_class, FALSE AS recoverable FROM k""",
    "chunk_accounting": f"""WITH {CHUNKS}, n AS (SELECT conversation_id, max(expected_last) + 1 AS expected_sequences, count(DISTINCT sequence_number) AS present,
  count_if(stt_status = 'completed' AND NOT useful) AS empty_transcripts, count_if(stt_status = 'failed') AS failed_transcripts, count_if(stt_status IN ('pending', 'processing')) AS pending_transcripts,
  count_if(useful) AS valid_transcripts, count_if(useful AND processing_window_id IS NOT NULL) AS valid_windowed, count_if(useful AND exclusion_reason IS NOT NULL) AS valid_excluded,
  count_if(useful AND processing_window_id IS NULL AND exclusion_reason IS NULL) AS valid_unwindowed, count_if(terminal) AS terminal_failed FROM k GROUP BY 1)
SELECT *, expected_sequences - present AS missing, present AS accounted_sequences, pending_transcripts + failed_transcripts - terminal_failed + expected_sequences - present AS unresolved_expected,
  terminal_failed AS permanent_failures, pending_transcripts + failed_transcripts - terminal_failed + expected_sequences - present > 0 AS unresolved FROM n""",
    "missing_sequences": f"""WITH {CHUNKS}, ends AS (SELECT DISTINCT conversation_id, expected_last FROM chunks),
every AS (SELECT conversation_id, CAST(unnest(range(0, expected_last + 1)) AS INTEGER) AS sequence_number FROM ends) SELECT * FROM every ANTI JOIN chunks USING (conversation_id, sequence_number)""",
    "reachable_chunks": f"""WITH {CHUNKS}, h AS (SELECT *, CASE WHEN NOT (stt_status = 'completed' OR skippable) OR coalesce(sequence_number - lag(sequence_number) OVER o > 1, FALSE) THEN 1 ELSE 0 END AS hole
  FROM k WINDOW o AS (PARTITION BY conversation_id ORDER BY sequence_number)), r AS (SELECT *, max(hole) OVER (PARTITION BY conversation_id ORDER BY sequence_number) AS cut FROM h)
SELECT conversation_id, sequence_number, useful, skippable FROM r WHERE cut = 0""",
    "window_ownership": f"""WITH {CHUNKS}, h AS (SELECT *, max(CASE WHEN stt_status = 'completed' OR skippable THEN 0 ELSE 1 END) OVER (PARTITION BY conversation_id ORDER BY sequence_number) AS cut FROM k)
SELECT conversation_id, sequence_number, CAST(1 AS BIGINT) AS owners FROM h WHERE cut = 0 AND useful""",
    "invalid_transitions": f"""WITH s AS (SELECT event_id, coalesce(lag(st) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'RECORDING') AS previous, st AS status
  FROM (SELECT *, [{', '.join(map(q, STATUSES))}][event_id % 11 + 1] AS st FROM events))
SELECT event_id, previous, status, previous = status OR (previous, status) IN (VALUES {', '.join(f'({q(a)}, {q(b)})' for a, bs in TRANSITIONS.items() for b in bs)}) AS valid FROM s""",
    "transcripts": f"""WITH {CHUNKS} SELECT conversation_id, string_agg('[' || sequence_number || '] ' || {strip('raw_text')}, chr(10) ORDER BY sequence_number) AS raw_transcript FROM chunks GROUP BY 1""",
    "speaker_turns": f"""WITH {WORDS}, f AS (SELECT *, CASE WHEN speaker IS DISTINCT FROM lag(speaker) OVER o OR row_number() OVER o = 1 THEN 1 ELSE 0 END AS fresh FROM w WINDOW o AS (PARTITION BY conv_id, turn ORDER BY pos)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS t FROM f)
SELECT conv_id, turn AS message, CAST(t AS BIGINT) AS turn, min(speaker) AS speaker, string_agg(word, ' ' ORDER BY pos) AS text FROM g GROUP BY conv_id, g.turn, t""",
    "speech_quality": f"""WITH {WORDS}, m AS (SELECT conv_id, turn, round(avg(confidence), 6) AS mean_confidence, min(confidence) AS min_confidence, count_if(confidence < 0.5) AS low_words, count(*) AS words,
  array_to_string(list_sort(list(DISTINCT speaker)), ',') AS speakers FROM w GROUP BY 1, 2) SELECT *, mean_confidence < 0.6 OR low_words / words >= 0.3 AS uncertain FROM m""",
    "fingerprints": f"""SELECT p_partkey, sha256(lower({squash('p_name')}) || '|' || lower({squash('p_brand')}) || '|' || lower({squash('p_type')})) AS fingerprint,
  sha256('c1|task|' || lower({squash('p_name')}) || '|' || lower({squash('p_brand')})) AS identity, left(sha1('staged:' || p_partkey || ':' || p_name), 24) AS id FROM part""",
    "best_matches": f"""WITH {ARTIFACTS}, b AS (SELECT *, {GROUPS} AS g, {tokens('title')} AS tk, {verb('title')} AS vb FROM a),
p AS (SELECT x.conversation_id, x.id AS new_id, y.id AS old_id, {jaccard('x.tk', 'y.tk')} AS similarity, x.vb <> y.vb AS apart FROM b x JOIN b y USING (conversation_id, g)
  WHERE x.id % 2 = 1 AND y.id % 2 = 0 AND len(list_intersect(x.tk, y.tk)) > 0),
m AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY new_id ORDER BY similarity DESC, old_id) = 1)
SELECT b.conversation_id, b.id AS new_id, m.old_id, coalesce(m.similarity, 0.0) AS similarity,
  CASE WHEN coalesce(apart, FALSE) AND coalesce(similarity, 0) < 0.9 THEN CASE WHEN coalesce(similarity, 0) >= 0.35 THEN 'related' ELSE 'new' END
    WHEN coalesce(similarity, 0) >= 0.75 THEN 'same' ELSE 'new' END AS verdict FROM b LEFT JOIN m ON b.id = m.new_id WHERE b.id % 2 = 1""",
    "extracted_artifacts": f"""WITH c AS (SELECT *, left(trim(text), 60) AS title FROM conversations), r AS (
  SELECT conv_id, turn, 0 AS b, CASE WHEN contains(lower(title), 'follow') THEN 'follow_up' ELSE 'task' END AS kind, title, role AS owner, 0.8 AS confidence, role FROM c WHERE turn % 4 = 0
  UNION ALL SELECT conv_id, turn, 1, 'note', title, NULL, 0.8, role FROM c WHERE turn % 4 = 1
  UNION ALL SELECT conv_id, turn, 2, CASE WHEN conv_id % 2 = 0 THEN 'idea' ELSE 'decision' END, title, NULL, 0.8, role FROM c WHERE turn % 4 = 2
  UNION ALL SELECT conv_id, turn, 3, CASE WHEN conv_id % 2 = 0 THEN 'question' ELSE 'risk' END, title, NULL, 0.8, role FROM c WHERE turn % 4 = 3
  UNION ALL SELECT conv_id, turn, 4, 'fact', left(text, 90), NULL, 0.55, role FROM c WHERE turn % 4 = 0
  UNION ALL SELECT conv_id, turn, 5, 'question', left(text, 90), NULL, 0.55, role FROM c WHERE turn % 4 = 1),
i AS (SELECT *, sha256(CAST(conv_id AS VARCHAR) || '|' || kind || '|' || lower({squash('title')}) || '|' || lower({squash('owner')})) AS identity_key FROM r WHERE trim(title) <> '')
SELECT conv_id AS conversation_id, CAST(turn AS INTEGER) AS window_index, kind AS artifact_type, title, CAST(confidence AS DOUBLE) AS confidence, role AS topic, identity_key FROM i
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn, identity_key ORDER BY b) = 1""",
    "coverage": f"""WITH {ARTIFACTS}, m AS (SELECT *, {tokens('title')} AS tk, {verb('title')} AS vb FROM a WHERE status <> 'rejected' AND trim(title) <> ''),
f AS (SELECT DISTINCT conversation_id, title, {tokens('title')} AS tk, {verb('title')} AS vb FROM a WHERE id % 10 = 3),
h AS (SELECT DISTINCT m.id FROM m JOIN f USING (conversation_id) WHERE lower(m.title) = lower(f.title) OR ({jaccard('m.tk', 'f.tk')} >= 0.9 AND m.vb = f.vb)),
wn AS (SELECT DISTINCT conversation_id, window_index FROM a),
wk AS (SELECT * FROM wn ANTI JOIN (SELECT * FROM a WHERE id % 7 < 2 AND window_index < 4) z USING (conversation_id, window_index)),
n AS (SELECT w.conversation_id, (SELECT count(*) FROM m WHERE m.conversation_id = w.conversation_id) AS meaningful,
  (SELECT count(*) FROM m JOIN h USING (id) WHERE m.conversation_id = w.conversation_id) AS represented, (SELECT count(*) FROM a WHERE id % 10 = 3 AND a.conversation_id = w.conversation_id) AS final,
  (SELECT count(*) FROM wn WHERE wn.conversation_id = w.conversation_id) AS windows, (SELECT count(*) FROM wk WHERE wk.conversation_id = w.conversation_id) AS weak FROM (SELECT DISTINCT conversation_id FROM wn) w)
SELECT *, meaningful - represented AS unrepresented,
  concat_ws(',', CASE WHEN meaningful >= 8 AND 4 * final <= meaningful AND final < greatest(5, meaningful * 35 // 100) THEN 'suspicious_compression_ratio' END, CASE WHEN weak > 0 THEN 'weak_windows' END,
    CASE WHEN meaningful - represented >= greatest(3, meaningful * 4 // 10) THEN 'unrepresented_artifacts' END) AS reasons,
  least(CASE WHEN meaningful > 0 THEN represented / meaningful ELSE 1.0 END, greatest(0.0, 1 - weak / greatest(windows, 1))) AS score FROM n""",
    "weak_windows": f"""WITH {ARTIFACTS}, w AS (SELECT conversation_id, window_index, sum(length(title)) AS token_count, count_if(id % 3 = 0) AS non_empty_chunk_count,
  max(CASE WHEN id % 5 = 0 THEN title ELSE '' END) AS text, count_if(id % 7 = 0 AND conversation_id % 3 = 0) AS extracted FROM a GROUP BY 1, 2)
SELECT conversation_id, window_index, CAST(token_count AS BIGINT) AS token_count FROM w ANTI JOIN (SELECT * FROM a WHERE id % 40 = 0) z USING (conversation_id, window_index)
WHERE extracted = 0 AND (non_empty_chunk_count > 0 OR {strip('text')} <> '')""",
    "meeting_memory": f"""WITH {ARTIFACTS}, m AS (SELECT * FROM a WHERE status <> 'rejected' QUALIFY row_number() OVER (PARTITION BY conversation_id, artifact_type ORDER BY position) <= 5)
SELECT conversation_id, artifact_type, string_agg(title, '|' ORDER BY position) AS titles FROM m GROUP BY 1, 2""",
    "topics": f"""WITH {ARTIFACTS}, w AS (SELECT conversation_id, window_index, max(sequence_end) AS sequence_end, list_sort(list(DISTINCT topic)) AS topics FROM a GROUP BY 1, 2),
s AS (SELECT conversation_id, window_index, sequence_end, unnest(topics) AS topic, generate_subscripts(topics, 1) AS pos FROM w),
t AS (SELECT conversation_id, topic, min((window_index, pos)) AS fst, count(DISTINCT window_index) AS windows, max(sequence_end) AS last_sequence FROM s GROUP BY 1, 2),
c AS (SELECT conversation_id, topic, count(*) AS artifacts FROM a GROUP BY 1, 2)
SELECT conversation_id, topic, windows, last_sequence, artifacts, CAST(row_number() OVER (PARTITION BY conversation_id ORDER BY fst, topic) AS INTEGER) AS rank FROM t JOIN c USING (conversation_id, topic) QUALIFY rank <= 20""",
    "document_chunks": f"""WITH p AS (SELECT doc_id, {PARTS} AS ps FROM documents), u AS (SELECT doc_id, unnest(ps) AS t, generate_subscripts(ps, 1) - 1 AS i FROM p)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CAST(length(t) AS INTEGER) AS chars, md5(t) AS md5 FROM u""",
    "rule_signals": "SELECT doc_id, CAST(" + " + ".join(f"CAST(regexp_matches(lower(coalesce(text, '')), {q('(?i)' + p)}) AS INTEGER)" for p in ACTION_PATTERNS[:23]) + " AS INTEGER) AS signals, CAST("
    + " + ".join(f"len(regexp_extract_all(coalesce(text, ''), {q('(?i)' + p)}))" for p in ENTITY_PATTERNS) + f" AS INTEGER) AS entities, trim(coalesce(text, '')) <> '' AND {says('text', *ACTIONABLE)} AS actionable FROM documents",
    "token_counts": rf"""SELECT doc_id, CAST(greatest(1, len(list_filter(string_split({squash('text')}, ' '), lambda w: w <> ''))) AS INTEGER) AS tokens, CAST(greatest(1, length(coalesce(text, '')) // 4) AS INTEGER) AS rough,
  CAST(len({TERMS.format('text')}) AS INTEGER) AS terms FROM documents""",
    "top_vectors": f"WITH {SCORES} SELECT query_id, rank, id, score FROM top",
    "retrieved_context": f"""WITH {SCORES}, d AS (SELECT doc_id, {PARTS} AS ps FROM documents), parts AS (SELECT doc_id AS job_id, unnest(ps) AS text, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS chunk_index FROM d),
hits AS (SELECT query_id, id AS job_id, CAST(id % 3 AS INTEGER) AS chunk_index, score FROM top),
near AS (SELECT query_id, job_id, CAST(unnest(range(greatest(chunk_index - 1, 0), chunk_index + 2)) AS INTEGER) AS chunk_index, score FROM hits),
par AS (SELECT query_id, job_id, chunk_index, 0.92::DOUBLE * max(score) AS score FROM near GROUP BY 1, 2, 3),
allp AS (SELECT h.query_id, job_id, chunk_index, text, score, 0 AS is_parent FROM hits h JOIN parts USING (job_id, chunk_index) UNION ALL SELECT p.query_id, job_id, chunk_index, text, score, 1 FROM par p JOIN parts USING (job_id, chunk_index)),
one AS (SELECT * FROM allp WHERE trim(text) <> '' QUALIFY row_number() OVER (PARTITION BY query_id, job_id, chunk_index ORDER BY is_parent, score DESC) = 1),
lex AS (SELECT one.*, len(list_intersect({TERMS.format('q.text')}, regexp_extract_all(lower(one.text), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+'))) AS lexical FROM one JOIN documents q ON q.doc_id = query_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score + 0.04::DOUBLE * lexical, 9) DESC, lexical DESC, job_id DESC, chunk_index) AS INTEGER) AS rank, job_id, chunk_index, is_parent,
  round(score, 6) AS score, CAST(lexical AS INTEGER) AS lexical FROM lex QUALIFY rank <= 24""",
    "routed_events": f"WITH {ENVELOPES} SELECT event_id, event_type, CASE event_type {' '.join(f'WHEN {q(a)} THEN {q(b)}' for a, b in ROUTES.items())} END AS stream, event_type <> 'unknown.type' AS accepted FROM e",
    "accepted_once": f"WITH {ENVELOPES} SELECT idempotency_key, event_id FROM e QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY created_at, event_id) = 1",
    "failure_routes": f"""WITH {ENVELOPES}, r AS (SELECT *, NOT readable OR NOT retryable OR attempt >= 5 AS dead FROM e)
SELECT event_id, readable, CASE WHEN dead THEN 'dead_letter' ELSE 'retry' END AS route, CASE WHEN NOT dead THEN attempt + 1 END AS next_attempt,
  CASE WHEN NOT dead THEN strftime(date_trunc('second', created_at) + to_seconds(CAST(least(300, pow(2, attempt)) AS BIGINT)), {STAMP}) END AS not_before FROM r""",
    "inactive_sessions": f"""WITH o AS (SELECT user_id, ts, CASE WHEN coalesce(ts - lag(ts) OVER w >= INTERVAL 15 MINUTE, TRUE) THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM o)
SELECT user_id, strftime(min(ts), {STAMP}) AS begin, strftime(max(ts), {STAMP}) AS last_at, count(*) AS events FROM g GROUP BY user_id, n""",
    "offered_load": """WITH r AS (SELECT event_type AS p, event_id AS request_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, event_id % 900 + 100 AS tokens FROM events)
SELECT request_id, count(*) OVER w AS requests, CAST(sum(tokens) OVER w AS BIGINT) AS load FROM r WINDOW w AS (PARTITION BY p ORDER BY s RANGE BETWEEN 60 PRECEDING AND CURRENT ROW)""",
    "first_success": """WITH a AS (SELECT event_id // 4 AS call_id, event_id % 4 AS ord, 'p' || (event_id % 4) AS provider, user_id % 3 = 0 AS ok, user_id % 3 > 0 AS retryable FROM events),
b AS (SELECT *, coalesce(max(CASE WHEN ok OR NOT retryable THEN 1 ELSE 0 END) OVER (PARTITION BY call_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM a)
SELECT call_id, count(*) AS tried, max(CASE WHEN ok THEN provider END) AS provider FROM b WHERE over = 0 GROUP BY 1""",
    "space_stats": f"""WITH {TASKS}, n AS (SELECT space_id, count(*) AS total, count_if(status = 'completed') AS completed, count_if(status IN ('pending', 'in_progress')) AS active, strftime(max(updated_at), {STAMP}) AS last_update FROM t GROUP BY 1)
SELECT *, CAST(round_even(100 * completed / total, 0) AS INTEGER) AS percent FROM n""",
    "active_tasks": f"WITH {TASKS} SELECT space_id, CAST(row_number() OVER (PARTITION BY space_id ORDER BY updated_at DESC, task_id DESC) AS INTEGER) AS rank, task_id, status FROM t WHERE status <> 'completed' QUALIFY rank <= 20",
    "due_tasks": f"WITH {TASKS} SELECT task_id, '- ' || task_id || ' (' || status || ', due ' || strftime(updated_at, '%Y-%m-%d') || ')' AS line FROM t WHERE CAST(updated_at AS DATE) = DATE '1995-03-15' OR lower(trim(due_text)) IN ('today', '1995-03-15')",
    "task_page": f"WITH {TASKS} SELECT task_id, strftime(updated_at, {STAMP}) AS updated_at FROM t WHERE t.updated_at < TIMESTAMP '1997-01-01' OR (t.updated_at = TIMESTAMP '1997-01-01' AND task_id < 5000) ORDER BY t.updated_at DESC, task_id DESC LIMIT 51",
    "space_list": f"""WITH {TASKS}, s AS (SELECT DISTINCT space_id FROM t) SELECT space_id, CASE WHEN space_id % 4 = 0 OR n_name IS NULL THEN 'Space ' || right(CAST(space_id AS VARCHAR), 6) ELSE trim(n_name) END AS label
FROM s LEFT JOIN nation ON n_nationkey = space_id ORDER BY lower(CASE WHEN space_id % 4 = 0 THEN '' ELSE coalesce(trim(n_name), '') END), space_id LIMIT 100""",
    "latest_orders": f"SELECT o_custkey, o_orderkey, strftime(o_orderdate, {STAMP}) AS o_orderdate, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY orders.o_orderdate DESC, o_orderkey DESC) = 1",
    "upserted_orders": """WITH n AS (SELECT o_orderkey + o_orderkey % 2 * 1000000 AS o_orderkey, o_custkey, 'N' AS o_orderstatus FROM orders WHERE o_orderkey % 3 = 0)
SELECT * FROM n UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n)""",
    "inserted_orders": "SELECT o_orderkey, o_custkey FROM orders",
    "last_messages": "WITH l AS (SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4) SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS n FROM l",
    "key_sources": """WITH u AS (SELECT c_nationkey AS value, 'customer' AS s FROM customer UNION SELECT s_nationkey, 'supplier' FROM supplier UNION SELECT n_nationkey, 'nation' FROM nation)
SELECT value, string_agg(s, ',' ORDER BY s) AS sources FROM u GROUP BY 1""",
    "object_keys": """SELECT c_custkey, 'audio/' || regexp_replace(trim(c_name), '[^A-Za-z0-9._-]+', '_', 'g') || '/' || c_mktsegment || '/' || c_custkey || '/' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 8, '0') || '_part_1.webm' AS object_key,
  c_custkey || ':' || (c_custkey % 7) || ':c' AS job_id, right(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g'), 6) AS label, c_custkey AS cursor_key FROM customer""",
    "question_plans": f"""SELECT conv_id, turn, concat_ws(',', CASE WHEN {says('text', 'task', 'plan')} THEN 'tasks' END, CASE WHEN {says('text', 'note')} THEN 'notes' END, CASE WHEN {says('text', 'summary', 'summarize')} THEN 'summaries,space_memory' END,
  CASE WHEN {says('text', 'decision')} THEN 'decisions' END, CASE WHEN {says('text', 'issue', 'risk', 'blocker')} THEN 'issues' END) AS focus,
  CASE WHEN {says('text', 'today')} THEN 'today' WHEN {says('text', 'tomorrow')} THEN 'tomorrow' WHEN {says('text', 'all')} THEN 'all' ELSE 'unspecified' END AS scope FROM conversations""",
    "repaired_text": "SELECT doc_id, md5(coalesce(text, '')) AS md5 FROM documents",
    "json_objects": "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events",
    "merged_items": f"WITH {ITEMS} SELECT conversation_id, section, id FROM m QUALIFY row_number() OVER (PARTITION BY conversation_id, section, identity ORDER BY window_index, id) = 1",
    "carried_items": f"WITH {ITEMS} SELECT conversation_id, section, id FROM m QUALIFY row_number() OVER (PARTITION BY conversation_id, section, identity ORDER BY window_index <> 4, window_index, id) = 1",
    "valid_items": f"""WITH {ITEMS} SELECT conversation_id, id, collection, coalesce(body, '') AS body, CASE WHEN collection = 'tasks' THEN coalesce(operation, 'NEEDS_CONFIRMATION') ELSE operation END AS operation,
  coalesce(confidence, 0.5) AS confidence, CASE WHEN collection = 'tasks' THEN coalesce(operation, 'NEEDS_CONFIRMATION') = 'NEEDS_CONFIRMATION' END AS needs_confirmation,
  CASE WHEN collection = 'decisions' THEN coalesce(status, 'unresolved_discussion') ELSE status END AS status, CASE WHEN collection = 'issues' THEN coalesce(kind, 'open_question') ELSE kind END AS kind
FROM m WHERE coalesce(title, '') <> '' AND span <> '' AND (collection <> 'notes' OR coalesce(body, '') <> '')""",
    "window_recovery": f"""WITH {OUTCOMES} SELECT conv_id, turn, trim(coalesce(text, '')) <> '' AND (NOT (tasks OR notes OR decisions) OR (NOT notes AND (facts OR told >= 20)) OR ({says('text', *ACTIONABLE)} AND NOT (tasks OR notes))) AS needs_recovery FROM o""",
    "final_recovery": f"""WITH {OUTCOMES}, w AS (SELECT conv_id, bool_or(notes OR facts OR told >= 30) AS n, bool_or(tasks OR notes OR decisions OR facts OR told >= 30) AS a FROM o GROUP BY 1)
SELECT conv_id, (conv_id % 3 <> 0 AND n) OR (conv_id % 4 <> 0 AND conv_id % 3 <> 0 AND a) AS needs_recovery FROM w""",
    "unsaved_windows": f"""WITH {ARTIFACTS}, w AS (SELECT conversation_id, window_index, count_if(status <> 'rejected') AS expected FROM a GROUP BY 1, 2), h AS (SELECT DISTINCT conversation_id, window_index, TRUE AS has FROM a WHERE window_index < 3 OR id % 40 = 0)
SELECT conversation_id, window_index, CAST(expected AS BIGINT) AS expected FROM w LEFT JOIN h USING (conversation_id, window_index) WHERE expected > 0 AND NOT (coalesce(has, FALSE) AND (conversation_id + window_index) % 4 <> 1)""",
    "item_findings": f"""WITH {ITEMS}, own AS (SELECT * FROM i WHERE collection <> 'tasks' OR conversation_id % 2 = 1),
t AS (SELECT conversation_id, coalesce(string_agg(title, ' ' ORDER BY title) FILTER (id % 4 < 3), '') AS raw FROM a GROUP BY 1), n AS (SELECT *, CASE WHEN conversation_id % 4 < 2 THEN 'we need to ' || raw ELSE raw END AS normalized FROM t)
SELECT conversation_id, 'MISSING_EVIDENCE' AS code, collection, title FROM own WHERE span = ''
UNION ALL SELECT conversation_id, 'EVIDENCE_TEXT_NOT_EXACT_MATCH', collection, title FROM own JOIN n USING (conversation_id) WHERE span <> '' AND NOT contains(lower(raw), lower(quote)) AND NOT contains(lower(normalized), lower(quote))
UNION ALL SELECT conversation_id, 'ACTION_WITHOUT_TASK', NULL, NULL FROM n WHERE ({ACTS}) AND conversation_id NOT IN (SELECT conversation_id FROM own WHERE collection = 'tasks')""",
    "published_tasks": """WITH t AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_custkey AS user_id, 'f' || o_orderkey AS fingerprint, o_orderstatus AS status FROM orders WHERE o_orderkey % 2 = 0),
s AS (SELECT o_orderkey AS n, 's' || o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey AS VARCHAR) END AS existing_id, o_custkey AS user_id, 'f' || (o_orderkey % 5000) AS fingerprint FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 7 <> 0),
f AS (SELECT id, user_id, fingerprint FROM s WHERE existing_id IS NULL AND fingerprint NOT IN (SELECT fingerprint FROM t) QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY n) = 1)
SELECT t.id, t.user_id, coalesce(s.fingerprint, t.fingerprint) AS fingerprint, 1 AS created_at, CASE WHEN s.id IS NULL THEN t.status ELSE 'staged' END AS status FROM t LEFT JOIN s ON s.existing_id = t.id AND s.user_id = t.user_id
UNION ALL SELECT id, user_id, fingerprint, 2, 'staged' FROM f""",
    "attempt_statuses": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'permanent_audio_error' WHEN 2 THEN CASE WHEN user_id % 3 < 2 AND event_id % 6 <> 0 THEN 'retry' ELSE 'fallback' END ELSE 'fallback' END AS status FROM events""",
    "candidate_orders": "SELECT event_id, coalesce(array_to_string(list_filter(CASE event_id % 8 " + " ".join(f"WHEN {n} THEN [{', '.join(map(q, v))}]" for n, v in enumerate(CANDIDATES.values())) + f" ELSE [{', '.join(map(q, OTHERS))}] END, "
    "lambda p: (event_id // (8 * CASE p WHEN 'gemini' THEN 1 WHEN 'groq' THEN 2 WHEN 'mistral' THEN 4 ELSE 8 END)) % 2 = 1), ','), '') AS providers FROM events",
    "storage_errors": f"""WITH e AS (SELECT event_id, event_id % 4 AS k, {one_of([*PERMANENT_CODES, *TEMPORARY_CODES, 'Other', ''], '(event_id // 4) % 10')} AS code, [400, 403, 404, 409, 500, 503][(event_id // 40) % 6 + 1] AS s FROM events)
SELECT event_id, CASE WHEN k = 0 THEN 'permanent' WHEN k <> 2 THEN 'temporary' WHEN code IN {among(PERMANENT_CODES)} THEN 'permanent' WHEN code IN {among(TEMPORARY_CODES)} OR s >= 500 THEN 'temporary' WHEN s < 409 THEN 'permanent' ELSE 'temporary' END AS class FROM e""",
    "space_selection": rf"""WITH c AS (SELECT conv_id, turn, text || CASE turn % 4 WHEN 0 THEN '' WHEN 1 THEN ' in space ' || turn WHEN 2 THEN ' for Workspace ' || turn ELSE ' of PROJECT ' || turn END || ' please' AS x,
  CASE turn % 3 WHEN 0 THEN CAST(turn AS VARCHAR) WHEN 1 THEN 'Space ' || turn ELSE text END AS r FROM conversations)
SELECT conv_id, turn, coalesce(nullif(regexp_extract(x, '(?i)\bspace\s+(\d+)\b', 1), ''), nullif(regexp_extract(x, '(?i)\bworkspace\s+(\d+)\b', 1), ''), nullif(regexp_extract(x, '(?i)\bproject\s+(\d+)\b', 1), '')) AS space,
  trim(regexp_replace(regexp_replace(x, {q('(?i)' + SPACE_PHRASE)}, '', 'g'), '\s+', ' ', 'g')) AS question, regexp_matches(lower(trim(r)), '^[0-9]+$') OR regexp_matches(lower(trim(r)), {q(SPACE_REPLY)}) AS is_reply FROM c""",
    "chosen_options": """WITH o AS (SELECT n_regionkey AS region, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i, lower(n_name) AS label, 'v' || n_nationkey AS value FROM nation),
c AS (SELECT CAST(c_custkey % 5 AS INTEGER) AS region, c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_custkey % 8 END AS n, CASE c_custkey % 3 WHEN 0 THEN '0' || (c_custkey % 8) WHEN 1 THEN lower(n_name) ELSE 'v' || (c_custkey % 25) END AS said FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c.region, c_custkey, value AS option FROM c LEFT JOIN o ON c.region = o.region AND (i = n OR label = said OR value = said) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY i <> n, i) = 1""",
}

# The same for every id divisible by 20, and chunks spread over the whole document.
SQL["vector_searches"] = SQL["top_vectors"]
SQL["label_searches"] = """WITH n AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS x, sqrt(list_dot_product(x, x)) AS l FROM embeddings),
s AS (SELECT a.label AS label, a.id AS query_id, b.id AS id, round(CASE WHEN a.l * b.l > 0 THEN list_dot_product(a.x, b.x) / (a.l * b.l) ELSE 0 END, 6) AS score FROM n a JOIN n b USING (label) WHERE a.id % 20 = 0)
SELECT label, query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, score FROM s QUALIFY rank <= 8"""
SQL["searched_context"] = SQL["retrieved_context"].replace(
    "CAST(id % 3 AS INTEGER) AS chunk_index, score FROM top)", "CAST(id % len(ps) AS INTEGER) AS chunk_index, score FROM top JOIN d ON doc_id = id WHERE len(ps) > 0)"
)
