"""Queries over stored tables, guarded counters, holes and answers, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convlake.functions import keys
from convlake.operators import chunks as ch
from convlake.oracle import CHUNKS
from convlake.oracle import SQL as ENGINE
from convlake.plans import answers
from convlake.plans.answers import ACTIVE, NO_NOTES, NO_SUMMARY, NO_TASKS, NOTES, NOTHING_TODAY, NOTHING_TOMORROW, SUMMARY, TASKS, TODAY, TOMORROW
from convlake.session import shared_folder
from convlake.sources import store
from convlake.sources import tables as src
from convlake.streaming import counters

DAY = "1998-08-01"


def _orders(spark: SparkSession, d: str) -> tuple[store.Table, DataFrame, DataFrame]:
    """Orders, and others that replace or join them."""
    o = src.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    k = F.col("o_orderkey")
    new = o.where(k % 3 == 0).select((k + k % 2 * 1_000_000).alias("o_orderkey"), "o_custkey", F.lit("N").alias("o_orderstatus"))
    return store.Table(shared_folder(spark, "orders"), "o_orderkey", ("o_orderkey",), 16), o, new


def stored_upserts(spark: SparkSession, d: str) -> DataFrame:
    """upserted_orders through a stored table."""
    table, o, new = _orders(spark, d)
    store.create(table, o)
    store.upsert(table, new, ["o_orderkey"], ["o_custkey"])
    return store.read(spark, table)


def replaced_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Orders by status, of which all pending ones are replaced."""
    o = src.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    table = store.Table(shared_folder(spark, "statuses"), "o_orderstatus", ("o_orderkey",), None)
    store.create(table, o)
    store.replace(table, o.where("o_orderstatus = 'P' and o_orderkey % 2 = 0").withColumn("o_custkey", -F.col("o_custkey")))
    return store.read(spark, table)


def _chunk_table(spark: SparkSession, d: str) -> store.Table:
    table = store.Table(shared_folder(spark, "chunks"), "conversation_id", ("sequence_number",), 16)
    store.create(table, src.chunks(spark, d))
    return table


def chunk_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Completed chunks 2 to 6 of every conversation, without their texts, from a stored table."""
    return store.scan(spark, _chunk_table(spark, d), None, 2, 6, F.col("stt_status") == "completed", columns=["conversation_id", "sequence_number", "chunk_id", "stt_attempts"])


def unprocessed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Completed chunks up to number 9 that no window has and nothing excludes."""
    open_ = (F.col("stt_status") == "completed") & F.col("processing_window_id").isNull() & F.col("exclusion_reason").isNull()
    return store.scan(spark, _chunk_table(spark, d), None, None, 9, open_, columns=["conversation_id", "sequence_number"])


def stored_points(spark: SparkSession, d: str) -> DataFrame:
    """All but the texts of the chunks of three conversations, which their keys' slices hold."""
    return store.scan(spark, _chunk_table(spark, d), [1, 3, 8], without=("raw_text", "normalized_text", "role", "last_error", "duration_ms", "exclusion_reason", "processing_window_id"))


def hole_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Holes of the conversations whose id isn't a multiple of 9; the others' chunks are all lost."""
    c = src.chunks(spark, d)
    all_ = c.select("conversation_id", "expected_last").distinct()
    return ch.hole_ranges(c.where("conversation_id % 9 <> 0"), conversations=all_)


def deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries from `events`: every third comes twice."""
    i = F.col("event_id")
    kind = F.when(i % 5 < 2, "received").when(i % 5 < 4, "completed").otherwise("failed")
    e = src.table(spark, d, "events").select(i.cast("string").alias("delivery_id"), (F.col("user_id") % 97).alias("conversation_id"), (F.floor(i / 5) % 40).cast("int").alias("sequence_number"), kind.alias("kind"), i.alias("at"))
    return e.unionByName(e.where("at % 3 = 0"))


def guarded_counters(spark: SparkSession, d: str) -> DataFrame:
    return counters.guarded_counters(deliveries(spark, d))


def _spaces(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Questions of every customer, and the rows of their two spaces, both from orders and customers."""
    k, day = F.col("o_orderkey"), F.lit(DAY).cast("timestamp")
    o = src.table(spark, d, "orders")
    base = [F.col("o_custkey").alias("user_id"), (k % 2).alias("space_id"), k.alias("id"), F.col("o_orderdate").alias("at")]
    title = F.when(k % 6 != 5, F.concat(F.lit("Order "), k.cast("string")))
    body = F.when(k % 3 == 0, F.concat(F.lit(" "), F.col("o_orderpriority")))
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "pending").when(k % 10 == 3, None).otherwise("in_progress")
    date = F.when(k % 7 == 0, F.lit(DAY)).when(k % 7 == 1, F.date_format(F.date_add(day, 1), "yyyy-MM-dd")).when(k % 7 == 4, "1999-01-01")
    text = F.when(k % 7 == 2, " Today").when(k % 7 == 3, "tomorrow").when(k % 7 == 5, "some day")
    tasks = o.select(*base, title.alias("title"), status.alias("status"), F.when(k % 4 == 1, F.col("o_orderpriority")).alias("owner"), date.alias("due_date"), text.alias("due_text"), body.alias("body"))
    notes = o.select(*base, title.alias("title"), body.alias("body"))
    told = o.select(*base, F.concat(F.lit("Summary "), k.cast("string")).alias("summary"))
    rows = answers.task_rows(tasks.where("id % 4 <> 0"), day)
    for part in (
        answers.task_rows(tasks.where("id % 8 = 0"), day, "staged_task"), answers.note_rows(notes.where("id % 3 = 0"), day), answers.note_rows(notes.where("id % 9 = 1"), day, "staged_note"),
        answers.summary_rows(told.where("id % 5 = 0"), day), answers.memory_rows(told.where("id % 11 = 0"), day),
    ):
        rows = rows.unionByName(part)
    c = F.col("c_custkey")
    scope = F.when(c % 4 == 0, "today").when(c % 4 == 1, "tomorrow").when(c % 4 == 2, "none")
    asked = src.table(spark, d, "customer").select(c.alias("question_id"), c.alias("user_id"), F.floor(c / 4).alias("n"), scope.alias("scope"))
    wants = [(F.col("n") % 3 == 0).alias("wants_summary"), (F.col("n") % 5 != 4).alias("wants_tasks"), (F.col("n") % 4 == 0).alias("wants_notes")]
    return asked.select("question_id", "user_id", (F.col("n") % 2).alias("space_id"), "scope", *wants), rows


def direct_answers(spark: SparkSession, d: str) -> DataFrame:
    return answers.direct_answers(*_spaces(spark, d))


def audio_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of uploads and chunks from customers, with odd names and endings, and whether keys that may lie elsewhere are in scope."""
    i = F.col("c_custkey")
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (i % n).cast("int"))
    user, space, name = F.concat(F.lit("user #"), i.cast("string")), pick(["a/b", "", "..x--", "s=1"], 4), pick(["dir/part 1.WebM", ".hidden", "..", "/", "x.tar.gz", "ümlaut?.m4a"], 6)
    key = keys.chunk_key(F.lit("/audio/"), user, space, i.cast("string"), i * 1_000_003, F.col("c_mktsegment"), pick([".WAV", "mp 3", "?", " .m4a "], 4))
    asked = F.when(i % 5 == 0, F.concat(F.lit("/audio/"), key)).when(i % 5 == 1, F.concat(key, F.lit("/../x"))).when(i % 5 == 2, F.replace(key, F.lit("/"), F.lit("\\"))).otherwise(key)
    return src.table(spark, d, "customer").select("c_custkey", key.alias("chunk_key"), keys.upload_key(F.lit("audio"), user, space, pick(["", "s 1"], 2), i.cast("string"), name).alias("upload_key"), keys.valid_key(asked).alias("valid_key"), keys.in_scope(asked, F.lit("audio"), user, space, i.cast("string")).alias("in_scope"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _headed(headline: str, rows: str, most: int | None) -> str:
    title = " || ".join(_quoted(p) if p != "{n}" else f"len({rows})" for p in headline.replace("{n}", "\0{n}\0").split("\0") if p)
    shown = rows if most is None else f"({rows})[:{most}]"
    return f"CASE WHEN len({rows}) > 0 THEN {title} || chr(10) || array_to_string(list_transform({shown}, lambda x: x.line), chr(10)) END"


ACTIVE_SQL = "(" + ", ".join(map(_quoted, ACTIVE)) + ")"
TESTS_SQL = {"any": "TRUE", "unfinished": f"x.status IN {ACTIVE_SQL}", "completed": "x.status = 'completed'", "due_today": "x.due = 'today'", "due_tomorrow": "x.due = 'tomorrow'", "today": "x.today"}


def _some(kind: str, test: str) -> str:
    also = f" AND x.status IN {ACTIVE_SQL}" if kind == "task" and test.startswith("due") else ""
    return f"list_filter(items, lambda x: x.kind = '{kind}' AND coalesce({TESTS_SQL[test]}{also}, FALSE))"


def _first(plan: list[tuple], nothing: str) -> str:
    return "coalesce(" + ", ".join(_headed(h, _some(k, t), m) for k, t, m, h in plan) + f", {_quoted(nothing)})"


def _sections(found: str, plan: list[tuple], nothing: str) -> str:
    empty = " AND ".join(f"len({_some(k, 'any')}) = 0" for k in dict.fromkeys(k for k, *_ in plan))
    parts = ", ".join(_headed(h, _some(k, t), m) for k, t, m, h in plan)
    return f"CASE WHEN {empty} THEN {_quoted(nothing)} ELSE concat_ws(chr(10), {found}, {parts}) END"


def _line(kind: str) -> str:
    if kind.endswith("note"):
        return "'- ' || coalesce(title, 'Untitled') || CASE WHEN body IS NULL THEN '' ELSE ': ' || trim(body) END"
    status = "'unknown'" if kind == "task" else "'pending review'"
    return f"'- ' || coalesce(title, 'Untitled') || ' (' || coalesce(status, {status}) || ', owner: ' || coalesce(owner, 'no owner') || ', due: ' || coalesce(due_date, due_text, 'no due date') || ')' || CASE WHEN body IS NULL THEN '' ELSE ' - ' || trim(body) END"


SQL = {"any": "TRUE", "unfinished": f"x.status IN {ACTIVE_SQL}", "completed": "x.status = 'completed'", "due_today": "x.due = 'today'", "due_tomorrow": "x.due = 'tomorrow'", "today": "x.today"}


def _some(kind: str, test: str) -> str:
    also = f" AND x.status IN {ACTIVE_SQL}" if kind == "task" and test.startswith("due") else ""
    return f"list_filter(items, lambda x: x.kind = '{kind}' AND coalesce({TESTS_SQL[test]}{also}, FALSE))"


def _first(plan: list[tuple], nothing: str) -> str:
    return "coalesce(" + ", ".join(_headed(h, _some(k, t), m) for k, t, m, h in plan) + f", {_quoted(nothing)})"


def _sections(found: str, plan: list[tuple], nothing: str) -> str:
    empty = " AND ".join(f"len({_some(k, 'any')}) = 0" for k in dict.fromkeys(k for k, *_ in plan))
    parts = ", ".join(_headed(h, _some(k, t), m) for k, t, m, h in plan)
    return f"CASE WHEN {empty} THEN {_quoted(nothing)} ELSE concat_ws(chr(10), {found}, {parts}) END"


def _line(kind: str) -> str:
    if kind.endswith("note"):
        return "'- ' || coalesce(title, 'Untitled') || CASE WHEN body IS NULL THEN '' ELSE ': ' || trim(body) END"
    status = "'unknown'" if kind == "task" else "'pending review'"
    return f"'- ' || coalesce(title, 'Untitled') || ' (' || coalesce(status, {status}) || ', owner: ' || coalesce(owner, 'no owner') || ', due: ' || coalesce(due_date, due_text, 'no due date') || ')' || CASE WHEN body IS NULL THEN '' ELSE ' - ' || trim(body) END"


ANSWERS = f"""WITH b AS (SELECT o_custkey AS user_id, o_orderkey % 2 AS space_id, o_orderkey AS id, o_orderdate AS placed, CASE WHEN o_orderkey % 6 <> 5 THEN 'Order ' || o_orderkey END AS title,
  CASE WHEN o_orderkey % 3 = 0 THEN ' ' || o_orderpriority END AS body, CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderkey % 10 = 3 THEN NULL ELSE 'in_progress' END AS status,
  CASE WHEN o_orderkey % 4 = 1 THEN o_orderpriority END AS owner, CASE o_orderkey % 7 WHEN 0 THEN '1998-08-01' WHEN 1 THEN '1998-08-02' WHEN 4 THEN '1999-01-01' END AS due_date,
  CASE o_orderkey % 7 WHEN 2 THEN ' Today' WHEN 3 THEN 'tomorrow' WHEN 5 THEN 'some day' END AS due_text, CASE o_orderkey % 7 WHEN 0 THEN 'today' WHEN 2 THEN 'today' WHEN 1 THEN 'tomorrow' WHEN 3 THEN 'tomorrow' END AS due,
  CAST(o_orderdate AS DATE) = DATE '1998-08-01' AS today FROM orders),
r AS (SELECT user_id, space_id, 'task' AS kind, 100 AS cap, id, placed, {_line('task')} AS line, status, due, today FROM b WHERE id % 4 <> 0
  UNION ALL SELECT user_id, space_id, 'staged_task', 50, id, placed, {_line('staged_task')}, status, due, today FROM b WHERE id % 8 = 0
  UNION ALL SELECT user_id, space_id, 'note', 50, id, placed, {_line('note')}, NULL, NULL, today FROM b WHERE id % 3 = 0
  UNION ALL SELECT user_id, space_id, 'staged_note', 50, id, placed, {_line('staged_note')}, NULL, NULL, today FROM b WHERE id % 9 = 1
  UNION ALL SELECT user_id, space_id, 'summary', 8, id, placed, '- Summary ' || id, NULL, NULL, today FROM b WHERE id % 5 = 0
  UNION ALL SELECT user_id, space_id, 'memory', 1, id, placed, 'Summary ' || id, NULL, NULL, today FROM b WHERE id % 11 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, space_id, kind ORDER BY placed DESC, id DESC) AS rank FROM r QUALIFY rank <= cap),
g AS (SELECT user_id, space_id, list(struct_pack(kind := kind, line := line, status := status, due := due, today := today) ORDER BY rank) AS items FROM n GROUP BY ALL),
q AS (SELECT c_custkey AS question_id, c_custkey // 4 AS n, CASE c_custkey % 4 WHEN 0 THEN 'today' WHEN 1 THEN 'tomorrow' WHEN 2 THEN 'none' END AS scope FROM customer),
a AS (SELECT question_id, question_id AS user_id, q.n % 2 AS space_id, q.n AS n, coalesce(scope, '') AS scope, coalesce(items, []) AS items FROM q LEFT JOIN g ON g.user_id = question_id AND g.space_id = q.n % 2)
SELECT question_id, user_id, space_id, nullif(concat_ws(chr(10) || chr(10),
  CASE WHEN n % 3 = 0 THEN concat_ws(chr(10), {_quoted(SUMMARY)}, nullif(array_to_string(list_transform({_some('memory', 'any')}, lambda x: x.line), chr(10)), ''),
    coalesce({_headed('Today:', _some('summary', 'today'), 5)}, {_headed('Recent:', _some('summary', 'any'), 3)}, {_quoted(NO_SUMMARY)}),
    coalesce({_headed('Tasks due today: {n}', _some('task', 'due_today'), 10)}, 'Tasks due today: none found.'), {_headed('Notes updated today: {n}', _some('note', 'today'), 5)}) END,
  CASE WHEN n % 5 <> 4 THEN CASE scope WHEN 'today' THEN {_first(TODAY, NOTHING_TODAY)} WHEN 'tomorrow' THEN {_first(TOMORROW, NOTHING_TOMORROW)}
    ELSE {_sections(f"'I found ' || len({_some('task', 'any')}) || ' task(s) in this space. Unfinished: ' || len({_some('task', 'unfinished')}) || '.'", TASKS, NO_TASKS)} END END,
  CASE WHEN n % 4 = 0 THEN {_sections(f"'I found ' || len({_some('note', 'any')}) || ' published note(s) and ' || len({_some('staged_note', 'any')}) || ' staged note(s):'", NOTES, NO_NOTES)} END), '') AS answer FROM a"""

PART = "coalesce(nullif(trim(regexp_replace(coalesce(nullif({}, ''), 'unknown'), '[^A-Za-z0-9._=-]+', '-', 'g'), '.-/'), ''), 'unknown')"
KEYS = rf"""WITH a AS (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS i, 'user #' || c_custkey AS u, ['a/b', '', '..x--', 's=1'][c_custkey % 4 + 1] AS s, ['part 1.WebM', '.hidden', '..', '', 'x.tar.gz', 'ümlaut?.m4a'][c_custkey % 6 + 1] AS f,
  ['wav', 'mp3', NULL, 'm4a'][c_custkey % 4 + 1] AS e, c_mktsegment AS m, CASE WHEN c_custkey % 2 = 0 THEN 'no-session' ELSE 's 1' END AS n FROM customer),
b AS (SELECT *, regexp_extract(f, '^.+(\.[^.]+)$', 1) AS x, 'audio/' || {PART.format('u')} || '/' || {PART.format('s')} || '/' || i || '/' AS own FROM a),
k AS (SELECT *, own || lpad(CAST(c_custkey * 1000003 AS VARCHAR), CAST(greatest(8, length(CAST(c_custkey * 1000003 AS VARCHAR))) AS INTEGER), '0') || '-' || {PART.format('m')} || '.' || e AS key FROM b),
v AS (SELECT *, CASE WHEN c_custkey % 5 = 0 THEN 'audio/' || key WHEN c_custkey % 5 = 1 THEN NULL ELSE key END AS valid FROM k)
SELECT c_custkey, key AS chunk_key, 'audio/' || {PART.format('u')} || '/' || {PART.format('s')} || '/' || {PART.format('n')} || '/' || i || '/' || CASE WHEN trim(f) IN ('', '.', '..') THEN 'audio'
  ELSE coalesce(nullif(trim(regexp_replace(left(f, length(f) - length(x)), '[^A-Za-z0-9._-]+', '-', 'g'), '.-_'), ''), 'audio') || left(regexp_replace(x, '[^A-Za-z0-9.]+', '', 'g'), 16) END AS upload_key,
  valid AS valid_key, coalesce(starts_with(valid, own), FALSE) AS in_scope FROM v"""

SQL = {
    "audio_keys": KEYS,
    "stored_upserts": ENGINE["upserted_orders"],
    "replaced_partitions": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN -o_custkey ELSE o_custkey END AS o_custkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P' OR o_orderkey % 2 = 0",
    "chunk_ranges": f"WITH {CHUNKS} SELECT conversation_id, sequence_number, 'chunk_' || sequence_number AS chunk_id, CAST(stt_attempts AS INTEGER) AS stt_attempts FROM k WHERE sequence_number BETWEEN 2 AND 6 AND stt_status = 'completed'",
    "unprocessed_chunks": f"WITH {CHUNKS} SELECT conversation_id, sequence_number FROM k WHERE sequence_number <= 9 AND stt_status = 'completed' AND processing_window_id IS NULL AND exclusion_reason IS NULL",
    "stored_points": f"WITH {CHUNKS} SELECT conversation_id, sequence_number, expected_last, 'chunk_' || sequence_number AS chunk_id, stt_status, CAST(stt_attempts AS INTEGER) AS stt_attempts FROM k WHERE conversation_id IN (1, 3, 8)",
    "hole_ranges": f"""WITH {CHUNKS}, s AS (SELECT conversation_id, CAST(sequence_number AS BIGINT) AS n, bool_or(terminal) AS failed, bool_or(useful) AS useful, bool_or(skippable) AS skippable FROM k WHERE conversation_id % 9 <> 0 GROUP BY ALL),
numbers AS (SELECT conversation_id, unnest(range(0, expected_last + 1)) AS n FROM lst), lacking AS (SELECT * FROM numbers ANTI JOIN s USING (conversation_id, n)),
islands AS (SELECT 'sequence_missing' AS kind, conversation_id, n, n - row_number() OVER (PARTITION BY conversation_id ORDER BY n) AS i FROM lacking
  UNION ALL SELECT 'stt_failed', conversation_id, n, n - row_number() OVER (PARTITION BY conversation_id ORDER BY n) FROM s WHERE failed),
lead AS (SELECT conversation_id, n FROM numbers JOIN s USING (conversation_id, n) WHERE skippable AND NOT useful
  AND n < (SELECT coalesce(min(m.n), 1000000) FROM numbers m LEFT JOIN s x USING (conversation_id, n) WHERE m.conversation_id = numbers.conversation_id AND (x.n IS NULL OR x.useful OR NOT x.skippable)))
SELECT conversation_id, kind, min(n) AS low, max(n) AS high FROM islands GROUP BY conversation_id, kind, i
UNION ALL SELECT conversation_id, 'empty_transcript', min(n), max(n) FROM lead GROUP BY conversation_id""",
    "guarded_counters": """WITH e AS (SELECT DISTINCT event_id AS i, user_id % 97 AS conversation_id, event_id // 5 % 40 AS n, CASE WHEN event_id % 5 < 2 THEN 'received' WHEN event_id % 5 < 4 THEN 'completed' ELSE 'failed' END AS kind FROM events),
p AS (SELECT *, lag(kind) OVER (PARTITION BY conversation_id, n ORDER BY i) AS before FROM e WHERE kind <> 'received')
SELECT conversation_id, count(DISTINCT n) FILTER (kind = 'received') AS received, count(*) FILTER (kind = 'completed' AND before IS DISTINCT FROM 'completed') AS completed, count(*) FILTER (kind = 'failed') AS failed
FROM (SELECT conversation_id, n, kind, before FROM p UNION ALL SELECT conversation_id, n, kind, NULL FROM e WHERE kind = 'received') GROUP BY 1""",
    "direct_answers": ANSWERS,
}
QUERIES = [audio_keys, stored_upserts, replaced_partitions, chunk_ranges, unprocessed_chunks, stored_points, hole_ranges, guarded_counters, direct_answers]
