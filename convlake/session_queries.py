"""Queries over recording sessions and their DuckDB SQL, both on views that fixed rules make from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convlake.operators import sessions as ses
from convlake.oracle import ARTIFACTS, CHUNKS, among, q
from convlake.sources import tables as src

STATUSES = ["RECORDING", "STOP_REQUESTED", "WAITING_FOR_TRANSCRIPTS", "READY_FOR_PROCESSING", "PROCESSING", "COMPLETED", "FINALIZING"]
WINDOW_STATUSES = ["completed", "pending", "processing", "completed", "failed"]
ALLOWED = ["audio/wav", "audio/mpeg"]
NOW, STALE = 1_006_000, 1_003_000


def at(seconds: Column | int) -> Column:
    return F.timestamp_seconds(F.lit(seconds) if isinstance(seconds, int) else seconds)


def sessions(spark: SparkSession, d: str) -> DataFrame:
    s = src.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("conversation_id")).agg(F.max("turn").cast("int").alias("m"))
    i = F.col("conversation_id")
    status = F.get(F.array(*map(F.lit, STATUSES)), (i % 7).cast("int"))
    begun = 1_000_000 + i * 100
    return s.select("conversation_id", status.alias("status"), F.when(i % 11 != 0, F.col("m")).alias("expected_last"), F.when(i % 3 == 0, 0).otherwise(F.col("m") + 1).alias("received"), at(begun).alias("updated_at"), F.when(i % 5 != 0, at(begun - 800 * (i % 3))).alias("stopped_at"))


def windows(spark: SparkSession, d: str) -> DataFrame:
    w = src.chunks(spark, d).select("conversation_id", F.floor(F.col("sequence_number") / 2).cast("int").alias("window_index")).distinct()
    i, n = F.col("conversation_id"), F.col("window_index")
    status = F.get(F.array(*map(F.lit, WINDOW_STATUSES)), ((i * 3 + n) % 5).cast("int"))
    return w.select("conversation_id", "window_index", status.alias("status"), F.when((i + n) % 7 != 0, (i + n) % 4 != 1).alias("artifacts_saved"), at(1_000_000 + i * 50 + n * 1000).alias("updated_at"), at(F.lit(900_000) + i).alias("queued_at"), F.lit(None).cast("string").alias("last_error"))


def timed_chunks(spark: SparkSession, d: str) -> DataFrame:
    i, n = F.col("conversation_id"), F.col("sequence_number")
    c = src.chunks(spark, d).withColumn("updated_at", F.when((i + n) % 9 != 0, at(1_000_000 + i * 50 + n * 500)))
    return c.withColumn("audio_file_path", F.when((i + n) % 4 != 0, F.concat(F.lit("/audio/"), "chunk_id")))


def session_accounting(spark: SparkSession, d: str) -> DataFrame:
    out = ses.full_accounting(src.chunks(spark, d), windows(spark, d), sessions(spark, d), at(NOW))
    return out.select("conversation_id", *ses.PUBLIC, "missing", "permanent_failures", "incomplete_windows", "artifact_persistence_gaps", "pending_transcripts", "valid_excluded")


def session_recovery(spark: SparkSession, d: str) -> DataFrame:
    return ses.recovery_events(sessions(spark, d), at(STALE))


def reclaimed_windows(spark: SparkSession, d: str) -> DataFrame:
    out = ses.reclaimed(windows(spark, d), "status", at(STALE), at(NOW), "stale processing reclaimed", "queued_at")
    return out.withColumn("updated_at", F.unix_timestamp("updated_at")).withColumn("queued_at", F.unix_timestamp("queued_at")).drop("artifacts_saved")


def transcription_requests(spark: SparkSession, d: str) -> DataFrame:
    c = timed_chunks(spark, d)
    i, n = F.col("conversation_id"), F.col("sequence_number")
    audio = c.where((i * 3 + n) % 4 < 2).select(
        "conversation_id", "sequence_number", F.when(n % 2 == 0, F.concat(F.lit("f"), n.cast("string"), F.lit(".ogg"))).alias("filename"), F.when(n % 3 == 0, F.lit("audio/ogg")).alias("content_type"),
        F.when(i % 2 == 0, F.lit("S3")).alias("provider"), F.when(i % 4 == 0, F.lit("b")).alias("bucket"), F.when(i % 4 == 0, F.concat(F.lit("k/"), n.cast("string"))).alias("object_key"), F.when(n % 2 == 1, F.lit("/stored")).alias("file_path"),
    )
    return ses.transcription_requests(c, audio, at(STALE), at(NOW))


def upload_errors(spark: SparkSession, d: str) -> DataFrame:
    i, n = F.col("conversation_id"), F.col("sequence_number")
    c = src.chunks(spark, d).join(sessions(spark, d).select("conversation_id", "status"), "conversation_id")
    pick = lambda k, *values: F.get(F.array(*map(F.lit, values)), (k % len(values)).cast("int"))
    kind, ending = pick(i + n, "audio/wav", " Audio/MPEG; q=1", "", "audio/wav", "text/plain"), pick(i * 2 + n, "wav", ".MP3", "", "w-a-v", "abcdefghijklmnopqrstu")
    error = ses.upload_error(F.col("status"), F.col("expected_last") - 1, n, 29_990 + (i + n) % 20, kind, ending, pick(i + n * 3, 5, 1000, 0, 99_999_999), ALLOWED)
    return c.select("conversation_id", "sequence_number", error.alias("error"))


def window_artifacts(spark: SparkSession, d: str) -> DataFrame:
    a = src.artifacts(spark, d).withColumn("windows", F.when(F.col("id") % 3 != 0, F.array(((F.col("id") % 7)).cast("int"), F.col("window_index"))))
    return ses.window_artifacts(a.select("conversation_id", "window_index").distinct(), a)


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    a = src.artifacts(spark, d).withColumn("resolution", F.when(i % 4 == 0, "UPDATE").when(i % 4 == 1, "CONTRADICTION")).withColumn("needs_confirmation", F.when(i % 3 != 0, i % 3 == 1))
    a = a.withColumn("status", F.when(i % 19 == 0, "rejected").when(i % 23 == 0, "completed").when(i % 29 == 0, "superseded").when(i % 5 == 0, "active").otherwise("provisional"))
    return a.withColumn("content", F.when(i % 6 == 0, "").otherwise(F.col("content"))).withColumn("evidence", F.when(i % 8 == 0, F.array().cast("array<int>")).otherwise(F.array("sequence_start")))


def result_items(spark: SparkSession, d: str) -> DataFrame:
    return ses.results_of(_resolved(spark, d))


def preserved_items(spark: SparkSession, d: str) -> DataFrame:
    items = ses.results_of(_resolved(spark, d)).withColumn("title", F.substring_index("title", " ", 1))
    return ses.preserve_unrepresented(items.where("id % 3 = 0"), items.where("id % 3 <> 0"))


def reviewed_items(spark: SparkSession, d: str) -> DataFrame:
    a = src.artifacts(spark, d).where("artifact_type in ('task', 'note')").withColumn("index", (F.col("id") % 100).cast("int")).withColumnRenamed("artifact_type", "kind")
    i = F.col("id")
    said = a.where("id % 4 < 2").select("conversation_id", "kind", "index", F.explode(F.array(F.lit(0), F.lit(1))).alias("position"), i)
    said = said.select("conversation_id", "kind", "index", "position", ((i + F.col("position")) % 3 != 0).alias("keep"), F.when((i + F.col("position")) % 2 == 0, F.concat(F.lit("r"), i.cast("string"))).alias("revised_body"), F.lit("dull").alias("reason"))
    return ses.reviewed(a.select("conversation_id", "kind", "index", "title", F.col("content").alias("body")), said)


def short_summaries(spark: SparkSession, d: str) -> DataFrame:
    w = windows(spark, d).withColumn("summary", F.when((F.col("conversation_id") + F.col("window_index")) % 3 == 0, F.concat(F.lit(" Said in "), F.col("window_index").cast("string"), F.lit(". "))))
    n = F.col("conversation_id")
    topics = sessions(spark, d).where(n % 4 != 0).select("conversation_id", F.explode(F.sequence(F.lit(1), (n % 9 + 1).cast("int"))).alias("rank")).withColumn("label", F.concat(F.lit("t"), F.col("rank").cast("string")))
    return ses.short_summary(w, topics)


def space_totals(spark: SparkSession, d: str) -> DataFrame:
    o = src.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 50).alias("user_id"), (F.col("o_custkey") % 7).alias("space_id"), F.col("o_orderstatus").alias("s"))
    tasks = o.where("k % 4 = 0 and user_id % 3 > 0").withColumn("status", F.when(F.col("s") == "F", "completed").otherwise("pending"))
    jobs = o.where("k % 4 = 2").withColumn("operation", F.when(F.col("s") == "F", "DONE").when(F.col("s") == "P", "COMPLETE").otherwise("CREATE"))
    return ses.space_totals(o.where("k % 4 = 1"), tasks, o.where("k % 4 = 3"), jobs)


def staged_jobs(spark: SparkSession, d: str) -> DataFrame:
    o = src.table(spark, d, "orders")
    old = o.where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("user_id"))
    new = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_custkey") % 2 == 0, "done").alias("status"), F.col("o_orderpriority").alias("note"))
    return ses.staged(old, new, "job_id")


def listed(values: list) -> str:
    return "[" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in values) + "]"


SESSIONS = f"""ss AS (SELECT conv_id AS conversation_id, CAST(max(turn) AS INTEGER) AS m FROM conversations GROUP BY 1),
sessions AS (SELECT conversation_id, {listed(STATUSES)}[conversation_id % 7 + 1] AS status, CASE WHEN conversation_id % 11 <> 0 THEN m END AS expected_last,
  CASE WHEN conversation_id % 3 = 0 THEN 0 ELSE m + 1 END AS received, 1000000 + conversation_id * 100 AS updated_at,
  CASE WHEN conversation_id % 5 <> 0 THEN 1000000 + conversation_id * 100 - 800 * (conversation_id % 3) END AS stopped_at FROM ss)"""
WINDOWS = f"""wi AS (SELECT DISTINCT conversation_id, sequence_number // 2 AS window_index FROM chunks),
windows AS (SELECT *, {listed(WINDOW_STATUSES)}[(conversation_id * 3 + window_index) % 5 + 1] AS status, CASE WHEN (conversation_id + window_index) % 7 <> 0 THEN (conversation_id + window_index) % 4 <> 1 END AS saved,
  1000000 + conversation_id * 50 + window_index * 1000 AS updated_at, 900000 + conversation_id AS queued_at FROM wi)"""
STUCK = f"(status = 'processing' AND updated_at <= {STALE})"
RESOLVED = f"""{ARTIFACTS}, r AS (SELECT conversation_id, id, position, artifact_type AS kind, title, CASE WHEN id % 6 = 0 THEN '' ELSE content END AS content, CASE WHEN id % 17 = 0 THEN 'COMPLETE' WHEN id % 13 = 0 THEN 'UPDATE' END AS op,
  CASE id % 4 WHEN 0 THEN 'UPDATE' WHEN 1 THEN 'CONTRADICTION' END AS resolution, CASE WHEN id % 3 <> 0 THEN id % 3 = 1 END AS unsure,
  CASE WHEN id % 19 = 0 THEN 'rejected' WHEN id % 23 = 0 THEN 'completed' WHEN id % 29 = 0 THEN 'superseded' WHEN id % 5 = 0 THEN 'active' ELSE 'provisional' END AS status FROM a),
o AS (SELECT *, CASE WHEN kind IN {among(ses.TASKS)} THEN 'tasks' WHEN kind = 'decision' THEN 'decisions' WHEN kind IN {among(ses.ISSUES)} THEN 'issues' ELSE 'notes' END AS section,
  CASE WHEN content = '' THEN title ELSE content END AS filled FROM r WHERE status NOT IN ('rejected', 'superseded')),
items AS (SELECT conversation_id, section, id, position, title, CASE WHEN section IN ('tasks', 'notes') THEN filled END AS body,
  CASE section WHEN 'decisions' THEN CASE WHEN status = 'provisional' AND resolution IS DISTINCT FROM 'CONTRADICTION' THEN 'proposal' ELSE 'confirmed_decision' END
    WHEN 'issues' THEN CASE WHEN kind IN ('blocker', 'risk') THEN kind ELSE 'open_question' END END AS state,
  CASE section WHEN 'tasks' THEN coalesce(op, CASE WHEN status = 'completed' THEN 'COMPLETE' WHEN resolution = 'UPDATE' THEN 'UPDATE' WHEN unsure THEN 'NEEDS_CONFIRMATION' ELSE 'CREATE' END) END AS operation FROM o WHERE id % 8 <> 0
  UNION ALL SELECT conversation_id, 'facts', id, position, filled, NULL, NULL, NULL FROM o WHERE kind = 'fact'
  UNION ALL SELECT conversation_id, 'questions', id, position, title, NULL, NULL, NULL FROM o WHERE kind = 'question')"""
SQL: dict[str, str] = {
    "session_accounting": f"""WITH {CHUNKS}, {SESSIONS}, {WINDOWS},
g AS (SELECT conversation_id, coalesce(stopped_at <= {NOW} - 900, FALSE) AS late FROM sessions),
n AS (SELECT conversation_id, max(expected_last) + 1 AS expected_sequences, count(DISTINCT sequence_number) AS present, count_if(stt_status = 'completed' AND NOT useful) AS empty_transcripts,
  count_if(stt_status = 'failed') AS failed_transcripts, count_if(stt_status IN ('pending', 'processing')) AS pending_transcripts, count_if(useful) AS valid_transcripts,
  count_if(useful AND processing_window_id IS NOT NULL) AS valid_windowed, count_if(useful AND exclusion_reason IS NOT NULL) AS valid_excluded,
  count_if(useful AND processing_window_id IS NULL AND exclusion_reason IS NULL) AS valid_unwindowed, count_if(terminal) AS terminal_failed FROM cl GROUP BY 1),
w AS (SELECT conversation_id, count(*) AS windows_created, count_if(status = 'completed') AS windows_completed, count_if(status = 'pending') AS windows_pending, count_if(status = 'processing') AS windows_processing,
  count_if(status = 'failed') AS windows_failed, count_if(status <> 'completed') AS incomplete_windows, count_if(coalesce(status = 'completed' AND NOT saved, FALSE)) AS artifact_persistence_gaps FROM windows GROUP BY 1)
SELECT conversation_id, expected_sequences, present + CASE WHEN late THEN expected_sequences - present ELSE 0 END AS accounted_sequences, empty_transcripts, failed_transcripts, valid_transcripts, valid_windowed, valid_unwindowed,
  windows_created, windows_completed, windows_pending, windows_processing, windows_failed, pending_transcripts + failed_transcripts - terminal_failed + CASE WHEN late THEN 0 ELSE expected_sequences - present END AS unresolved_expected,
  expected_sequences - present AS missing, terminal_failed + CASE WHEN late THEN expected_sequences - present ELSE 0 END AS permanent_failures, incomplete_windows, artifact_persistence_gaps, pending_transcripts, valid_excluded
FROM n JOIN g USING (conversation_id) JOIN w USING (conversation_id)""",
    "session_recovery": f"""WITH {SESSIONS} SELECT conversation_id, CASE WHEN status = 'READY_FOR_PROCESSING' THEN 'conversation.processing.requested' ELSE 'conversation.finalization.requested' END AS event_type,
  CASE WHEN status = 'READY_FOR_PROCESSING' THEN 'stale-processing-recovery' ELSE 'stale-finalization-recovery' END AS source, expected_last
FROM sessions WHERE status IN {among(ses.UNFINALIZED)} AND expected_last IS NOT NULL AND updated_at <= {STALE} AND received > 0""",
    "reclaimed_windows": f"""WITH {CHUNKS}, {WINDOWS} SELECT conversation_id, window_index, CASE WHEN {STUCK} THEN 'pending' ELSE status END AS status, CASE WHEN {STUCK} THEN {NOW} ELSE updated_at END AS updated_at,
  CASE WHEN NOT {STUCK} THEN queued_at END AS queued_at, CASE WHEN {STUCK} THEN 'stale processing reclaimed' END AS last_error, {STUCK} AS reclaimed FROM windows""",
    "transcription_requests": f"""WITH {CHUNKS}, t AS (SELECT *, 'chunk_' || sequence_number AS chunk_id, CASE WHEN (conversation_id + sequence_number) % 9 <> 0 THEN 1000000 + conversation_id * 50 + sequence_number * 500 END AS updated_at,
  CASE WHEN (conversation_id + sequence_number) % 4 <> 0 THEN '/audio/chunk_' || sequence_number END AS path, (conversation_id * 3 + sequence_number) % 4 < 2 AS stored FROM chunks),
l AS (SELECT *, stored AND conversation_id % 2 = 0 AS s3 FROM t WHERE ((stt_status = 'processing' AND updated_at <= {STALE})
  OR (stt_status NOT IN ('processing', 'completed') AND NOT (stt_status = 'failed' AND (last_error LIKE 'Invalid%' OR stt_attempts >= 5)) AND (updated_at IS NULL OR updated_at <= {STALE}))) AND (stored OR path IS NOT NULL))
SELECT conversation_id, sequence_number, chunk_id, CASE WHEN stored AND sequence_number % 2 = 0 THEN 'f' || sequence_number || '.ogg' ELSE chunk_id || '.audio' END AS filename,
  CASE WHEN stored AND sequence_number % 3 = 0 THEN 'audio/ogg' ELSE 'audio/wav' END AS content_type, CASE WHEN s3 THEN 's3' END AS storage_provider, CASE WHEN s3 AND conversation_id % 4 = 0 THEN 'b' END AS bucket,
  CASE WHEN s3 AND conversation_id % 4 = 0 THEN 'k/' || sequence_number END AS object_key, CASE WHEN NOT s3 THEN CASE WHEN stored AND sequence_number % 2 = 1 THEN '/stored' ELSE path END END AS file_path FROM l""",
    "upload_errors": f"""WITH {CHUNKS}, {SESSIONS}, u AS (SELECT k.conversation_id AS i, k.sequence_number AS n, s.status, k.expected_last AS m FROM k JOIN sessions s USING (conversation_id))
SELECT i AS conversation_id, n AS sequence_number, CASE WHEN status <> 'RECORDING' AND n > m - 1 THEN 'closed' WHEN 29990 + (i + n) % 20 > 30000 THEN 'too_long' WHEN (i + n) % 5 = 2 THEN 'no_content_type'
  WHEN (i * 2 + n) % 5 IN (2, 4) THEN 'bad_extension' WHEN (i + n) % 5 = 4 THEN 'unsupported_content_type' WHEN (i + n * 3) % 4 = 2 THEN 'empty' WHEN (i + n * 3) % 4 = 3 THEN 'too_large' END AS error FROM u""",
    "window_artifacts": f"""WITH {ARTIFACTS}, e AS (SELECT conversation_id, id, window_index FROM a UNION SELECT conversation_id, id, id % 7 FROM a WHERE id % 3 <> 0)
SELECT conversation_id, window_index, count(e.id) AS artifacts FROM (SELECT DISTINCT conversation_id, window_index FROM a) w LEFT JOIN e USING (conversation_id, window_index) GROUP BY 1, 2""",
    "result_items": f"WITH {RESOLVED} SELECT * FROM items",
    "preserved_items": f"""WITH {RESOLVED}, s AS (SELECT conversation_id, section, position, string_split(title, ' ')[1] AS title, CASE WHEN id % 3 = 0 THEN 0 ELSE 1 END AS source FROM items)
SELECT * FROM s QUALIFY source = 0 OR row_number() OVER (PARTITION BY conversation_id, section, lower(title) ORDER BY source, position) = 1""",
    "reviewed_items": f"""WITH {ARTIFACTS}, i AS (SELECT *, CAST(id % 100 AS INTEGER) AS idx FROM a WHERE artifact_type IN ('task', 'note'))
SELECT conversation_id, artifact_type AS kind, idx AS index, title, CASE WHEN id % 4 < 2 AND (id + 1) % 2 = 0 THEN 'r' || id ELSE content END AS body,
  CASE WHEN id % 4 < 2 AND (id + 1) % 3 = 0 THEN 'REVIEW_FLAGGED_' || upper(artifact_type) || '_KEPT: ' || title || ' (dull)' END AS warning FROM i""",
    "short_summaries": f"""WITH {CHUNKS}, {WINDOWS}, l AS (SELECT conversation_id, 'Said in ' || max(window_index) || '.' AS last FROM windows WHERE (conversation_id + window_index) % 3 = 0 GROUP BY 1),
t AS (SELECT conversation_id, list_aggregate(list_transform(range(1, least(6, conversation_id % 9 + 1) + 1), lambda x: 't' || x), 'string_agg', ', ') AS labels FROM (SELECT DISTINCT conversation_id FROM chunks) WHERE conversation_id % 4 <> 0)
SELECT conversation_id, CASE WHEN last IS NOT NULL AND labels IS NOT NULL THEN last || ' Topics: ' || labels || '.' WHEN last IS NOT NULL THEN last WHEN labels IS NOT NULL THEN 'Active topics: ' || labels || '.' ELSE '' END AS summary
FROM (SELECT DISTINCT conversation_id FROM windows) LEFT JOIN l USING (conversation_id) LEFT JOIN t USING (conversation_id)""",
    "space_totals": """WITH o AS (SELECT o_orderkey AS k, o_custkey % 50 AS user_id, o_custkey % 7 AS space_id, o_orderstatus AS s FROM orders),
n AS (SELECT user_id, space_id, count_if(k % 4 = 1) AS notes, count_if(k % 4 = 0 AND user_id % 3 > 0) AS tasks, count_if(k % 4 = 0 AND user_id % 3 > 0 AND s = 'F') AS done_tasks, count_if(k % 4 = 3) AS staged_notes,
  count_if(k % 4 = 2) AS staged_tasks, count_if(k % 4 = 2 AND s IN ('F', 'P')) AS done_staged_tasks FROM o GROUP BY 1, 2)
SELECT *, CAST(CASE WHEN tasks > 0 THEN round_even(100 * done_tasks / tasks, 0) WHEN staged_tasks > 0 THEN round_even(100 * done_staged_tasks / staged_tasks, 0) ELSE 0 END AS INTEGER) AS percent
FROM n WHERE notes + tasks + staged_notes + staged_tasks > 0""",
    "staged_jobs": """SELECT o_orderkey AS job_id, coalesce(CASE WHEN o_orderkey % 2 = 0 AND o_custkey % 2 = 0 THEN 'done' END, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END) AS status,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS note, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS user_id FROM orders WHERE o_orderkey % 3 > 0 OR o_orderkey % 2 = 0""",
}
QUERIES = [
    session_accounting, session_recovery, reclaimed_windows, transcription_requests, upload_errors, window_artifacts, result_items, preserved_items, reviewed_items, short_summaries, space_totals, staged_jobs,
]
