"""Queries over single rules (contents, fingerprints, windows, deliveries, snapshots, reports) and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlake.functions import routing, text
from convlake.functions.text import ACTION_VERBS
from convlake.operators import chunks as chunk_ops
from convlake.operators import artifacts as art
from convlake.operators import merge, retrieval
from convlake.oracle import ARTIFACTS, CHUNKS, ENVELOPES, PARTS, among, jaccard, squash, tokens
from convlake.plans import workspace
from convlake.session_queries import NOW, SESSIONS, STALE, WINDOWS, at, sessions, windows
from convlake.sources import tables as src
from convlake.streaming import events


def _beside(spark: SparkSession, d: str) -> DataFrame:
    """Each artifact with the next one."""
    a = src.artifacts(spark, d)
    other = a.select((F.col("id") - 1).alias("id"), F.col("title").alias("other"), F.col("content").alias("more"))
    return a.withColumn("content", F.when(F.col("id") % 6 == 0, "").otherwise(F.col("content"))).join(other, "id")


def content_rules(spark: SparkSession, d: str) -> DataFrame:
    span = text.evidence_range(F.array(F.struct("sequence_start", "sequence_end"), F.struct((F.col("id") % 20).cast("int").alias("sequence_start"), F.lit(25).cast("long").alias("sequence_end"))))
    due = F.lit("friday")
    return _beside(spark, d).select(
        "id", text.task_status(F.col("operation"), F.col("id") % 7 == 0).alias("task_status"), text.lifecycle(F.col("operation")).alias("lifecycle"), F.round(text.object_jaccard("title", "other"), 6).alias("objects"),
        text.richer("content", "more").alias("richer"), span.alias("span"), text.task_fingerprint(F.lit("s1"), F.col("title"), F.col("content"), F.col("owner"), due, span).alias("task_fingerprint"),
        text.note_fingerprint(F.lit("s1"), F.col("title"), F.col("content"), span).alias("note_fingerprint"), text.line_sequence(F.concat(F.lit("["), F.col("id").cast("string"), F.lit("] "), "title")).alias("line"),
        text.line_sequence("title").alias("no_line"), F.size(text.sentences(F.concat("title", F.lit(". "), "owner", F.lit("?\n"), "content"))).alias("sentences"),
    )


def evidence_merges(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    one = lambda n: F.struct((i % 10 + n).cast("int").alias("sequence_start"), (i % 10 + n + 1).cast("int").alias("sequence_end"), F.col("title").alias("text"))
    merged = text.merge_evidence(F.array(*[one(n) for n in range(6)]), F.array(*[one(n) for n in range(3, 10)]))
    history = text.ring(F.transform(F.sequence(F.lit(1), (i % 12 + 1).cast("int")), lambda k: F.concat(F.lit("h"), k.cast("string"))), F.lit("new"))
    return src.artifacts(spark, d).select("id", F.array_join(F.transform(merged, lambda e: e.sequence_start.cast("string")), ",").alias("starts"), F.array_join(history, ",").alias("history"))


def window_rules(spark: SparkSession, d: str) -> DataFrame:
    w = windows(spark, d).withColumn("queued_at", F.when(F.col("window_index") % 2 == 0, F.col("queued_at")))
    publish = chunk_ops.should_publish_window(F.col("status"), F.col("queued_at"), F.col("updated_at"), at(STALE))
    return w.select("conversation_id", "window_index", publish.alias("publish"), chunk_ops.is_stale(F.upper("status"), F.col("updated_at"), at(NOW)).alias("stale"))


def inactive_recordings(spark: SparkSession, d: str) -> DataFrame:
    s = sessions(spark, d).withColumnRenamed("updated_at", "last_activity_at")
    return chunk_ops.inactive(s, at(STALE)).select("conversation_id", "received")


def delivery_rules(spark: SparkSession, d: str) -> DataFrame:
    """Events by what becomes of their delivery: due again, not acknowledged in time, or too late for their conversation."""
    e = src.envelopes(spark, d)
    failed = events.after_failure(events.parsed(e))
    now = F.lit("2024-01-15").cast("timestamp")
    again = events.due(failed, now).select(F.col("causation_id").alias("event_id"), F.lit("due").alias("rule"), F.col("event_id").alias("detail"))
    idle = events.unacknowledged(e, e.where("event_id % 3 = 0"), now).select("event_id", F.lit("unacknowledged").alias("rule"), F.lit(None).cast("string").alias("detail"))
    states = e.select((F.col("event_id") % 40).alias("conversation_id")).distinct().withColumn("status", F.when(F.col("conversation_id") % 4 == 0, "COMPLETED").when(F.col("conversation_id") % 4 == 1, "PROCESSING").otherwise("PARTIAL"))
    late = events.late(e.withColumn("conversation_id", F.col("event_id") % 50), states).where("not propagate").select("event_id", F.lit("late").alias("rule"), F.lit(None).cast("string").alias("detail"))
    return again.unionByName(idle).unionByName(late)


def snapshot_rules(spark: SparkSession, d: str) -> DataFrame:
    o = src.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    o = merge.update_where(o, F.col("o_totalprice") > 100_000, {"o_orderstatus": F.lit("X"), "o_totalprice": F.lit(100_000.0)})
    o = merge.with_expiry(o, "o_orderdate", 45)
    return merge.unexpired(o, F.lit("1996-03-01").cast("timestamp_ntz")).select("o_orderkey", "o_orderstatus", "o_totalprice", F.date_format("expires_at", "yyyy-MM-dd").alias("expires"))


def workspace_reports(spark: SparkSession, d: str) -> DataFrame:
    o = src.table(spark, d, "orders").select(F.lit("u").alias("user_id"), (F.col("o_custkey") % 5).cast("string").alias("space_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("updated_at"))
    o = o.withColumn("updated_at", F.expr("updated_at + make_dt_interval(0, 0, 0, id / 1000000D)"))
    found = workspace.reports({"tasks": o, "notes": o.where("id % 2 = 0"), "other": o}, "u", "3", ["tasks", "notes", "nothing"], 15)
    parts = [df.select(F.lit(n).alias("report"), "id", workspace.is_on(F.col("updated_at"), F.lit("1998-08-01").cast("date")).alias("today"), workspace.may_continue((F.col("id") % 120).cast("int")).alias("may_continue")) for n, df in found.items()]
    return parts[0].unionByName(parts[1])


def vector_points(spark: SparkSession, d: str) -> DataFrame:
    """Points of all documents, put over older ones of every second document: none is there twice."""
    t = src.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("job_id"), F.lit(" u1 ").alias("user_id"), F.lit("s").alias("space_id"), "text")
    old = retrieval.vector_points(t.where("job_id % 2 = 0").withColumn("text", F.lit("old")))
    both = merge.upsert(old.withColumn("at", F.lit(1)), retrieval.vector_points(t).withColumn("at", F.lit(2)), ["id"], ["at"])
    return both.select("id", "job_id", "user_id", "chunk_index", F.md5(F.col("text").cast("binary")).alias("md5"), "at")


def compact_artifacts(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    a = src.artifacts(spark, d).withColumn("content", F.repeat("content", 20)).withColumn("windows", F.sequence(F.lit(1), (i % 12 + 1).cast("int"))).withColumn("due_text", F.when(i % 3 == 0, "")).withColumn("due_date", F.lit("2024-01-02"))
    return art.compact(a).select("id", F.length("content").alias("length"), F.size("windows").alias("windows"), "due_text")


def small_rules(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    limit = routing.input_token_limit(F.when(k % 3 > 0, "groq").otherwise("other"), (k % 40 * 500).cast("long"), (k % 7 * 1000).cast("long"), F.lit(9000).cast("long"))
    o = src.table(spark, d, "orders")
    return o.select(k, limit.alias("token_limit"), workspace.date_text(F.when(k % 2 == 0, F.col("o_orderdate")), F.when(k % 5 > 0, F.when(k % 5 > 1, F.col("o_orderpriority")).otherwise(""))).alias("date_text"))


def objects(x: str) -> str:
    return f"list_filter({tokens(x)}, lambda w: w NOT IN {among(ACTION_VERBS)})"


FALLBACK = "CASE WHEN length({0}) = 0 OR length({1}) = 0 THEN 0.0 ELSE {2} END"
OPERATION = "CASE WHEN id % 17 = 0 THEN 'COMPLETE' WHEN id % 13 = 0 THEN 'UPDATE' END"
SQL: dict[str, str] = {
    "content_rules": f"""WITH {ARTIFACTS}, b AS (SELECT a.id, a.title, CASE WHEN a.id % 6 = 0 THEN '' ELSE a.content END AS content, a.owner, a.sequence_start AS s, a.sequence_end AS e, n.title AS other, n.content AS more
  FROM a JOIN a n ON n.id = a.id + 1), c AS (SELECT *, least(s, id % 20) || ':' || greatest(e, 25) AS span, {OPERATION} AS op, {objects('title')} AS x, {objects('other')} AS y FROM b)
SELECT id, CASE WHEN id % 7 = 0 THEN 'needs_confirmation' WHEN op = 'COMPLETE' THEN 'completed' ELSE 'pending' END AS task_status, CASE op WHEN 'COMPLETE' THEN 'completed' WHEN 'UPDATE' THEN 'active' ELSE 'provisional' END AS lifecycle,
  round({FALLBACK.format('x', 'y', jaccard('x', 'y'))}, 6) AS objects, CASE WHEN content = '' OR length(more) >= length(content) OR len(list_filter({tokens('more')}, lambda w: NOT list_contains({tokens('content')}, w))) > 0 THEN more ELSE content END AS richer, span,
  sha256('s1|' || lower({squash('title')}) || '|' || lower({squash('content')}) || '|' || lower({squash('owner')}) || '|friday|' || span) AS task_fingerprint,
  sha256('s1|' || lower({squash('title')}) || '|' || lower({squash('content')}) || '|' || span) AS note_fingerprint, CAST(id AS INTEGER) AS line, 0 AS no_line, CASE WHEN content = '' THEN 2 ELSE 3 END AS sentences FROM c""",
    "evidence_merges": f"""WITH {ARTIFACTS} SELECT id, list_aggregate(list_transform(range(0, 8), lambda n: CAST(id % 10 + n AS VARCHAR)), 'string_agg', ',') AS starts,
  list_aggregate(list_concat(list_transform(range(greatest(1, id % 12 + 1 - 6), id % 12 + 2), lambda k: 'h' || k), ['new']), 'string_agg', ',') AS history FROM a""",
    "window_rules": f"""WITH {CHUNKS}, {WINDOWS} SELECT conversation_id, window_index, CASE status WHEN 'failed' THEN TRUE WHEN 'pending' THEN window_index % 2 = 1 OR updated_at <= {STALE} ELSE FALSE END AS publish,
  status = 'processing' AND {NOW} - updated_at > 1800 AS stale FROM windows""",
    "inactive_recordings": f"WITH {SESSIONS} SELECT conversation_id, received FROM sessions WHERE status = 'RECORDING' AND updated_at <= {STALE} AND received > 0 ORDER BY updated_at, conversation_id LIMIT 100",
    "delivery_rules": f"""WITH {ENVELOPES} SELECT event_id, 'due' AS rule, sha1(event_id || ':' || (attempt + 1)) AS detail FROM e WHERE readable AND retryable AND attempt < 5
  AND epoch(date_trunc('second', created_at)) + CAST(least(300, power(2, attempt)) AS BIGINT) <= epoch(TIMESTAMP '2024-01-15')
UNION ALL SELECT event_id, 'unacknowledged', NULL FROM e WHERE event_id % 3 <> 0 AND epoch(TIMESTAMP '2024-01-15') - epoch(date_trunc('second', created_at)) >= 60
UNION ALL SELECT event_id, 'late', NULL FROM e WHERE event_id % 50 < 40 AND event_id % 50 % 4 <> 1""",
    "snapshot_rules": """SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, least(o_totalprice, 100000.0) AS o_totalprice, strftime(o_orderdate + INTERVAL 45 DAY, '%Y-%m-%d') AS expires
FROM orders WHERE o_orderdate + INTERVAL 45 DAY > TIMESTAMP '1996-03-01'""",
    "workspace_reports": """WITH o AS (SELECT o_orderkey AS id, o_orderdate AS placed FROM orders WHERE o_custkey % 5 = 3), r AS (SELECT 'tasks' AS report, * FROM (SELECT * FROM o ORDER BY placed DESC, id DESC LIMIT 15)
  UNION ALL SELECT 'notes', * FROM (SELECT * FROM o WHERE id % 2 = 0 ORDER BY placed DESC, id DESC LIMIT 15))
SELECT report, id, CAST(placed AS DATE) = DATE '1998-08-01' AS today, id % 120 + 2 <= 100 AS may_continue FROM r""",
}
SQL |= {
    "vector_points": f"""WITH p AS (SELECT CAST(doc_id AS VARCHAR) AS job_id, {PARTS} AS ps FROM documents), n AS (SELECT job_id, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS i, unnest(ps) AS t, 2 AS "at" FROM p),
b AS (SELECT * FROM n UNION ALL SELECT job_id, 0, 'old', 1 FROM p WHERE CAST(job_id AS BIGINT) % 2 = 0 AND len(ps) = 0)
SELECT left(sha1(job_id || ':' || i), 24) AS id, job_id, 'u1' AS user_id, i AS chunk_index, md5(t) AS md5, "at" FROM b""",
    "compact_artifacts": f"WITH {ARTIFACTS} SELECT id, least(240, 20 * length(content)) AS length, least(8, id % 12 + 1) AS windows, '2024-01-02' AS due_text FROM a",
    "small_rules": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN greatest(1000, o_orderkey % 40 * 500 - greatest(512, least(o_orderkey % 7 * 1000, o_orderkey % 40 * 500 // 2)) - 500) ELSE 9000 END AS token_limit,
  CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 5 > 1 THEN o_orderpriority ELSE 'unknown date' END AS date_text FROM orders""",
}
QUERIES = [vector_points, compact_artifacts, small_rules, content_rules, evidence_merges, window_rules, inactive_recordings, delivery_rules, snapshot_rules, workspace_reports]

