"""Tables of the engine, read from Parquet, and views that give the conversation tables from the driver's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlake.session import ready


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder; Spark reads it, so any store will do."""
    return ready(spark).read.parquet(f"{folder}/{name}.parquet")


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Transcript chunks from `conversations`: some numbers missing, some silent, some failed or pending, by fixed rules."""
    c = table(spark, folder, "conversations").select(F.col("conv_id").alias("conversation_id"), F.col("turn").cast("int").alias("sequence_number"), "role", "text")
    last = c.groupBy("conversation_id").agg(F.max("sequence_number").alias("expected_last"))
    i, n = F.col("conversation_id"), F.col("sequence_number")
    status = (i * 3 + n * 5) % 17
    out = c.where(~(((i * 31 + n * 7) % 13 == 5) & (n > 0))).join(last, "conversation_id")
    return out.select(
        "conversation_id", "sequence_number", "expected_last", "role",
        F.concat_ws("_", F.lit("chunk"), "sequence_number").alias("chunk_id"),
        F.when((i + n) % 5 == 3, "").otherwise(F.col("text")).alias("raw_text"),
        F.lit(None).cast("string").alias("normalized_text"),
        F.when(status == 0, "failed").when(status == 1, "pending").when(status == 2, "processing").otherwise("completed").alias("stt_status"),
        ((i + n) % 7).cast("int").alias("stt_attempts"),
        F.when(status == 0, F.when(n % 2 == 0, "Invalid audio: HTTP 415").otherwise("HTTP 503 try again")).alias("last_error"),
        F.lit(30_000).cast("long").alias("duration_ms"),
        F.when((i + n) % 11 == 4, "empty_transcript").alias("exclusion_reason"),
        F.when((i * 5 + n) % 3 > 0, F.concat_ws("_", F.lit("win"), (n / 2).cast("int"))).alias("processing_window_id"),
    )


def artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """Artifacts from `part`: a hundred parts' names a conversation, their kinds by key."""
    p = table(spark, folder, "part")
    kinds = F.array(*map(F.lit, ["task", "note", "decision", "risk", "question", "task", "fact", "follow_up", "blocker", "idea"]))
    k = F.col("p_partkey")
    return p.select(
        F.floor(k / 100).alias("conversation_id"), k.alias("id"), k.alias("position"), F.get(kinds, (k % 10).cast("int")).alias("artifact_type"), F.col("p_name").alias("title"), F.col("p_type").alias("content"),
        F.col("p_brand").alias("owner"), F.when(k % 17 == 0, "COMPLETE").when(k % 13 == 0, "UPDATE").alias("operation"), F.when(k % 19 == 0, "rejected").otherwise("provisional").alias("status"),
        (k % 100 / 20).cast("int").alias("window_index"), F.col("p_size").alias("sequence_start"), (F.col("p_size") + k % 3).alias("sequence_end"), F.lower("p_brand").alias("topic"),
    )


def words(spark: SparkSession, folder: str) -> DataFrame:
    """Transcribed words from `conversations`, with confidences and speakers by place."""
    c = table(spark, folder, "conversations").select("conv_id", "turn", F.posexplode(F.filter(F.split("text", " "), lambda w: w != "")).alias("pos", "word"))
    return c.withColumn("confidence", (F.col("conv_id") * 7 + F.col("turn") * 11 + F.col("pos") * 13) % 100 / 100).withColumn("speaker", (F.col("conv_id") + F.floor(F.col("pos") / 5)) % 3)


def doc_lines(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    return d.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("sequence_number", "text"))


# Event types that are routed, and the stream each goes to.
ROUTES = {
    "audio.ingested": "audio",
    "speech.transcribe.requested": "speech",
    "stt.requested": "stt",
    "conversation.transcript.ready": "transcripts",
    "conversation.window.extraction.requested": "windows",
    "conversation.finalization.requested": "finalization",
    "conversation.processing.requested": "processing",
    "job.retry.requested": "retries",
}


def envelopes(spark: SparkSession, folder: str) -> DataFrame:
    """Event envelopes from `events`: a routed or an unknown type, attempts and duplicates by id."""
    e = table(spark, folder, "events")
    kinds = F.array(*map(F.lit, [*ROUTES, "unknown.type"]))
    i = F.col("event_id")
    return e.select(
        "event_id", F.concat_ws("-", F.lit("evt"), F.floor(i / 3)).alias("idempotency_key"), F.get(kinds, (i % 9).cast("int")).alias("event_type"), (i % 7).cast("int").alias("attempt"),
        F.col("ts").cast("timestamp").alias("created_at"), F.col("user_id"), F.when(i % 23 == 0, F.lit("{broken")).otherwise(F.col("props")).alias("payload"), (i % 5 != 0).alias("retryable"), "value",
    )
