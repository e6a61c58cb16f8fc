"""Predicates, classes and accounting of transcript chunks, and what of a conversation can be windowed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlake.functions.text import any_of, text_or_empty

MAX_ATTEMPTS = 5
# Messages that say a chunk's audio can never be transcribed.
PERMANENT_CHUNK = ["audio duration exceeds", "exceeds the maximum limit", "failed to read the file", "audio format", "invalid audio", "file too large", "batch api", "unsupported audio content type"]
# The same for a speech provider's messages.
PERMANENT_AUDIO = [
    "audio format", "audio duration exceeds", "corrupt", "corrupted", "empty audio", "failed to read the file", "file is empty", "file too large",
    "invalid audio", "missing or empty", "no audio", "over 30 seconds", "unsupported file", "unsupported media", "unsupported audio", "unprocessable",
]
# Messages after which stored audio is worth another try.
RECOVERABLE = ["missing or empty", "no such file", "resources/audio_jobs"]
# HTTP statuses after which a call may be made again.
RETRYABLE = [408, 409, 425, 429, 500, 502, 503, 504]
# Which status may follow which.
TRANSITIONS = {
    "RECORDING": ["STOP_REQUESTED", "WAITING_FOR_TRANSCRIPTS", "FAILED"],
    "STOP_REQUESTED": ["WAITING_FOR_TRANSCRIPTS", "FINALIZING", "READY_FOR_PROCESSING", "PARTIAL", "RETRY_PENDING", "FAILED"],
    "WAITING_FOR_TRANSCRIPTS": ["FINALIZING", "READY_FOR_PROCESSING", "PROCESSING", "PARTIAL", "RETRY_PENDING", "FAILED"],
    "FINALIZING": ["WAITING_FOR_TRANSCRIPTS", "READY_FOR_PROCESSING", "PROCESSING", "PARTIAL", "COMPLETED", "FAILED"],
    "READY_FOR_PROCESSING": ["PROCESSING", "RETRY_PENDING", "FAILED"],
    "PROCESSING": ["VALIDATING", "FINALIZING", "RETRY_PENDING", "FAILED"],
    "VALIDATING": ["COMPLETED", "PARTIAL", "RETRY_PENDING", "FAILED"],
    "COMPLETED": [],
    "PARTIAL": ["PROCESSING", "RETRY_PENDING", "FAILED", "COMPLETED"],
    "RETRY_PENDING": ["WAITING_FOR_TRANSCRIPTS", "READY_FOR_PROCESSING", "PROCESSING", "FAILED"],
    "FAILED": ["RETRY_PENDING"],
}
STATUSES = list(TRANSITIONS)


def chunk_text(normalized: str | Column = "normalized_text", raw: str | Column = "raw_text") -> Column:
    """The normalised text if it isn't empty, else the raw one."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.coalesce(F.nullif(c(normalized), F.lit("")), c(raw), F.lit(""))


def is_useful(normalized: str | Column = "normalized_text", raw: str | Column = "raw_text") -> Column:
    return F.trim(F.regexp_replace(chunk_text(normalized, raw), r"(?U)\s+", " ")) != ""


def is_terminal_failure(error: Column, attempts: Column) -> Column:
    return any_of(error, PERMANENT_CHUNK) | (F.coalesce(attempts, F.lit(0)) >= MAX_ATTEMPTS)


def is_lost_job(status: Column, error: Column, attempts: Column, updated: Column, stale: Column) -> Column:
    """A transcription job that nobody works on any more. Only a failed one may be beyond saving."""
    over = (status == "failed") & is_terminal_failure(error, attempts)
    return F.when(status.isin("processing", "completed") | over, False).otherwise(updated.isNull() | (updated <= stale))


def should_publish_window(status: Column, queued: Column, updated: Column, stale: Column) -> Column:
    return F.when(status == "failed", True).when(status != "pending", False).otherwise(queued.isNull() | F.coalesce(updated <= stale, F.lit(False)))


def is_stale(status: Column, updated: Column, now: Column, seconds: int = 1800) -> Column:
    return (status == "PROCESSING") & (updated.isNull() | (F.unix_timestamp(now) - F.unix_timestamp(updated) > seconds))


def is_recoverable(provider: Column, error: Column) -> Column:
    return (F.lower(text_or_empty(provider)) == "s3") & any_of(error, RECOVERABLE)


def is_retryable_status(status: Column) -> Column:
    return F.coalesce(status.isin(RETRYABLE), F.lit(False))


def error_class(message: Column, status: Column | None = None) -> Column:
    """A speech provider's error, first match: permanent, auth, billing, rate_limit, else temporary. The status may stand in the text."""
    found = F.nullif(F.regexp_extract(text_or_empty(message), r"\bHTTP\s+(\d{3})\b", 1), F.lit("")).cast("int")
    code = F.coalesce(found if status is None else F.coalesce(status, found), F.lit(0))
    says = lambda *m: any_of(message, list(m))
    return (
        F.when(any_of(message, PERMANENT_AUDIO) | code.isin(413, 415, 422), "permanent")
        .when(code.isin(401, 403) | says("unauthorized", "forbidden"), "auth")
        .when((code == 402) | says("billing", "payment", "credit"), "billing")
        .when((code == 429) | says("rate limit", "too many requests"), "rate_limit")
        .otherwise("temporary")
    )


def is_valid_transition(current: Column, target: Column) -> Column:
    ok = current == target
    for status, following in TRANSITIONS.items():
        if following:
            ok = ok | ((current == status) & target.isin(following))
    return ok


def invalid_transitions(changes: DataFrame, key: str, order: list[str], status: str = "status") -> DataFrame:
    """Each change of status with the one before it (first: RECORDING), and whether it is allowed."""
    before = F.coalesce(F.lag(status).over(Window.partitionBy(key).orderBy(*order)), F.lit("RECORDING"))
    return changes.withColumn("previous", before).withColumn("valid", is_valid_transition(F.col("previous"), F.col(status)))


def classified(chunks: DataFrame) -> DataFrame:
    """chunks with useful, terminal and skippable (excluded, completed but empty, or failed for good)."""
    useful, done = is_useful(), F.col("stt_status") == "completed"
    terminal = (F.col("stt_status") == "failed") & is_terminal_failure(F.col("last_error"), F.col("stt_attempts"))
    return chunks.withColumn("useful", done & useful).withColumn("terminal", terminal).withColumn("skippable", (done & ~useful) | (F.coalesce("exclusion_reason", F.lit("")) != "") | terminal)


def reachable(chunks: DataFrame, key: str = "conversation_id", gaps_are_terminal: bool = False) -> DataFrame:
    """Each conversation's chunks from its first up to the first hole: a chunk that is neither completed nor skippable, or a missing
    sequence number (unless these are given up)."""
    by = Window.partitionBy(key).orderBy("sequence_number")
    hole = ~((F.col("stt_status") == "completed") | F.col("skippable"))
    if not gaps_are_terminal:
        hole = hole | F.coalesce(F.col("sequence_number") - F.lag("sequence_number").over(by) > 1, F.lit(False))
    rows = classified(chunks).withColumn("__hole", hole.cast("int"))
    return rows.withColumn("__hole", F.max("__hole").over(by)).where("__hole = 0").drop("__hole")


def missing_sequences(chunks: DataFrame, key: str = "conversation_id") -> DataFrame:
    """(key, sequence_number) of the numbers 0 .. expected_last that no chunk has. Holes are read off neighbouring chunks, so nothing
    but the holes themselves is spelt out."""
    by = Window.partitionBy(key).orderBy("sequence_number")
    own = chunks.select(key, "sequence_number", "expected_last").distinct()
    own = own.withColumn("low", F.coalesce(F.lag("sequence_number").over(by), F.lit(-1)) + 1).withColumn("next", F.lead("sequence_number").over(by))
    inner = own.where("sequence_number > low").select(key, "low", (F.col("sequence_number") - 1).alias("high"))
    tail = own.where("next is null and expected_last > sequence_number").select(key, (F.col("sequence_number") + 1).alias("low"), F.col("expected_last").alias("high"))
    return inner.unionByName(tail).select(key, F.explode(F.sequence("low", "high")).alias("sequence_number"))


def hole_ranges(chunks: DataFrame, key: str = "conversation_id", conversations: DataFrame | None = None) -> DataFrame:
    """(key, kind, low, high): the stretches of numbers that windows go over, as ranges, which are never spelt out.

    sequence_missing: numbers 0 .. expected_last without a chunk, all of them where a conversation (key, expected_last) has no chunk
    at all. stt_failed: neighbouring chunks that failed for good. empty_transcript: what can be skipped before the first useful chunk,
    from 0 on without a gap. Of chunks with one number the first kind counts that any of them has.
    """
    rows = classified(chunks)
    flag = lambda c: F.max(F.coalesce(c, F.lit(False)).cast("int"))
    rows = rows.groupBy(key, F.col("sequence_number").cast("long").alias("n")).agg(flag(F.col("terminal")).alias("failed"), flag(F.col("useful")).alias("useful"), flag(F.col("skippable")).alias("skippable"), F.max("expected_last").cast("long").alias("last"))
    by = Window.partitionBy(key).orderBy("n")
    before, after = F.coalesce(F.lag("n").over(by), F.lit(-1)), F.lead("n").over(by)
    rows = rows.withColumn("before", before).withColumn("after", after)
    gap = lambda low, high, when: rows.where(when).select(key, F.lit("sequence_missing").alias("kind"), low.alias("low"), high.alias("high"))
    out = gap(F.col("before") + 1, F.col("n") - 1, F.col("n") > F.col("before") + 1)
    out = out.unionByName(gap(F.col("n") + 1, F.col("last"), F.col("after").isNull() & (F.col("last") > F.col("n"))))
    if conversations is not None:
        none = conversations.where("expected_last >= 0").join(chunks.select(key).distinct(), key, "left_anti")
        out = out.unionByName(none.select(key, F.lit("sequence_missing").alias("kind"), F.lit(0).cast("long").alias("low"), F.col("expected_last").cast("long").alias("high")))
    # islands: numbers less their rank are equal along a stretch
    failed = rows.where("failed = 1").withColumn("island", F.col("n") - F.row_number().over(by)).groupBy(key, "island").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    out = out.unionByName(failed.select(key, F.lit("stt_failed").alias("kind"), "low", "high"))
    stop = (F.col("useful") == 1) | (F.col("skippable") == 0) | (F.col("n") != F.col("before") + 1)
    open_ = F.max(stop.cast("int")).over(by)
    leading = rows.withColumn("open", open_).where("open = 0").groupBy(key).agg(F.min("n").alias("low"), F.max("n").alias("high"))
    return out.unionByName(leading.select(key, F.lit("empty_transcript").alias("kind"), "low", "high"))


def accounting(chunks: DataFrame, key: str = "conversation_id", missing_timeout: Column | None = None) -> DataFrame:
    """One row for each conversation: what became of all the chunks it expects."""
    timeout = F.lit(False) if missing_timeout is None else missing_timeout
    c = classified(chunks)
    n = lambda cond: F.count_if(cond)
    status = F.col("stt_status")
    windowed = F.col("processing_window_id").isNotNull()
    excluded = F.coalesce("exclusion_reason", F.lit("")) != ""
    out = c.groupBy(key).agg(
        (F.max("expected_last") + 1).alias("expected_sequences"),
        F.count_distinct("sequence_number").alias("present"),
        n((status == "completed") & ~F.col("useful")).alias("empty_transcripts"),
        n(status == "failed").alias("failed_transcripts"),
        n(status.isin("pending", "processing")).alias("pending_transcripts"),
        n("useful").alias("valid_transcripts"),
        n(F.col("useful") & windowed).alias("valid_windowed"),
        n(F.col("useful") & excluded).alias("valid_excluded"),
        n(F.col("useful") & ~windowed & ~excluded).alias("valid_unwindowed"),
        n("terminal").alias("terminal_failed"),
        F.max(timeout.cast("int")).alias("given_up"),
    )
    missing = F.col("expected_sequences") - F.col("present")
    lost, open_ = F.col("given_up") * missing, (1 - F.col("given_up")) * missing
    out = out.withColumn("missing", missing).withColumn("accounted_sequences", F.col("present") + lost)
    out = out.withColumn("unresolved_expected", F.col("pending_transcripts") + F.col("failed_transcripts") - F.col("terminal_failed") + open_)
    return out.withColumn("permanent_failures", F.col("terminal_failed") + lost).withColumn("unresolved", F.col("unresolved_expected") > 0).drop("given_up")


def window_counts(windows: DataFrame, key: str = "conversation_id") -> DataFrame:
    one = lambda s: F.count_if(F.col("status") == s).alias(f"windows_{s}")
    return windows.groupBy(key).agg(F.count("*").alias("windows_created"), *map(one, ("completed", "pending", "processing", "failed")), F.count_if(F.col("status") != "completed").alias("incomplete_windows"))


def inactive(conversations: DataFrame, cutoff: Column, limit: int = 100) -> DataFrame:
    """Recordings that nothing has come in for since the cutoff, oldest first."""
    return conversations.where((F.col("status") == "RECORDING") & (F.col("last_activity_at") <= cutoff) & (F.col("received") > 0)).orderBy("last_activity_at", "conversation_id").limit(limit)
