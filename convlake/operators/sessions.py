"""Recording sessions: full accounting, recovery of what hangs, admission of uploads, and artifacts given back as results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlake.functions.text import resolver_text, strip, text_or_empty
from convlake.operators.artifacts import HIDDEN
from convlake.operators.chunks import accounting, is_lost_job, is_recoverable, is_terminal_failure, window_counts

# Statuses of conversations that have stopped and aren't finalized, and the one that only waits for processing.
UNFINALIZED = ["STOP_REQUESTED", "WAITING_FOR_TRANSCRIPTS", "FINALIZING", "READY_FOR_PROCESSING"]
READY = "READY_FOR_PROCESSING"
# Seconds after which missing sequences are given up, longest chunk in milliseconds, largest upload in bytes.
MISSING_TIMEOUT, LONGEST_MS, LARGEST_BYTES = 900, 30_000, 25 * 1024 * 1024
# Kinds of artifacts that are given back as tasks, decisions and issues; all others are notes.
TASKS, DECISIONS, ISSUES = ["task", "follow_up", "commitment", "deadline"], ["decision"], ["question", "risk", "blocker"]
# The accounting's measures that are shown to users.
PUBLIC = [
    "expected_sequences", "accounted_sequences", "empty_transcripts", "failed_transcripts", "valid_transcripts", "valid_windowed", "valid_unwindowed", "windows_created", "windows_completed",
    "windows_pending", "windows_processing", "windows_failed", "unresolved_expected",
]


def seconds_since(at: Column, now: Column) -> Column:
    return F.unix_timestamp(now) - F.unix_timestamp(at)


# --- accounting


def gaps_are_terminal(stopped: Column, now: Column, timeout: int = MISSING_TIMEOUT) -> Column:
    """Are missing sequences given up? From `timeout` seconds after the recording stopped on."""
    return F.coalesce(seconds_since(stopped, now) >= timeout, F.lit(False))


def full_accounting(chunks: DataFrame, windows: DataFrame, sessions: DataFrame, now: Column, key: str = "conversation_id") -> DataFrame:
    """One row for each session: the fate of its chunks, its windows by status, incomplete ones and gaps in what was saved.

    sessions: key, stopped_at; windows: key, status, artifacts_saved. Sessions without chunks or windows have zeros for them.
    """
    timed = chunks.join(sessions.select(key, gaps_are_terminal(F.col("stopped_at"), now).alias("__late")), key, "left")
    own = accounting(timed, key, F.coalesce("__late", F.lit(False)))
    gaps = windows.groupBy(key).agg(F.count_if((F.col("status") == "completed") & (F.col("artifacts_saved") == False)).alias("artifact_persistence_gaps"))  # noqa: E712  null isn't a gap
    out = own.join(window_counts(windows, key), key, "left").join(gaps, key, "left")
    counted = [c for c in out.columns if c.startswith("windows_") or c in ("incomplete_windows", "artifact_persistence_gaps")]
    return out.fillna(0, counted)


def public_accounting(rows: DataFrame, key: str = "conversation_id") -> DataFrame:
    return rows.select(key, *PUBLIC)


def window_artifacts(windows: DataFrame, artifacts: DataFrame, key: str = "conversation_id") -> DataFrame:
    """How many artifacts each window has: those that name it as their source or among their sources. Each counts once for a window."""
    named = F.array_distinct(F.array_compact(F.concat(F.array("window_index"), F.coalesce("windows", F.array().cast("array<int>")))))
    each = artifacts.select(key, F.explode(named).alias("window_index")).groupBy(key, "window_index").agg(F.count("*").alias("artifacts"))
    return windows.join(each, [key, "window_index"], "left").fillna(0, ["artifacts"])


# --- recovery


def stale_unfinalized(sessions: DataFrame, cutoff: Column) -> DataFrame:
    """Sessions that stopped, have audio and a last sequence, and haven't moved since the cutoff."""
    return sessions.where(F.col("status").isin(UNFINALIZED) & F.col("expected_last").isNotNull() & (F.col("updated_at") <= cutoff) & (F.col("received") > 0))


def recovery_events(sessions: DataFrame, cutoff: Column) -> DataFrame:
    """The event that takes each stale session on: to processing where that is all it waits for, else to finalization."""
    waits = F.col("status") == READY
    out = stale_unfinalized(sessions, cutoff).withColumn("event_type", F.when(waits, "conversation.processing.requested").otherwise("conversation.finalization.requested"))
    return out.select("conversation_id", "event_type", F.when(waits, "stale-processing-recovery").otherwise("stale-finalization-recovery").alias("source"), "expected_last")


def reclaimed(rows: DataFrame, status: str, stale: Column, now: Column, note: str, queued: str | None = None) -> DataFrame:
    """All rows; those that have been processing since before `stale` are pending again, with a note, and no longer queued."""
    old = F.coalesce((F.col(status) == "processing") & (F.col("updated_at") <= stale), F.lit(False))
    out = rows.withColumn("reclaimed", old)
    changes = {status: F.lit("pending"), "last_error": F.lit(note), "updated_at": now} | ({queued: F.lit(None)} if queued else {})
    return out.select(*[F.when(F.col("reclaimed"), v).otherwise(F.col(c)).alias(c) if (v := changes.get(c)) is not None else F.col(c) for c in out.columns])


def transcription_requests(chunks: DataFrame, audio: DataFrame, stale: Column, now: Column, key: str = "conversation_id", s3: bool = False) -> DataFrame:
    """New requests for chunks whose transcription was lost, with what the audio store knows of them (key, sequence_number, filename,
    content_type, provider, bucket, object_key, file_path).

    Stuck chunks are pending again first. A permanently bad recording isn't asked for; a failed one that had its attempts only if its
    audio is in object storage and the error may pass; nor is a chunk that has neither a file nor stored audio.
    """
    rows = reclaimed(chunks, "stt_status", stale, now, "stale STT processing reclaimed")
    lost = F.col("reclaimed") | is_lost_job(F.col("stt_status"), F.col("last_error"), F.col("stt_attempts"), F.col("updated_at"), stale)
    failed = F.col("stt_status") == "failed"
    own = audio.withColumn("stored", F.lit(True))
    both = rows.join(own, [key, "sequence_number"], "left")
    in_s3 = F.coalesce((F.lower(text_or_empty("provider")) == "s3") | F.col("bucket").isNotNull() | F.col("object_key").isNotNull(), F.lit(False)) | F.lit(s3)
    spent = failed & is_terminal_failure(F.lit(None).cast("string"), F.col("stt_attempts"))
    bad = failed & is_terminal_failure(F.col("last_error"), F.lit(0))
    again = is_recoverable(F.when(in_s3, F.lit("s3")), F.col("last_error"))
    asked = both.where(lost & ~bad & (~spent | again) & (F.col("audio_file_path").isNotNull() | F.col("stored").isNotNull()))
    return asked.select(
        key, "sequence_number", "chunk_id",
        F.coalesce(F.nullif("filename", F.lit("")), F.concat("chunk_id", F.lit(".audio"))).alias("filename"),
        F.coalesce(F.nullif("content_type", F.lit("")), F.lit("audio/wav")).alias("content_type"),
        F.when(in_s3, "s3").alias("storage_provider"), F.when(in_s3, F.col("bucket")).alias("bucket"), F.when(in_s3, F.col("object_key")).alias("object_key"),
        F.when(~in_s3, F.coalesce(F.nullif("file_path", F.lit("")), "audio_file_path")).alias("file_path"),
    )


# --- admission


def upload_error(status: Column, expected_last: Column, sequence: Column, duration_ms: Column, content_type: Column, extension: Column, size: Column, allowed: list[str]) -> Column:
    """Why a chunk isn't taken, the first reason; null if it is: closed input, too long, its type, its extension, its size."""
    kind = F.lower(strip(F.substring_index(text_or_empty(content_type), ";", 1)))
    ending = F.regexp_replace(F.regexp_replace(F.lower(strip(extension)), r"^\.+", ""), "[^a-z0-9]+", "")
    return (
        F.when((status != "RECORDING") & (sequence > expected_last), "closed")
        .when(duration_ms > LONGEST_MS, "too_long")
        .when(kind == "", "no_content_type")
        .when((ending == "") | (F.length(ending) > 16), "bad_extension")
        .when(~kind.isin(allowed), "unsupported_content_type")
        .when(size <= 0, "empty")
        .when(size > LARGEST_BYTES, "too_large")
    )


# --- results


def task_operation() -> Column:
    """What is to be done with an artifact's task: its own operation, else by its status, its resolution, and doubt."""
    return (
        F.coalesce(
            F.nullif("operation", F.lit("")),
            F.when(F.col("status") == "completed", "COMPLETE").when(F.col("status") == "rejected", "CANCEL").when(F.col("resolution") == "UPDATE", "UPDATE"),
            F.when(F.coalesce("needs_confirmation", F.lit(False)), "NEEDS_CONFIRMATION"),
            F.lit("CREATE"),
        )
    )


def results_of(artifacts: DataFrame) -> DataFrame:
    """Artifacts as items of a result (section, id, title, body, status or kind, operation), in order of `position`.

    Hidden artifacts give nothing, and only those with evidence are items; facts and questions stand in their own lists besides,
    evidence or not. artifacts: conversation_id, id, position, artifact_type, title, content, status, resolution, operation,
    needs_confirmation, evidence.
    """
    own = artifacts.where(~F.coalesce(F.col("status").isin(HIDDEN), F.lit(False)))
    kind = F.col("artifact_type")
    section = F.when(kind.isin(TASKS), "tasks").when(kind.isin(DECISIONS), "decisions").when(kind.isin(ISSUES), "issues").otherwise("notes")
    filled = F.coalesce(F.nullif("content", F.lit("")), "title")
    state = F.when(section == "decisions", F.when((F.col("status") == "provisional") & ~F.coalesce(F.col("resolution") == "CONTRADICTION", F.lit(False)), "proposal").otherwise("confirmed_decision"))
    state = F.coalesce(state, F.when(section == "issues", F.when(kind.isin("blocker", "risk"), kind).otherwise("open_question")))
    items = own.where(F.size("evidence") > 0).select(
        "conversation_id", section.alias("section"), "id", "position", "title", F.when(section.isin("tasks", "notes"), filled).alias("body"), state.alias("state"), F.when(section == "tasks", task_operation()).alias("operation")
    )
    listed = own.where(kind == "fact").withColumn("section", F.lit("facts")).withColumn("said", filled)
    listed = listed.unionByName(own.where(kind == "question").withColumn("section", F.lit("questions")).withColumn("said", F.col("title")))
    none = F.lit(None).cast("string")
    return items.unionByName(listed.select("conversation_id", "section", "id", "position", F.col("said").alias("title"), none.alias("body"), none.alias("state"), none.alias("operation")))


def preserve_unrepresented(final: DataFrame, carried: DataFrame, key: str = "conversation_id") -> DataFrame:
    """A final result's items (key, section, position, title) and, after them, the carried ones whose title no item of their section
    has yet; of carried ones with one title the first. Titles compare as resolver text, listed facts and questions by their own text."""
    listed = F.col("section").isin("facts", "questions")
    same = F.when(listed, F.lower(strip("title"))).otherwise(resolver_text("title"))
    columns = [key, "section", "position", "title"]
    rows = final.select(*columns, F.lit(0).alias("source")).unionByName(carried.select(*columns, F.lit(1).alias("source"))).withColumn("same", same)
    first = Window.partitionBy(key, "section", "same").orderBy("source", "position")
    # an item without words is represented by nothing; a listed text without any is left out
    new = (F.row_number().over(first) == 1) | ((F.col("same") == "") & ~listed)
    return rows.withColumn("new", new).where("source = 0 or (new and (same <> '' or section not in ('facts', 'questions')))").select(*columns, "source")


def reviewed(items: DataFrame, decisions: DataFrame, key: str = "conversation_id") -> DataFrame:
    """Items (key, kind, index, title, body) after a review (key, kind, index, position, keep, revised_body, reason): the last decision
    for an index counts; a revised body takes the body's place, and an item that was to go stays with a warning."""
    last = decisions.groupBy(key, "kind", "index").agg(F.max_by(F.struct("keep", "revised_body", "reason"), "position").alias("d"))
    out = items.join(last, [key, "kind", "index"], "left")
    body = F.coalesce(F.nullif("d.revised_body", F.lit("")), "body")
    warning = F.when(~F.col("d.keep"), F.concat(F.lit("REVIEW_FLAGGED_"), F.upper("kind"), F.lit("_KEPT: "), "title", F.lit(" ("), text_or_empty("d.reason"), F.lit(")")))
    return out.select(key, "kind", "index", "title", body.alias("body"), warning.alias("warning"))


def short_summary(windows: DataFrame, topics: DataFrame, key: str = "conversation_id") -> DataFrame:
    """The last window's summary that isn't empty, and up to six topics, in one line; windows: key, window_index, summary; topics: key,
    rank, label."""
    last = windows.where(text_or_empty("summary") != "").groupBy(key).agg(strip(F.max_by("summary", "window_index")).alias("last"))
    six = topics.where("rank <= 6").groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x.label), ", ").alias("labels"))
    out = windows.select(key).distinct().join(last, key, "left").join(six, key, "left").fillna("", ["last", "labels"])
    both = F.concat(F.left("last", F.lit(240)), F.lit(" Topics: "), "labels", F.lit("."))
    other = F.when(F.col("last") != "", F.left("last", F.lit(280))).when(F.col("labels") != "", F.concat(F.lit("Active topics: "), "labels", F.lit("."))).otherwise("")
    return out.select(key, F.when((F.col("last") != "") & (F.col("labels") != ""), both).otherwise(other).alias("summary"))


def space_totals(notes: DataFrame, tasks: DataFrame, staged_notes: DataFrame, staged_tasks: DataFrame, keys: tuple[str, ...] = ("user_id", "space_id")) -> DataFrame:
    """Notes and tasks of each user's space, saved and staged, and the share done in whole percent (halves to even); staged tasks
    count for the share only where none is saved."""
    count = lambda df, name, done=None: df.groupBy(*keys).agg(F.count("*").alias(name), *([F.count_if(done).alias(f"done_{name}")] if done is not None else []))
    parts = [count(notes, "notes"), count(tasks, "tasks", F.col("status") == "completed"), count(staged_notes, "staged_notes"), count(staged_tasks, "staged_tasks", F.col("operation").isin("DONE", "COMPLETE"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, list(keys), "full")
    out = out.fillna(0, [c for c in out.columns if c not in keys])
    saved = F.col("tasks") > 0
    total, done = F.when(saved, F.col("tasks")).otherwise(F.col("staged_tasks")), F.when(saved, F.col("done_tasks")).otherwise(F.col("done_staged_tasks"))
    return out.withColumn("percent", F.when(total == 0, 0).otherwise(F.bround(100 * done / total)).cast("int"))


def staged(existing: DataFrame, job: DataFrame, key: str) -> DataFrame:
    """A job's fields over those already staged: the new value where there is one."""
    other = [c for c in job.columns if c != key]
    kept = [c for c in existing.columns if c != key and c not in other]
    old, new = existing.alias("old"), job.alias("new")
    both = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full")
    get = lambda c: F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}")) if c in existing.columns else F.col(f"new.{c}")
    return both.select(get(key).alias(key), *[get(c).alias(c) for c in other], *[F.col(f"old.{c}") for c in kept])
