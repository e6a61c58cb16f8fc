"""Extraction results: validation of items, merging without repeats, recovery, repair of gaps, findings and publishing.

Items are rows: a conversation, a collection (tasks, notes, decisions, issues), title, body, operation, status, kind, fingerprint and
evidence, an array of structs with sequence_start, sequence_end and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlake.functions.text import action_signals, evidence_found, looks_actionable, rough_tokens, text_or_empty
from convlake.operators.artifacts import resolve_artifacts
from convlake.operators.merge import latest_wins

# Issues by their kinds.
BLOCKERS = ["blocker", "risk"]
QUESTIONS = ["open_question", "missing_information"]
# What an item has where it says nothing.
DEFAULTS = {"operation": "NEEDS_CONFIRMATION", "confidence": 0.5, "status": "unresolved_discussion", "kind": "open_question"}


def is_action(operation: Column) -> Column:
    """False for items that ask for nothing to be done; a null operation is an action."""
    return ~F.coalesce(operation == "NO_ACTION", F.lit(False))


def item_identity(title: Column, body: Column, operation: Column, status: Column, kind: Column, evidence: Column, fingerprint: Column) -> Column:
    """The fingerprint, else the lower-cased fields and evidence spans; nulls count as empty."""
    spans = F.array_join(F.transform(evidence, lambda e: F.concat_ws(":", e.sequence_start.cast("string"), e.sequence_end.cast("string"))), "|")
    parts = [title, F.left(body, F.lit(300)), operation, status, kind, spans]
    return F.coalesce(F.nullif(fingerprint, F.lit("")), F.lower(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])))


def identified(items: DataFrame) -> DataFrame:
    return items.withColumn("identity", item_identity(*map(F.col, ["title", "body", "operation", "status", "kind", "evidence", "fingerprint"])))


def issue_section(kind: Column) -> Column:
    """blockers or questions; null for kinds that are neither."""
    return F.when(kind.isin(BLOCKERS), "blockers").when(kind.isin(QUESTIONS), "questions")


def merge_items(items: DataFrame, order: list[str], key: str = "conversation_id") -> DataFrame:
    """The first item of each identity in a conversation's collection, issues by section; tasks without an action and issues of other
    kinds go. An aggregation that combines before the shuffle, so a repeated item is one row of each task."""
    section = F.when(F.col("collection") == "issues", issue_section(F.col("kind"))).otherwise(F.col("collection"))
    rows = identified(items.where((F.col("collection") != "tasks") | is_action(F.col("operation")))).withColumn("section", section).where("section is not null")
    rest = [c for c in rows.columns if c not in (key, "section", "identity")]
    return rows.groupBy(key, "section", "identity").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("i")).select(key, "section", "identity", "i.*")


def carried(primary: DataFrame, others: DataFrame, order: list[str], key: str = "conversation_id") -> DataFrame:
    """primary's items and those of others that it lacks: a result with its recovery, or the final result with its windows' items."""
    both = primary.withColumn("__from", F.lit(0)).unionByName(others.withColumn("__from", F.lit(1)))
    return merge_items(both, ["__from", *order], key).drop("__from")


def valid_items(items: DataFrame) -> DataFrame:
    """Items with a title and evidence (notes: and a body; tasks: and an action), what is absent filled in by DEFAULTS."""
    c, filled = F.col("collection"), lambda x: F.coalesce(F.col(x) != "", F.lit(False))
    kept = items.where(filled("title") & (F.coalesce(F.size("evidence"), F.lit(0)) > 0) & ((c != "notes") | filled("body")) & ((c != "tasks") | is_action(F.col("operation"))))
    default = lambda name, of: F.when(c == of, F.coalesce(name, F.lit(DEFAULTS[name]))).otherwise(F.col(name))
    kept = kept.withColumn("operation", default("operation", "tasks")).withColumn("status", default("status", "decisions")).withColumn("kind", default("kind", "issues"))
    confirm = F.when(c == "tasks", F.coalesce("needs_confirmation", F.col("operation") == DEFAULTS["operation"])).otherwise(F.col("needs_confirmation"))
    return kept.withColumn("confidence", F.coalesce("confidence", F.lit(DEFAULTS["confidence"]))).withColumn("needs_confirmation", confirm).withColumn("body", text_or_empty("body"))


def needs_window_recovery(text: Column) -> Column:
    """Should a window be extracted again? Columns: counts tasks, notes, decisions, issues, facts, topics, questions, and summary."""
    n = lambda *names: F.greatest(F.lit(0), *[F.coalesce(x, F.lit(0)) for x in names]) > 0
    note_source = n("facts", "topics", "questions") | (rough_tokens("summary") >= 20)
    missed = ~n("tasks", "notes", "decisions", "issues") | (~n("notes") & note_source) | (looks_actionable(text) & ~n("tasks", "notes"))
    return (F.trim(text_or_empty(text)) != "") & missed


def needs_final_recovery(windows: DataFrame, final: DataFrame, key: str = "conversation_id") -> DataFrame:
    """(key, needs_recovery) for each conversation in final (counts tasks, notes, decisions, issues): what its windows held is lost."""
    some = lambda *names: F.greatest(F.lit(0), *[F.coalesce(x, F.lit(0)) for x in names]) > 0
    told = rough_tokens("summary") >= 30
    sources = windows.groupBy(key).agg(F.bool_or(some("notes", "facts") | told).alias("for_notes"), F.bool_or(some("tasks", "notes", "decisions", "issues", "facts", "questions") | told).alias("for_any"))
    out = final.join(sources, key, "left")
    lost = (~some("notes") & F.coalesce("for_notes", F.lit(False))) | (~some("tasks", "notes", "decisions", "issues") & F.coalesce("for_any", F.lit(False)))
    return out.select(key, lost.alias("needs_recovery"))


def unsaved_windows(windows: DataFrame, artifacts: DataFrame, key: str = "conversation_id") -> DataFrame:
    """Windows (key, window_index, expected, saved) that should have artifacts, but have none or were not saved whole."""
    has = artifacts.select(key, "window_index").distinct().withColumn("__has", F.lit(True))
    out = windows.where("expected > 0").join(has, [key, "window_index"], "left")
    return out.where(~(F.coalesce("__has", F.lit(False)) & F.coalesce("saved", F.lit(False)))).drop("__has")


def repair_windows(windows: DataFrame, existing: DataFrame, incoming: DataFrame, key: str = "conversation_id") -> DataFrame:
    """What becomes of the unsaved windows' artifacts when they are resolved, in order of position, after all existing ones."""
    lacking = incoming.join(unsaved_windows(windows, existing, key), [key, "window_index"], "left_semi")
    columns = [key, "id", "artifact_type", "title", "content", "owner", "operation", "identity_key"]
    was = existing.withColumn("operation", F.lit(None).cast("string")).select(*columns, F.struct(F.lit(0), "position").alias("position"), F.lit("e").alias("__s"))
    new = lacking.select(*columns, F.struct(F.lit(1), "position").alias("position"), F.lit("n").alias("__s"))
    rows = was.unionByName(new).withColumn("id", F.concat("__s", F.col("id").cast("string")))
    out = resolve_artifacts(rows).where(F.startswith("id", F.lit("n")))
    return out.select(key, F.expr("substr(id, 2)").alias("id"), "resolution", F.expr("substr(matched_id, 2)").alias("matched_id"))


def findings(items: DataFrame, transcripts: DataFrame, key: str = "conversation_id") -> DataFrame:
    """(key, code, collection, title): items without evidence, each quote that neither transcript (raw, normalized) has, and
    conversations that sound like action but have no task."""
    none = F.lit(None).cast("string")
    bare = items.where(F.coalesce(F.size("evidence"), F.lit(0)) <= 0).select(key, F.lit("MISSING_EVIDENCE").alias("code"), "collection", "title")
    quotes = items.select(key, "collection", "title", F.explode("evidence").alias("e")).join(transcripts, key, "left")
    found = F.coalesce(evidence_found("e.text", "raw"), F.lit(False)) | F.coalesce(evidence_found("e.text", "normalized"), F.lit(False))
    wrong = quotes.where(~found).select(key, F.lit("EVIDENCE_TEXT_NOT_EXACT_MATCH").alias("code"), "collection", "title")
    idle = transcripts.where(F.size(action_signals("normalized")) > 0).join(items.where("collection = 'tasks'"), key, "left_anti")
    return bare.unionByName(wrong).unionByName(idle.select(key, F.lit("ACTION_WITHOUT_TASK").alias("code"), none.alias("collection"), none.alias("title")))


def publish(target: DataFrame, staged: DataFrame, order: list[str]) -> DataFrame:
    """target (id, user_id, space_id, fingerprint, created_at, ...) after a run's staged rows, which also have existing_id and operation.

    A row that names an existing id overwrites it, if user and space agree, but for created_at; the last of several does. Of other
    rows, the first of each fingerprint is added where target has none of it; rows without a fingerprint go by their own id. Rows
    without an action are left out. Fingerprints are held against target as it was before the run.
    """
    live = staged.where(is_action(F.col("operation"))).withColumn("existing_id", F.nullif(F.trim("existing_id"), F.lit("")))
    fixed = ("id", "user_id", "space_id", "created_at")
    rest = [c for c in target.columns if c not in fixed]
    over = latest_wins(live.where("existing_id is not null").select("existing_id", "user_id", "space_id", *rest, *[c for c in order if c not in rest]), ["existing_id", "user_id", "space_id"], order)
    over = over.select(F.col("existing_id").alias("id"), "user_id", "space_id", F.struct(*rest).alias("__new"))
    kept = target.join(over, ["id", "user_id", "space_id"], "left")
    kept = kept.select(*[F.when(F.col("__new").isNotNull(), F.col("__new")[c]).otherwise(F.col(c)).alias(c) if c in rest else F.col(c) for c in target.columns])
    mark = lambda df: df.withColumn("__mark", F.coalesce(F.concat(F.lit("f"), F.nullif("fingerprint", F.lit(""))), F.concat(F.lit("i"), "id")))
    fresh = mark(live.where("existing_id is null"))
    fresh = fresh.groupBy("__mark").agg(F.min_by(F.struct(*target.columns), F.struct(*order)).alias("r")).join(mark(target.select("id", "fingerprint")).select("__mark"), "__mark", "left_anti")
    return kept.unionByName(fresh.select("r.*"))
