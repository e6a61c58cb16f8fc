"""Workspace reports: task lists, statistics, spaces, chat sessions, direct answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlake.functions.text import fallback_label, first_filled

# The columns that may hold a space's label, in order.
LABELS = ["spaceName", "spacename", "space_name", "name", "title", "label", "workspaceName", "workspace_name"]
ACTIVE = ["pending", "in_progress", "blocked", "needs_confirmation"]


def scoped(df: DataFrame, user: str, space: str) -> DataFrame:
    """Only the rows of one user's space."""
    return df.where((F.col("user_id") == user) & (F.col("space_id") == space))


def active_tasks(tasks: DataFrame, most: int = 20) -> DataFrame:
    """The latest active tasks of each space."""
    rank = Window.partitionBy("space_id").orderBy(F.desc("updated_at"), F.desc("task_id"))
    return tasks.where(F.col("status").isin(ACTIVE)).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= most)


def is_due(resolved: Column, text: Column, day: Column, word: str) -> Column:
    """Is the resolved date this day, or the text the word or the date?"""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.coalesce(resolved == day, F.lit(False)) | (low == word) | (low == F.date_format(day, "yyyy-MM-dd"))


def is_on(at: Column, day: Column) -> Column:
    return F.coalesce(F.to_date(at) == day, F.lit(False))


def date_text(at: Column, text: Column) -> Column:
    """A time's date, else the text, else that it isn't known."""
    return F.coalesce(F.date_format(at, "yyyy-MM-dd"), F.nullif(text, F.lit("")), F.lit("unknown date"))


def due_display(resolved: Column, date: Column, text: Column) -> Column:
    return F.coalesce(F.date_format(resolved, "yyyy-MM-dd"), F.date_format(date, "yyyy-MM-dd"), F.nullif(F.trim(text), F.lit("")), F.lit("no due date"))


def task_line(title: Column, status: Column, due: Column) -> Column:
    return F.concat(F.lit("- "), title, F.lit(" ("), status, F.lit(", due "), due, F.lit(")"))


def space_stats(tasks: DataFrame) -> DataFrame:
    """Counts by status for each space, and the share completed in whole percent (halves to even)."""
    out = tasks.groupBy("space_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status").isin(ACTIVE)).alias("active"), F.max("updated_at").alias("last_update"))
    return out.withColumn("percent", F.when(F.col("total") > 0, F.bround(100 * F.col("completed") / F.col("total"))).otherwise(0).cast("int"))


def spaces(found: DataFrame, labels: DataFrame, most: int = 100) -> DataFrame:
    """Spaces with their labels, the first filled of the columns in LABELS that `labels` has, by label and id; a space without one is shown under the end of its id, after it was sorted."""
    named = found.join(labels.select("space_id", first_filled(*[c for c in LABELS if c in labels.columns]).alias("label")), "space_id", "left")
    ordered = named.orderBy(F.lower(F.coalesce("label", F.lit(""))), "space_id").limit(most)
    return ordered.withColumn("label", F.coalesce("label", F.concat(F.lit("Space "), fallback_label(F.col("space_id").cast("string")))))


def reports(tables: dict[str, DataFrame], user: str, space: str, focus: list[str], most: int = 20) -> dict[str, DataFrame]:
    """The reports a plan asks for, each the latest rows of one table in the user's space."""
    return {name: scoped(tables[name], user, space).orderBy(F.desc("updated_at")).limit(most) for name in focus if name in tables}


def may_continue(message_count: Column, most: int = 100) -> Column:
    """May a chat session take another question and answer?"""
    return message_count + 2 <= most
