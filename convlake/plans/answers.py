"""Answers to many questions at once from what their spaces have: lists by space, made once, and a plan for each question.

A plan is what a question asks for: a scope (today, tomorrow or none) and whether it wants a summary, tasks and notes. Whatever the
number of questions, rows are ranked and gathered once by space, at most CAPS of a kind, and a question is one join with its space.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlake.functions.text import let
from convlake.plans.workspace import ACTIVE

# How many rows of a kind a space's answers may draw on, the latest first.
CAPS = {"task": 100, "staged_task": 50, "note": 50, "staged_note": 50, "summary": 8, "memory": 1}
# For each scope, what is said, in order: the first list that isn't empty, with its headline (its number in place of {n}) and
# how many of its lines are shown (None: all); the last text stands where all are empty.
TODAY = [
    ("task", "due_today", None, "You have {n} task(s) due today:"),
    ("staged_task", "due_today", None, "I found {n} staged task(s) due today:"),
    ("task", "unfinished", 10, "I do not see any tasks due today, but you have unfinished tasks:"),
    ("staged_task", "any", 10, "I do not see published tasks due today, but I found staged tasks:"),
]
TOMORROW = [
    ("task", "due_tomorrow", None, "You have {n} task(s) due tomorrow:"),
    ("staged_task", "due_tomorrow", None, "I found {n} staged task(s) due tomorrow:"),
    ("task", "unfinished", 10, "I do not see tasks explicitly due tomorrow. Here are unfinished tasks you can plan from:"),
    ("staged_task", "any", 10, "I do not see published unfinished tasks, but I found staged tasks you can plan from:"),
]
NOTHING_TODAY = "I do not see any saved tasks due today or unfinished tasks in this space."
NOTHING_TOMORROW = "I do not see any saved unfinished tasks in this space to plan for tomorrow."
NO_TASKS, NO_NOTES = "I do not see any saved tasks in this space yet.", "I do not see any saved notes in this space yet."
NO_SUMMARY, SUMMARY = "No conversation summaries are saved yet for this space.", "Here is your workspace summary:"
# Sections of the answer on all tasks and on notes: kind, which of them, lines shown, headline.
TASKS = [("task", "unfinished", 20, "Unfinished tasks:"), ("task", "completed", 10, "Completed tasks:"), ("staged_task", "any", 20, "Staged tasks waiting in the app: {n}")]
NOTES = [("note", "any", 20, "Published notes:"), ("staged_note", "any", 20, "Staged notes:")]

ROW = ["kind", "id", "at", "line", "status", "due", "today"]


def filled(x: Column | str, otherwise: str) -> Column:
    return F.coalesce(F.nullif(F.col(x) if isinstance(x, str) else x, F.lit("")), F.lit(otherwise))


def due_on(resolved: Column, text: Column, day: Column) -> Column:
    """today, tomorrow, or null: the resolved date, or what the text says (the word, or for today the date)."""
    said, date = F.lower(F.trim(F.coalesce(text, F.lit("")))), F.coalesce(resolved, F.lit(""))
    one, two = F.date_format(day, "yyyy-MM-dd"), F.date_format(F.date_add(day, 1), "yyyy-MM-dd")
    return F.when((date == one) | said.isin("today") | (said == one), "today").when((date == two) | (said == "tomorrow"), "tomorrow")


def task_rows(tasks: DataFrame, day: Column, kind: str = "task") -> DataFrame:
    """Rows of a kind from tasks (user_id, space_id, id, at, title, status, owner, due_date, due_text, body)."""
    due = F.coalesce(F.nullif("due_date", F.lit("")), F.nullif("due_text", F.lit("")), F.lit("no due date"))
    body = F.trim(F.coalesce("body", F.lit("")))
    status = filled("status", "unknown" if kind == "task" else "pending review")
    head = F.concat(F.lit("- "), filled("title", "Untitled"), F.lit(" ("), status, F.lit(", owner: "), filled("owner", "no owner"), F.lit(", due: "), due, F.lit(")"))
    line = F.when(body != "", F.concat(head, F.lit(" - "), body)).otherwise(head)
    return _rows(tasks, kind, line, F.col("status"), due_on(F.col("due_date"), F.col("due_text"), day), day)


def note_rows(notes: DataFrame, day: Column, kind: str = "note") -> DataFrame:
    body = F.trim(F.coalesce("body", F.lit("")))
    head = F.concat(F.lit("- "), filled("title", "Untitled"))
    return _rows(notes, kind, F.when(body != "", F.concat(head, F.lit(": "), body)).otherwise(head), F.lit(None), F.lit(None), day)


def summary_rows(summaries: DataFrame, day: Column) -> DataFrame:
    return _rows(summaries, "summary", F.concat(F.lit("- "), F.coalesce("summary", F.lit(""))), F.lit(None), F.lit(None), day)


def memory_rows(memories: DataFrame, day: Column) -> DataFrame:
    return _rows(memories, "memory", F.trim(F.coalesce("summary", F.lit(""))), F.lit(None), F.lit(None), day)


def _rows(df: DataFrame, kind: str, line: Column, status: Column, due: Column, day: Column) -> DataFrame:
    today = F.coalesce(F.to_date("at") == F.to_date(day), F.lit(False))
    return df.select("user_id", "space_id", F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"), F.col("at").cast("timestamp").alias("at"), line.alias("line"), status.cast("string").alias("status"), due.cast("string").alias("due"), today.alias("today"))


def gathered(rows: DataFrame) -> DataFrame:
    """(user_id, space_id, items): a space's latest rows, at most CAPS of each kind, in order. One shuffle: the ranking and the gathering
    are both by space, and the ranking drops what is beyond the caps as it goes."""
    own = ["user_id", "space_id"]
    rank = F.row_number().over(Window.partitionBy(*own, "kind").orderBy(F.desc("at"), F.desc("id")))
    cap = F.coalesce(*[F.when(F.col("kind") == k, n) for k, n in CAPS.items()])
    kept = rows.repartition(*own).withColumn("rank", rank).where(F.col("rank") <= cap)
    return kept.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("rank", "kind", "line", "status", "due", "today"))).alias("items"))


TESTS: dict[str, Callable[[Column], Column]] = {
    "any": lambda x: F.lit(True),
    "unfinished": lambda x: x.status.isin(ACTIVE),
    "completed": lambda x: x.status == "completed",
    "due_today": lambda x: x.due == "today",
    "due_tomorrow": lambda x: x.due == "tomorrow",
    "today": lambda x: x.today,
}


def some(items: Column, kind: str, test: str) -> Column:
    """A space's rows of a kind that meet a test. Of published tasks only unfinished ones are due."""
    def holds(x: Column) -> Column:
        also = x.status.isin(ACTIVE) if kind == "task" and test.startswith("due") else F.lit(True)
        return (x.kind == kind) & F.coalesce(TESTS[test](x) & also, F.lit(False))

    return F.filter(items, holds)


def lines(rows: Column, most: int | None) -> Column:
    return F.array_join(F.transform(rows if most is None else F.slice(rows, 1, most), lambda x: x.line), "\n")


def headed(headline: str, rows: Column, most: int | None) -> Column:
    """The headline and its lines; null where there is no row."""
    before, _, after = headline.partition("{n}")
    title = F.concat(F.lit(before), F.size(rows).cast("string"), F.lit(after)) if after or "{n}" in headline else F.lit(headline)
    return F.when(F.size(rows) > 0, F.concat(title, F.lit("\n"), lines(rows, most)))


def block(items: Column, kind: str, test: str, most: int | None, headline: str) -> Column:
    return let(some(items, kind, test), lambda rows: headed(headline, rows, most))


def first_of(items: Column, plan: list[tuple], nothing: str) -> Column:
    return F.coalesce(*[block(items, *p) for p in plan], F.lit(nothing))


def sections(items: Column, plan: list[tuple]) -> list[Column]:
    return [block(items, *p) for p in plan]


def size_of(items: Column, kind: str, test: str = "any") -> Column:
    return F.size(some(items, kind, test)).cast("string")


def tasks_answer(items: Column, scope: Column) -> Column:
    found = F.concat(F.lit("I found "), size_of(items, "task"), F.lit(" task(s) in this space. Unfinished: "), size_of(items, "task", "unfinished"), F.lit("."))
    every = F.when((size_of(items, "task") == "0") & (size_of(items, "staged_task") == "0"), NO_TASKS).otherwise(F.concat_ws("\n", found, *sections(items, TASKS)))
    return F.when(scope == "today", first_of(items, TODAY, NOTHING_TODAY)).when(scope == "tomorrow", first_of(items, TOMORROW, NOTHING_TOMORROW)).otherwise(every)


def notes_answer(items: Column) -> Column:
    found = F.concat(F.lit("I found "), size_of(items, "note"), F.lit(" published note(s) and "), size_of(items, "staged_note"), F.lit(" staged note(s):"))
    return F.when((size_of(items, "note") == "0") & (size_of(items, "staged_note") == "0"), NO_NOTES).otherwise(F.concat_ws("\n", found, *sections(items, NOTES)))


def summary_answer(items: Column) -> Column:
    memory = F.nullif(lines(some(items, "memory", "any"), 1), F.lit(""))
    told = F.coalesce(headed("Today:", some(items, "summary", "today"), 5), headed("Recent:", some(items, "summary", "any"), 3), F.lit(NO_SUMMARY))
    due = F.coalesce(headed("Tasks due today: {n}", some(items, "task", "due_today"), 10), F.lit("Tasks due today: none found."))
    return F.concat_ws("\n", F.lit(SUMMARY), memory, told, due, headed("Notes updated today: {n}", some(items, "note", "today"), 5))


def direct_answers(questions: DataFrame, rows: DataFrame) -> DataFrame:
    """(question_id, user_id, space_id, answer) of questions (question_id, user_id, space_id, scope, wants_summary, wants_tasks, wants_notes)
    from rows (task_rows, note_rows, summary_rows and memory_rows, in one table).

    What a question wants is answered in this order, parts apart by a blank line; one that wants nothing in particular has no
    direct answer (null). A space without rows is answered too. A scope other than today and tomorrow, or null, is none.
    """
    asked = questions.join(gathered(rows), ["user_id", "space_id"], "left")
    items = F.coalesce("items", F.slice("items", 1, 0), F.array().cast("array<struct<rank:int,kind:string,line:string,status:string,due:string,today:boolean>>"))
    asked = asked.withColumn("items", items)
    own = F.col("items")
    parts = [F.when(F.col(f"wants_{k}"), v) for k, v in (("summary", summary_answer(own)), ("tasks", tasks_answer(own, F.coalesce("scope", F.lit("")))), ("notes", notes_answer(own)))]
    return asked.select("question_id", "user_id", "space_id", F.nullif(F.concat_ws("\n\n", *parts), F.lit("")).alias("answer"))
