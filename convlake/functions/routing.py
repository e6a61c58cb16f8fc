"""Choices by rule: which provider is next, what an error means, which space a question names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlake.functions.text import any_of, text_or_empty

# Providers by capability, in the order in which they are tried; other capabilities take OTHERS.
CANDIDATES = {
    "normalization": ["gemini", "groq", "mistral", "sarvam"],
    "simple_summary": ["groq", "mistral", "sarvam"],
    "chat_answer": ["groq", "gemini", "mistral", "sarvam"],
    "validation": ["groq", "mistral", "sarvam"],
    "high_accuracy_reasoning": ["groq", "mistral", "sarvam"],
    "complex_task_matching": ["groq", "mistral", "sarvam"],
    "fallback": ["mistral", "sarvam"],
}
OTHERS = ["groq", "mistral", "sarvam"]
# Messages of errors that another attempt at the same provider can't mend.
NOT_AGAIN = ["api key is not configured", "sdk is not installed"]
# Codes and statuses of an object store's errors.
PERMANENT_CODES = ["NoSuchKey", "NoSuchBucket", "AccessDenied", "InvalidAccessKeyId", "SignatureDoesNotMatch"]
TEMPORARY_CODES = ["SlowDown", "RequestTimeout", "Throttling"]
PERMANENT_STATUSES = [400, 403, 404]
# How a question names a space by number.
SPACE_WORDS = ["space", "workspace", "project"]
SPACE_PHRASE = r"\b(?:for|from|in|inside|of)?\s*(?:space|workspace|project)\s+\d+\b"
SPACE_REPLY = r"^(?:space|workspace|project)\s+\d+$"


def candidates(capability: Column, configured: Column) -> Column:
    """The configured providers that serve a capability, in order."""
    order = F.coalesce(*[F.when(capability == k, F.array(*map(F.lit, v))) for k, v in CANDIDATES.items()], F.array(*map(F.lit, OTHERS)))
    return F.filter(order, lambda p: F.array_contains(configured, p))


def attempt_status(outcome: Column, attempt: Column, message: Column, most: int = 3) -> Column:
    """What a transcription attempt (from 0) leads to. outcome: ok, permanent, temporary or another provider error."""
    again = (attempt < most - 1) & ~any_of(message, NOT_AGAIN)
    return F.when(outcome == "ok", "completed").when(outcome == "permanent", "permanent_audio_error").when((outcome == "temporary") & again, "retry").otherwise("fallback")


def storage_error(kind: Column, code: Column, status: Column) -> Column:
    """permanent or temporary. kind: credentials, timeout, client or anything else; only client errors go by code and status."""
    client = F.when(code.isin(PERMANENT_CODES), "permanent").when(code.isin(TEMPORARY_CODES) | (status >= 500), "temporary").when(status.isin(PERMANENT_STATUSES), "permanent").otherwise("temporary")
    return F.when(kind == "credentials", "permanent").when(kind == "client", client).otherwise("temporary")


def inline_space(question: Column | str) -> Column:
    """The number of the space that a question names; null if it names none."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text_or_empty(question), rf"(?i)\b{w}\s+(\d+)\b", 1), F.lit("")) for w in SPACE_WORDS])


def without_inline_space(question: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text_or_empty(question), "(?i)" + SPACE_PHRASE, ""), r"\s+", " "))


def is_option_reply(question: Column | str) -> Column:
    """Is it only a number, or a space and its number?"""
    said = F.lower(F.trim(text_or_empty(question)))
    return F.rlike(said, F.lit(r"^[0-9]+$")) | F.rlike(said, F.lit(SPACE_REPLY))


def resolve_options(replies: DataFrame, options: DataFrame, keys: list[str], reply_id: str) -> DataFrame:
    """(keys, reply_id, option) for replies (keys, reply_id, selection): the value of the option (keys, index, label, value) with that
    index, else of the first one with that label or value; null if there is none. An equality join on what can be said."""
    said = F.lower(F.trim(text_or_empty("selection")))
    number = F.when(F.rlike(said, F.lit(r"^[0-9]{1,18}$")), F.concat(F.lit("#"), said.cast("long").cast("string")))
    asked = replies.select(*keys, reply_id, F.explode(F.array_compact(F.array(number, F.when(said != "", F.concat(F.lit("="), said))))).alias("__say"))
    names = [F.concat(F.lit("#"), F.col("index").cast("string")), *[F.concat(F.lit("="), F.lower(F.trim(text_or_empty(c)))) for c in ("label", "value")]]
    known = options.select(*keys, "index", "value", F.explode(F.array_distinct(F.array(*names))).alias("__say"))
    hit = asked.join(known, [*keys, "__say"]).groupBy(*keys, reply_id).agg(F.min_by("value", F.struct(F.startswith("__say", F.lit("=")), "index")).alias("option"))
    return replies.select(*keys, reply_id).join(hit, [*keys, reply_id], "left")


def input_token_limit(provider: Column, per_minute: Column, answer: Column, other: Column) -> Column:
    """Tokens that a request to a provider may have: of one with a limit a minute, what an answer (512 at least, half the limit at most)
    and 500 more leave of it, but 1000 at least."""
    kept = F.greatest(F.lit(512), F.least(answer, F.floor(per_minute / 2)))
    return F.when(provider == "groq", F.greatest(F.lit(1000), per_minute - kept - 500)).otherwise(other)
