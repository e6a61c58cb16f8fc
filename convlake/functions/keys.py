"""Names and keys of stored objects as Column expressions: parts, file names, extensions, scopes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from convlake.functions.text import strip, text_or_empty

LONGEST_EXTENSION = 16


def _or(x: Column, otherwise: str) -> Column:
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(otherwise))


def key_part(x: Column) -> Column:
    """A part of a key: runs of other characters than letters, digits and ._=- become one hyphen, and none of .-/ is left at its ends."""
    return _or(F.btrim(F.regexp_replace(_or(text_or_empty(x), "unknown"), "[^A-Za-z0-9._=-]+", "-"), F.lit(".-/")), "unknown")


def file_name(x: Column) -> Column:
    """The last part of a path as a safe name with its extension; audio where nothing is left."""
    name = F.trim(F.regexp_extract(_or(text_or_empty(x), "audio"), "([^/]*)/*$", 1))
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    stem = _or(F.btrim(F.regexp_replace(F.left(name, F.length(name) - F.length(suffix)), "[^A-Za-z0-9._-]+", "-"), F.lit(".-_")), "audio")
    named = F.concat(stem, F.left(F.regexp_replace(suffix, "[^A-Za-z0-9.]+", ""), F.lit(LONGEST_EXTENSION)))
    return F.when(name.isin("", ".", ".."), "audio").otherwise(named)


def extension(x: Column) -> Column:
    """A lower-case extension of letters and digits; null where none is left, or it is too long."""
    plain = F.regexp_replace(F.lower(strip(x)), "[^a-z0-9]+", "")
    return F.when(F.length(plain).between(1, LONGEST_EXTENSION), plain)


def _joined(*parts: Column) -> Column:
    return F.concat_ws("/", *[F.nullif(F.btrim(p, F.lit("/")), F.lit("")) for p in parts])


def chunk_key(prefix: Column, user: Column, space: Column, conversation: Column, sequence: Column, chunk: Column, ending: Column) -> Column:
    """The key of a conversation's chunk; null without a valid extension."""
    last = F.format_string("%08d-%s.%s", sequence.cast("long"), key_part(chunk), extension(ending))
    return F.when(extension(ending).isNotNull(), _joined(prefix, key_part(user), key_part(space), key_part(conversation), last))


def upload_key(prefix: Column, user: Column, space: Column, session: Column, job: Column, name: Column) -> Column:
    return _joined(prefix, key_part(user), key_part(space), key_part(_or(text_or_empty(session), "no-session")), key_part(job), file_name(name))


def valid_key(x: Column) -> Column:
    """A key as it is stored: slashes forward, none at its beginning; null if it is empty or goes up a folder."""
    key = F.regexp_replace(F.replace(strip(x), F.lit("\\"), F.lit("/")), "^/+", "")
    return F.when((key != "") & ~F.array_contains(F.split(key, "/"), ".."), key)


def in_scope(key: Column, prefix: Column, user: Column, space: Column, conversation: Column) -> Column:
    """Is a valid key among a conversation's own?"""
    own = F.concat(F.concat_ws("/", prefix, key_part(user), key_part(space), key_part(conversation)), F.lit("/"))
    return F.coalesce(F.startswith(valid_key(key), own), F.lit(False))
