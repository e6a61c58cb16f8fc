"""Repairs that built-in functions can't express: wrongly decoded text, and JSON inside other text (Arrow batches)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


# What a character of each class says for a text; classes may overlap.
WEIGHTS = {
    r"\x{FFFD}": -12, r"[\p{L}&&[^\x00-\x7F]]": 3, r"[A-Za-z]": 1, r"\p{N}": 1, r"\p{C}": -8,
    r"[\xA0-\xFF&&[^\p{Ll}\p{Lu}]]": -4, r"[\x80-\x9F]": -8,
}
# what Windows-1252 has at 80 to 9F, where it has anything
WINDOWS = {chr(b): t for b in range(0x80, 0xA0) if (t := bytes([b]).decode("cp1252", "ignore"))}


def quality(x: Column) -> Column:
    """How much a text looks like text: its characters counted by class, and weighed."""
    return sum((F.regexp_count(x, F.lit(c)) * w for c, w in WEIGHTS.items()), F.lit(0))


def reread(x: Column, allowed: str) -> Column:
    """The text's characters as Latin-1 bytes read as UTF-8; null if it has others than the allowed, or the bytes aren't UTF-8."""
    return F.try_validate_utf8(F.when(x.rlike(allowed), F.encode(x, "ISO-8859-1")).cast("string"))


def repair_text(x: Column | str) -> Column:
    """The likeliest of the text, and the text read again as UTF-8 from Latin-1 or Windows-1252 bytes; the first of equals."""
    x = F.col(x) if isinstance(x, str) else x
    latin = reread(x, r"\A[\x00-\xFF]*\z")
    bytes_ = F.translate(x, "".join(WINDOWS.values()), "".join(WINDOWS))
    windows = F.when(~x.rlike(r"[\x80-\x9F]"), reread(bytes_, r"\A[\x00-\xFF]*\z"))
    best = F.when(quality(windows) > F.greatest(quality(x), quality(latin)), windows).when(quality(latin) > quality(x), latin).otherwise(x)
    return F.when(x.rlike(r"[^\x00-\x7F]"), best).otherwise(x)


def first_object(text: str) -> str | None:
    """The first JSON object in a text, without what stands around it; null if there is none."""
    decoder = json.JSONDecoder(strict=False)
    at = text.find("{")
    while at >= 0:
        try:
            value, _ = decoder.raw_decode(text, at)
            return json.dumps(value, ensure_ascii=False)
        except ValueError:
            at = text.find("{", at + 1)
    return None


def _objects(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else first_object(t))


def json_object(x: Column | str) -> Column:
    return F.pandas_udf(_objects, T.StringType())(x)
