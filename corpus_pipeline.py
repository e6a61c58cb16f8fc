"""A corpus pipeline over `documents`: toxicity, near duplicates, repeated passages, mixing and packing, one after the other.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and returns a DataFrame that is written as
Parquet, in the shared checkpoint folder, and read again as the next one's docs. All but the last return the columns of `documents`, so stages can be left out or
run alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlake.llm import toxicity
from convlake.llm.common import clear, ready, release, settle
from convlake.llm.mixing import mixed_documents
from convlake.llm.neardup import near_duplicates
from convlake.llm.packing import pack_documents
from convlake.llm.suffixes import without_repeats
from convlake.session import remove, shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def begin(spark: SparkSession) -> None:
    """What the stages before have left on the driver goes first: all run in one session."""
    release(ready(spark))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the conditional random field, learnt from `labels`, doesn't find toxic; null or empty texts stay."""
    begin(spark)
    own = docs.select("doc_id", "text")
    labels = toxicity.training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    model = toxicity.train(own, labels)
    numbered = settle(clear(docs, "__row").withColumn("__row", F.monotonically_increasing_id()))
    verdict = toxicity.score(numbered.select("__row", "text"), model, key="__row", with_spans=False).where("predicted = 0").select("__row")
    return numbered.join(verdict, "__row", "left_semi").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8 or more): the one with the smallest doc_id. Documents
    without words, and rows without a doc_id, are in no group and stay; of rows with one doc_id, those kept all stay."""
    begin(spark)
    found = near_duplicates(docs.select("doc_id", "text"), size=5, percent=80)
    gone = found.where("doc_id is not null and not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 50 bytes or more that a document with a smaller doc_id has too.

    Where a cut falls within a character, what is left of that character goes too; n_chars follows the text. Null texts stay null;
    rows of one doc_id don't remove from each other.
    """
    begin(spark)
    out = without_repeats(docs, removed="__removed")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words of all sources mixed to their target weights, up to twice; one row for each pass over a document."""
    begin(spark)
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces in sequences of at most 2048 tokens, best fit."""
    begin(spark)
    return pack_documents(docs.select("doc_id", "text"), with_ids=False)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", drop_repeats),
    ("mixing", mix),
    ("packing", pack),
]

ORACLE_SQL = None  # learnt scores, whole-suffix matches and hashed draws are beyond SQL; tests/llm holds brute-force versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written as Parquet to the shared checkpoint folder and read again by the next. A stage's rows go once
    the next one's are written; the last folder stays, as the result reads it."""
    docs, done = ready(spark).read.parquet(f"{sf_dir}/documents.parquet"), None
    folder = shared_folder(spark, "stages")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if done:
            remove(spark, f"{folder}/{done}")
        docs, done = spark.read.parquet(f"{folder}/{name}"), name
    return STAGES[-1][1](spark, docs, sf_dir)
