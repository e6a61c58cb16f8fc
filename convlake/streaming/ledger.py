"""Sinks that take every event once: files of a micro-batch count only when a ledger names them, and the ledger names a batch once.

A stream's checkpoint repeats a batch that a crash cut short, with the same number and rows. Each sink asks the ledger for that number first;
what was committed before the crash is skipped, and files of an attempt without an entry are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from convlake.session import exists, shared_folder

ENTRY = "sink string, batch long, files array<string>, events long"


def commit(rows: DataFrame, folder: str, sink: str, batch: int) -> bool:
    """Write a batch's rows to a sink unless the ledger has it; returns whether it was written now.

    The rows go to a folder of this attempt's own. The entry is one file that is renamed into place, and counts with its success
    mark; it acknowledges the batch.
    """
    spark = rows.sparkSession
    entry = f"{folder}/ledger/{sink}/{batch}"
    if exists(spark, f"{entry}/_SUCCESS"):
        return False
    data = f"{folder}/data/{sink}/{batch}-{shared_folder(spark, '').rsplit('-', 1)[1]}"
    rows.write.parquet(data)
    written = spark.read.schema(rows.schema).parquet(data)
    files = written.inputFiles()
    spark.createDataFrame([(sink, batch, files, written.count())], ENTRY).coalesce(1).write.mode("overwrite").json(entry)
    return True


def entries(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(ENTRY).option("recursiveFileLookup", "true").json(f"{folder}/ledger")


def delivered(spark: SparkSession, folder: str, sink: str, schema: str) -> DataFrame:
    """A sink's events: the rows of the files that the ledger names. The names are joined, not listed on the driver."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/data/{sink}")
    name = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/+", "/")  # noqa: E731  one file may be named file:/ and file:///
    named = entries(spark, folder).where(F.col("sink") == sink).select(F.explode("files").alias("__file")).select(name("__file").alias("__file")).distinct()
    return rows.withColumn("__file", name(F.col("_metadata.file_path"))).join(named, "__file", "left_semi").drop("__file")


def deliver(events: DataFrame, sinks: list[str], folder: str, checkpoint: str, by: str = "route", available_now: bool = True) -> StreamingQuery:
    """A stream of events split by a column over sinks, each event once in its sink, whatever restarts there are. Values that name no
    sink go to none."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for name in sinks:
                commit(batch.where(F.col(by) == name), folder, name, number)
        finally:
            batch.unpersist()

    out = events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()
