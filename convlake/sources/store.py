"""Tables of slices: Parquet folders by a hash (or the value) of a column, and versions that name the folders they consist of.

A change writes new folders for the slices it touches and then, in one step, a version that points to them and to the old folders of
all other slices. Readers see whole versions only; a run that dies before that step leaves folders that no version names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convlake.operators.merge import latest_wins
from convlake.session import exists, remove

VERSION = "version long, slices array<struct<slice: string, folder: string>>"


@dataclass(frozen=True)
class Table:
    """Where a table lies, the column that its slices follow, the order of rows within them, and the number of slices (None: one for each
    value of the column). `by` must not be null."""

    path: str
    by: str
    order: tuple[str, ...] = ()
    slices: int | None = 64

    def slice_of(self, value: Column) -> Column:
        return (F.pmod(F.xxhash64(value), F.lit(self.slices)) if self.slices else value).cast("string")

    def sliced(self, df: DataFrame) -> DataFrame:
        return df.withColumn("slice", self.slice_of(F.col(self.by)))


def versions(spark: SparkSession, table: Table) -> DataFrame:
    return spark.read.schema(VERSION).json(f"{table.path}/versions")


def current(spark: SparkSession, table: Table, version: int | None = None) -> tuple[int, dict[str, str]]:
    """A version's number (the last, unless one is named) and its folders by slice: a row for each slice, not for each file."""
    if not exists(spark, f"{table.path}/versions"):
        return 0, {}
    rows = versions(spark, table)
    last = rows.where(F.col("version") == version) if version is not None else rows.orderBy(F.desc("version")).limit(1)
    found = last.first()
    if found is None:
        raise ValueError(f"{table.path} has no version {version}")
    return found.version, {s.slice: s.folder for s in found.slices}


def _write(table: Table, rows: DataFrame, version: int) -> dict[str, str]:
    """Rows as new folders, clustered: a slice's rows are in order over its files, and a large slice is several tasks and files."""
    folder = f"{table.path}/data/v={version}"
    keys = list(dict.fromkeys(["slice", table.by, *table.order]))
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").partitionBy("slice").parquet(folder)
    spark = rows.sparkSession
    made = spark.read.schema(T.StructType([*rows.drop("slice").schema.fields, T.StructField("slice", T.StringType())])).parquet(folder)
    return {r["slice"]: f"{folder}/slice={r['slice']}" for r in made.select("slice").distinct().collect()}


def _switch(spark: SparkSession, table: Table, version: int, slices: dict[str, str]) -> int:
    """The one step that makes a version visible: a file that is renamed into place. A version that is there already isn't replaced, so of two writers the
    second fails."""
    row = spark.createDataFrame([(version, sorted(slices.items()))], VERSION)
    row.coalesce(1).write.mode("errorifexists").json(f"{table.path}/versions/number={version}")
    return version


def create(table: Table, rows: DataFrame) -> int:
    return _switch(rows.sparkSession, table, 1, _write(table, table.sliced(rows), 1))


def _folders(spark: SparkSession, table: Table, folders: dict[str, str], schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("basePath", f"{table.path}/data")
    rows = (reader.schema(schema) if schema else reader).parquet(*folders.values()) if folders else spark.createDataFrame([], schema)
    return rows.withColumn("slice", F.col("slice").cast("string")).drop("v")


def read(spark: SparkSession, table: Table, version: int | None = None) -> DataFrame:
    return _folders(spark, table, current(spark, table, version)[1]).drop("slice")


def scan(spark: SparkSession, table: Table, keys: list | None = None, low: object = None, high: object = None, where: Column | None = None, columns: list[str] | None = None, without: tuple[str, ...] = ()) -> DataFrame:
    """Rows of some keys with the first order column between low and high (each may be open), that meet `where`, with `columns` or all
    but `without`.

    The keys name their slices before anything is read, so that only these folders are listed and opened; bounds and keys go down to the
    row groups, whose ranges are narrow because slices are clustered; only the columns asked for are read.
    """
    rows = _folders(spark, table, current(spark, table)[1])
    if keys is not None:
        kind = rows.schema[table.by].dataType
        values = [F.lit(k).cast(kind) for k in keys]
        of = {r[0] for r in spark.range(1).select(F.explode(F.array(*[table.slice_of(v) for v in values]))).collect()} if keys else set()
        rows = rows.where(F.col("slice").isin(sorted(of)) & F.col(table.by).isin(*keys)) if keys else rows.where(F.lit(False))
    for bound, test in ((low, F.col(table.order[0]).__ge__ if table.order else None), (high, F.col(table.order[0]).__le__ if table.order else None)):
        rows = rows.where(test(bound)) if bound is not None else rows
    rows = rows.where(where) if where is not None else rows
    return rows.select(*(columns if columns is not None else [c for c in rows.columns if c not in {"slice", *without}]))


def upsert(table: Table, incoming: DataFrame, keys: list[str], order: list[str]) -> int:
    """Insert or replace rows by key, the last in `order` of incoming's rows for a key; returns the table's version then.

    Only slices with a row that differs are written anew, the others keep their folders; what changes nothing makes no version, so that a
    run may be repeated. `keys` include the column that slices follow, and aren't null.
    """
    spark = incoming.sparkSession
    version, folders = current(spark, table)
    old = _folders(spark, table, folders)
    new = table.sliced(latest_wins(incoming.select(*[c for c in old.columns if c != "slice"]), keys, order)).persist()
    try:
        touched = [r["slice"] for r in new.select("slice").distinct().collect()]
        there = old.where(F.col("slice").isin(touched))
        columns = [c for c in old.columns if c != "slice"]
        a, b = new.alias("a"), there.alias("b")
        same = F.lit(True)
        for c in columns:
            same = same & (F.col(f"a.{c}") == F.col(f"b.{c}") if c in keys else F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")))
        changed = [r["slice"] for r in a.join(b, same, "left_anti").select("slice").distinct().collect()]
        if not changed:
            return version
        kept = there.where(F.col("slice").isin(changed)).join(new.select(*keys), keys, "left_anti")
        rows = new.where(F.col("slice").isin(changed)).unionByName(kept)
        return _switch(spark, table, version + 1, folders | _write(table, rows, version + 1))
    finally:
        new.unpersist()


def replace(table: Table, rows: DataFrame) -> int:
    """Put rows in the place of all that their slices had; slices that rows lacks stay. With a slice for each value this replaces whole
    partitions, all at once."""
    spark = rows.sparkSession
    version, folders = current(spark, table)
    return _switch(spark, table, version + 1, folders | _write(table, table.sliced(rows), version + 1))


def expire(spark: SparkSession, table: Table, keep: int = 1) -> list[str]:
    """Delete what only versions before the last `keep` name, and what no version names; returns the folders that went."""
    rows = versions(spark, table).orderBy(F.desc("version")).limit(keep).collect()
    used = {s.folder for r in rows for s in r.slices}
    listed = spark.read.option("basePath", f"{table.path}/data").parquet(f"{table.path}/data").select("v", F.col("slice").cast("string").alias("slice")).distinct().collect()
    gone = sorted(f for f in (f"{table.path}/data/v={r.v}/slice={r['slice']}" for r in listed) if f not in used)
    for folder in gone:
        remove(spark, folder)
    for r in versions(spark, table).select("version").collect():
        if r.version not in {x.version for x in rows}:
            remove(spark, f"{table.path}/versions/number={r.version}")
    return gone
