"""Keyed tables without an index: first or latest row wins, snapshots, expiry, pages and tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key: the first to arrive."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def latest_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the last in `order`, by an aggregation that combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*")


def insert_absent(target: DataFrame, incoming: DataFrame, keys: list[str], order: list) -> DataFrame:
    """target and, of incoming, the first row of each key that target doesn't have."""
    return target.unionByName(first_wins(incoming, keys, order).join(target.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def upsert(target: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """incoming's latest rows, and target's where incoming has none of their key."""
    latest = latest_wins(incoming, keys, order)
    return latest.unionByName(target.join(latest.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def replace_partition(df: DataFrame, path: str, partition: list[str]) -> None:
    """Write df over its own partitions of a Parquet table; the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def update_where(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """A snapshot in which the rows that meet the condition have new values."""
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def with_expiry(df: DataFrame, at: str, days: int = 30) -> DataFrame:
    return df.withColumn("expires_at", F.col(at) + F.make_dt_interval(F.lit(days)))


def unexpired(df: DataFrame, now: Column) -> DataFrame:
    return df.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def page(df: DataFrame, at: str, key: str, size: int, after: tuple | None = None) -> DataFrame:
    """A page of rows by (at, key) downwards, from after a cursor, and one more row that tells whether there are others."""
    if after is not None:
        when, last = map(F.lit, after)
        when = when.cast(df.schema[at].dataType)
        df = df.where((F.col(at) < when) | ((F.col(at) == when) & (F.col(key) < last)))
    return df.orderBy(F.desc(at), F.desc(key)).limit(size + 1)


def last_rows(df: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """The last `most` rows of each key, numbered from 1 in order."""
    back = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    kept = df.withColumn("__n", F.row_number().over(back)).where(F.col("__n") <= most).drop("__n")
    return kept.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def distinct_sources(tables: dict[str, DataFrame], column: str) -> DataFrame:
    """(value, sources): each value of a column in any of the tables, and which have it."""
    parts = [df.select(F.col(column).alias("value"), F.lit(n).alias("source")).where("value is not null").distinct() for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("value").agg(F.array_sort(F.collect_list("source")).alias("sources"))
