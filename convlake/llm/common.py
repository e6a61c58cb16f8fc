"""Helpers that several operators share: reliable checkpoints, distributed prefix sums, connected components."""

from __future__ import annotations

import gc

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convlake.session import ready

TASK_ROWS = 20_000  # rows of a few numbers that are one task's work

def settle(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there: lineage ends, rows are fixed."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let go of what the rounds so far have left: Spark drops broadcasts, shuffle files and checkpoints when the driver collects its
    garbage, which in a row of many short queries may be long after the last use. Nor does memory that the driver freed outside its heap
    go back to the system by itself."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> None:
    """Give back what the driver's JVM freed outside its heap, which the C library keeps for each of the JVM's many threads: the JVM's own
    command System.trim_native_heap. A JVM without it keeps that memory."""
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array

    def array(kind, *items):
        out = new(kind, len(items))
        for i, x in enumerate(items):
            out[i] = x
        return out

    named = jvm.java.lang.Class.forName
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    kinds = map(named, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"))
    invoke = named("javax.management.MBeanServer").getMethod("invoke", array(jvm.java.lang.Class, *kinds))
    try:
        invoke.invoke(server, array(jvm.java.lang.Object, commands, "systemTrimNativeHeap", None, None))
    except Py4JJavaError:  # no such command
        pass


def fitted(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A settled table in one partition for each TASK_ROWS of its rows, if it has more: a small table of many partitions costs a task, and
    the driver's memory, for each of them at every step, and what lies in one partition needs no exchange. rows: their number, if known."""
    n = df.count() if rows is None else rows
    return df.coalesce(max(1, -(-n // TASK_ROWS)))


def clear(df: DataFrame, *names: str) -> DataFrame:
    """Without the columns whose names an operator adds itself: its own columns replace them."""
    own = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in own])


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def with_offsets(df: DataFrame, keys: list[str], order: list[str], weight: str, out: str, rows_per_bucket: int = 20_000, rows: int | None = None) -> DataFrame:
    """Exclusive running sum of `weight` within `keys`, spread over many tasks however large one key is.

    Rows fall into buckets by a hash of `order` (a total order within a key); bucket totals are summed over buckets, and rows
    within their own bucket. `df` should be settled: it is read twice. Keys must not be null.
    """
    n = df.count() if rows is None else rows
    buckets = max(16, -(-n // rows_per_bucket))
    df = df.withColumn("__b", F.pmod(F.xxhash64(F.lit(7), *order), F.lit(buckets)))
    within = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, "__b").agg(F.sum(weight).alias("__t"))
    totals = totals.withColumn("__base", F.coalesce(F.sum("__t").over(before), F.lit(0))).drop("__t")
    df = df.withColumn("__in", F.coalesce(F.sum(weight).over(within), F.lit(0)))
    return df.join(totals, [*keys, "__b"]).withColumn(out, (F.col("__base") + F.col("__in")).cast("long")).drop("__b", "__base", "__in")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) of the nodes in edges (a, b); component is the smallest node reachable.

    Alternating large and small stars; every round is a join and an aggregation on nodes, and nothing comes to the driver but
    counts. Hubs are split by adaptive skew joins. A round's edges lie in as many partitions as the first ones need, since a round
    makes at most two of one.
    """
    e = settle(edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where("a <> b").distinct())
    n = 2 * e.count()
    e = fitted(e, n)
    for _ in range(most):
        both = e.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        e = settle(fitted(large.join(small, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct(), n))
        # settled: each node has one parent and no parent has a parent
        roles = e.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("c"), F.lit(0).alias("p")), F.struct(F.col("b").alias("n"), F.lit(0).alias("c"), F.lit(1).alias("p")))).alias("r")).select("r.*")
        if roles.groupBy("n").agg(F.sum("c").alias("c"), F.max("p").alias("p")).where("c > 1 or (c > 0 and p > 0)").isEmpty():
            break
        release(edges.sparkSession)
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
