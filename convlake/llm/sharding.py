"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix (DataFrame and SQL functions only)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convlake.llm.common import clear, settle

LOCAL = (1 << 33) - 1  # monotonically_increasing_id keeps the row number within its partition in these bits


def _ln_factorial(n: str) -> str:
    """ln(n!) by Stirling's series, shifted by ten."""
    z = f"({n} + 10D)"
    less = " * ".join(f"({n} + {i}D)" for i in range(1, 11))
    return f"({z} * ln({z}) - {z} + 0.5D * ln({2 * math.pi}D * {z}) + 1D / (12D * {z}) - 1D / (360D * {z} * {z} * {z}) - ln({less}))"


def _choose(n: str, k: str) -> str:
    return f"({_ln_factorial(n)} - {_ln_factorial(k)} - {_ln_factorial(f'({n} - {k})')})"


def _draw(good: str, bad: str, n: str, u: str) -> str:
    """SQL of one hypergeometric draw by inversion: how many of n rows taken from good + bad places are among the good ones.

    The sum runs over eight standard deviations and a margin about the mode; what lies outside has a probability below 1e-14.
    """
    spread = "(8D * sqrt(q.n * (q.g + 1D) * (q.b + 1D) / ((q.g + q.b + 2D) * (q.g + q.b + 2D))) + 16D)"
    mode = "((q.n + 1D) * (q.g + 1D) / (q.g + q.b + 2D))"
    low = f"cast(greatest(0D, q.n - q.b, floor({mode} - {spread})) as bigint)"
    high = f"cast(least(q.n, q.g, ceil({mode} + {spread})) as bigint)"
    first = f"exp({_choose('r.g', 'r.a')} + {_choose('r.b', '(r.n - r.a)')} - {_choose('(r.g + r.b)', 'r.n')})"
    return f"""element_at(transform(array(named_struct('g', cast({good} as double), 'b', cast({bad} as double), 'n', cast({n} as double), 'u', {u})), q ->
      element_at(transform(array(named_struct('g', q.g, 'b', q.b, 'n', q.n, 'u', q.u, 'a', {low}, 'z', {high})), r ->
        aggregate(sequence(r.a, r.z), named_struct('c', 0D, 'f', {first}, 'k', -1L),
          (s, x) -> named_struct('c', s.c + s.f, 'f', s.f * ((r.g - x) * (r.n - x) / ((x + 1D) * (r.b - r.n + x + 1D))), 'k', if(s.k < 0 and s.c + s.f >= r.u, x, s.k)),
          s -> if(s.k < 0, r.z, s.k))), 1)), 1)"""


def _uniform(*parts: str) -> str:
    return f"((cast(shiftrightunsigned(xxhash64({', '.join(parts)}), 11) as double) + 0.5D) / 9007199254740992D)"


def _matrix_rows(seed: int, level: int, blocks: str, capacity: str, shards: int) -> str:
    """SQL folding over blocks (array of struct(id, n)): each block's counts by shard, drawn from the places still free."""
    good = "element_at(t.cap, i + 1)"
    one = f"""aggregate(sequence(0, {shards - 1}), named_struct('left', b.n, 'rest', aggregate(t.cap, 0L, (x, y) -> x + y), 'out', cast(array() as array<bigint>)),
        (w, i) -> element_at(transform(array({_draw(good, f'(w.rest - {good})', 'w.left', _uniform(f'{seed}L', f'{level}', 'b.id', 'i'))}), k ->
          named_struct('left', w.left - k, 'rest', w.rest - {good}, 'out', concat(w.out, array(k)))), 1), w -> w.out)"""
    return f"""aggregate({blocks}, named_struct('cap', {capacity}, 'rows', cast(array() as array<struct<id: bigint, counts: array<bigint>>>)),
        (t, b) -> element_at(transform(array({one}), o -> named_struct('cap', zip_with(t.cap, o, (x, y) -> x - y),
          'rows', concat(t.rows, array(named_struct('id', b.id, 'counts', o))))), 1), t -> t.rows)"""


def communication_matrix(counts: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """(id, counts array<long>): how many rows of each block go to each shard, for blocks (id, n).

    Column sums are the shard sizes (at most one apart), row sums the block sizes, and the law is that of a uniform permutation
    of all rows. Blocks are drawn in two levels, groups of about the square root of their number and then each group's own
    blocks in parallel; a group's row is a hypergeometric draw, and so are its blocks' given that row.
    """
    total, blocks = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    step = max(1, math.isqrt(max(blocks, 1)))
    ranked = counts.withColumn("g", F.pmod(F.col("id"), F.lit(step)).cast("long"))
    lists = ranked.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("blocks"), F.sum("n").alias("n"))
    places = "array(" + ", ".join(f"{total // shards + (s < total % shards)}L" for s in range(shards)) + ")"
    top = lists.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.col("g").alias("id"), "n"))).alias("all"))
    rows = top.select(F.expr(f"inline({_matrix_rows(seed, 1, '`all`', places, shards)})")).toDF("g", "cap")
    return lists.join(rows, "g").select(F.expr(f"inline({_matrix_rows(seed, 2, 'blocks', 'cap', shards)})")).toDF("id", "counts")


def uniform_shards(df: DataFrame, shards: int = 16, seed: int = 20_011, rows_per_cell: int = 20_000) -> DataFrame:
    """All rows and columns of df, with `shard` int (0 to shards - 1) and `slot` long (0, 1, ... without gaps in its shard).

    A uniform shuffle: any arrangement of the rows over all slots is as likely as any other, and shard sizes differ by one row
    at most. Each input partition permutes its own rows, is cut by its row of the communication matrix, rows move to their
    shards, and are permuted again there. Equal rows, nulls and empty or long texts are rows like any other; an empty table
    gives an empty result. Columns named shard or slot in the input are replaced.

    Shards are cut into cells of about rows_per_cell rows, so no task holds a whole shard. The copy of the rows is written
    once; a lost executor re-reads it and gets the same permutation.
    """
    df = clear(df, "shard", "slot")
    key = F.xxhash64(F.lit(seed), F.monotonically_increasing_id())
    mine = df.withColumn("__block", F.spark_partition_id().cast("long")).withColumn("__key", key)
    mine = mine.sortWithinPartitions("__key").withColumn("__rank", F.monotonically_increasing_id().bitwiseAND(F.lit(LOCAL))).drop("__key")
    mine = settle(mine)
    counts = settle(mine.groupBy(F.col("__block").alias("id")).agg(F.count("*").alias("n")))
    matrix = communication_matrix(counts, shards, seed)
    # the block's shard bounds, running from 0
    bounds = F.expr("aggregate(counts, array(0L), (a, c) -> concat(a, array(element_at(a, -1) + c)))")
    cut = settle(matrix.select(F.col("id").alias("__block"), bounds.alias("__cut")))
    sent = mine.join(cut, "__block").withColumn("shard", F.expr("cast(size(filter(slice(__cut, 2, size(__cut) - 2), c -> c <= __rank)) as int)"))
    n = counts.agg(F.sum("n")).first()[0] or 0
    cells = max(4, -(-n // (shards * rows_per_cell)))
    second = F.xxhash64(F.lit(seed + 1), "__block", "__rank")
    sent = sent.withColumn("__key", second).withColumn("__cell", F.pmod(F.xxhash64(F.lit(seed + 2), "__key"), F.lit(cells)))
    # cell sizes are known from the narrow columns alone
    before = Window.partitionBy("shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    base = sent.groupBy("shard", "__cell").agg(F.count("*").alias("__n"))
    base = base.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    order = Window.partitionBy("shard", "__cell").orderBy("__key", "__block", "__rank")
    slot = sent.withColumn("__in", F.row_number().over(order) - 1).join(base, ["shard", "__cell"])
    return slot.withColumn("slot", (F.col("__base") + F.col("__in")).cast("long")).select(*df.columns, "shard", "slot")
