"""Retrieval: exact cosine top-k, neighbouring chunks, lexical re-ranking, context."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from convlake.functions.repair import repair_text
from convlake.functions.text import fixed_chunks, lexical_overlap, short_id, strip
from convlake.session import ready

PARENT = 0.92
LEXICAL = 0.04
TILE = 1 << 13  # rows of either side that meet in one task


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def unit_rows(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows divided by their length (zero vectors stay zero), shorter ones filled up with zeros, and which of them are whole:
    neither null nor with a null or non-finite component."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(lists)
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) if n else np.zeros(0, np.int64)
    flat = np.asarray(lists.flatten().cast(pa.float64()).fill_null(float("nan")), float) if n else np.zeros(0)
    owner, place = np.repeat(np.arange(n), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    rows = np.zeros((n, int(size.max(initial=0))))
    rows[owner, place] = flat
    good = ~np.asarray(lists.is_null(), bool) & np.isfinite(rows).all(1) if n else np.zeros(0, bool)
    length = np.sqrt((rows * rows).sum(1))
    return rows / np.where(length > 0, length, 1)[:, None], good


def best_of(q: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, score) of each query's k best rows by (score to six digits, id): one matrix product, and only rows that
    reach the k-th best are put in order."""
    width = max(q.shape[1], v.shape[1])
    score = np.pad(q, ((0, 0), (0, width - q.shape[1]))) @ np.pad(v, ((0, 0), (0, width - v.shape[1]))).T
    score = np.round(score, 6) + 0.0
    fits = score >= np.partition(score, -k, axis=1)[:, -k, None] if score.shape[1] > k else np.ones(score.shape, bool)
    row, at = np.nonzero(fits)
    order = np.lexsort((ids[at], -score[row, at], row))
    row, at = row[order], at[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], at[first], score[row[first], at[first]]


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 8, keys: tuple[str, ...] = (), tile: int = TILE) -> DataFrame:
    """(keys, query_id, rank, id, score): for each query the k vectors with the highest cosine, to six digits, ties to the smaller id.

    With `keys` (say, user and space) a query meets only vectors of its own. One plan whatever there are: the queries and the vectors of a key
    are dealt by hash into tiles of about `tile` rows, every tile of queries meets every tile of vectors in a task of its own as a
    product of two blocks, and k rows a query and task go on to the ranking. A key with few rows is one task; a frequent one is many. Vectors
    that are null or have null or non-finite components take no part; a vector without length has the score 0.
    """
    name = lambda df, side: df.select(*keys, F.col("query_id" if side == "q" else "id").alias(f"{side}_id"), F.col("vector").cast("array<double>").alias(f"{side}_vector"))
    q, v = name(queries, "q"), name(vectors, "v")
    if not keys:
        q, v = q.withColumn("__all", F.lit(0)), v.withColumn("__all", F.lit(0))
    by = list(keys) or ["__all"]
    tiles = lambda df, out: df.groupBy(*by).agg(F.ceil(F.count("*") / tile).cast("int").alias(out))
    counts = tiles(q, "q_tiles").join(tiles(v, "v_tiles"), by)  # only keys that both sides have
    own = lambda n, i: F.pmod(F.xxhash64(i), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = q.join(counts, by).withColumn("q_tile", own("q_tiles", "q_id")).withColumn("v_tile", every("v_tiles")).drop("q_tiles", "v_tiles")
    v = v.join(counts, by).withColumn("v_tile", own("v_tiles", "v_id")).withColumn("q_tile", every("q_tiles")).drop("q_tiles", "v_tiles")
    group = [*by, "q_tile", "v_tile"]
    v = v.select(*[F.col(c).alias(f"v_{c}") for c in group], "v_id", "v_vector")
    schema = T.StructType([*(queries.schema[c] for c in keys), T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("id", vectors.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    names = schema.names

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            (x, has), (y, good) = unit_rows(left.column("q_vector")), unit_rows(right.column("v_vector"))
            left, right, x, y = left.filter(pa.array(has)), right.filter(pa.array(good)), x[has], y[good]
            ids = right.column("v_id").combine_chunks()
            order = pc.rank(ids, sort_keys="ascending", tiebreaker="first").to_numpy().astype(np.int64) if len(ids) else np.zeros(0, np.int64)
            for low in range(0, len(x) if len(y) else 0, 256):
                row, at, score = best_of(x[low : low + 256], y, order, k)
                pick = pa.array(row + low)
                out.append(pa.table([*(left.column(c).take(pick) for c in keys), left.column("q_id").take(pick), ids.take(pa.array(at)), pa.array(score)], names=names))
        return pa.concat_tables(out) if out else arrow.empty_table()

    arrow = to_arrow_schema(schema)
    ready(queries.sparkSession)
    found = q.groupBy(*group).cogroup(v.groupBy(*[f"v_{c}" for c in group])).applyInArrow(solve, schema)
    rank = Window.partitionBy(*keys, "query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select(*keys, "query_id", "rank", "id", "score")


def neighbours(hits: DataFrame, chunks: DataFrame, width: int = 1) -> DataFrame:
    """(query_id, job_id, chunk_index, score, text) of the chunks about each hit: 0.92 of the best hit within `width`.

    Each hit names its neighbours' indexes, so that this is an equality join.
    """
    at = F.explode(F.sequence(F.greatest(F.col("chunk_index") - width, F.lit(0)), F.col("chunk_index") + width))
    near = hits.select("query_id", "job_id", at.alias("chunk_index"), "score").groupBy("query_id", "job_id", "chunk_index").agg(F.max("score").alias("best"))
    return near.join(chunks.select("job_id", "chunk_index", "text"), ["job_id", "chunk_index"]).withColumn("score", PARENT * F.col("best")).drop("best")


def merged(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """Hits, then parents that aren't hits; blank texts go."""
    columns = ["query_id", "job_id", "chunk_index", "text", "score"]
    both = hits.select(*columns, F.lit(0).alias("is_parent")).unionByName(parents.select(*columns, F.lit(1).alias("is_parent")))
    first = Window.partitionBy("query_id", "job_id", "chunk_index").orderBy("is_parent", F.desc("score"))
    return both.where(F.trim("text") != "").withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def ranked(rows: DataFrame, questions: DataFrame, most: int = 24) -> DataFrame:
    """Rows by score plus 0.04 for each question word they hold, then by words, later jobs and earlier chunks; the first `most`."""
    out = rows.join(questions.select("query_id", "question"), "query_id").withColumn("lexical", lexical_overlap("question", "text"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round(F.col("score") + LEXICAL * F.col("lexical"), 9)), F.desc("lexical"), F.desc("job_id"), "chunk_index")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("question")


def context(rows: DataFrame) -> DataFrame:
    """(query_id, context): the ranked passages under their numbers."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.trim("text"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x.line), "\n\n").alias("context"))


def vector_points(transcripts: DataFrame, size: int = 900, overlap: int = 150) -> DataFrame:
    """Points of a vector table (id, job_id, user_id, space_id, chunk_index, text, source) from transcripts (job_id, user_id, space_id,
    text): the repaired text in fixed chunks. An id follows from job and index, so that merge.upsert replaces what came before; a
    blank transcript gives none."""
    parts = transcripts.select("job_id", strip("user_id").alias("user_id"), strip("space_id").alias("space_id"), F.posexplode(fixed_chunks(repair_text("text"), size, overlap)).alias("chunk_index", "text"))
    return parts.select(short_id("job_id", "chunk_index").alias("id"), "job_id", "user_id", "space_id", "chunk_index", "text", F.lit("speech").alias("source"))


def parents_first(contexts: DataFrame) -> DataFrame:
    """Contexts by job and place: without a job first, without a place as if it were the first."""
    return contexts.orderBy(F.coalesce("job_id", F.lit("")), F.coalesce("chunk_index", F.lit(0)))
