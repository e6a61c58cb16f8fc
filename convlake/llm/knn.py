"""Exact top-k inner products by a Voronoi join: pivots, bounds from cell summaries, queries sent only where they can gain."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convlake.llm.common import clear, settle

CELL_ROWS = 50_000  # rows for which there is one more pivot
PIVOTS = (32, 1024)
TILE = 1 << 14  # candidates, and queries, that one local task holds
GIANT = 1e140  # a scaled component from which squares and products may leave a double's range
APART = -1  # the cell of vectors that have such a component


def whole(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors take part (no null, no non-finite component), and their components as rows of doubles. Shorter vectors are
    filled up with zeros, which changes no inner product."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    if not n:
        return np.zeros(0, bool), np.zeros((0, 0))
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    value = np.asarray(flat.cast(pa.float64()).fill_null(float("nan")), float)
    owner, place = np.repeat(np.arange(n), size), np.arange(len(value)) - np.repeat(np.cumsum(size) - size, size)
    good = ~np.asarray(column.is_null())
    good[owner[~np.isfinite(value)]] = False
    rows = np.zeros((n, int(size.max(initial=0))))
    rows[owner, place] = np.where(good[owner], value, 0)
    return good, rows


def widen(rows: np.ndarray, width: int) -> np.ndarray:
    return np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


def scaled(rows: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as doubles: integers, or infinite beyond a double's range."""
    with np.errstate(over="ignore"):
        return np.floor(scale * rows)


def exact(x: float, scale: float) -> int:
    return math.floor(Fraction(float(x)) * Fraction(scale))


def low_bits(rows: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) modulo 2**64, as longs."""
    value = scaled(rows, scale)
    beyond = ~(np.abs(value) < 2.0**63)
    out = np.where(beyond, 0, value).astype(np.int64)
    for i, j in zip(*np.nonzero(beyond), strict=True):
        out[i, j] = np.uint64(exact(rows[i, j], scale) % (1 << 64)).astype(np.int64)
    return out


def inner(a: np.ndarray, b: np.ndarray, scale: float = 64) -> tuple[np.ndarray, np.ndarray]:
    """Integer inner products of floor(scale * x), exact, and which of them a long holds.

    In doubles where no sum can leave their exact range. Else modulo 2**64, which is the product wherever a long holds it; doubles
    and their rounding bound tell where, and integers of any size decide the pairs that they leave open.
    """
    width = max(a.shape[1], b.shape[1], 1)
    a, b = widen(a, width), widen(b, width)
    x, y = scaled(a, scale), scaled(b, scale)
    if float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * width < 2**53:
        return (x @ y.T).astype(np.int64), np.ones((len(a), len(b)), bool)
    with np.errstate(all="ignore"):
        score = low_bits(a, scale) @ low_bits(b, scale).T
        about, slack = x @ y.T, (width + 2) * 2.0**-52 * (np.abs(x) @ np.abs(y).T)
        holds = np.abs(about) + slack < 2.0**63
        for i, j in zip(*np.nonzero(~holds & ~(np.abs(about) - slack > 2.0**63)), strict=True):
            holds[i, j] = -(1 << 63) <= sum(exact(u, scale) * exact(v, scale) for u, v in zip(a[i], b[j], strict=True)) < 1 << 63
    return score, holds


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of doubles from their bytes."""
    rows = [np.frombuffer(b) for b in column.to_pylist()]
    width = max(map(len, rows), default=0)
    return np.array([r if len(r) == width else np.pad(r, (0, width - len(r))) for r in rows]).reshape(len(rows), width)


def mapped(values: dict[int, int], key: Column | str) -> Column:
    """A small mapping as a column; null where the key isn't in it."""
    pairs = [F.lit(x) for pair in values.items() for x in pair] or [F.lit(-1), F.lit(0)]
    return F.try_element_at(F.create_map(*pairs), F.col(key) if isinstance(key, str) else key)


def top_inner(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, every: int = 20, scale: float = 64, tile: int = TILE) -> DataFrame:
    """(query_id, rank from 1, key, score): for each row whose key is divisible by `every`, the k highest integer inner products of
    floor(scale * x) with all rows of other keys, ties to the smaller key.

    Every row is a candidate: equal rows each take their rank. Query rows with one key are ranked together, each with its own
    scores. Rows with a null key, a null vector, null or non-finite components take no part, and neither do single pairs whose
    score no long holds. Fewer candidates give fewer rows; an empty table gives an empty result.

    Pivots (a hashed sample of distinct vectors, at most PIVOTS[1]) part the space; each row goes to its nearest. Equal rows travel
    as one with their number. A cell is summed up by its radius and the k + 1 least distances to its pivot; with
    |q.x - q.p| <= |q| |x - p| these give each query a score that at least k rows of other keys reach, and each cell a score that no
    row exceeds. A query goes only to cells that can reach its score, and a cell's rows are replicated only as often as tiles of
    `tile` queries were sent to it, so a frequent vector or a crowded cell is many tasks; a last ranking by query takes k rows a tile.
    Vectors with scaled components of GIANT or more, for which doubles give no bounds, have a cell of their own that all queries
    reach, and as queries reach all cells.
    """
    rows = clear(vectors, *(set(vectors.columns) - {key, vector})).where(f"{key} is not null").select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = settle(rows)
    n = rows.count()
    many = min(PIVOTS[1], max(PIVOTS[0], n // CELL_ROWS))
    sample = rows.where("v is not null").orderBy(F.xxhash64("v"), "id").limit(many * 4).select("v").toPandas()["v"]
    good, found = whole(pa.array([list(x) for x in sample], pa.list_(pa.float64())))
    found = scaled(found, scale)
    pivots = np.unique(found[good & (np.abs(found) < GIANT).all(1)], axis=0)
    pivots = pivots[np.linspace(0, len(pivots) - 1, min(many, len(pivots))).astype(int)].astype(float) if len(pivots) else np.zeros((1, found.shape[1]))
    placed_schema = T.StructType.fromDDL("id long, x binary, cell int, far double")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, x = whole(batch.column(1))
            x = x[good]
            width = max(x.shape[1], pivots.shape[1])
            wide, p = widen(scaled(x, scale), width), widen(pivots, width)
            giant = ~(np.abs(wide) < GIANT).all(1)
            wide[giant] = 0
            apart = (wide * wide).sum(1)[:, None] - 2 * wide @ p.T + (p * p).sum(1)
            cell = apart.argmin(1) if len(x) else np.zeros(0, int)
            far = np.sqrt(((wide - p[cell]) ** 2).sum(1)) * (1 + 1e-12)
            cell[giant], far[giant] = APART, np.inf
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(cell.astype(np.int32)), pa.array(far)], names=placed_schema.names)

    # equal rows of one key become one, with their number
    placed = settle(rows.mapInArrow(place, placed_schema).groupBy("id", "x").agg(F.first("cell").alias("cell"), F.first("far").alias("far"), F.count("*").alias("m")))
    near = Window.partitionBy("cell", "part").orderBy("far", "id")
    # the least distances of a cell: first of its parts, then of the cell
    parts = placed.select("cell", F.pmod(F.xxhash64("id"), F.lit(64)).alias("part"), "far", "id").withColumn("r", F.row_number().over(near)).where(f"r <= {k + 1}")
    least = parts.withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy("far", "id"))).where(f"r <= {k + 1}").groupBy("cell").agg(F.array_sort(F.collect_list("far")).alias("near"))
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).join(least, "cell").orderBy("cell").collect()  # a row for each pivot at most
    number = np.array([c.cell for c in cells], int)
    radius = np.array([c.radius for c in cells])
    nearest = np.array([(list(c.near) + [np.inf] * (k + 1))[: k + 1] for c in cells]).reshape(len(cells), k + 1)
    tiles = {int(c.cell): -(-c.n // tile) for c in cells}
    queries = placed.where(F.pmod("id", F.lit(every)) == 0)
    queries = queries.join(queries.groupBy("id").agg(F.count("*").alias("same")), "id")
    sent_schema = T.StructType.fromDDL("cell int, id long, x binary, m long, floor double")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 128):
                part = batch.slice(low, 128)
                q = scaled(matrix(pa.chunked_array([part.column(1)])), scale)
                q = widen(q, max(pivots.shape[1], q.shape[1]))
                giant = ~(np.abs(q) < GIANT).all(1)
                q[giant] = 0
                norm = np.sqrt((q * q).sum(1))
                centre = widen(pivots[np.maximum(number, 0)], q.shape[1])
                mid = q @ centre.T
                # what rounding may cost, by query: a share of its largest possible products
                slack = 1e-6 + 1e-9 * norm * (1 + np.sqrt((centre * centre).sum(1)).max(initial=0) + radius[np.isfinite(radius)].max(initial=0))
                # a score that k rows of other keys reach at least: further down the promises where more rows have the query's key
                near = norm[:, None, None] * np.where(np.isinf(nearest), 0, nearest)
                # rows whose score a long may not hold promise nothing
                promise = np.where(np.isinf(nearest) | (mid[:, :, None] + near > 2.0**62), -np.inf, mid[:, :, None] - near).reshape(len(q), -1)
                promise.sort(axis=1)
                back = k + part.column(3).to_numpy()
                floor = np.where(back <= promise.shape[1], promise[np.arange(len(q)), -np.minimum(back, promise.shape[1])], -np.inf) - slack
                floor[giant] = -np.inf
                reach = mid + norm[:, None] * np.where(np.isinf(radius), 0, radius) + slack[:, None]
                row, cell = np.nonzero((reach >= floor[:, None]) | np.isinf(radius) | giant[:, None])
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(number[cell].astype(np.int32)), *[part.column(i).take(at) for i in (0, 1, 2)], pa.array(floor[row])], names=sent_schema.names)

    sent = settle(queries.select("id", "x", "m", "same").mapInArrow(send, sent_schema))
    chunks = {r.cell: -(-r["count"] // tile) for r in sent.groupBy("cell").count().collect()}
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    hashed = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "id", "x"), n).cast("int")
    sent = sent.withColumn("chunk", hashed(mapped(chunks, "cell"), 5)).withColumn("tile", each(mapped(tiles, "cell")))
    own = placed.where(mapped(chunks, "cell").isNotNull()).withColumn("tile", hashed(mapped(tiles, "cell"), 3)).withColumn("chunk", each(mapped(chunks, "cell")))
    keys, solved_schema = ["cell", "tile", "chunk"], T.StructType.fromDDL("query_id long, id long, score long, m long")

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(4)]
        if left.num_rows and right.num_rows:
            ids, x, times = right.column("id").to_numpy(), matrix(right.column("x")), right.column("m").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, x, times = ids[order], x[order], times[order]
            for low in range(0, left.num_rows, 256):
                part = left.slice(low, 256)
                own, floor, more = part.column("id").to_numpy(), part.column("floor").to_numpy(), part.column("m").to_numpy()
                score, holds = inner(matrix(part.column("x")), x, scale)
                fits = (score >= floor[:, None]) & (ids != own[:, None]) & holds
                if score.shape[1] > k:  # no lower than the k-th best; what is equal to it is ranked below
                    fits &= score >= np.partition(np.where(fits, score, np.iinfo(np.int64).min), -k, axis=1)[:, -k, None]
                row, at = np.nonzero(fits)
                order = np.lexsort((at, -score[row, at], row))
                row, at = row[order], at[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                row, at = row[place < k], at[place < k]
                for column, value in zip(out, (own[row], ids[at], score[row, at], np.minimum(times[at], k) * np.minimum(more[row], k)), strict=True):
                    column.append(value)
        return pa.table([pa.array(np.concatenate(c)) for c in out], names=solved_schema.names)

    solved = sent.groupBy(*keys).cogroup(own.select(*keys, "id", "x", "m").groupBy(*keys)).applyInArrow(solve, solved_schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    best = solved.withColumn("rank", rank).where(f"rank <= {k}")  # each stands for one row or more
    best = best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("m", F.lit(k)).cast("int")))).withColumn("rank", rank.cast("int")).where(f"rank <= {k}")
    return best.select("query_id", "rank", F.col("id").alias(key), "score")
