"""Whitening of embeddings by a tall-skinny QR: exact sums, a factor for each partition, factors merged in a tree, SVD of the last.

The covariance of the vectors is never formed: with centred rows X and X = QR, the right singular vectors of R are the covariance's
eigenvectors and its singular values, squared over n, the eigenvalues.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convlake.llm.common import clear, settle

SHIFT = 1_000_000
FAN = 8  # factors that one task merges
HALF = 31  # bits of the low half in which longs are summed up
CELLS = 1 << 20  # doubles that a step over a batch's rows holds
MOST = 1 << 62  # a component beyond is no long


def integers(column: pa.Array | pa.ChunkedArray, width: int = 0, scale: float = 64) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors take part, and their floor(scale * c) + SHIFT as rows of longs, shorter vectors filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    if not n:
        return np.zeros(0, bool), np.zeros((0, width), np.int64)
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    value = np.asarray(column.flatten().cast(pa.float64()).fill_null(float("nan")), float)
    owner, place = np.repeat(np.arange(n), size), np.arange(len(value)) - np.repeat(np.cumsum(size) - size, size)
    value = np.where(np.isfinite(value), value, np.inf)
    with np.errstate(over="ignore"):
        value = np.floor(scale * value)
    good = ~np.asarray(column.is_null())
    good[owner[~(np.abs(value) < MOST)]] = False
    rows = np.zeros((n, max(width, int(size.max(initial=0)))), np.int64)
    rows[owner, place] = np.where(good[owner], value, 0).astype(np.int64)
    return good, rows + SHIFT


def centred(rows: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Rows less the mean, as doubles: the mean's whole part goes in longs, so only what is small is rounded."""
    base = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (rows - base).astype(float) - rest


def deviations(rows: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over dimensions of (n * x - S)**2 of each row, exactly; None where no long holds it."""
    if not rows.size:
        return [0] * len(rows)
    base, rest = np.array([s // n for s in sums], np.int64), [s % n for s in sums]
    less = rows - base
    top = (int(np.abs(less).max()) + 1) * n
    if top * top * len(sums) < 1 << 63:
        return (((n * less - np.array(rest, np.int64)) ** 2).sum(1)).tolist()
    exact = n * less.astype(object) - np.array(rest, object)
    return [d if d < 1 << 63 else None for d in (exact * exact).sum(1)]


def triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


@dataclass
class Whitening:
    """A fit: rows, exact sums by dimension, unit components (one a column, by falling eigenvalue), eigenvalues, their total."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    scale: float = 64

    def apply(self, rows: np.ndarray) -> np.ndarray:
        return centred(rows, self.n, self.sums) @ (self.components / np.sqrt(self.eigenvalues))


def fit(vectors: DataFrame, vector: str = "embedding", components: int = 32, scale: float = 64) -> Whitening:
    """Learn the whitening of floor(scale * c) + SHIFT from all vectors of the table.

    Null vectors and those with null or non-finite entries (or ones whose scaled size is 2**62 or more, which no long holds) take no
    part; shorter vectors are filled up with zeros. Components whose eigenvalue is zero up to rounding are left out, so one row,
    or equal rows, give a fit without components, and so does an empty table.

    Three passes' worth of work in two scans: exact sums (longs in two halves, added up as decimals), then centred rows whose factor R
    is kept per partition and merged by FAN in a tree; what travels are width x width factors, however many rows there are. The
    driver gets the sums and the last factor.
    """
    own = vectors.select(F.col(vector).cast("array<double>").alias("v"))
    low = (1 << HALF) - 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, rows = integers(batch.column(0), scale=scale)
            rows = rows[good]
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows.shape[1], dtype=np.int32)), pa.array((rows >> HALF).sum(0)), pa.array((rows & low).sum(0)), pa.array(np.full(rows.shape[1], len(rows), np.int64))], names=["dim", "high", "low", "n"])
                if not rows.shape[1]:  # vectors without a dimension are counted too
                    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([len(rows)], pa.int64())], names=["dim", "high", "low", "n"])

    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    got = own.mapInArrow(add, "dim int, high long, low long, n long").groupBy("dim").agg(wide("high").alias("high"), wide("low").alias("low"), F.sum("n").alias("n")).orderBy("dim").collect()
    n = sum(r.n for r in got if r.dim <= 0)
    width = max((r.dim + 1 for r in got), default=0)
    if not width:
        return Whitening(n, [], np.zeros((0, 0)), np.zeros(0), 0.0, scale)
    # a batch of shorter vectors lacks the dimensions beyond them: there each row counts as SHIFT
    sums = [(int(r.high) << HALF) + int(r.low) + (n - r.n) * SHIFT for r in got if r.dim >= 0]

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            good, rows = integers(batch.column(0), width, scale)
            rows = rows[good]
            step = max(4 * width, CELLS // width)
            for at in range(0, len(rows), step):
                r = triangle(np.vstack([r, centred(rows[at : at + step], n, sums)]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    def merge(table: pa.Table) -> pa.Table:
        r = np.zeros((0, width))
        for b in table.column("r"):
            r = triangle(np.vstack([r, np.frombuffer(b.as_py()).reshape(-1, width)]))
        return pa.table([pa.array([table.column("node")[0].as_py() // FAN], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["node", "r"])

    factors = own.mapInArrow(factor, "r binary").withColumn("node", F.spark_partition_id().cast("long"))
    # the number of factors is known once they are there: one small row a partition
    factors = settle(factors)
    most = (factors.agg(F.max("node")).first()[0] or 0) + 1
    tree = factors.select(F.expr(f"node div {FAN}").alias("node"), "r")
    while most > FAN:
        tree = tree.groupBy("node").applyInArrow(merge, "node long, r binary")
        most = -(-most // FAN)
    last = tree.groupBy("node").applyInArrow(merge, "node long, r binary").first()
    _, s, right = np.linalg.svd(np.frombuffer(last.r).reshape(-1, width), full_matrices=False)
    e = s * s / n
    keep = min(components, int((s > s[0] * max(n, width) * np.finfo(float).eps).sum()) if len(s) and s[0] > 0 else 0)
    return Whitening(n, sums, np.ascontiguousarray(right[:keep].T), e[:keep], float(e.sum()), scale)


def whiten(vectors: DataFrame, model: Whitening, vector: str = "embedding") -> DataFrame:
    """The rows that take part, with all their columns, `deviation` long (null where no long holds it) and `whitened` array<double>,
    one entry a component; columns of these names are replaced."""
    kept = clear(vectors, "deviation", "whitened")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in kept.schema] + [T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    at, width = kept.columns.index(vector), len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, CELLS // max(width, 1))
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                good, rows = integers(part.column(at), width, model.scale)
                part, rows = part.filter(pa.array(good)), rows[good]
                out = model.apply(rows) if model.components.size else np.zeros((len(rows), 0))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(deviations(rows, model.n, model.sums), pa.int64()), lists], names=schema.names)

    return kept.mapInArrow(run, schema)


def identity_error(whitened: DataFrame, n: int, components: int) -> float:
    """The largest absolute entry of the whitened vectors' covariance (divisor n) minus the identity, measured on the vectors."""
    if not n or not components:
        return 0.0

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(components), np.zeros((components, components))
        for batch in batches:
            w = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, components)
            total += w.sum(0)
            products += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(components * (components + 1), dtype=np.int32)), pa.array(np.r_[total, products.ravel()])], names=["i", "x"])

    got = whitened.select("whitened").mapInArrow(moments, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    x = np.array([r.x for r in got])
    mean = x[:components] / n
    return float(np.abs(x[components:].reshape(components, components) / n - np.outer(mean, mean) - np.eye(components)).max())


def whitening_report(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 32) -> DataFrame:
    """(key, component from 1, n, deviation, whitened, explained, identity_error): a row for each vector that takes part and component.

    See fit() for rows that take no part; null and repeated keys, and repeated vectors, are rows like any other. A table
    without components (no row, one row, equal rows) gives no rows.
    """
    vectors = vectors.select(key, vector)
    model = fit(vectors, vector, components)
    many = len(model.eigenvalues)
    rows = whiten(vectors, model, vector)
    error = identity_error(rows, model.n, many)
    if not math.isfinite(error):
        raise ArithmeticError("the whitened vectors are beyond a double's range")
    explained = F.array(*[F.lit(float(x / model.trace)) for x in model.eigenvalues]) if many else F.array().cast("array<double>")
    out = rows.select(key, "deviation", F.posexplode(F.arrays_zip(F.col("whitened").alias("w"), explained.alias("x"))).alias("i", "both"))
    return out.select(key, (F.col("i") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("both.w").alias("whitened"), F.col("both.x").alias("explained"), F.lit(error).alias("identity_error"))
