"""Ordered folds: one pass over each key's rows in order, with only the fold's own state in memory, however long a key is."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from convlake.session import ready

OUT = 2048  # rows that are handed on at once


class Fold(Protocol):
    """The state of one key: `add` takes a row and returns the rows it completes, `finish` returns what is left."""

    def add(self, row: dict) -> list[dict]: ...

    def finish(self) -> list[dict]: ...


def key_runs(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[int, int]]:
    """First row and row after the last of each stretch of rows with equal keys."""
    new = np.zeros(batch.num_rows, bool)
    for k in keys:
        codes = batch.column(batch.schema.get_field_index(k)).dictionary_encode("encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    cuts = np.r_[0, np.flatnonzero(new), batch.num_rows]
    yield from zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], make: Callable[[dict], Fold], schema: T.StructType | str) -> DataFrame:
    """Rows of df by keys, in order, through a Fold that `make` builds from a key's first row.

    Rows are shuffled once by key and sorted within partitions; a key's rows stream through a stretch at a time, so that a key may
    be any size. A fold with `add_many` gets whole stretches as record batches, others row by row.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)
    ready(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple | None = None
        fold: Fold | None = None
        out: list[dict] = []
        for batch in batches:
            for start in range(0, batch.num_rows, OUT):
                part = batch.slice(start, OUT)
                for low, high in key_runs(part, keys):
                    rows = part.slice(low, high - low)
                    first = rows.slice(0, 1).to_pylist()[0]
                    key = tuple(first[k] for k in keys)
                    if fold is None or key != current:
                        out += fold.finish() if fold is not None else []
                        current, fold = key, make(first)
                    if hasattr(fold, "add_many"):
                        out += fold.add_many(rows)
                    else:
                        for row in rows.to_pylist():
                            out += fold.add(row)
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
        out += fold.finish() if fold is not None else []
        yield pa.RecordBatch.from_pylist(out, schema=arrow)

    by = [F.desc(o.removesuffix(" desc")) if o.endswith(" desc") else F.col(o) for o in order]
    return df.repartition(*keys).sortWithinPartitions(*keys, *by).mapInArrow(run, schema)
