"""Media columns: payloads stored as FLAC streams, read back and described."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from convlake.llm import flac
from convlake.llm.textkit import segments

FIELDS = [
    ("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()),
    ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()),
]


def padded(payload: bytes) -> bytes:
    """Spaces up to a positive multiple of the frame length; an empty payload becomes one frame of spaces."""
    return payload.ljust(max(flac.BLOCK, -(-len(payload) // flac.BLOCK) * flac.BLOCK), b" ")


def feature(samples: bytes) -> str:
    """Peak, mean square and sign changes of the signed samples, and the frames: integers, so equal payloads agree anywhere."""
    x = np.frombuffer(samples, np.uint8).astype(np.int16) - 128
    wide = x.astype(np.int64)
    turns = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"frames={len(x) // flac.BLOCK};peak={int(np.abs(x).max())};energy={int(wide @ wide)};sum={int(wide.sum())};turns={turns}"


def store_payloads(rows: DataFrame, key: str = "doc_id", payload: str = "payload", keep_media: bool = True) -> DataFrame:
    """Each row's payload (binary) stored as a FLAC stream and read back from it; one row out per row in, nothing is shuffled.

    Columns: key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature and, with keep_media,
    the stream itself as `media`. All but n_bytes and the media's own come from the decoded samples. A null payload is empty; null
    keys and repeated rows are rows like any other; other columns are left out. A stream that doesn't decode to its own checksums
    raises flac.Damaged.
    """
    fields = [T.StructField(n, t) for n, t in FIELDS] + [T.StructField("media", T.BinaryType())] * keep_media
    schema = T.StructType([rows.schema[key], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in segments(batch.column(1), 1 << 20):
                raw = data.tobytes()
                texts = [raw[offsets[i] : offsets[i + 1]] for i in range(high - low)]
                streams = flac.encode([padded(t) for t in texts])
                back = flac.decode(streams)
                columns = [
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([len(p) for p in back], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in back]),
                    pa.array([zlib.crc32(p[-16:]) for p in back], pa.int64()),
                    pa.array([len(s) for s in streams], pa.int64()),
                    pa.array([hashlib.sha256(s).hexdigest() for s in streams]),
                    pa.array([feature(p) for p in back]),
                ]
                columns += [pa.array(streams, pa.binary())] * keep_media
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *columns], names=schema.names)

    return rows.select(key, payload).mapInArrow(run, schema)
