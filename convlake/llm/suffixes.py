"""Removal of repeated byte strings: a distributed merge sort of sampled suffixes, front-coded, merged without re-comparing prefixes.

A text has one suffix for every byte, far too many to exchange. Of the positions in each window of `length` bytes one is an anchor:
the place of the least hashed K-gram (leftmost if several). Equal windows have their anchor at the same place, so any string of
`length` bytes that two documents share has an anchor in both, with equal bytes on either side. Only anchors' suffixes are sorted,
each with as many bytes on either side as the windows that it is the anchor of. An anchor's windows are of two sides, those that begin
at most `middle` bytes before it and the others: all windows of a side share about two thirds of their bytes, so an anchor goes about
for a side only if these bytes occur more than once anywhere.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from convlake.llm.common import clear, settle
from convlake.llm.textkit import U, mix, segments

K = 16
BLOCK = 1 << 23  # bytes of text in a block
PLACE = (1 << 15) - 1
SCAN = PLACE - 255  # starts at a time: few enough that what is computed of them stays in the processor's cache, and a place takes 15 bits
SLICE = 1 << 14  # positions whose surroundings are put together at a time
PRINT_BITS = 40
CROWDED = 400  # different surroundings of a side's bytes from which on its windows go about singly
LAST = (1 << 63) - 1  # a null key comes after all others
_STEP = 0x9E3779B97F4A7C15


def squeeze(*arrays: np.ndarray, level: int = 1) -> bytes:
    parts = [a.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=level).compress(struct.pack(f"<{len(parts)}q", *map(len, parts)) + b"".join(parts))


def expand(blob: bytes, *types: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = struct.unpack(f"<{len(types)}q", raw[: 8 * len(types)])
    out, at = [], 8 * len(types)
    for t, n in zip(types, sizes, strict=True):
        out.append(np.frombuffer(raw, t, n // np.dtype(t).itemsize, at))
        at += n
    return out


def planes(values: np.ndarray) -> np.ndarray:
    """The bytes of unsigned 32-bit numbers, all lowest bytes first: the higher ones then compress away."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)


def unplanes(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def grams(data: np.ndarray) -> np.ndarray:
    """32-bit hashes of the K bytes from each position, put together from runs of 1, 2, 4, ... bytes."""
    h, size, power = data.astype(np.uint32), 1, _STEP & 0xFFFFFFFF
    while size < K:
        h = h[:-size] * np.uint32(power) + h[size:]
        size, power = size * 2, power * power % (1 << 32)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    h *= np.uint32(0x297A2D39)
    return h


def pieces(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the `size` bytes from each position, 8 at least, which are read 8 at a time."""
    longs = np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data), strides=(1,))
    h = np.zeros(len(at), np.uint64)
    for i in (*range(0, size - 8, 8), size - 8):
        h = mix(h * U(_STEP) + longs[at + i])
    return h


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors in order, and the first and the last start of the windows within one text that have each as their anchor."""
    n, span, none = len(data), length - K + 1, np.empty(0, np.int64)
    if n < length:
        return none, none, none
    v = grams(data)
    v &= np.uint32(0xFFFFFFFF ^ PLACE)
    v |= np.arange(len(v), dtype=np.uint32)
    width = 1
    while width * 2 <= span:
        v = np.minimum(v[: len(v) - width], v[width:])
        width *= 2
    if width < span:
        v = np.minimum(v[: len(v) - (span - width)], v[span - width :])
    v &= np.uint32(PLACE)  # never falls from one window to the next
    new = np.empty(len(v) + 1, bool)
    new[0] = new[-1] = True
    np.not_equal(v[1:], v[:-1], out=new[1:-1])
    ends = offsets[1:] - (length - 1)  # after the last window of each text
    new[offsets[:-1][offsets[:-1] < len(v)]] = True
    new[ends[ends > 0]] = True
    cuts = np.flatnonzero(new)
    first, after = cuts[:-1], cuts[1:]
    ok = np.flatnonzero(first < ends[np.searchsorted(offsets, first, "right") - 1])  # windows that end within their text
    return v[first[ok]].astype(np.int64), first[ok], after[ok] - 1


def all_anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """anchors(), a stretch of SCAN starts at a time, whatever texts lie in it; stretches overlap by a window less a byte."""
    found = [(np.empty(0, np.int64),) * 3]
    for low in range(0, max(0, len(data) - length + 1), SCAN):
        high = min(len(data), low + SCAN + length - 1)
        inner = offsets[np.searchsorted(offsets, low, "right") : np.searchsorted(offsets, high, "left")] - low
        found.append(tuple(x + low for x in anchors(data[low:high], np.r_[0, inner, high - low], length)))
    at, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
    new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.empty(0, np.int64)  # one anchor of two stretches
    return at[new], first[new], last[np.r_[new[1:], len(at)] - 1] if len(at) else new


def blocks(docs: DataFrame, key: str, text: str, others: list[str]) -> DataFrame:
    """(block, keys, data, rest): texts put together in rows of about BLOCK bytes, with their offsets, compressed; rest has the rows'
    other columns, and whether the text is null, as an Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).cast(pa.int64())
            for low, high, data, offsets in segments(batch.column(1), BLOCK):
                own = keys.slice(low, high - low)
                nulls = np.asarray(own.is_null())
                blob = squeeze(offsets, np.asarray(data), nulls, level=3)
                sink = pa.BufferOutputStream()
                if others:
                    rows = batch.slice(low, high - low).select(range(2, batch.num_columns))
                    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                        writer.write_batch(rows)
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (own.fill_null(LAST).to_numpy().tobytes(), blob, sink.getvalue().to_pybytes())], names=["keys", "data", "rest"])

    rest = [F.col(c) for c in others] + [F.col(text).isNull().alias("__null")] * bool(others)
    out = docs.select(F.col(key).cast("long").alias("__key"), F.coalesce(text, F.lit("")).alias("__text"), *rest).mapInArrow(run, T.StructType.fromDDL("keys binary, data binary, rest binary"))
    return out.withColumn("block", F.monotonically_increasing_id())


class Block:
    """A block's row, unpacked. `anchors` are those of the first side and then those of the second, each with the bytes on either side that
    the side's windows take."""

    def __init__(self, keys: bytes, data: bytes, length: int):
        self.keys = np.frombuffer(keys, np.int64)
        self.offsets, self.data, self.nulls = expand(data, "<i8", "u1", "?")
        # found again wherever a block is read: that takes less than carrying them
        at, first, last = all_anchors(self.data, self.offsets, length)
        left, right = at - first, last + length - at
        self.length, self.middle = length, (length - K) // 2
        one, two = right >= length - self.middle, left > self.middle
        self.anchors, self.ones = np.r_[at[one], at[two]], int(one.sum())
        self.left = np.r_[np.minimum(left[one], self.middle), left[two]].astype(np.uint8)
        self.right = np.r_[right[one], np.minimum(right[two], length - self.middle - 1)].astype(np.uint8)
        self.padded = np.r_[np.zeros(length, np.uint8), self.data, np.zeros(2 * length, np.uint8)]

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, "right") - 1

    def prints(self) -> np.ndarray:
        """Of the bytes that all of a side's windows share: from the anchor on, or those before it and its K-gram."""
        at, before = self.anchors + self.length, self.middle + 1
        one = pieces(self.padded, at[: self.ones], self.length - self.middle)
        two = pieces(self.padded, at[self.ones :] - before, before + K)
        return np.r_[one, mix(two ^ U(_STEP))] >> U(64 - PRINT_BITS)

    def around(self, at: np.ndarray, right: np.ndarray, left: np.ndarray | None = None) -> np.ndarray:
        """Rows of the bytes from each position and, after `length` places, of those before it, nearest first; each byte plus one, and 0
        beyond `right` and `left` bytes. Done a slice at a time: beside the rows themselves nothing grows with their number."""
        back = 0 if left is None else self.length - K
        out = np.empty((len(at), self.length + back), np.uint8)
        ahead = np.lib.stride_tricks.sliding_window_view(self.padded, self.length)
        behind = np.lib.stride_tricks.sliding_window_view(self.padded, max(back, 1))
        column, column_back = np.arange(self.length, dtype=np.uint8), np.arange(back, dtype=np.uint8)
        for low in range(0, len(at), SLICE):
            own, rows = at[low : low + SLICE], out[low : low + SLICE]
            np.add(ahead[own + self.length], np.uint8(1), out=rows[:, : self.length])
            rows[:, : self.length] *= column < right[low : low + SLICE, None]
            if left is not None:
                np.add(behind[own + self.length - back][:, ::-1], np.uint8(1), out=rows[:, self.length :])
                rows[:, self.length :] *= column_back < left[low : low + SLICE, None]
        return out

    def surroundings(self, which: np.ndarray) -> np.ndarray:
        """A hash of the bytes around each of these anchors."""
        h = np.zeros(len(which), np.uint64)
        back = self.length - K
        wide = -(-(self.length + back) // 8) * 8
        for low in range(0, len(h), SLICE):
            some = which[low : low + SLICE]
            rows = self.around(self.anchors[some], self.right[some], self.left[some])
            longs = np.pad(rows, ((0, 0), (0, wide - rows.shape[1]))).view("<u8")
            own = h[low : low + SLICE]
            for i in range(longs.shape[1]):
                own[:] = mix(own * U(_STEP) + longs[:, i])
        return h

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct prints, how many surroundings each has (at least; by hash), and whether it occurs more than once."""
        prints = self.prints()
        order = np.argsort(prints)
        prints = prints[order]
        new = np.r_[True, prints[1:] != prints[:-1]] if len(prints) else np.empty(0, bool)
        again = np.flatnonzero(~new | np.r_[~new[1:], False]) if len(prints) else np.empty(0, np.int64)
        h = self.surroundings(order[again])  # only prints that occur again may have several
        h = h[np.lexsort((h, prints[again]))]
        other = new.copy()
        other[again] |= np.r_[True, h[1:] != h[:-1]] if len(again) else False
        first = np.flatnonzero(new)
        return prints[first], np.add.reduceat(other.astype(np.int64), first) if len(first) else first, np.diff(np.r_[first, len(prints)]) > 1


def print_rows(table: DataFrame, ranges: int, length: int) -> DataFrame:
    """(range, block, prints): each block's distinct prints, in `ranges` slices, as steps."""
    shift = PRINT_BITS - (ranges.bit_length() - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, keys, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                prints, around, more = Block(keys, data, length).distinct()
                cuts = np.searchsorted(prints, np.arange(ranges + 1).astype(np.uint64) << U(shift))
                note = np.minimum(around, 30_000).astype(np.uint16) * 2 + more
                blobs = []
                for r in range(ranges):
                    own = prints[cuts[r] : cuts[r + 1]]
                    step = np.diff(own, prepend=U(r) << U(shift))
                    blobs.append(squeeze(planes(step & U(0xFFFFFFFF)), (step >> U(32)).astype(np.uint8), note[cuts[r] : cuts[r + 1]]))
                yield pa.RecordBatch.from_arrays([pa.array(range(ranges), pa.int32()), pa.array([block] * ranges, pa.int64()), pa.array(blobs, pa.binary())], names=["range", "block", "prints"])

    return table.select("block", "keys", "data").mapInArrow(run, T.StructType.fromDDL("range int, block long, prints binary"))


def common_prints(rows: DataFrame, ranges: int, crowded: int = CROWDED) -> DataFrame:
    """(block, range, flags): for each of a block's prints 0, 1 if it occurs again, or 2 if it is also crowded."""
    shift = PRINT_BITS - (ranges.bit_length() - 1)

    def run(table: pa.Table) -> pa.Table:
        r = table.column("range")[0].as_py()
        lists, notes = [], []
        for blob in table.column("prints").to_pylist():
            low, high, note = expand(blob, "u1", "u1", "<u2")
            lists.append(np.cumsum(unplanes(low).astype(np.uint64) | high.astype(np.uint64) << U(32), dtype=np.uint64) + (U(r) << U(shift)))
            notes.append(note)
        prints, note = np.concatenate(lists), np.concatenate(notes).astype(np.int64)
        order = np.argsort(prints, kind="stable")
        p = prints[order]
        first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]) if len(p) else np.empty(0, np.int64)
        flags = np.zeros(len(p), np.uint8)
        if len(p):
            size = np.diff(np.r_[first, len(p)])
            again = (size > 1) | (np.add.reduceat(note[order] & 1, first) > 0)
            crowd = np.add.reduceat(note[order] >> 1, first) >= crowded
            flags[order] = np.repeat(again.astype(np.uint8) * (1 + crowd), size)
        cuts = np.cumsum([0, *map(len, lists)])
        blobs = [squeeze(flags[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({"block": table.column("block"), "range": table.column("range"), "flags": pa.array(blobs, pa.binary())})

    return rows.groupBy("range").applyInArrow(run, "block long, range int, flags binary")


@dataclass
class Suffixes:
    """A block's suffixes that occur again, in order: by part, then bytes. Equal surroundings are one suffix, which stands for the
    positions at[first] .. at[first + members - 1] and has the least key among them; right and left are its bytes on either side."""

    rows: np.ndarray
    right: np.ndarray
    left: np.ndarray
    part: np.ndarray
    least: np.ndarray
    first: np.ndarray
    members: np.ndarray
    at: np.ndarray


def own_suffixes(block: Block, flags: list[tuple[int, bytes]], parts: int) -> Suffixes:
    """From the flags of the block's prints (range, blob). A crowded print's suffixes go by whole windows instead."""
    length, back = block.length, block.length - K
    flag = np.concatenate([expand(b, "u1")[0] for _, b in sorted(flags)]) if flags else np.empty(0, np.uint8)
    prints = block.prints()
    turn = np.argsort(prints)
    ordered = prints[turn]
    spread = np.zeros(len(prints), np.uint8)
    if len(prints):
        spread[turn] = flag[np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]])]
    one, crowd = spread == 1, spread == 2
    at = block.anchors[one]
    right, left = block.right[one], block.left[one]
    rows, part = block.around(at, right, left), (prints[one] % U(parts)).astype(np.int64)
    if crowd.any():
        many = block.left[crowd].astype(np.int64) + block.right[crowd] - length + 1  # windows of each anchor, from its first on
        begin = block.anchors[crowd] - block.left[crowd]
        starts = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        windows = block.around(starts, np.full(len(starts), length, np.uint8))
        h = np.zeros(len(starts), np.uint64)
        for i in range(length):
            h *= U(_STEP)
            h += windows[:, i]
        at = np.r_[at, starts]
        right, left = np.r_[right, np.full(len(starts), length, np.uint8)], np.r_[left, np.zeros(len(starts), np.uint8)]
        rows = np.concatenate([rows, np.pad(windows, ((0, 0), (0, back)))])
        part = np.r_[part, (mix(h) % U(parts)).astype(np.int64)]
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable") if len(rows) else np.empty(0, np.int64)
    order = order[np.argsort(part[order], kind="stable")]
    at, rows, right, left, part = at[order], rows[order], right[order], left[order], part[order]
    new = np.r_[True, (rows[1:] != rows[:-1]).any(1) | (part[1:] != part[:-1])] if len(rows) else np.empty(0, bool)
    first = np.flatnonzero(new)
    keys = block.keys[block.text_of(at)]
    least = np.minimum.reduceat(keys, first) if len(first) else keys
    return Suffixes(rows[first], right[first], left[first], part[first], least, first, np.diff(np.r_[first, len(at)]), at)


def suffix_runs(table: DataFrame, flags: DataFrame, parts: int, length: int) -> DataFrame:
    """(part, block, base, run): sorted front-coded runs of each block's suffixes, cut by part; `base` is a run's first number."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [], [])
        if left.num_rows:
            number = left.column("block")[0].as_py()
            block = Block(left.column("keys")[0].as_py(), left.column("data")[0].as_py(), length)
            found = own_suffixes(block, list(zip(right.column("range").to_pylist(), right.column("flags").to_pylist(), strict=True)), parts)
            cuts = np.searchsorted(found.part, np.arange(parts + 1))
            suffix, before = found.rows[:, :length], found.rows[:, length:]
            differs = suffix[1:] != suffix[:-1]
            shared = np.r_[0, np.where(differs.any(1), differs.argmax(1), length)][: len(suffix)]
            shared = np.minimum(shared, found.right).astype(np.uint8)
            shared[cuts[:-1][cuts[:-1] < cuts[1:]]] = 0  # a run's first
            column = np.arange(length, dtype=np.uint8)
            rest, before = suffix[(column >= shared[:, None]) & (column < found.right[:, None])], before[before > 0]
            to_rest = np.r_[0, np.cumsum(found.right - shared, dtype=np.int64)].tolist()
            to_before = np.r_[0, np.cumsum(found.left, dtype=np.int64)].tolist()
            cuts = cuts.tolist()
            for p, (a, b) in enumerate(itertools.pairwise(cuts)):
                if a < b:
                    out[0].append(p), out[1].append(number), out[2].append(a)
                    out[3].append(squeeze(shared[a:b], found.right[a:b], found.left[a:b], rest[to_rest[a] : to_rest[b]], before[to_before[a] : to_before[b]], planes(found.least[a:b].view("<u4")), level=3))
        return pa.table([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], names=["part", "block", "base", "run"])

    return table.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(run, "part int, block long, base long, run binary")


def merge(runs: list[tuple[list[int], list[int], bytes]]) -> tuple[list[int], list[int]]:
    """Merge sorted front-coded runs (shared prefix with the suffix before, length, the bytes after the prefix) by a tree of losers.

    Returns for each suffix in order its run, and its common prefix with the suffix before. Each run's head knows its common prefix
    with the last winner; the longer one wins unseen, and only heads that agree on it are compared: as whole numbers, of which the
    highest bit that differs tells the common prefix. Only heads are decoded.
    """
    many = len(runs)
    leaves = 1
    while leaves < many:
        leaves *= 2
    wide = max((max(sizes) for _, sizes, _ in runs), default=0)
    bits = 8 * wide
    heads: list[bytes] = [raw[: sizes[0]] for _, sizes, raw in runs]
    values = [int.from_bytes(x.ljust(wide, b"\0")) for x in heads]
    known = [0] * many + [-1] * (leaves - many)
    place, read, losers = [0] * many, [sizes[0] for _, sizes, _ in runs], [0] * leaves

    def play(a: int, b: int) -> tuple[int, int]:
        i = known[a]
        if i > known[b]:
            return a, b
        if i < known[b] or i < 0:
            return b, a
        x, y = values[a], values[b]
        if x == y:
            known[b] = len(heads[b])
            return a, b
        i = (bits - (x ^ y).bit_length()) >> 3
        if x < y:
            known[b] = i
            return a, b
        known[a] = i
        return b, a

    winners = [0] * leaves + list(range(leaves))
    for node in range(leaves - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1] if leaves > 1 else 0
    order, shared = [], []
    for _ in range(sum(len(sizes) for _, sizes, _ in runs)):
        order.append(best)
        shared.append(known[best])
        prefix, sizes, raw = runs[best]
        i = place[best] = place[best] + 1
        if i < len(sizes):
            start = read[best]
            s = known[best] = prefix[i]
            end = read[best] = start + sizes[i] - s
            heads[best] = x = heads[best][:s] + raw[start:end]
            values[best] = int.from_bytes(x.ljust(wide, b"\0"))
        else:
            s = known[best] = -1
        node = (best + leaves) >> 1
        while node:
            other = losers[node]
            i = known[other]
            if s < i:
                losers[node], best, s = best, other, i
            elif s == i >= 0:  # play(best, other), without the call
                x, y = values[best], values[other]
                if x == y:
                    known[other] = len(heads[other])
                else:
                    i = (bits - (x ^ y).bit_length()) >> 3
                    if x < y:
                        known[other] = i
                    else:
                        known[best] = i
                        losers[node], best = best, other
            node >>= 1
    return order, shared


def decoded(shared: np.ndarray, right: np.ndarray, rest: np.ndarray, length: int) -> np.ndarray:
    """Front-coded suffixes as rows of `length` bytes, 0 after their end."""
    column = np.arange(length, dtype=np.uint8)
    rows = np.zeros((len(shared), length), np.uint8)
    rows[(column >= shared[:, None]) & (column < right[:, None])] = rest
    rows, n = np.ascontiguousarray(rows.T), np.arange(len(shared))
    for i in range(int(shared.max(initial=0))):
        rows[i] = rows[i][np.maximum.accumulate(np.where(shared <= i, n, 0))]  # a prefix stands where it was last written out
    return np.ascontiguousarray(rows.T)


def sorted_suffixes(shared: np.ndarray, right: np.ndarray, rest: np.ndarray, base: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of runs put together, of which each begins at a place of `base`: the places of all suffixes in order, and each one's common prefix
    with the one before. Equal suffixes are merged as one, which stands in the first of their runs."""
    rows = decoded(shared, right, rest, length)
    wide = np.pad(rows, ((0, 0), (0, -length % 8))).view("<u8")
    h = np.zeros(len(rows), np.uint64)
    for i in range(wide.shape[1]):
        h = mix(h * U(_STEP) + wide[:, i])
    turn = np.argsort(h, kind="stable")
    new = np.r_[True, (h[turn[1:]] != h[turn[:-1]]) | (wide[turn[1:]] != wide[turn[:-1]]).any(1)]
    begin = np.flatnonzero(new)
    many = np.diff(np.r_[begin, len(turn)])
    single = np.sort(turn[begin])  # the first of its equals
    own = np.empty(len(rows), np.int64)
    own[turn[begin]] = np.arange(len(begin))
    # what the remaining ones of a run share is the least that those between them did
    prefix = np.minimum.reduceat(shared[: single[-1] + 1], np.r_[0, single[:-1] + 1])
    column = np.arange(length, dtype=np.uint8)
    left = rows[single]
    sizes = right[single]
    raw = left[(column >= prefix[:, None]) & (column < sizes[:, None])].tobytes()
    to_raw = np.r_[0, np.cumsum(sizes - prefix, dtype=np.int64)].tolist()
    cuts = np.unique(np.searchsorted(single, base)).tolist()
    prefix, sizes = prefix.tolist(), sizes.tolist()
    order, common = merge([(prefix[a:b], sizes[a:b], raw[to_raw[a] : to_raw[b]]) for a, b in itertools.pairwise(cuts)])
    at = np.empty(len(order), np.int64)
    at[np.argsort(np.array(order, np.int64), kind="stable")] = single
    own = own[at]
    each = many[own]
    to = np.cumsum(each) - each
    out = np.repeat(right[at].astype(np.int64), each)
    out[to] = common
    return turn[np.repeat(begin[own] - to, each) + np.arange(len(turn))], out


def first_keys(shared: np.ndarray, right: np.ndarray, left: np.ndarray, before: np.ndarray, keys: np.ndarray, length: int) -> np.ndarray:
    """For sorted suffixes and each number of bytes before them (a column each): the least key among all that have the same window.

    A window of `length` bytes that begins l bytes before a suffix is the same where the suffixes agree in length - l bytes, so
    stand in one stretch of the sorted order, and the l bytes before them are equal.
    """
    n, back = len(keys), length - K
    out = np.repeat(keys[:, None], back + 1, axis=1)
    h = np.zeros(n, np.uint64)
    for l in range(back + 1):
        if l:
            h = mix(h * U(_STEP) + before[:, l - 1].astype(np.uint64) + U(1))
        stretch = np.cumsum(shared < length - l)
        ok = (right >= length - l) & (left >= l)
        near = np.zeros(n, bool)
        same = shared[1:] >= length - l
        near[1:] |= same
        near[:-1] |= same
        at = np.flatnonzero(ok & near)
        if not len(at):
            continue
        group = mix(h[at] ^ (stretch[at].astype(np.uint64) * U(0xD6E8FEB86659FD93)))
        order = np.argsort(group)
        at, group = at[order], group[order]
        new = np.r_[True, group[1:] != group[:-1]]
        out[at, l] = np.minimum.reduceat(keys[at], np.flatnonzero(new))[np.cumsum(new) - 1]
    return out


def merged(runs: DataFrame, length: int) -> DataFrame:
    """(block, found): per run, suffixes with an earlier key elsewhere: number within the block, first and last l, that key."""
    back = length - K

    def run(table: pa.Table) -> pa.Table:
        found: tuple[list, ...] = ([], [], [], [], [], [])
        for blob in table.column("run").to_pylist():
            for column, value in zip(found, expand(blob, "u1", "u1", "u1", "u1", "u1", "u1"), strict=True):
                column.append(value)
        base = np.cumsum([0, *map(len, found[0])])
        keys = np.concatenate([unplanes(x).view("<i8") for x in found[5]])
        shared, right, left, rest = (np.concatenate(x) for x in found[:4])
        before = np.zeros((len(keys), back), np.uint8)
        before[np.arange(back, dtype=np.uint8) < left[:, None]] = np.concatenate(found[4])
        rank, shared = sorted_suffixes(shared, right, rest, base, length)
        least = first_keys(shared, right[rank], left[rank], before[rank], keys[rank], length)
        back_to = np.empty_like(rank)
        back_to[rank] = np.arange(len(rank))
        least = least[back_to]
        better, step = least < keys[:, None], least[:, 1:] != least[:, :-1]
        begins, ends = better.copy(), better
        begins[:, 1:] &= step
        ends[:, :-1] &= step
        row, low = np.nonzero(begins)
        high = np.nonzero(ends)[1]
        key, cuts, blobs = least[row, low], np.searchsorted(row, base), []
        for i, start in enumerate(table.column("base").to_pylist()):
            a, b = cuts[i], cuts[i + 1]
            blobs.append(squeeze((row[a:b] + (start - base[i])).astype("<u4"), low[a:b].astype(np.uint8), high[a:b].astype(np.uint8), key[a:b]))
        return pa.table({"block": table.column("block"), "found": pa.array(blobs, pa.binary())})

    return runs.groupBy("part").applyInArrow(run, "block long, found binary")


def united(begin: np.ndarray, end: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maximal runs that intervals cover, each within its text."""
    if not len(begin):
        return begin, end, text
    order = np.argsort(begin, kind="stable")
    begin, end, text = begin[order], np.maximum.accumulate(end[order]), text[order]
    new = np.r_[True, (begin[1:] > end[:-1]) | (text[1:] != text[:-1])]
    return begin[new], end[np.r_[new[1:], True]], text[new]


def spans_of(block: Block, own: Suffixes, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) byte in the block of each maximal removed run."""
    length, none = block.length, np.empty(0, np.int64)
    runs, pending = (none, none, none), 0
    if len(own.at):
        count, at, first = own.members, own.at, own.first
        text = block.text_of(at)
        keys = block.keys[text]
        # all windows about a suffix go by the least key in this block, and some by an earlier one elsewhere
        here = (np.arange(len(count), dtype=np.uint32), length - own.right, own.left, own.least)
        records = [np.concatenate(x) for x in zip(here, *(expand(f, "<u4", "u1", "u1", "<i8") for f in found), strict=True)]
        new: list[tuple[np.ndarray, ...]] = []
        for start in range(0, len(records[0]), SLICE):
            record, low, high, key = (x[start : start + SLICE].astype(np.int64) for x in records)
            each = count[record]
            who = np.repeat(first[record] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
            later = keys[who] > np.repeat(key, each)
            who = who[later]
            new.append((at[who] - np.repeat(high, each)[later], at[who] - np.repeat(low, each)[later] + length, text[who]))
            pending += len(who)
            if pending > 1 << 19:
                runs, new, pending = united(*map(np.concatenate, zip(runs, *new, strict=True))), [], 0
        runs = united(*map(np.concatenate, zip(runs, *new, strict=True)))
    return runs[0], runs[1]


def exchanged(docs: DataFrame, key: str, text: str, length: int, crowded: int, others: list[str]) -> tuple[DataFrame, DataFrame, int]:
    """The table of blocks, what each block has to know of the others (block, range, note), and the number of parts."""
    if not K < length < 256:
        raise ValueError(f"length must be {K + 1} to 255")
    table = settle(blocks(docs, key, text, others))
    n = table.count()
    ranges = 16
    while ranges * 8 < n:
        ranges *= 2
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 2)
    flags = settle(common_prints(print_rows(table, ranges, length), ranges, crowded))
    found = merged(suffix_runs(table, flags, parts, length), length)
    notes = flags.select("block", "range", F.col("flags").alias("note")).unionByName(found.select("block", F.lit(-1).alias("range"), F.col("found").alias("note")))
    return table, notes, parts


def kept_texts(block: Block, notes: pa.Table, parts: int, raw: bytes) -> Iterator[tuple[int, int, list[tuple[int, int]], bytes]]:
    """Each text's first byte, byte after the last, removed runs, and what is left of it."""
    pairs = list(zip(notes.column("range").to_pylist(), notes.column("note").to_pylist(), strict=True))
    # sorted once more rather than stored: their positions are a large part of the runs
    begin, end = spans_of(block, own_suffixes(block, [x for x in pairs if x[0] >= 0], parts), [b for r, b in pairs if r < 0])
    low, high = np.searchsorted(begin, block.offsets[:-1]), np.searchsorted(begin, block.offsets[1:])
    for i, (a, b) in enumerate(itertools.pairwise(block.offsets.tolist())):
        cuts = list(zip(begin[low[i] : high[i]].tolist(), end[low[i] : high[i]].tolist(), strict=True))
        pieces, last = [], a
        for s, e in cuts:
            pieces.append(raw[last:s])
            last = e
        yield a, b, cuts, b"".join([*pieces, raw[last:b]])


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50, crowded: int = CROWDED, removed: str = "n_removed") -> DataFrame:
    """The rows of docs with all their columns, the text without what remove_repeats takes and without what a cut leaves of a
    character, and the number of bytes removed in a column `removed`, which replaces one of that name. The other columns go with
    their block, so no row meets its text again in a join. Null texts stay null; repeated rows are rows each."""
    docs = clear(docs, removed)
    others = [c for c in docs.columns if c != text]
    table, notes, parts = exchanged(docs, key, text, length, crowded, others)
    schema = T.StructType([*docs.schema.fields, T.StructField(removed, T.LongType())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        texts, gone, rest = [], [], None
        if left.num_rows:
            block = Block(left.column("keys")[0].as_py(), left.column("data")[0].as_py(), length)
            rest = pa.ipc.open_stream(left.column("rest")[0].as_py()).read_all()
            for (a, b, cuts, kept), null in zip(kept_texts(block, right, parts, block.data.tobytes()), rest.column("__null").to_pylist(), strict=True):
                texts.append(None if null else kept.decode("utf-8", "ignore") if cuts else kept.decode())
                gone.append(b - a - len(kept))
        made = {text: pa.array(texts, pa.string()), removed: pa.array(gone, pa.int64())}
        if rest is None:
            return to_arrow_schema(schema).empty_table()
        return pa.table([made[c] if c in made else rest.column(c) for c in schema.names], names=schema.names)

    return table.groupBy("block").cogroup(notes.groupBy("block")).applyInArrow(run, schema)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50, with_kept: bool = True, crowded: int = CROWDED) -> DataFrame:
    """Per document: key, n_bytes, n_removed, n_spans, kept_sha256 and, with_kept, `spans` (array of begin, end), `kept`
    (binary), `kept_text` (without what a cut leaves of a character) and text_sha256 of the input.

    Removed is each byte covered by a string of `length` bytes (at least 17, at most 255) that also starts in a document with a
    smaller key; strings are judged on the input, overlaps count, and none crosses documents. A null text is empty; rows with equal
    keys don't remove from each other; a null key comes after all others; an empty table gives an empty result; other columns are
    left out. A repeated passage in any number of documents is one suffix for each block of documents; a K-gram with very many
    different surroundings goes about by whole windows, which spread evenly, so no task gets a frequent one alone.
    """
    docs = clear(docs, *(set(docs.columns) - {key, text}))
    table, notes, parts = exchanged(docs, key, text, length, crowded, [])
    kind = dict((f.name, f.dataType) for f in docs.schema.fields)[key]
    fields = [T.StructField(key, kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    if with_kept:
        fields += T.StructType.fromDDL("spans array<struct<begin: long, end: long>>, kept binary, kept_text string, text_sha256 string").fields
    schema = T.StructType(fields)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in fields]
        if left.num_rows:
            block = Block(left.column("keys")[0].as_py(), left.column("data")[0].as_py(), length)
            raw = block.data.tobytes()
            for (a, b, cuts, kept), key_, null in zip(kept_texts(block, right, parts, raw), block.keys.tolist(), block.nulls.tolist(), strict=True):
                values = [None if null else key_, b - a, b - a - len(kept), len(cuts), hashlib.sha256(kept).hexdigest()]
                if with_kept:
                    values += [[{"begin": s - a, "end": e - a} for s, e in cuts], kept, kept.decode("utf-8", "ignore"), hashlib.sha256(raw[a:b]).hexdigest()]
                for column, value in zip(out, values, strict=True):
                    column.append(value)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.binary(), pa.string(), pa.string()]
        made = [pa.array(c, t) for c, t in zip(out, types, strict=False)]
        made[0] = made[0].cast(pa.int32()) if isinstance(kind, T.IntegerType) else made[0]
        return pa.table(made, names=schema.names)

    return table.groupBy("block").cogroup(notes.groupBy("block")).applyInArrow(run, schema)
