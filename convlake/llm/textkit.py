"""Vectorised word hashing over Arrow batches: the bytes of many texts at once, without a Python string per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ODD, SEGMENT = 0x9E3779B97F4A7C15, 1 << 20
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD**i and its inverse modulo 2**64, for i < n. Kept for the next call, but no more than three segments' worth."""
    if n > 3 * SEGMENT:
        _powers.clear()
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", ODD), ("down", pow(ODD, -1, 1 << 64))):
            steps = np.full(n, U(base & (2**64 - 1)))
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    up, down = _powers["up"][:n], _powers["down"][:n]
    if n > 3 * SEGMENT:
        _powers.clear()
    return up, down


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and len + 1 offsets into them; a null text is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    buffers = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def segments(column: pa.Array, size: int = SEGMENT) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about `size` bytes: first row, row after the last, bytes, offsets. A longer text is one run."""
    data, offsets = text_bytes(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte after the last, and text number of every word; a word is a run without ASCII white space."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, none
    ink = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = ink.copy()
    first[1:] &= ~ink[:-1] | edge[1:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:] | edge[1:-1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(begin, offsets))
    return begin, end, np.repeat(np.arange(len(offsets) - 1), counts)


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans in order, equal where the bytes are equal after lower-casing A-Z. Long data goes a stretch of spans at
    a time, so that working memory follows SEGMENT (or the longest span), not the text."""
    if len(data) > 2 * SEGMENT and len(begin) > 1:
        out, i = np.empty(len(begin), np.uint64), 0
        while i < len(begin):
            j = max(i + 1, int(np.searchsorted(begin, begin[i] + SEGMENT)))
            low, high = int(begin[i]), int(end[i:j].max())
            out[i:j] = _span_hashes(data[low:high], begin[i:j] - low, end[i:j] - low)
            i = j
        return out
    return _span_hashes(data, begin, end)


def _span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = powers(len(data) + 1)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + U(1)) * up[:-1], out=run[1:])
    return mix((run[end] - run[begin]) * down[begin] + (end - begin).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def shingles(hashes: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words within one text, and their text numbers. A text of fewer words is one shingle."""
    n = len(hashes)
    if not n:
        return hashes, text
    steps = [pow(0xA24BAED4963EE407, i + 1, 1 << 64) for i in range(size)]
    full = np.zeros(n, bool)
    if n >= size:
        full[: n - size + 1] = text[: n - size + 1] == text[size - 1 :]
    at = np.flatnonzero(full)
    out = np.zeros(len(at), np.uint64)
    for i, c in enumerate(steps):
        out += hashes[at + i] * U(c)
    out, owner = mix(out), text[at]
    begin = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    count = np.diff(np.r_[begin, n])
    few = count < size
    if few.any():
        short = np.zeros(int(few.sum()), np.uint64)
        for i, c in enumerate(steps[:-1]):
            has = count[few] > i
            short[has] += hashes[begin[few][has] + i] * U(c)
        short = mix(short + count[few].astype(np.uint64) * U(0x632BE59BD9B4E019))
        out, owner = np.r_[out, short], np.r_[owner, text[begin[few]]]
        order = np.argsort(owner, kind="stable")
        out, owner = out[order], owner[order]
    return out, owner
