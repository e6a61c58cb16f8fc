"""Best-fit packing of tokenised documents: large pieces are matched in pairs, smaller ones fill the best gaps."""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convlake.llm.common import clear, settle, with_offsets
from convlake.llm.textkit import LOWER, SPACE, segments

CAPACITY = 2048
CACHED_WORDS = 300_000  # some 60 MB of a worker
RUN_BYTES, STRETCH = 2 << 20, 1 << 18
#: The rules of tokenizers whose texts may be taken word by word; with others, texts are encoded whole.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
SIMPLE = re.compile("[a-zß-öø-ÿ]+")  # words that the normalizer leaves as they are and SPLIT as one
#: What a byte may be: no white space; a to z once lower-cased; other ASCII but white space; the second of U+00C0 to U+00FF, letters but for two.
INK, LETTER, MARK, LATIN = 1, 2, 4, 8
LOWERED = LOWER.tobytes()
KINDS = bytes(
    INK * (not SPACE[b]) | LETTER * chr(b).isascii() * chr(b).isalpha() | MARK * (33 <= b < 127 and not chr(b).isalpha()) | LATIN * (0x80 <= b < 0xC0 and b not in (0x97, 0xB7))
    for b in range(256)
)
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of texts by one tokenizer. Words met before stay known in this worker, up to CACHED_WORDS: number i has the ids
    flat[bounds[i] : bounds[i + 1]]; number 0 is the closing id 0."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        model, parts = rules["model"], {"type": "Sequence", "pretokenizers": [SPLIT, BYTE_LEVEL]}
        self.by_word = (rules.get("normalizer"), rules.get("pre_tokenizer"), model.get("end_of_word_suffix")) == (NORMALIZER, parts, "</w>")
        self.by_word &= not any(rules.get(x) for x in ("truncation", "padding", "post_processor"))
        self.by_word &= all(t["content"].startswith("<|") and not (t["normalized"] or t["lstrip"] or t["rstrip"]) for t in rules.get("added_tokens", []))
        self.simple = Tokenizer(self.whole.model)
        self.simple.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.whole.get_vocab()
        self.closes = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, int] = {}
        self.flat, self.bounds = np.zeros(1, "<u4"), np.array([0, 1])

    def ids(self, tokenizer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' ids in a row, and how many each has."""
        ids, counts = [np.empty(0, "<u4")], [np.empty(0, np.int64)]
        for i in range(0, len(texts), 200):  # what the tokenizer returns is many times the ids
            lists = [x.ids for x in tokenizer.encode_batch_fast(texts[i : i + 200], add_special_tokens=False)]
            ids.append(np.fromiter(chain.from_iterable(lists), "<u4"))
            counts.append(np.fromiter(map(len, lists), np.int64, len(lists)))
        return np.concatenate(ids), np.concatenate(counts)

    def simple_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As `ids`, for words of SIMPLE: they go straight to the model, many in one text, and the ids tell where each ends."""
        ids, _ = self.ids(self.simple, [" ".join(words[i : i + 100]) for i in range(0, len(words), 100)])
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(words):
            raise ValueError(f"{len(words)} words, {len(ends)} ends among their ids")
        return ids, np.diff(ends, prepend=0)

    def numbers(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of each of these distinct words, and the ids and bounds that the numbers point into."""
        known = self.known
        numbers = np.fromiter(map(known.get, words, repeat(0)), np.int64, len(words))
        new = np.flatnonzero(numbers == 0)
        if not len(new):
            return numbers, self.flat, self.bounds
        easy = np.fromiter((SIMPLE.fullmatch(words[i]) is not None for i in new), bool, len(new))
        flats, counts = [self.flat], []
        for chosen, encode in ((new[easy], self.simple_ids), (new[~easy], lambda w: self.ids(self.whole, w))):
            if len(chosen):
                ids, n = encode([words[i] for i in chosen])
                flats.append(ids)
                counts.append(n)
        new = np.concatenate([new[easy], new[~easy]])
        old = len(self.bounds)
        flat, bounds = np.concatenate(flats), np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(np.concatenate(counts))])
        numbers[new] = np.arange(old - 1, old - 1 + len(new))
        room = min(len(new), CACHED_WORDS - len(known))
        if room > 0:
            known.update((words[i], old - 1 + k) for k, i in enumerate(new[:room].tolist()))
            self.flat, self.bounds = flat, bounds
            if room < len(new):
                self.bounds = bounds[: old + room].copy()
                self.flat = flat[: self.bounds[-1]].copy()
        return numbers, flat, bounds


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, and each text's number of them. A word ends at ASCII white space and where another ASCII
    character follows a letter (a to z, or of Latin-1); A to Z are lower-cased. Texts with `<|`, which may begin an added token, end words at white
    space only and keep their case."""
    raw = data.tobytes()
    low, kinds = (np.frombuffer(bytearray(raw.translate(x)), np.uint8) for x in (LOWERED, KINDS))
    ink, letter, mark = kinds & INK > 0, kinds & LETTER > 0, kinds & MARK > 0
    letter[1:] |= (data[:-1] == 0xC3) & (kinds[1:] & LATIN > 0)
    if b"<|" in raw:
        for i in np.unique(np.searchsorted(offsets, np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)), "right") - 1):
            a, b = offsets[i], offsets[i + 1]
            low[a:b], letter[a:b] = data[a:b], False
    first = ink.copy()
    first[1:] &= ~ink[:-1] | (letter[:-1] & mark[1:])
    starts = offsets[:-1][np.diff(offsets) > 0]
    first[starts] = ink[starts]
    counts = np.diff(np.searchsorted(np.flatnonzero(first), offsets))
    body, bounds = low[ink], np.append(np.flatnonzero(first[ink]), int(ink.sum()))
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(body)), counts


def document_ids(path: str, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in a row, each with the closing id 0, and len + 1 bounds of the texts in them.

    The vocabulary's pieces never cross ASCII white space, which it drops, nor the end of a run of letters, and it lower-cases, so a
    text's ids are those of its words by `split_words` in a row; each distinct word is encoded once a run of texts.
    """
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    encoder = _encoders[path]
    if not encoder.by_word:
        raw = data.tobytes()
        ids, counts = encoder.ids(encoder.whole, [raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
        return np.insert(ids, np.cumsum(counts), 0), np.concatenate([[0], np.cumsum(counts + 1)])
    words, counts = split_words(data, offsets)
    words = words.dictionary_encode()
    numbers, flat, bounds = encoder.numbers(words.dictionary.to_numpy(zero_copy_only=False).tolist())
    ends = np.cumsum(counts)
    row = np.insert(numbers[words.indices.to_numpy()], ends, 0)
    sizes = np.diff(bounds)[row]
    to = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(to[-1], "<u4")
    for i in range(0, len(row), STRETCH):
        j = min(i + STRETCH, len(row))
        shift = np.repeat(bounds[row[i:j]] - to[i:j], sizes[i:j])
        out[to[i] : to[j]] = flat[shift + np.arange(to[i], to[j])]
    return out, to[np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]) of every document; a null or empty text is the single id 0."""
    fields = [docs.schema[key], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    fields += [T.StructField("ids", T.BinaryType())] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in segments(batch.column(1), RUN_BYTES):
                ids, bounds = document_ids(path, data, offsets)
                rows: tuple[list, ...] = ([], [], [], [], [], [])
                for i, first, end in zip(range(low, high), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    for n, at in enumerate(range(first, end, capacity)):
                        part = ids[at : min(at + capacity, end)].tobytes()
                        for column, value in zip(rows, (i, n, at - first, len(part) // 4, zlib.crc32(part), part), strict=True):
                            column.append(value)
                arrays = [batch.column(0).take(pa.array(rows[0])), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:5])]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(rows[5], pa.binary())] * with_ids, names=[f.name for f in fields])

    return docs.select(key, F.coalesce("text", F.lit(""))).mapInArrow(cut, T.StructType(fields))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Where pieces go, by length alone: (length, first rank, ranks, first sequence, pieces in a sequence, offset of the first).

    Pieces above a third of the capacity: from the longest down, each is matched with the longest other one that still fits, so
    a sequence holds two at most. The rest, from the longest down, go where the smallest gap that takes them is, and to a new
    sequence if there is none. Sequences with the same gap are one entry (first, number), which a step splits at most once; the
    plan's size depends on the number of lengths, not on that of pieces.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    used: dict[int, int] = dict.fromkeys(left, 0)
    moves: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    sequences = 0

    def put(n: int, count: int, first: int, each: int, at: int) -> None:
        moves.append((n, used[n], count, first, each, at))
        used[n] += count
        left[n] -= count

    def gap(size: int, first: int, count: int) -> None:
        if size and count:
            if size not in gaps:
                gaps[size] = []
                insort(order, size)
            gaps[size].append((first, count))

    large = sorted(n for n in left if 3 * n > capacity)
    for n in reversed(large):
        while left[n]:
            fits = [m for m in large[: bisect_left(large, min(n, capacity - n) + 1)] if left[m] > (m == n)]
            m = fits[-1] if fits else 0
            count = min(left[n], left[m]) if m and m != n else left[n] // 2 if m else left[n]
            put(n, count, sequences, 1, 0)
            if m:
                put(m, count, sequences, 1, n)
            gap(capacity - n - m, sequences, count)
            sequences += count
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            i = bisect_left(order, n)
            if i == len(order):
                gap(capacity, sequences, -(-left[n] // (capacity // n)))
                sequences += -(-left[n] // (capacity // n))
                continue
            size = order[i]
            first, count = gaps[size].pop()
            if not gaps[size]:
                del gaps[size], order[i]
            each, at = size // n, capacity - size
            whole = min(count, left[n] // each)
            if whole:
                put(n, whole * each, first, each, at)
                gap(size - each * n, first, whole)
            if whole < count and left[n] and left[n] < each:
                rest = left[n]
                put(n, rest, first + whole, each, at)
                gap(size - rest * n, first + whole, 1)
                whole += 1
            gap(size, first + whole, count - whole)
    return moves


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """items (with `length` long, 1 to capacity) with `sequence_id` and `offset`.

    Only the counts by length (at most `capacity` rows) reach the driver, where the plan is made; each piece then finds its place
    from its rank among the pieces of its length, ranks being taken in hashed buckets so that a frequent length is no single task.
    """
    if "__row" not in items.columns:
        items = items.withColumn("__row", F.monotonically_increasing_id())
    items = settle(items)
    counts = {r.length: r["count"] for r in items.groupBy("length").count().collect()}
    moves = sorted(plan(counts, capacity))
    table = np.array(moves, np.int64).reshape(-1, 6)
    ranked = with_offsets(items.withColumn("__one", F.lit(1)), ["length"], ["__row"], "__one", "__rank", 200_000, sum(counts.values())).drop("__one", "__row")
    names = [c for c in ranked.columns if c != "__rank"]
    schema = T.StructType([*(ranked.schema[c] for c in names), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    wide = int(table[:, :1].max(initial=0)) + 1
    # one sorted key for (length, first rank), as the pair doesn't fit a long for any number of pieces
    starts = {n: table[table[:, 0] == n] for n in counts}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "__rank"))
            sequence, at = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            by = np.argsort(n, kind="stable")
            bounds = np.searchsorted(n[by], np.arange(wide + 1))
            for length in np.unique(n):
                rows, moved = by[bounds[length] : bounds[length + 1]], starts[int(length)]
                m = moved[np.searchsorted(moved[:, 1], rank[rows], "right") - 1]
                k = rank[rows] - m[:, 1]
                sequence[rows], at[rows] = m[:, 3] + k // m[:, 4], m[:, 5] + k % m[:, 4] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(sequence), pa.array(at)], names=schema.names)

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Documents as pieces in sequences of at most `capacity` tokens: key, piece, start, length, ids_crc32[, ids], sequence_id,
    offset. Only documents longer than a sequence are cut. Null keys and repeated rows are documents like any other; an empty
    table gives an empty result; columns of docs other than key and text are left out.
    """
    return pack(pieces(clear(docs, "piece", "start", "length"), path or tokenizer_path(), capacity, key, with_ids), capacity)
