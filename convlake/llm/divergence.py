"""Audit of how far sources differ in their words: a byte-level tokenizer, exact counts, divergences over CSR blocks.

Documents become counts by language, source and term inside Arrow batches; Spark adds them up. Each language's table of sources by
kept terms is cut by terms into blocks; a block is a CSR matrix whose divergences are sums over its stored entries only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convlake.llm.common import settle
from convlake.llm.textkit import segments

TERM = np.zeros(256, np.uint8)  # 0 where no term goes on, else the byte as it is counted
TERM[0x41:0x5B] = np.arange(0x61, 0x7B)
TERM[0x61:0x7B] = np.arange(0x61, 0x7B)
TERM[0x80:] = np.arange(0x80, 0x100)
SHORT = 32  # bytes from which the xxhash library hashes slice by slice
ENTRIES = 200_000  # stored entries of a block
PAIRS = 1 << 20  # pairs of sources that one task sums up
LEAST, TOP, UNIT = 10, 10, 1_000_000_000
M64 = (1 << 64) - 1
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def xxh64(grid: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of each row of an n x length grid of bytes, length < 32: the public algorithm's short form, rows in parallel."""
    n, length = grid.shape
    h = np.full(n, (int(P5) + length) & M64, np.uint64)
    at = 0
    while at + 8 <= length:
        lane = np.ascontiguousarray(grid[:, at : at + 8]).view("<u8")[:, 0]
        h = _turn(h ^ _turn(lane * P2, 31) * P1, 27) * P1 + P4
        at += 8
    if at + 4 <= length:
        lane = np.ascontiguousarray(grid[:, at : at + 4]).view("<u4")[:, 0].astype(np.uint64)
        h = _turn(h ^ lane * P1, 23) * P2 + P3
        at += 4
    for i in range(at, length):
        h = _turn(h ^ grid[:, i].astype(np.uint64) * P5, 11) * P1
    h = (h ^ h >> np.uint64(33)) * P2
    h = (h ^ h >> np.uint64(29)) * P3
    return h ^ h >> np.uint64(32)


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The counted bytes, and begin, end and text number of each term: a maximal run within one text."""
    low = TERM[data]
    ink = low != 0
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1] | cut[1:-1]
    last[:-1] &= ~ink[1:] | cut[1:-1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return low, begin, end, np.searchsorted(offsets, begin, "right") - 1


def _grid(low: np.ndarray, begin: np.ndarray, length: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(low, length)[begin]


def grouped(low: np.ndarray, begin: np.ndarray, end: np.ndarray, mask: int = M64) -> tuple[np.ndarray, np.ndarray]:
    """(number of its term for each slice, a slice that has it for each term): slices with equal bytes get one number.

    Slices are grouped by length and xxhash, then each is held against its group's first, byte for byte; what differs though
    hash and length agree forms further groups. `mask` weakens the hash, for tests.
    """
    term, first, size = np.zeros(len(begin), np.int64), [], end - begin
    order = np.argsort(size, kind="stable")
    edges = np.r_[0, np.flatnonzero(np.diff(size[order])) + 1, len(order)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        left = order[a:b]
        if not len(left):
            continue
        length = int(size[left[0]])
        if length < SHORT:
            hashes = xxh64(_grid(low, begin[left], length))
        else:
            hashes = np.fromiter((xxhash.xxh64_intdigest(low[s : s + length]) for s in begin[left]), np.uint64, len(left))
        hashes &= np.uint64(mask)
        while len(left):
            _, head, group = np.unique(hashes, return_index=True, return_inverse=True)
            same = np.ones(len(left), bool)
            step = max(1, (1 << 22) // length)
            for i in range(0, len(left), step):
                part = slice(i, i + step)
                same[part] = (_grid(low, begin[left[part]], length) == _grid(low, begin[left[head[group[part]]]], length)).all(1)
            term[left[same]] = sum(map(len, first)) + group[same]
            first.append(left[head])
            left, hashes = left[~same], hashes[~same]
    return term, np.concatenate(first) if first else np.zeros(0, np.int64)


def count_terms(docs: DataFrame, mask: int = M64) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with the term, by language and source; null columns count as ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [batch.column(i).fill_null("").dictionary_encode() for i in (0, 1)]
            lang, source = (c.indices.to_numpy() for c in codes)
            many = max(1, len(codes[1].dictionary))
            group = lang.astype(np.int64) * many + source
            for low, _, data, offsets in segments(batch.column(2), 1 << 22):
                data, begin, end, text = spans(data, offsets)
                if not len(begin):
                    continue
                term, first = grouped(data, begin, end, mask)
                wide = len(first)
                # once for each text and term, then added up for each group and term
                each, times = np.unique(text * wide + term, return_counts=True)
                cell, at = np.unique(group[low + each // wide] * wide + each % wide, return_inverse=True)
                n, found = np.bincount(at, times).astype(np.int64), np.bincount(at)
                rep = first[cell % wide]
                start, size = begin[rep], end[rep] - begin[rep]
                bounds = np.r_[0, np.cumsum(size)]
                flat = data[np.repeat(start - bounds[:-1], size) + np.arange(bounds[-1])]
                terms = pa.LargeStringArray.from_buffers(len(rep), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(flat.tobytes())).cast(pa.string())
                names = [c.dictionary.take(pa.array(i)) for c, i in zip(codes, (cell // wide // many, cell // wide % many), strict=True)]
                yield pa.RecordBatch.from_arrays([*names, terms, pa.array(n), pa.array(found.astype(np.int64))], names=["lang", "source", "term", "n", "docs"])

    counted = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: np.ndarray, total: int | np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * count / total) for 0 <= count <= total < 2**53, in longs: a long division by steps of a thousand."""
    left = np.asarray(count, np.int64)
    out = np.zeros_like(left)
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // total
        left = left % total
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def block_divergences(groups: np.ndarray, terms: int, row: np.ndarray, column: np.ndarray, count: np.ndarray, kept: int, low: int, high: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """One block of a language: summed divergences of its sources low .. high - 1 from all sources, and what stands out.

    groups: each source's sum of counts over all kept terms of the language (there are `kept`); row, column, count: the entries of
    the block's CSR matrix by row. Returns the sums over the block's terms (high - low rows), and (row, column, f) of entries whose share is above the
    language's. A term that neither source has adds what their empty shares differ by; so sums start from that, and are corrected
    where one of both has an entry, by one reduceat over the stored entries.
    """
    total = np.maximum(groups + 2 * kept, 1)
    none = share(np.full(len(groups), 2), total)
    indptr = np.searchsorted(row, np.arange(len(groups) + 1))
    p = share(count + 2, total[row])
    filled = np.flatnonzero(np.diff(indptr))
    sums = np.zeros((high - low, len(groups)), np.int64)
    for s in range(low, high):
        own = slice(indptr[s], indptr[s + 1])
        line = np.full(terms, none[s])
        line[column[own]] = p[own]
        out = terms * apart(none[s], none)
        # entries of s against sources without the term
        step = max(1, (1 << 21) // max(1, own.stop - own.start))
        for i in range(0, len(groups), step):
            part = slice(i, i + step)
            out[part] += (apart(p[own][None, :], none[part][:, None]) - apart(none[s], none[part])[:, None]).sum(1)
        # entries of the others, in place of what was assumed for them
        if len(filled):
            mine = line[column]
            out[filled] += np.add.reduceat(apart(mine, p) - apart(mine, none[row]), indptr[filled])
        sums[s - low] = out
    whole = np.bincount(column, count, terms).astype(np.int64) if count.sum() < 1 << 53 else np.array([int(count[column == c].sum()) for c in range(terms)], np.int64)
    q = share(whole + 2, max(1, int(groups.sum()) + 2 * kept))[column]
    high_entry = np.flatnonzero((p > q) & (row >= low) & (row < high))
    return sums, (row[high_entry], column[high_entry], apart(p[high_entry], q[high_entry]))


def divergence_audit(docs: DataFrame, least: int = LEAST, top: int = TOP, entries: int = ENTRIES, pairs: int = PAIRS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from each other one, and by which terms it
    stands out from its language.

    A language keeps the terms that occur in `least` of its documents or more. Shares are 1 + floor(10**9 (count + 2) / (N + 2 V)), N a
    group's occurrences of kept terms and V their number; the divergence of two shares is floor((p - q)**2 / (p + q)). Part `pair`
    has each other source of the language and the sum over all kept terms (0 where none is kept); part `term` the `top` terms with
    shares above the language's. Ranks go by falling value, then by the item's bytes.

    Null texts, languages and sources count as ''; repeated rows are documents of their own; a language with one source has no
    pairs; an empty table gives an empty result. Sums of counts must stay below 2**52.

    A hot source or word is added up before it is shuffled. Blocks of a language hold about `entries` entries, dealt by a hash of the term, and
    a block of many sources is worked on in stripes of about `pairs` pairs, so no task holds a whole language.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    named = docs.select(text("lang"), text("source"), "text")
    found = F.sum("docs").over(Window.partitionBy("lang", "term"))  # over a term's sources, a row each
    cells = settle(count_terms(named).withColumn("found", found).where(F.col("found") >= least).select("lang", "source", "term", "n"))
    sizes = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    by_lang = cells.groupBy("lang").agg(F.count("*").alias("stored"), F.count_distinct("term").alias("kept"))
    groups = named.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(by_lang, "lang", "left").fillna(0, ["total", "stored", "kept"])
    # a language's sources in order, counted over its summary rows
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = groups.withColumn("at", place).withColumn("many", F.count("*").over(Window.partitionBy("lang")))
    groups = groups.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("stored") / entries)).cast("int"))
    groups = settle(groups.withColumn("stripes", F.greatest(F.lit(1), F.least("many", F.ceil(F.col("many") * F.col("many") / pairs))).cast("int")))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["lang", "block", "stripe"]
    lists = groups.withColumn("block", each("blocks")).withColumn("stripe", each("stripes")).select(*keys, "at", "total", "kept", "many", "stripes")
    mine = cells.join(groups.select("lang", "source", "at", "blocks", "stripes"), ["lang", "source"])
    mine = mine.withColumn("block", F.pmod(F.xxhash64("term"), "blocks").cast("int")).withColumn("stripe", each("stripes")).select(*[F.col(k).alias(f"own_{k}") for k in keys], F.col("at").alias("row"), "term", "n")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(left.column("at").to_numpy(), kind="stable")
        groups = left.column("total").to_numpy()[order]
        lang, stripe, kept, many, stripes = (left.column(c)[0].as_py() for c in ("lang", "stripe", "kept", "many", "stripes"))
        low, high = many * stripe // stripes, many * (stripe + 1) // stripes
        encoded = right.column("term").combine_chunks().dictionary_encode()
        encoded = encoded.combine_chunks() if isinstance(encoded, pa.ChunkedArray) else encoded
        row, column, count = right.column("row").to_numpy(), encoded.indices.to_numpy(), right.column("n").to_numpy()
        by_row = np.lexsort((column, row))
        names = encoded.dictionary
        sums, (at, of, value) = block_divergences(groups, len(names), row[by_row], column[by_row], count[by_row], kept, low, high)
        alike = pc.rank(names, sort_keys="ascending", tiebreaker="first").to_numpy()
        best = np.lexsort((alike[of], -value, at))
        at, of, value = at[best], of[best], value[best]
        first = np.arange(len(at)) - np.searchsorted(at, at) < top
        at, of, value = at[first], of[first], value[first]
        i, j = np.nonzero(np.arange(many)[None, :] > np.arange(low, high)[:, None])  # each pair once
        n = len(i) + len(at)
        item = pa.concat_arrays([pa.nulls(len(i), pa.string()), names.take(pa.array(of)).cast(pa.string())])
        number = lambda a, b: pa.array(np.r_[a, b].astype(np.int64))
        return pa.table([pa.array([lang] * n, pa.string()), number(i + low, at), number(j, np.full(len(at), -1)), item, number(sums[i, j], value)], names=["lang", "at", "other", "item", "value"])

    found = lists.groupBy(*keys).cogroup(mine.groupBy(*[f"own_{k}" for k in keys])).applyInArrow(work, "lang string, at long, other long, item string, value long")
    found = settle(found)
    sums = found.where("item is null").groupBy("lang", "at", "other").agg(F.sum("value").alias("value"))
    both = sums.select("lang", F.explode(F.array(F.struct("at", "other"), F.struct(F.col("other").alias("at"), F.col("at").alias("other")))).alias("p"), "value").select("lang", "p.at", "p.other", "value")
    names = groups.select("lang", F.col("at").cast("long").alias("at"), "source")
    both = both.join(names.select("lang", F.col("at").alias("other"), F.col("source").alias("item")), ["lang", "other"]).select("lang", "at", F.lit("pair").alias("part"), "item", "value")
    terms = found.where("item is not null").select("lang", "at", F.lit("term").alias("part"), "item", "value")
    out = both.unionByName(terms).join(names, ["lang", "at"])
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    out = out.withColumn("rank", rank.cast("int")).where((F.col("part") == "pair") | (F.col("rank") <= top))
    return out.select("lang", "source", "part", "item", "value", "rank")
