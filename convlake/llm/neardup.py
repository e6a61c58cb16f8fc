"""Near duplicates by HyperMinHash registers: banding, a collision-corrected estimate, and confirmation on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convlake.llm.common import clear, components, fitted, release, settle
from convlake.llm.textkit import SEGMENT, U, mix, segments, shingles, span_hashes, text_bytes, words

BUCKETS_LOG = 8
BUCKETS = 1 << BUCKETS_LOG
MANTISSA = 4
BITS = 6 + MANTISSA  # a register: leading zeros and mantissa
EMPTY = (1 << BITS) - 1
ROWS = 6  # registers in a long, which is a band: 42 bands miss a pair of similarity 0.8 once in 1e5, witnesses included
BANDS = BUCKETS // ROWS
WITNESS = 4  # following longs that go with a band
TRIES = 24
ROUNDS = 2  # rounds in which a node meets one leader; then all that is still apart
SURE = 4.0  # deviations below the threshold from which on registers rule a pair out
SMALL = 512  # sets of so many shingles or fewer are held against each other whole, their hashes cut to 16 bits
NEARBY = 1_000_000  # keys that may be broadcast
NEARBY_BYTES = 1 << 25  # and bytes of what goes with them
BROADCAST_TASK = 1 << 22  # bytes that a task sends of rows to be broadcast
SKETCH = "n_shingles long, sign_a long, sign_b long, raw array<long>, dense array<long>"
_FROM = (mix(np.arange(1, TRIES * BUCKETS + 1, dtype=np.uint64)) >> U(64 - BUCKETS_LOG)).astype(np.int64).reshape(TRIES, BUCKETS)
_SHIFT = np.arange(ROWS) * BITS


def sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, sorted within each, and where each text's begin (one more entry than texts)."""
    begin, end, text = words(data, offsets)
    hashes, owner = shingles(span_hashes(data, begin, end), text, size)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.r_[True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])] if len(hashes) else np.empty(0, bool)
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(offsets)))


def registers(hashes: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """HyperMinHash of each sorted set (a row): in each bucket (first bits) the least hash, as its leading zeros and MANTISSA
    further bits; and the same rows made dense: an empty bucket takes over the register of a filled one, the first that a fixed
    sequence of its own names, else the next to the right. So dense registers of small sets agree as often as those of large
    ones, and a band is as choosy."""
    n = len(cuts) - 1
    raw = np.full((n, BUCKETS), EMPTY, np.uint16)
    owner = np.repeat(np.arange(n), np.diff(cuts))
    place = owner * BUCKETS + (hashes >> U(64 - BUCKETS_LOG)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.empty(0, np.int64)
    rest = hashes[first] << U(BUCKETS_LOG)
    zeros = np.minimum(62, 53 - np.frexp((rest >> U(11)).astype(float))[1]).astype(np.uint64)
    at = place[first]
    raw.ravel()[at] = (zeros << U(MANTISSA) | (rest << (zeros + U(1))) >> U(64 - MANTISSA)).astype(np.uint16)
    dense = raw.copy()
    flat = dense.ravel()
    filled = flat != EMPTY
    open_ = np.flatnonzero(~filled & np.repeat(np.diff(cuts) > 0, BUCKETS))
    for row in _FROM:
        source = open_ - open_ % BUCKETS + row[open_ % BUCKETS]
        has = filled[source]
        flat[open_[has]] = flat[source[has]]
        open_ = open_[~has]
    if len(open_):  # a text has a filled bucket, so the next to the right, going round, is its own
        i, low = np.searchsorted(at, open_), np.searchsorted(at, open_ - open_ % BUCKETS)
        i = np.where((i < len(at)) & (at[np.minimum(i, len(at) - 1)] // BUCKETS == open_ // BUCKETS), i, low)
        flat[open_] = flat[at[i]]
    return raw, dense


def pack(rows: np.ndarray) -> pa.Array:
    """Rows of registers, ROWS of them in a long."""
    longs = (rows[:, : BANDS * ROWS].astype(np.int64).reshape(len(rows), BANDS, ROWS) << _SHIFT).sum(2)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * BANDS), pa.array(longs.ravel()))


def unpack(column: pa.Array) -> np.ndarray:
    longs = column.flatten().to_numpy().reshape(-1, BANDS, 1)
    return ((longs >> _SHIFT) & EMPTY).reshape(-1, BANDS * ROWS)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, at: float) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of pairs of register rows with set sizes n and m, less what chance agreements add; and their standard
    deviation for pairs of similarity `at`. Buckets are a sample of the union without replacement."""
    filled = (a != EMPTY) | (b != EMPTY)
    used = np.maximum(1, filled.sum(1))
    x = np.minimum(n, m) / np.maximum(np.maximum(n, m), 1)
    chance = 0.169919487 * 2.0**-MANTISSA * 4 * x / (1 + x) ** 2
    agree = ((a == b) & filled).sum(1) / used
    left = np.maximum(0.05, 1 - used * (1 + at) / np.maximum(n + m, 1))
    return np.clip((agree - chance) / (1 - chance), 0, 1), np.sqrt(at * (1 - at) / used * left) + 0.3 / used


def sketch(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, n_shingles, sign_a, sign_b, raw and dense registers): the signs are two sums over the set, equal for equal sets."""
    schema = T.StructType([docs.schema[key], *T.StructType.fromDDL(SKETCH).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in segments(batch.column(1)):
                hashes, cuts = sets(data, offsets, size)
                total = lambda x: np.diff(np.r_[U(0), np.cumsum(x, dtype=np.uint64)][cuts]).view(np.int64)  # noqa: E731, B023
                columns = [batch.column(0).slice(low, high - low), pa.array(np.diff(cuts)), pa.array(total(hashes)), pa.array(total(mix(hashes ^ U(0x5851F42D4C957F2D)))), *map(pack, registers(hashes, cuts))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(key, F.coalesce(text, F.lit("")).alias(text)).mapInArrow(run, schema)


def likely(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose registers don't rule them out."""
    schema = T.StructType.fromDDL("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
            j, deviation = estimate(unpack(get("ra")), unpack(get("rb")), get("na").to_numpy(), get("nb").to_numpy(), percent / 100)
            keep = pa.array(j >= percent / 100 - SURE * deviation)
            yield pa.RecordBatch.from_arrays([get("a").filter(keep), get("b").filter(keep)], names=["a", "b"])

    return pairs.mapInArrow(run, schema)


def confirmed(pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of pairs (a, b, ta, tb) with both texts, those whose full shingle sets meet the threshold."""
    schema = T.StructType.fromDDL("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            bytes_ = np.cumsum(sum(np.diff(text_bytes(batch.column(i))[1]) for i in (2, 3)))
            row = 0
            while row < batch.num_rows:
                end = max(row + 1, int(np.searchsorted(bytes_, (bytes_[row - 1] if row else 0) + SEGMENT, "right")))
                parts = [sets(*text_bytes(batch.column(i).slice(row, end - row)), size) for i in (2, 3)]
                n = end - row
                hashes = np.concatenate([h for h, _ in parts])
                owner = np.concatenate([np.repeat(np.arange(n), np.diff(c)) for _, c in parts])
                order = np.lexsort((hashes, owner))
                hashes, owner = hashes[order], owner[order]
                twice = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
                common, total = np.bincount(owner[1:][twice], minlength=n), np.bincount(owner, minlength=n)
                keep.append((total > 0) & (100 * common >= percent * (total - common)))
                row = end
            kept = pa.array(np.concatenate(keep)) if keep else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(kept) for i in (0, 1)], names=["a", "b"])

    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, schema)


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def among(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose node is in keys (distinct); keys are broadcast if they are few, so that the rows needn't be shuffled whole."""
    return rows.join(F.broadcast(keys) if keys.count() <= NEARBY else keys, "node", "left_semi")


def small_sets(texts: DataFrame, size: int) -> DataFrame:
    """(node, few): the set's hashes cut to 16 bits, distinct; null if the set has more than SMALL shingles or two texts have the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in segments(batch.column(1)):
                hashes, cuts = sets(data, offsets, size)
                short = (hashes >> U(48)).astype(np.uint16)  # sorted, as the hashes are
                owner = np.repeat(np.arange(high - low), np.diff(cuts))
                new = np.r_[True, (short[1:] != short[:-1]) | (owner[1:] != owner[:-1])] if len(short) else np.empty(0, bool)
                keep = new & (np.diff(cuts) <= SMALL)[owner]
                ends_ = np.r_[0, np.cumsum(np.bincount(owner[keep], minlength=high - low))].astype(np.int32)
                few = pa.ListArray.from_arrays(pa.array(ends_), pa.array(short[keep].view(np.int16)), mask=pa.array(np.diff(cuts) > SMALL))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), few], names=["node", "few"])

    made = texts.select("node", "text").mapInArrow(run, "node long, few array<smallint>")
    return made.groupBy("node").agg(F.when(F.count("*") == 1, F.first("few")).alias("few"))


def beside(pairs: DataFrame, rows: DataFrame, size: Column, names: tuple[str, ...]) -> DataFrame:
    """Pairs with the columns of rows (node, ...) for both ends, named name + "a" and name + "b". If the rows are few bytes, they are
    broadcast and the pairs only dealt out evenly; else both are shuffled."""
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    small = total <= NEARBY_BYTES
    if small:
        rows = rows.coalesce(max(1, -(-total // BROADCAST_TASK)))
        pairs = pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "b")
    for end in "ab":
        own = rows.toDF(end, *[n + end for n in names])
        pairs = pairs.join(F.broadcast(own) if small else own, end)
    return pairs


def differ(x: str, y: str) -> str:
    """SQL: in how many registers two longs differ; carries out of a register's lower bits show that the difference isn't zero."""
    low, high = (sum(v << (BITS * i) for i in range(ROWS)) for v in ((1 << (BITS - 1)) - 1, 1 << (BITS - 1)))
    return f"bit_count(((((({x}) ^ ({y})) & {low}L) + {low}L) | (({x}) ^ ({y}))) & {high}L)"


def apart(x: str, y: str) -> Column:
    """In how many witness registers two rows differ."""
    return F.expr(" + ".join(differ(f"{x}.w{i}", f"{y}.w{i}") for i in range(WITNESS)))


def slack(percent: int) -> int:
    """How many witnesses may differ, so that a pair at the threshold passes 19 times in 20, in each band anew."""
    t, n, sum_ = percent / 100, ROWS * WITNESS, 0.0
    for k in range(n + 1):
        sum_ += comb(n, k) * (1 - t) ** k * t ** (n - k)
        if sum_ >= 0.95:
            return k
    return n


def sized(x: str, y: str, percent: int) -> Column:
    return F.expr(f"100 * least({x}.n, {y}.n) >= {percent} * greatest({x}.n, {y}.n)")


def close(x: str, y: str, percent: int) -> Column:
    """Sizes allow the similarity, and the witnesses speak for it."""
    return sized(x, y, percent) & (apart(x, y) <= slack(percent))


def agree(x: str, y: str, percent: int) -> Column:
    """Do all raw registers of two rows speak for the threshold? The same test as in likely(), collisions taken out, within a join."""
    t, full = percent / 100, sum(EMPTY << (BITS * i) for i in range(ROWS))
    total = lambda each: f"aggregate(zip_with({x}.raw, {y}.raw, (p, q) -> {each}), 0, (s, v) -> s + v)"
    used = f"(1D * {total(differ('p & q', f'{full}L'))})"
    left = f"greatest(0.05D, 1D - {used} * {1 + t}D / ({x}.n + {y}.n))"
    chance = f"({0.169919487 * 2.0**-MANTISSA * 4}D * {x}.n * {y}.n / (({x}.n + {y}.n) * 1D * ({x}.n + {y}.n)))"
    return F.expr(f"{total(differ('p', 'q'))} <= (1D - {chance}) * ({1 - t}D * {used} + 0.3D * {SURE}D + {SURE}D * sqrt({t * (1 - t)}D * {used} * {left}))")


def may_link(x: str, y: str, percent: int) -> Column:
    """Can two rows be linked? Small sets tell: the hashes they share, and those that the cut to 16 bits may have made equal within
    x, are at least the intersection, so no link is lost. Larger ones go by their registers."""
    common = f"(size(array_intersect({x}.few, {y}.few)) + {x}.n - size({x}.few))"
    return F.when(F.expr(f"{x}.few is not null and {y}.few is not null"), F.expr(f"{100 + percent} * {common} >= {percent} * ({x}.n + {y}.n)")).otherwise(agree(x, y, percent))


def first_met(x: str, y: str) -> Column:
    """Is this the first band that two rows share?"""
    return F.expr(f"array_position(zip_with({x}.dense, {y}.dense, (p, q) -> p = q), true) = {x}.b + 1")


def members(nodes: DataFrame) -> DataFrame:
    """(node, n, band, w0, ...) of the bands that two nodes or more share; a band's witnesses are the longs that follow it."""
    every = nodes.select("node", F.expr("inline(transform(dense, (d, b) -> struct(b, xxhash64(b, d) as band)))"))
    shared = every.groupBy("band").agg(F.count("*").alias("size")).where("size > 1").select("band")
    rows = every.join(shared, "band").join(nodes.select("node", "n", F.expr(f"concat(dense, slice(dense, 1, {WITNESS}))").alias("__d")), "node")
    return rows.select("node", "n", "b", "band", *[F.expr(f"element_at(__d, b + {i + 2}) as w{i}") for i in range(WITNESS)])


def prefix_pairs(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes that include every pair of the similarity: sets meet in the rarest shingles of each.

    Of a set of n shingles in the order of their frequency, one of the first n - ceil(n * percent / 100) + 1 is also among another's
    first such ones if the two are linked. Every shingle is shuffled, and frequent ones pair all that have them among their first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in segments(batch.column(1)):
                hashes, cuts = sets(data, offsets, size)
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), lists], names=["node", "shingles"])

    own = settle(texts.select("node", "text").mapInArrow(run, "node long, shingles array<long>").withColumn("row", F.monotonically_increasing_id()))
    every = own.select("row", "node", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    known = every.join(every.groupBy("shingle").agg(F.count("*").alias("df")), "shingle")
    sorted_ = known.groupBy("row").agg(F.first("node").alias("node"), F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("s"))
    first = sorted_.select("node", "n", F.explode(F.expr(f"slice(s, 1, n - cast(ceil(n * {percent} / 100D) as int) + 1)")).alias("s")).where("s.df > 1").select("node", "n", "s.shingle")
    x, y = first.alias("x"), first.alias("y")
    met = x.join(y, F.expr("x.shingle = y.shingle and x.node < y.node") & sized("x", "y", percent))
    return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, exact: bool = False) -> DataFrame:
    """(key, n_shingles, component_id, kept): the components of documents linked by 100 * intersection >= percent * union.

    A document's set holds its distinct shingles of `size` words (runs without ASCII white space, A-Z lower-cased); fewer words
    are one shingle; a null or wordless text has the empty set and links with nothing. component_id is the smallest key that can
    be reached. A null key gets its class's component if others have one, and is never kept; repeated rows all get their row, and are
    all kept if they have the component's own key. An empty table gives an empty result. The key is a long.

    Equal sets are one class from the start, so exact copies are never paired. Classes meet in bands of registers. In each of the
    first ROUNDS rounds a node is compared with one leader, the closest of its bands', and components grow; in the last, what is
    still apart from its bucket's largest component is held against all others of the bucket within the join: small sets (SMALL)
    whole, larger ones by registers, so that what leaves the join are links and pairs next to the threshold, not pairs of the bucket.
    No bucket is capped. A pair that shares no band is missed: about one in 1e5 at the threshold, fewer above. With `exact`, pairs
    come from a prefix filter on full sets instead (prefix_pairs), which misses none and shuffles every shingle.
    """
    docs = clear(docs, *(set(docs.columns) - {key, text}))
    made = settle(sketch(docs, key, text, size).withColumnRenamed(key, "doc"))
    sign = ["n_shingles", "sign_a", "sign_b"]
    full = ["raw", "dense"]
    classes = settle(made.where("n_shingles > 0 and doc is not null").groupBy(*sign).agg(F.min("doc").alias("node"), *[F.first(c).alias(c) for c in full]))
    # a key that stands for two classes (repeated keys with other texts) ties them: one document, one component
    nodes = classes.select("node", F.col("n_shingles").alias("n"), *full)
    if exact:
        texts = docs.select(F.col(key).alias("node"), F.coalesce(text, F.lit("")).alias("text"))
        texts = settle(texts.join(classes.select("node").distinct(), "node", "left_semi"))
        pairs = settle(prefix_pairs(texts, size, percent))
        links = settle(confirmed(beside(pairs, texts, F.octet_length("text") + 16, ("t",)), size, percent).distinct())
        return labelled(made, classes, components(links), sign, key)
    member = settle(members(nodes))
    w = [f"w{i}" for i in range(WITNESS)]
    by_key = docs.select(F.col(key).alias("node"), F.col(text).alias("text"))
    label = None
    for turn in range(ROUNDS + 1):
        release(docs.sparkSession)
        now = member.withColumn("component", F.col("node"))
        if label is not None:
            now = member.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
        if turn:
            # what is left are the buckets whose members are still apart
            sums = now.groupBy("band", "component").agg(F.count("*").alias("c")).groupBy("band").agg(F.max_by("component", F.struct("c", "component")).alias("most"), F.count("*").alias("k"))
            now = fitted(settle(now.join(sums.where("k > 1").select("band", "most"), "band")))
            if now.isEmpty():
                break
        if turn < ROUNDS:
            mixed = F.xxhash64(F.lit(turn), "node") if turn else F.col("node")
            leader = now.groupBy("band").agg(F.min(F.struct(mixed.alias("h"), "node", "n", "component", *w)).alias("x"))
            met = now.join(leader, "band").select("x", F.struct("node", "n", "component", *w).alias("y")).where("x.component <> y.component")
            met = met.where(close("x", "y", percent)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), apart("x", "y").alias("d"))
            pairs = met.groupBy("b").agg(F.min_by("a", F.struct("d", "a")).alias("a")).select("a", "b")
        else:
            few = small_sets(among(by_key, now.select("node").distinct()).withColumn("text", F.coalesce("text", F.lit(""))), size)
            now = settle(now.join(nodes.select("node", "raw", "dense").join(few, "node", "left"), "node"))
            x, y = now.where("component <> most").alias("x"), now.alias("y")
            one = F.expr("x.band = y.band and x.component <> y.component and (y.component = y.most or x.node < y.node)")
            met = x.join(y, one & sized("x", "y", percent) & first_met("x", "y") & may_link("x", "y", percent))
            pairs = met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
        pairs = fitted(settle(pairs))
        if turn < ROUNDS:  # the last round's join has made this test
            pairs = fitted(settle(likely(beside(pairs, settle(among(nodes.select("node", "n", "raw"), ends(pairs))), F.lit(8 * (BANDS + 4)), ("n", "r")), percent)))
        release(docs.sparkSession)
        texts = settle(among(by_key, ends(pairs)).withColumn("text", F.coalesce("text", F.lit(""))))
        both = beside(pairs, texts, F.octet_length("text") + 16, ("t",))
        links = fitted(settle(confirmed(both, size, percent)))
        if links.isEmpty():
            continue
        if label is None:
            label = components(links)
            continue
        old = label
        links = links.join(old.toDF("a", "ca"), "a", "left").join(old.toDF("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        merged = components(links).withColumnRenamed("component", "to")
        moved = label.join(merged.toDF("component", "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        label = fitted(settle(moved.unionByName(merged.join(label.select("node"), "node", "left_anti").withColumnRenamed("to", "component"))))
    return labelled(made, classes, label, sign, key)


def labelled(made: DataFrame, classes: DataFrame, label: DataFrame | None, sign: list[str], key: str) -> DataFrame:
    """Every document's class and component; label has the components of linked nodes."""
    home = classes.select(*sign, F.col("node"))
    home = home.join(label, "node", "left").withColumn("component", F.coalesce("component", "node")) if label is not None else home.withColumn("component", F.col("node"))
    out = made.join(home.select(*sign, "component"), sign, "left").withColumn("component_id", F.coalesce("component", "doc"))
    return out.select(F.col("doc").alias(key), "n_shingles", "component_id", F.coalesce(F.col("doc") == F.col("component_id"), F.lit(False)).alias("kept"))
