"""Mixing sources to target weights by fixed-length blocks, multinomial shard counts and index permutations."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convlake.llm.common import clear, settle, with_offsets, word_count
from convlake.llm.textkit import U, mix

WEIGHTS = (5.0, 2.0, 1.0)
WORDS = r"[^\x20\x09-\x0D]+"
SLOTS = 4096  # slots that one row stands for before they are made
PART_SLOTS = 1 << 20  # slots that one task makes
ROUNDS = 8  # of the Feistel network
DEALT = ["source_key", "shard", "first", "room", "slots", "cut", "blocks", "source_size"]


def targets(sources: DataFrame, share: float = 1.5, limit: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source key, source_size) with `target`: `share` of all sizes split by weight, none above `limit` times its size.

    Sources in order of their code points, null last, weigh weights[0], weights[1], ... in turn. What is above a limit goes to the
    others by weight until none is above: a source reaches its limit before another if limit / weight is smaller, so running sums
    in that order give the answer without a loop. One row per source; the sums are windows over that summary.
    """
    sources = sources.withColumn("__w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("source_rank"), F.lit(len(weights))) + 1).cast("int")))
    sources = sources.withColumn("__cap", F.lit(limit) * F.col("source_size")).withColumn("__at", F.col("__cap") / F.col("__w"))
    order = Window.orderBy("__at", "source_rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    sources = (
        sources.withColumn("__full", F.coalesce(F.sum("__cap").over(order), F.lit(0.0)))
        .withColumn("__used", F.coalesce(F.sum("__w").over(order), F.lit(0.0)))
        .withColumn("__level", (F.lit(share) * F.sum("source_size").over(every) - F.col("__full")) / (F.sum("__w").over(every) - F.col("__used")))
        # where the water stands: levels fall from the first source that isn't full on
        .withColumn("__water", F.max(F.when(F.col("__at") > F.col("__level"), F.col("__level"))).over(every))
    )
    target = F.least(F.col("__cap"), F.coalesce(F.col("__water") * F.col("__w"), F.col("__cap")))
    return sources.withColumn("target", target).drop("__w", "__cap", "__at", "__full", "__used", "__level", "__water")


def permutation(blocks: int, key: int, inverse: bool = False) -> Callable[[np.ndarray], np.ndarray]:
    """A pseudorandom permutation of 0 .. blocks - 1: a keyed Feistel network over an even number of bits that just hold them;
    what falls beyond goes through the network again until it doesn't (cycle walking). The inverse runs the rounds backwards."""
    half = U(max(1, ((blocks - 1).bit_length() + 1) // 2))
    mask = (U(1) << half) - U(1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15) ^ mix(np.array([key % 2**64], np.uint64)))
    turn = lambda right, k: mix(right ^ k) & mask

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> half, v & mask
        for k in keys[::-1] if inverse else keys:
            left, right = (right ^ turn(left, k), left) if inverse else (right, left ^ turn(right, k))
        return left << half | right

    def walk(places: np.ndarray) -> np.ndarray:
        v = once(places.astype(np.uint64))
        while len(out := np.flatnonzero(v >= U(blocks))):
            v[out] = once(v[out])
        return v.astype(np.int64)

    return walk


def stream_key(seed: int, source: int, epoch: int) -> int:
    return int.from_bytes(hashlib.sha256(f"{seed} {source} {epoch}".encode()).digest()[:8])


def drawn(slots: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Counts by source and shard: each shard has its share of all slots, and fills them by one multinomial draw over the sources, each as
    likely as it has slots."""
    total = int(slots.sum())
    out = np.zeros((len(slots), shards), np.int64)
    for h in range(shards if total else 0):
        out[:, h] = np.random.default_rng((seed, h)).multinomial(total // shards + (h < total % shards), slots / total)
    return out


def corrected(counts: np.ndarray, room: np.ndarray, want: int) -> np.ndarray:
    """One source's counts, none above its shard's room, with the least change that brings their sum to `want`: what is lacking or too
    much is spread evenly over the shards that can give or take."""
    counts = np.minimum(counts, room)
    while left := want - int(counts.sum()):
        free = room - counts if left > 0 else counts
        at = np.flatnonzero(free)
        if not len(at):
            break
        give = np.minimum(free[at], max(1, abs(left) // len(at)))
        at, give = (at, give) if give.sum() <= abs(left) else (at[: abs(left)], give[: abs(left)])
        counts[at] += np.sign(left) * give
    return counts


def places(k: np.ndarray, first: int, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Pass and place of a shard's k-th slots: it goes through its stretch of places once, and then again in the next pass."""
    return k // room, first + k % room


def dealt(sources: DataFrame, block: int, shards: int, seed: int, draw_seed: int | None = None) -> DataFrame:
    """The draw: (source_key, shard, first, room, slots, cut, blocks, source_size), one row per source and shard.

    A source's blocks have as many places in a pass; a shard owns a stretch of `room` of them from `first` on, in both passes. How
    many slots a shard takes from each source is drawn; in the last step the counts are corrected to the source's target, and
    `cut` words are left out of the last slot of one shard, so that targets are met to the word. The draw is made over the summary, a row a source.
    """
    draw_seed = seed if draw_seed is None else draw_seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.concatenate([np.column_stack([c.to_numpy() for c in batch.columns]) for batch in batches] or [np.zeros((0, 3), np.int64)])
        table = table[np.argsort(table[:, 0])]
        want = -(-table[:, 2] // block)
        for (source, size, wanted), counts in zip(table.tolist(), drawn(want, shards, draw_seed), strict=True):
            blocks = -(-size // block)
            edge = np.arange(shards + 1) * blocks // shards
            first, room = edge[:-1], np.diff(edge)
            lacks = blocks * block - size
            # the place of the short block in each pass, and the shard and slot that take it
            short = [int(permutation(blocks, stream_key(seed, source, epoch), inverse=True)(np.array([blocks - 1]))[0]) for epoch in (0, 1)]
            holder = [(h := int(np.searchsorted(edge, p, "right")) - 1, e * int(room[h]) + p - int(first[h])) for e, p in enumerate(short)]
            words = lambda c: int(c.sum()) * block - lacks * sum(int(c[h]) > k for h, k in holder)  # noqa: B023, E731
            slots = -(-wanted // block)
            counts = corrected(counts, 2 * room, slots)
            while words(counts) < wanted:  # short blocks are among them
                slots += -(-(wanted - words(counts)) // block)
                counts = corrected(counts, 2 * room, slots)
            cut = np.zeros(shards, np.int64)
            while over := words(counts) - wanted:
                h = int(np.flatnonzero(counts)[-1])
                length = block - (lacks if (h, int(counts[h]) - 1) in holder else 0)
                if over < length:
                    cut[h] = over
                    break
                counts[h] -= 1
            same = np.ones(shards, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (source * same, np.arange(shards), first, room, counts, cut, blocks * same, size * same)], names=DEALT)

    s = sources.where("source_size > 0 and target > 0").select("source_key", "source_size", F.least(F.round("target").cast("long"), 2 * F.col("source_size")).alias("wanted"))
    return s.where("wanted > 0").repartition(1).mapInArrow(run, ", ".join(f"{n} long" for n in DEALT))


def slots(draw: DataFrame, block: int, seed: int) -> DataFrame:
    """(source_key, epoch, place, index, length, shard): one row per slot of the draw. The slot at a place takes the block at that
    place of the pass's permutation."""
    chunk = F.explode(F.expr(f"sequence(0L, (slots - 1) div {SLOTS})"))
    # a number of partitions, as few small rows make many slots, which would else be put together in one task
    many = draw.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    parts = max(int(draw.sparkSession.conf.get("spark.sql.shuffle.partitions")), many // PART_SLOTS)
    rows = draw.where("slots > 0").withColumn("chunk", chunk).repartition(parts, "source_key", "shard", "chunk").select(*DEALT, "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, shard, first, room, many, cut, blocks, size, chunk in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                k = np.arange(chunk * SLOTS, min(many, (chunk + 1) * SLOTS))
                epochs, place = places(k, first, room)
                for epoch in np.unique(epochs).tolist():
                    on = epochs == epoch
                    index = permutation(blocks, stream_key(seed, source, epoch))(place[on])
                    length = np.where(index == blocks - 1, size - (blocks - 1) * block, block) - np.where(k[on] == many - 1, cut, 0)
                    same = lambda v: pa.array(np.full(int(on.sum()), v, np.int64))  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays([same(source), same(epoch), pa.array(place[on]), pa.array(index), pa.array(length), same(shard).cast(pa.int32())], names=["source_key", "epoch", "place", "index", "length", "shard"])

    return rows.mapInArrow(run, "source_key long, epoch long, place long, index long, length long, shard int")


def mix_sources(docs: DataFrame, key: str = "doc_id", block: int = 64, shards: int = 16, share: float = 1.5, limit: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = 7, draw_seed: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mix the documents' words to target weights. Returns (documents, cuts, shard counts).

    documents: key, source, size, source_size, target, taken. cuts: key, source, epoch, first and last word (from 0, last
    exclusive) of each run of words that the mix takes, block index, output shard and slot; their lengths add up to `taken`.
    shard counts: shard, source, blocks: how many blocks each shard takes of each source.

    A source's words stand in one row in a hashed order of its documents and are cut into blocks. Each output shard draws how many
    slots it fills from each source (multinomial by target) and takes so many from its own stretch of the source's pseudorandom
    permutation, one per pass, which the join by index follows; so the draw (draw_seed; else seed) decides which blocks are taken. In the last
    step a source's counts are corrected to its target, and one slot is cut, so that sources meet targets to the word; a shard
    goes through its stretch twice at most, so no document exceeds twice its size.

    Null texts and texts without words have size 0 and take part in nothing; a null source is a source of its own; repeated
    rows are separate documents; an empty table gives empty results. A source of any size is spread by block.
    """
    words = word_count(F.col("text")).alias("size")
    thin = settle(docs.select(F.col(key), F.col("source"), words, F.monotonically_increasing_id().alias("__row")))
    return mix_sizes(thin, key, block, shards, share, limit, weights, seed, draw_seed)


def mix_sizes(thin: DataFrame, key: str, block: int, shards: int, share: float, limit: float, weights: tuple[float, ...], seed: int, draw_seed: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    order = Window.orderBy(F.col("source").asc_nulls_last())
    sources = thin.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("source_rank", F.row_number().over(order) - 1)
    sources = sources.withColumn("source_key", F.col("source_rank").cast("long"))
    sources = settle(targets(sources, share, limit, weights))
    own = sources.select(F.col("source").alias("__s"), "source_key", "source_size", "target")
    # the summary has a row for each source; it is broadcast only if it is small
    few = sources.count() <= 10_000
    own = F.broadcast(own) if few else own
    named = thin.join(own, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    placed = settle(with_offsets(settle(named), ["source_key"], [key, "__row"], "size", "begin"))
    draw = settle(dealt(sources, block, shards, seed, draw_seed))
    counts = draw.groupBy("shard", "source_key").agg(F.sum("slots").alias("blocks")).where("blocks > 0")
    counts = counts.join(sources.select("source_key", "source"), "source_key").select(F.col("shard").cast("int").alias("shard"), "source", "blocks")
    uses = slots(draw, block, seed)
    parts = placed.where("size > 0").withColumn("index", F.explode(F.expr(f"sequence(begin div {block}, (begin + size - 1) div {block})")))
    # few rows make many slots, which Spark's estimates don't see: without the hint it would broadcast them
    cuts = parts.join(uses.hint("merge"), ["source_key", "index"])
    low, high = F.greatest(F.col("begin"), F.col("index") * block), F.least(F.col("begin") + F.col("size"), F.col("index") * block + F.col("length"))
    cuts = cuts.withColumn("first", low - F.col("begin")).withColumn("last", high - F.col("begin")).where("last > first")
    taken = cuts.groupBy("__row").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    out = placed.join(taken, "__row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    return out.select(key, "source", "size", "source_size", "target", "taken", "__row"), cuts.select(key, "__row", "source", "epoch", "first", "last", "index", "shard", F.col("place").alias("slot")), counts


def mixed_documents(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The mixed corpus with the columns of docs: one row for each pass (epoch) that takes words of a document.

    A row's text is the document's own text if the pass takes all of it, else the taken words, runs of neighbouring blocks
    joined, in order, by single spaces. Documents without words are kept as they are. n_chars, where present, follows the text.
    Rows are tied to their text by the key and a row number, so repeated rows stay apart.
    """
    own = settle(clear(docs, "__row", "__runs", "__whole").withColumn("__row", F.monotonically_increasing_id()))
    thin = settle(own.select(key, "source", word_count(F.col("text")).alias("size"), "__row"))
    opts = {"block": 64, "shards": 16, "share": 1.5, "limit": 2.0, "weights": WEIGHTS, "seed": 7} | options
    sized, cuts, _ = mix_sizes(thin, key, **opts)
    runs = cuts.groupBy("__row", "epoch").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"), F.sum(F.col("last") - F.col("first")).alias("got"))
    plan = runs.join(sized.select("__row", "size"), "__row").unionByName(sized.where("size = 0").select("__row", F.lit(0).alias("epoch"), F.expr("cast(null as array<struct<first: bigint, last: bigint>>)").alias("runs"), F.lit(0).cast("long").alias("got"), "size"))
    cut = F.expr(rf"array_join(flatten(transform(array(regexp_extract_all(text, '{WORDS}', 0)), w -> flatten(transform(__runs, r -> slice(w, cast(r.first + 1 as int), cast(r.last - r.first as int)))))), ' ')".replace("\\", "\\\\"))
    plan = plan.select("__row", F.col("runs").alias("__runs"), (F.col("got") == F.col("size")).alias("__whole"))
    out = own.join(plan, "__row").withColumn("text", F.when(F.col("__whole"), F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__whole"), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
