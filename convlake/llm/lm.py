"""A hashed maximum-entropy language model: n-gram and skip features, a class-factored softmax, distributed gradient updates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convlake.llm.common import clear, ready, settle
from convlake.llm.textkit import LOWER, U, mix, segments, span_hashes, words

HEAD = 1 << 18  # frequent words whose counts every task holds; the others' come by a join
OWN = 128  # the most frequent words are classes of their own
WIDE = 16  # classes stand in WIDE groups of WIDE
GROUP_BITS, CLASS_BITS = 14, 16  # hashed contexts for the group, and for the class within a group
FEATURES = 4
STRIPE = 1 << 10
END = U(0x5EED0E2D0F7E87)
BEFORE = U(0xB0B0B0B0B0B0B0B1)


@dataclass
class Model:
    """What scoring needs; every part has a fixed bound. head: hashes of frequent words in order, with rank and count."""

    head: np.ndarray
    rank: np.ndarray
    count: np.ndarray
    tokens: int
    vocabulary: int
    class_tokens: np.ndarray
    class_words: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1, WIDE), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros((1 + WIDE, WIDE), np.float32))


def token_stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, ending classes and text numbers of all tokens: each text's words, then its end."""
    begin, end, text = words(data, offsets)
    n = len(offsets) - 1
    counts = np.bincount(text, minlength=n)
    at, last = np.arange(len(text)) + text, np.cumsum(counts) + np.arange(n)
    h, ending, owner = np.empty(len(text) + n, np.uint64), np.zeros(len(text) + n, np.int64), np.empty(len(text) + n, np.int64)
    h[at], h[last] = span_hashes(data, begin, end), END
    owner[at], owner[last] = text, np.arange(n)
    if len(begin):
        tail = LOWER[data[end - 1]].astype(np.uint64) * U(257) + np.where(end - begin > 1, LOWER[data[np.maximum(end - 2, 0)]], 0).astype(np.uint64)
        ending[at] = (mix(tail + U(99)) >> U(57)).astype(np.int64)
    return h, ending, owner


def classes(h: np.ndarray, ending: np.ndarray, own: np.ndarray, own_rank: np.ndarray) -> np.ndarray:
    """A frequent word's own class (its rank), else OWN and the ending's number."""
    i = np.minimum(np.searchsorted(own, h), len(own) - 1)
    return np.where(own[i] == h, own_rank[i], OWN + ending) if len(own) else OWN + ending


def contexts(h: np.ndarray, owner: np.ndarray) -> list[np.ndarray]:
    """64-bit contexts of each token: the word before, the two before, the second before (a skip), and the first with the third."""
    back = []
    for k in (1, 2, 3):
        b = np.full(len(h), BEFORE)
        if len(h) > k:
            same = owner[k:] == owner[:-k]
            b[k:][same] = h[:-k][same]
        back.append(b)
    a, b, c = back
    return [mix(a), mix(a * U(3) + mix(b)), mix(b + U(77)), mix(a * U(5) + mix(c + U(9)))]


def rows_of(ctx: np.ndarray, k: int, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight rows of one feature: for the group, and for the class within the token's group."""
    x = mix(ctx + U(k * 0x9E3779B97F4A7C15 % 2**64))
    first = (x >> U(64 - GROUP_BITS)).astype(np.int64)
    second = (mix(x ^ (group.astype(np.uint64) + U(1)) * U(0xC2B2AE3D27D4EB4F)) >> U(64 - CLASS_BITS)).astype(np.int64)
    return first, second + (1 << GROUP_BITS)


def softmax_parts(weights: np.ndarray, bias: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities over groups, and over the classes of the token's own group."""
    out, one_row, ones = [], np.empty((len(group), WIDE), weights.dtype), np.ones(WIDE, weights.dtype)
    for level in (0, 1):
        z = np.repeat(bias[:1], len(group), 0) if level == 0 else np.take(bias, 1 + group, axis=0)
        for r in rows:
            z += np.take(weights, r[level], axis=0, out=one_row, mode="clip")
        most = z
        while most.shape[1] > 1:  # the row's greatest, by halves
            most = np.maximum(most[:, : most.shape[1] // 2], most[:, most.shape[1] // 2 :])
        z -= most
        np.exp(z, out=z)
        z /= (z @ ones)[:, None]
        out.append(z)
    return out[0], out[1]


def training(key: Column | str = "doc_id", folds: int = 7, held: int = 2) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds != held, F.lit(True))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, ending, c): the count of each distinct token, counted within batches before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, es = [], []
            for _, _, data, offsets in segments(batch.column(0), 1 << 22):
                h, e, _ = token_stream(data, offsets)
                h, first, count = np.unique(h, return_index=True, return_counts=True)
                hs.append((h, count))
                es.append(e[first])
            if hs:
                h, e, c = np.concatenate([x for x, _ in hs]), np.concatenate(es), np.concatenate([x for _, x in hs])
                u, first, back = np.unique(h, return_index=True, return_inverse=True)
                total = np.bincount(back, c, len(u)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(e[first].astype(np.int32)), pa.array(total)], names=["word", "ending", "c"])

    made = texts.mapInArrow(run, "word long, ending int, c long")
    return made.groupBy("word").agg(F.max("ending").alias("ending"), F.sum("c").alias("c"))


def striped(texts: DataFrame, model: Model) -> np.ndarray:
    """Sums over all texts by weight row: observed classes if the model has no weights yet, else what the model expects.

    Each task adds up its own texts; stripes of rows are then summed across tasks. The table of sums has a fixed size.
    """
    total = (1 << GROUP_BITS) + (1 << CLASS_BITS) + 1 + WIDE  # the last rows are the biases'
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        observe = len(m.weights) == 1
        top = m.rank < OWN
        own, own_rank = m.head[top], m.rank[top]
        sums = np.zeros(total * WIDE)
        for batch in batches:
            for _, _, data, offsets in segments(batch.column(0), 1 << 21):
                h, ending, owner = token_stream(data, offsets)
                c = classes(h, ending, own, own_rank)
                group, inner = c // WIDE, c % WIDE
                rows = [rows_of(x, k, group) for k, x in enumerate(contexts(h, owner))]
                always = (np.full(len(h), total - 1 - WIDE), total - WIDE + group)
                if observe:
                    for level, target in ((0, group), (1, inner)):
                        low, high = (0, 1 << GROUP_BITS) if level == 0 else (1 << GROUP_BITS, (1 << GROUP_BITS) + (1 << CLASS_BITS))
                        for r, low, high in [*((r, low, high) for r in rows), (always, total - 1 - WIDE, total)]:
                            sums[low * WIDE : high * WIDE] += np.bincount((r[level] - low) * WIDE + target, minlength=(high - low) * WIDE)
                    continue
                for level, p in enumerate(softmax_parts(m.weights, m.bias, rows, group)):
                    low, high = (0, 1 << GROUP_BITS) if level == 0 else (1 << GROUP_BITS, (1 << GROUP_BITS) + (1 << CLASS_BITS))
                    table = sums[low * WIDE : high * WIDE].reshape(-1, WIDE)
                    biases = sums.reshape(-1, WIDE)[total - 1 - WIDE :]
                    columns, made = np.ascontiguousarray(p.T, float), np.zeros((WIDE, high - low))
                    for r in rows:
                        at = r[level] - low
                        for j in range(WIDE):
                            made[j] += np.bincount(at, columns[j], high - low)
                    table += made.T
                    for j in range(WIDE):
                        biases[0 if level == 0 else slice(1, None), j] += columns[j].sum() if level == 0 else np.bincount(group, columns[j], WIDE)
        stripes = [sums[i : i + STRIPE * WIDE].astype(np.float32).tobytes() for i in range(0, len(sums), STRIPE * WIDE)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(stripes)), pa.int32()), pa.array(stripes, pa.binary())], names=["stripe", "sums"])

    def add(table: pa.Table) -> pa.Table:
        out = sum(np.frombuffer(b, np.float32).astype(float) for b in sorted(table.column("sums").to_pylist()))  # one order, so that reruns agree
        return pa.table({"stripe": table.column("stripe").slice(0, 1), "sums": pa.array([out.tobytes()], pa.binary())})

    parts = texts.mapInArrow(run, "stripe int, sums binary").groupBy("stripe").applyInArrow(add, "stripe int, sums binary").collect()
    return np.concatenate([np.frombuffer(r.sums, float) for r in sorted(parts)]).reshape(-1, WIDE) if parts else np.zeros((total, WIDE))


def head_threshold(counts: DataFrame, most: int = HEAD) -> int:
    """The least count that at most `most` words reach, from a histogram of counts: single ones below 4096, then 64 steps an octave."""
    c = F.col("c")
    step = F.when(c < 4096, c).otherwise(F.ceil(F.pow(F.lit(2.0), F.floor(F.log2(c) * 64) / 64)))  # no word of a step counts less
    steps = counts.groupBy(step.cast("long").alias("least")).agg(F.count("*").alias("n")).orderBy(F.desc("least")).collect()
    reached, threshold = 0, 1 << 62
    for r in steps:
        reached += r.n
        if reached > most:
            break
        threshold = r.least
    return threshold


def train(texts: DataFrame, rounds: int = 2, rate: float = 0.5) -> tuple[Model, DataFrame]:
    """The model and the table of all word counts (settled), from one column of texts.

    Word counts come first. The weights start from what each context saw: its classes' log ratio to the class's share, damped, a
    FEATURES-th of it for each feature. Then `rounds` gradient updates: tasks add up the classes expected under the current
    weights, and each weight moves along observed - expected, scaled by their mean (a diagonal preconditioner). Every round covers
    all texts; only the sums by weight row, a table of fixed size, come to the driver.
    """
    ready(texts.sparkSession)
    counts = settle(word_counts(texts))
    tokens, vocabulary = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head = counts.where(F.col("c") >= head_threshold(counts)).select("word", "ending", "c").toPandas().sort_values(["c", "word"], ascending=[False, True])
    top = head.head(OWN)
    by_class = counts.groupBy("ending").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    class_tokens, class_words = np.zeros(OWN), np.zeros(OWN)
    for r in by_class:
        class_tokens[r.ending], class_words[r.ending] = r.c, r.n
    np.subtract.at(class_tokens, top["ending"].to_numpy(int), top["c"].to_numpy(float))
    np.subtract.at(class_words, top["ending"].to_numpy(int), 1)
    h = head["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    model = Model(h[order], order.astype(np.int64), head["c"].to_numpy(np.int64)[order], tokens, vocabulary, class_tokens, class_words)
    seen = striped(texts, model)
    big = (1 << GROUP_BITS) + (1 << CLASS_BITS)
    bias = np.log((seen[big:] + 0.5) / (seen[big:] + 0.5).sum(1, keepdims=True))
    share = np.exp(bias)
    # rows of the class table serve several groups by hashing; their prior is the classes' overall share within groups
    inner = (seen[big + 1 :] + 0.5).sum(0)
    prior = np.where(np.arange(big)[:, None] < (1 << GROUP_BITS), share[0], inner / inner.sum())
    weights = np.log((seen[:big] + 4 * prior) / (seen[:big].sum(1, keepdims=True) + 4) / prior) / FEATURES
    for _ in range(rounds):
        model.weights, model.bias = weights.astype(np.float32), bias.astype(np.float32)
        made = striped(texts, model)
        move = rate * (seen - made) / ((seen + made) / 2 + 4)
        weights, bias = weights + move[:big], bias + move[big:]
    model.weights, model.bias = weights.astype(np.float32), bias.astype(np.float32)
    return model, counts


def score(docs: DataFrame, model: Model, counts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, base_score, score) of every whole text; a null text is empty, its only token the end.

    base: add-one unigram log10. score: log10 of class given contexts, times word given class (add-one within its class; a word of
    its own class is certain). Tasks hold the frequent words' counts; the rest of a document's words go out as rows, meet their
    counts in a join (rare words by construction, so no hot key), and are added up by document.
    """
    fields = [docs.schema[key], *T.StructType.fromDDL("row long, word long, tf long, kind int, n long, known long, base double, model double").fields]
    schema = T.StructType(fields)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    whole = np.log10(model.tokens + model.vocabulary + 1)
    within = np.log10(model.class_tokens + model.class_words + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        top = m.rank < OWN
        own, own_rank = m.head[top], m.rank[top]
        for batch in batches:
            for low, high, data, offsets in segments(batch.column(2), 1 << 20):
                h, ending, owner = token_stream(data, offsets)
                c = classes(h, ending, own, own_rank)
                group, inner = c // WIDE, c % WIDE
                rows = [rows_of(x, k, group) for k, x in enumerate(contexts(h, owner))]
                p, q = softmax_parts(m.weights, m.bias, rows, group)
                at = np.arange(len(h))
                value = np.log10(np.maximum(p[at, group], 1e-30).astype(float)) + np.log10(np.maximum(q[at, inner], 1e-30).astype(float))
                i = np.minimum(np.searchsorted(m.head, h), max(len(m.head) - 1, 0))
                common = m.head[i] == h if len(m.head) else np.zeros(len(h), bool)
                rare = c >= OWN
                n = high - low
                log_c = np.log10(m.count[i[common]] + 1.0) if len(m.head) else np.empty(0)
                both = common & rare
                value[both] += np.log10(m.count[i[both]] + 1.0) - within[ending[both]] if both.any() else 0
                tokens, known = np.bincount(owner, minlength=n), np.bincount(owner[common], minlength=n)
                base = np.bincount(owner[common], log_c - whole, n)
                total = np.bincount(owner, np.where(common, value, np.where(rare, value, 0)), n)
                # the others: one row for each word of a document
                rest = np.flatnonzero(~common)
                order = rest[np.lexsort((h[rest], owner[rest]))]
                new = np.r_[True, (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])] if len(order) else np.empty(0, bool)
                first = np.flatnonzero(new)
                tf = np.diff(np.r_[first, len(order)])
                who = np.r_[np.arange(n), owner[order[first]]] + low
                none = np.zeros(len(first))
                word = np.r_[mix(np.arange(n).astype(np.uint64) + U(low)), h[order[first]]].view(np.int64)
                pack = lambda a, b, t: pa.array(np.r_[a, b].astype(t))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(who)), batch.column(1).take(pa.array(who)), pa.array(word), pack(np.zeros(n), tf, np.int64),
                        pack(np.zeros(n), ending[order[first]], np.int32), pack(tokens, none, np.int64), pack(known, none, np.int64), pack(base, none, float), pack(total, none, float),
                    ],
                    names=schema.names,
                )

    text = F.coalesce(F.col(text), F.lit("")).alias("__text")
    made = docs.select(key, F.monotonically_increasing_id().alias("row"), text).mapInArrow(run, schema)
    joined = made.join(counts.select("word", "c"), "word", "left")
    log_c = F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0))
    inner = F.element_at(F.array(*[F.lit(float(x)) for x in within]), F.col("kind") + 1)
    out = joined.groupBy("row").agg(
        F.first(key).alias(key),
        F.sum("n").alias("n_tokens"),
        (F.sum("known") + F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0))).alias("n_known"),
        F.round(F.sum("base") + F.sum(F.col("tf") * (log_c - F.lit(float(whole)))), 9).alias("base_score"),
        F.round(F.sum("model") + F.sum(F.col("tf") * (log_c - inner)), 9).alias("score"),
    )
    return out.drop("row")


def score_corpus(docs: DataFrame, key: str = "doc_id", rounds: int = 2) -> DataFrame:
    """Fit on the training folds of docs and score all of docs: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null key trains. Repeated rows are scored each; an empty table gives an empty result; other columns are left out.
    """
    docs = clear(docs, *(set(docs.columns) - {key, "text"}))
    model, counts = train(docs.where(training(key)).select(F.coalesce("text", F.lit("")).alias("text")), rounds)
    out = score(docs, model, counts, key)
    return out.select(key, (~training(key)).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
