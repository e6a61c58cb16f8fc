"""Toxic spans by a linear-chain conditional random field over tokens; marginals give document scores and offsets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from convlake.llm.common import clear, ready, settle
from convlake.llm.textkit import LOWER, U, mix, powers, segments, words

BITS = 20
SAMPLE = 3_000  # labelled documents of either class that a fit may draw
SAMPLE_BYTES = 1 << 14  # longer documents aren't drawn; they are scored like all others
ROUNDS = 30
SURE = 16.0
ROW = 128
MARKS = np.zeros(256, bool)
MARKS[list(b".,;:!?\"'()[]{}*_-")] = True


@dataclass
class Model:
    """Weights of the offending tag against the other by hashed feature, transition and start weights, and the score's logistic."""

    weights: np.ndarray
    step: np.ndarray
    start: np.ndarray
    fit: tuple[float, float, float]


def features(data: np.ndarray, begin: np.ndarray, end: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashed features of each token (columns): the word without marks around it, its first four and five bytes, its last four,
    and the words before and after it in its text."""
    for _ in range(2):
        if len(begin):
            end = end - ((end - begin > 1) & MARKS[data[end - 1]])
            begin = begin + ((end - begin > 1) & MARKS[data[begin]])
    up, down = powers(len(data) + 1)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + U(1)) * up[:-1], out=run[1:])
    own = lambda a, b: (run[b] - run[a]) * down[a]
    word = own(begin, end)
    same = text[1:] == text[:-1] if len(text) else np.empty(0, bool)
    edge = U(0x1234567)
    before, after = np.full(len(word), edge), np.full(len(word), edge)
    before[1:][same], after[:-1][same] = word[:-1][same], word[1:][same]
    kinds = [word, own(begin, np.minimum(end, begin + 4)), own(begin, np.minimum(end, begin + 5)), own(np.maximum(begin, end - 4), end), before, after]
    out = np.empty((len(word), len(kinds)), np.int32)
    for i, h in enumerate(kinds):
        out[:, i] = (mix(h + U((i + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> U(64 - BITS)).astype(np.int32)
    return out


def marginals(odds: np.ndarray, first: np.ndarray, step: np.ndarray, start: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over chains laid end to end: each token's probability of the offending tag, and the expected counts of
    the four transitions. odds: the tokens' scores for that tag; first: whether a token begins a chain; weight: what a token counts.

    Tokens stand in rows of ROW. Each row's product of transition matrices is taken, side by side for all rows; the states at the
    rows' ends follow from these; then all rows go forward and backward at once.
    """
    n = len(odds)
    if not n:
        return np.empty(0), np.zeros(4)
    rows = -(-n // ROW)
    hot = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    t = np.exp(step - step.max())
    s = np.exp(start - start.max())
    m = np.zeros((4, rows * ROW))
    for i in range(4):  # from state i div 2 to state i mod 2
        m[i, :n] = np.where(first, s[i % 2], t[i]) * (hot if i % 2 else 1 - hot)
    m[0, n:] = m[3, n:] = 1
    m = np.ascontiguousarray(m.reshape(4, rows, ROW).transpose(2, 0, 1))
    p = [np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)]
    for a, b, c, d in m:
        p = [p[0] * a + p[1] * c, p[0] * b + p[1] * d, p[2] * a + p[3] * c, p[2] * b + p[3] * d]
        scale = 1 / (p[0] + p[1] + p[2] + p[3])
        p = [x * scale for x in p]
    ahead, behind = np.empty((rows + 1, 2)), np.empty((rows + 1, 2))
    products = np.array(p).T.tolist()
    x = y = 0.5
    for r, (a, b, c, d) in enumerate(products):
        ahead[r] = x, y
        x, y = x * a + y * c, x * b + y * d
        x, y = x / (x + y), y / (x + y)
    x = y = 0.5
    for r in range(rows - 1, -1, -1):
        behind[r] = x, y
        a, b, c, d = products[r]
        x, y = a * x + b * y, c * x + d * y
        x, y = x / (x + y), y / (x + y)
    forward, backward = np.empty((ROW, 2, rows)), np.empty((ROW, 2, rows))
    x, y = ahead[:rows].T
    for j in range(ROW):
        a, b, c, d = m[j]
        x, y = x * a + y * c, x * b + y * d
        scale = 1 / (x + y)
        x, y = x * scale, y * scale
        forward[j, 0], forward[j, 1] = x, y
    x, y = behind[:rows].T
    for j in range(ROW - 1, -1, -1):
        backward[j, 0], backward[j, 1] = x, y
        a, b, c, d = m[j]
        x, y = a * x + b * y, c * x + d * y
        scale = 1 / (x + y)
        x, y = x * scale, y * scale
    flat = lambda z: z.transpose(1, 2, 0).reshape(2, -1)[:, :n]
    f, g, m = flat(forward), flat(backward), m.transpose(1, 2, 0).reshape(4, -1)[:, :n]
    both = f * g
    tag = both[1] / (both[0] + both[1])
    pair = np.stack([f[i // 2, :-1] * m[i, 1:] * g[i % 2, 1:] for i in range(4)])
    pair = pair / pair.sum(0)
    if weight is not None:
        pair = pair * weight[1:]
    return tag, pair[:, ~first[1:]].sum(1)


def _chains(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, text numbers, and chain starts of a list of texts."""
    parts, owners, low = [], [], 0
    for a, b, data, offsets in segments(pa.array(texts, pa.string())):
        begin, end, text = words(data, offsets)
        parts.append(features(data, begin, end, text))
        owners.append(text + a)
        low = b
    owner = np.concatenate(owners) if owners else np.empty(low, np.int64)
    first = np.r_[True, owner[1:] != owner[:-1]] if len(owner) else np.empty(0, bool)
    return np.concatenate(parts) if parts else np.empty((0, 6), np.int32), owner, first


def token_tags(x: np.ndarray, owner: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Tags for the tokens of labelled documents: in a toxic one, those whose word or word beginning is in toxic
    documents (in different surroundings) far more often than chance allows (log-likelihood ratio of SURE or more); if there is none, those that come nearest. In other documents no token offends."""
    n = 1 << BITS
    sign = np.full(len(x), -np.inf)
    for column in (0, 1, 2):
        # different surroundings are counted, not documents: copies of one text say a thing once
        pair = x[:, column].astype(np.int64) * n + (x[:, 4] ^ x[:, 5])
        bad, good = (np.bincount(np.unique(pair[toxic[owner] == y]) // n, minlength=n).astype(float) for y in (True, False))
        both = bad + good
        share = bad.sum() / both.sum()
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(bad > 0, bad * np.log(bad / (both * share)), 0) + np.where(good > 0, good * np.log(good / (both * (1 - share))), 0)
        gain[bad * (1 - share) < 6 * (good + 0.1) * share] = -np.inf
        sign = np.maximum(sign, gain[x[:, column]])
    sign[~toxic[owner]] = -np.inf
    best = np.full(len(toxic), -np.inf)
    np.maximum.at(best, owner, sign)
    return (sign > 2) & (sign >= np.minimum(best[owner], SURE))


def pieces(first: np.ndarray, size: int = 1 << 17) -> list[tuple[int, int]]:
    """Stretches of whole chains of about `size` tokens, so that a fit's working memory doesn't grow with its sample."""
    starts, out, low = np.r_[np.flatnonzero(first), len(first)], [], 0
    while low < len(first):
        high = int(starts[max(np.searchsorted(starts, low + size, "right") - 1, np.searchsorted(starts, low, "right"))])
        out.append((low, high))
        low = high
    return out


def draw_weights(label: np.ndarray, totals: dict[int, int]) -> np.ndarray:
    """What each drawn document counts, so that both classes have the shares that `totals` (rows by class) gives them; 1 on average."""
    weight = np.ones(len(label))
    for y, n in totals.items():
        drawn = label == bool(y)
        weight[drawn] = n / max(1, drawn.sum())
    return weight * (len(label) / weight.sum()) if len(label) else weight


def fit(texts: list[str], toxic: list[bool], rounds: int = ROUNDS, totals: dict[int, int] | None = None) -> Model:
    """Fit the field by gradient ascent on the tags' likelihood (Adam on all tokens), then the logistic of the document score.

    totals: rows of each class (0, 1) that the texts were drawn from, where both classes weren't drawn at the same rate.
    """
    label = np.array(toxic, bool)
    weight = draw_weights(label, totals or {})
    x, owner, first = _chains(texts)
    model = Model(np.zeros(1 << BITS), np.zeros(4), np.zeros(2), (0.0, 0.0, float(np.log((weight[label].sum() + 0.5) / (weight[~label].sum() + 0.5)))))
    if not len(x) or label.all() or not label.any():
        return model
    tag = token_tags(x, owner, label).astype(float)
    counts = weight[owner]
    inner = ~first[1:]
    state = (2 * tag[:-1] + tag[1:]).astype(int)
    seen_steps = np.bincount(state[inner], counts[1:][inner], 4)[:4]
    seen_start = np.bincount(tag[first].astype(int), counts[first], 2)
    n, parts = 1 << BITS, pieces(first)
    seen, total = np.zeros(n), np.ones(n)
    for low, high in parts:
        flat = x[low:high].ravel()
        seen += np.bincount(flat, np.repeat(tag[low:high] * counts[low:high], x.shape[1]), n)
        total += np.bincount(flat, np.repeat(counts[low:high], x.shape[1]), n)
    theta, one, two = np.zeros(n + 6), np.zeros(n + 6), np.zeros(n + 6)

    def expected() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each token's marginal, and the expected counts of features, and of transitions and starts; a piece at a time."""
        p, made, steps = np.empty(len(x)), np.zeros(n), np.zeros(6)
        for low, high in parts:
            c = counts[low:high]
            own, steps_ = marginals(theta[x[low:high]].sum(1), first[low:high], theta[n : n + 4], theta[n + 4 :], c)
            p[low:high] = own
            made += np.bincount(x[low:high].ravel(), np.repeat(own * c, x.shape[1]), n)
            begins, c = own[first[low:high]], c[first[low:high]]
            steps += np.r_[steps_, ((1 - begins) * c).sum(), (begins * c).sum()]
        return p, made, steps

    for i in range(1, rounds + 1):
        _, made, steps = expected()
        g = np.r_[(seen - made) / np.sqrt(total) - 1e-2 * theta[:n], (np.r_[seen_steps, seen_start] - steps) / np.sqrt(counts.sum())]
        one, two = 0.9 * one + 0.1 * g, 0.99 * two + 0.01 * g * g
        theta += 0.2 * (one / (1 - 0.9**i)) / (np.sqrt(two / (1 - 0.99**i)) + 1e-6)
    model = Model(theta[:n], theta[n : n + 4], theta[n + 4 :], model.fit)
    p = expected()[0]
    a, b = summary(p, owner, len(texts))
    z, w = np.stack([a, b, np.ones(len(a))]), np.zeros(3)
    for _ in range(30):  # Newton steps, lightly held back
        q = 1 / (1 + np.exp(-np.clip(w @ z, -30, 30)))
        hessian = (z * (weight * q * (1 - q) + 1e-6)) @ z.T + np.diag([0.1, 0.1, 1e-3])
        w += np.linalg.solve(hessian, z @ (weight * (label - q)) - np.array([0.1, 0.1, 1e-3]) * w)
    model.fit = tuple(map(float, w))
    return model


def summary(p: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: log odds of the likeliest token, and the logarithm of one plus the expected number of offending tokens."""
    top = np.full(texts, 1e-6)
    np.maximum.at(top, owner, np.clip(p, 1e-6, 1 - 1e-6))
    return np.log(top / (1 - top)), np.log1p(np.bincount(owner, p, texts))


def drawn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> tuple[DataFrame, dict[int, int]]:
    """(key, of, text, toxic) of at most `sample` different texts of either class, none over `sample_bytes` bytes: those with the least
    hashed keys, however many rows a key or a text has; and the number of rows of each class that they were drawn from."""
    known = labels.where("toxic is not null").groupBy(key).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    short = docs.select(key, "text", F.xxhash64("text").alias("of")).where(F.octet_length("text") <= sample_bytes)
    # a narrow row for each labelled text, with its number of rows
    narrow = settle(short.select(key, "of").join(known, key).groupBy(key, "of", "toxic").agg(F.count("*").alias("n")))
    order = [F.xxhash64(F.lit(3), key), key, "of"]
    picked = [narrow.where(f"toxic = {y}").orderBy(*order).limit(sample) for y in (0, 1)]
    totals = {r.toxic: r.n for r in narrow.groupBy("toxic").agg(F.sum("n").alias("n")).collect()}
    chosen = F.broadcast(picked[0].unionByName(picked[1]).select(key, "of", "toxic"))
    return short.join(chosen, [key, "of"]).groupBy(key, "of").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic")), totals


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", rounds: int = ROUNDS, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from labels (key, toxic) on docs, fitted by one task on the texts that are drawn, weighted to their classes' shares;
    only the model comes to the driver. Null texts, null labels and labels without a document are left out; without any row of
    a class, or any row at all, the model knows no other."""
    got, totals = drawn(docs, labels, key, sample, sample_bytes)
    schema = to_arrow_schema(got.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), schema=schema).sort_by([(key, "ascending"), ("text", "ascending")])
        texts, toxic = rows.column("text").to_pylist(), [bool(y) for y in rows.column("toxic").to_pylist()]
        del rows
        m = fit(texts, toxic, rounds, totals)
        yield pa.RecordBatch.from_arrays([pa.array([np.asarray(x, float).tobytes()], pa.binary()) for x in (m.weights, m.step, m.start, m.fit)], names=["weights", "step", "start", "fit"])

    m = got.repartition(1).mapInArrow(run, "weights binary, step binary, start binary, fit binary").first()
    if m is None:  # no row, no task
        return fit([], [], rounds, totals)
    return Model(*(np.frombuffer(x) for x in (m.weights, m.step, m.start)), tuple(np.frombuffer(m.fit).tolist()))


def score(docs: DataFrame, model: Model, key: str = "doc_id", threshold: float = 0.5, with_spans: bool = True) -> DataFrame:
    """(key, score, predicted and, with_spans, spans: array of first byte, byte after the last, mean marginal) of every whole text.

    A null or wordless text gets the score of one in which nothing offends. Null keys and repeated rows are rows like any other;
    an empty table gives an empty result; other columns are left out.
    """
    fields = [docs.schema[key], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    if with_spans:
        fields += T.StructType.fromDDL("spans array<struct<begin: long, end: long, p: double>>").fields
    schema = T.StructType(fields)
    shared = docs.sparkSession.sparkContext.broadcast(Model(model.weights.astype(np.float32), model.step, model.start, model.fit))
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for low, high, data, offsets in segments(batch.column(1)):
                begin, end, text = words(data, offsets)
                first = np.r_[True, text[1:] != text[:-1]] if len(text) else np.empty(0, bool)
                x = features(data, begin, end, text)
                odds = m.weights[x[:, 0]].astype(float)
                for i in range(1, x.shape[1]):
                    odds += m.weights[x[:, i]]
                p, _ = marginals(odds, first, m.step, m.start)
                a, b = summary(p, text, high - low)
                total = 1 / (1 + np.exp(-np.clip(m.fit[0] * a + m.fit[1] * b + m.fit[2], -30, 30)))
                columns = [batch.column(0).slice(low, high - low), pa.array(total), pa.array((total >= threshold).astype(np.int32))]
                if with_spans:
                    spans: list[list] = [[] for _ in range(high - low)]
                    on = np.flatnonzero(p >= 0.5)
                    for run_ in np.split(on, np.flatnonzero((np.diff(on) > 1) | first[on[1:]]) + 1) if len(on) else []:
                        i = text[run_[0]]
                        spans[i].append({"begin": int(begin[run_[0]] - offsets[i]), "end": int(end[run_[-1]] - offsets[i]), "p": float(p[run_].mean())})
                    columns.append(pa.array(spans, kind))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(key, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def training_labels(labels: DataFrame, key: str = "doc_id", folds: int = 5) -> DataFrame:
    """Labels outside the held-out fold: crc32 of the key as text modulo `folds` is not 0."""
    ready(labels.sparkSession)
    return clear(labels, *(set(labels.columns) - {key, "toxic"})).where(F.crc32(F.col(key).cast("string").cast("binary")) % folds != 0)
