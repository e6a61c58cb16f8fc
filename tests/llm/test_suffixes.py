import hashlib
import random

import numpy as np

from convlake.llm.common import settle
from convlake.llm.suffixes import blocks, common_prints, expand, merge, print_rows, remove_repeats, sorted_suffixes, without_repeats


def brute(rows, length):
    texts = [(k, (t or "").encode()) for k, t in rows]
    order = lambda k: (k is None, k or 0)
    least = {}
    for k, t in texts:
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            least[w] = min(least.get(w, order(k)), order(k))
    out = []
    for k, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if least[t[i : i + length]] < order(k):
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((k, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    some = lambda n: "".join(r.choice("ab cdé\n") for _ in range(n))
    shared = [some(n) for n in (30, 49, 50, 51, 80, 300)]
    texts = [None, "", "x" * 49, "x" * 50, "x" * 51, "x" * 200, "ab" * 60, "ab" * 61, "xyz"]
    for _ in range(120):
        t = some(r.randint(0, 120))
        for _ in range(r.randint(0, 3)):
            t += r.choice(shared) + some(r.randint(0, 40))
        texts.append(t)
    texts += [texts[20]] * 4 + [some(60) + shared[4] + some(60) for _ in range(500)]
    r.shuffle(texts)
    return list(enumerate(texts, 5)) + [(None, texts[7]), (None, shared[5]), (6, shared[5] + "q"), (6, shared[5] + "q")]


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), with_kept=False)
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 50)


def test_crowded_and_not(spark):
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for crowded in (1, 1 << 30):
        assert sorted(map(tuple, remove_repeats(docs, with_kept=False, crowded=crowded).collect()), key=str) == brute(rows, 50)


def test_kept_and_spans(spark):
    a = "The quick brown fox jumps over the lazy dog and runs far away."
    got = remove_repeats(spark.createDataFrame([(1, a, "u"), (2, "Say: " + a + "!", "v")], "doc_id long, text string, spans string")).orderBy("doc_id").collect()
    assert got[0].kept == a.encode() and got[1].kept == b"Say: !"
    assert [tuple(s) for s in got[1].spans] == [(5, 5 + len(a))]


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_merge():
    r = random.Random(3)
    for many in (1, 2, 3, 9):
        lists = [sorted(bytes(r.choice(b"ab") for _ in range(r.randint(1, 8))) for _ in range(r.randint(1, 30))) for _ in range(many)]
        common = lambda x, y: next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        coded = [[0, *map(common, x, x[1:])] for x in lists]
        order, shared = merge([(c, list(map(len, x)), b"".join(t[n:] for t, n in zip(x, c))) for x, c in zip(lists, coded)])
        heads = [iter(x) for x in lists]
        out = [next(heads[i]) for i in order]
        assert out == sorted(sum(lists, []))
        assert shared[1:] == list(map(common, out, out[1:]))


def test_rows_keep_their_columns(spark):
    rows = corpus(4)
    docs = spark.createDataFrame([(k, t, i, None if i % 3 else [str(i)]) for i, (k, t) in enumerate(rows)], "doc_id long, text string, n_removed int, tags array<string>").repartition(6)
    with_kept = remove_repeats(docs).collect()
    want = sorted(((r.doc_id, r.text_sha256, r.kept_text, r.n_removed) for r in with_kept), key=str)
    got = without_repeats(docs.withColumnRenamed("n_removed", "number"), removed="gone")
    assert got.columns == ["doc_id", "text", "number", "tags", "gone"]
    got = got.collect()
    texts = {i: t for i, (_, t) in enumerate(rows)}
    assert sorted(((r.doc_id, hashlib.sha256((texts[r.number] or "").encode()).hexdigest(), r.text or "", r.gone) for r in got), key=str) == want
    assert all((r.text is None) == (texts[r.number] is None) and (r.tags is None) == (r.number % 3 > 0) for r in got)
    assert without_repeats(docs.limit(0)).collect() == []


def test_only_long_repeats_go_about(spark):
    # phrases of 30 bytes come again and again, but hardly two in the same order
    r = random.Random(5)
    phrases = ["".join(r.choice("abcdefgh ") for _ in range(30)) for _ in range(200)]
    rows = [(i, "".join(r.choices(phrases, k=20))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    table = settle(blocks(docs, "doc_id", "text", []))
    flags = np.concatenate([expand(x.flags, "u1")[0] for x in common_prints(print_rows(table, 16, 50), 16).collect()])
    assert len(flags) > 1000 and (flags > 0).mean() < 0.1
    assert sorted(map(tuple, remove_repeats(docs, with_kept=False).collect()), key=str) == brute(rows, 50)


def test_lengths(spark):
    rows = corpus(6)[:150]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for length in (17, 18, 51, 255):
        for crowded in (2, 400):
            assert sorted(map(tuple, remove_repeats(docs, length=length, with_kept=False, crowded=crowded).collect()), key=str) == brute(rows, length)


def test_equal_suffixes_are_one():
    r = random.Random(7)
    common = lambda x, y: next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    for many in (1, 2, 9):
        lists = [sorted(bytes(r.choice(b"ab") for _ in range(r.randint(1, 8))) for _ in range(r.randint(1, 30))) for _ in range(many)]
        flat = sum(lists, [])
        shared = np.array([n for x in lists for n in (0, *map(common, x, x[1:]))], np.uint8)
        rest = np.frombuffer(b"".join(x[n:] for x, n in zip(flat, shared.tolist())), np.uint8)
        order, found = sorted_suffixes(shared, np.array(list(map(len, flat)), np.uint8), rest, np.cumsum([0, *map(len, lists)]), 17)
        out = [flat[i] for i in order]
        assert sorted(order.tolist()) == list(range(len(flat))) and out == sorted(flat)
        assert found[1:].tolist() == list(map(common, out, out[1:]))
