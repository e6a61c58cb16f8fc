import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from convlake.llm.spotsigs import ANCHORS, _parts, fingerprint_report, near_pairs, spots

KNOWN = set(ANCHORS)


def plain(text, chain=2, gap=4):
    """Signatures as tuples, word by word."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    if not words:
        return set()
    runs, before = [], ["^"]
    for w in words:
        if w in KNOWN:
            before.append(w)
        else:
            runs.append((before, w))
            before = []
    if before:
        runs.append((before, ""))
    out = set()
    for i, (anchors, w) in enumerate(runs):
        if anchors or not any(runs[k][0] for k in range(max(0, i - gap), i)):
            out.add((anchors[-1] if anchors else None, w, *[runs[i + k][1] for k in range(1, chain) if i + k < len(runs)]))
    return out


def alike(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


def prose(r, n, few=60):
    return " ".join(r.choice(("the", "of", "la", "und", "que")) if r.random() < 0.3 else f"w{r.randrange(few)}" + r.choice(("", "", ",", ".")) for _ in range(n))


def test_against_brute_force(spark):
    r = random.Random(7)
    rows = [(i, prose(r, r.randrange(0, 90))) for i in range(1, 700) if i % 13]
    rows += [(9000 + i, t) for i, t in enumerate(["", None, "  \n", "the of and", "the", "word", "日本語 テキスト", "a b c d e f g h i", "É É́ x_y-z", "one two three four five six seven eight nine ten eleven", "..."])]
    rows += [(8000 + i, rows[5][1]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__d", F.lit("clash")).withColumn("fingerprint", F.lit(1)).repartition(5)
    got = {x.doc_id: x for x in fingerprint_report(docs).collect()}
    order = sorted(rows, key=lambda x: -x[0])
    assert len(got) == len(rows)
    prints = {}
    for (key, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after, x = text or "", after or "", got[key]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (x.n_chars, x.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        own, other, later = plain(text), plain(edited), plain(after)
        assert (x.n_spots, x.edited_spots, len(x.fingerprint)) == (len(own), len(other), 8 * len(own)), (text, own)
        assert x.near_edited == alike(own, other) and x.near_next == alike(own, later)
        assert prints.setdefault(text, x.fingerprint) == x.fingerprint


def test_rows_of_one_key_and_small_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert fingerprint_report(make([])).collect() == []
    one = fingerprint_report(make([(1, "the dog of my house")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"the dog of" + b"the dog o").hexdigest()
    r = random.Random(3)
    rows = [(5, prose(r, 20)) for _ in range(900)] + [(5, "same words in the text")] * 300 + [(None, prose(r, 9)) for _ in range(50)] + [(i, prose(r, 12)) for i in range(300)]
    got = fingerprint_report(make(rows)).collect()
    assert sorted((x.doc_id is None, x.doc_id or 0) for x in got) == sorted((k is None, k or 0) for k, _ in rows)
    edited = {t[: len(t) - len(t) // 2] + u[: len(t) // 2] for k, t in rows for m, u in rows if k == m == 5}
    inside = [x for x in got if x.doc_id == 5]
    hashes = {hashlib.sha256(e.encode()).hexdigest() for e in edited}
    assert sum(x.edited_sha256 not in hashes for x in inside) <= 1  # all but the last are followed by a row of their key
    keyed = make(rows).selectExpr("coalesce(doc_id, -1) as __d", "xxhash64(text) as __h")
    sizes = sorted(x["count"] for x in _parts(keyed, 64, 4096)(keyed).groupBy("__part").count().collect())
    assert sizes[-2] < 200  # but for the equal rows, no stretch has many


@pytest.mark.parametrize("n", [400_000])
def test_a_very_long_text(spark, n):
    text = " ".join(f"the w{i} x" for i in range(n))
    got = spark.createDataFrame([(text,)], "t string").select(F.size(spots(F.col("t")))).first()[0]
    assert n * 0.9999 < got <= n  # some of so many have one hash


def test_similar_documents(spark):
    r = random.Random(11)
    base = [prose(r, 120, few=4000) for _ in range(30)]
    rows = []
    for t in base:
        words = t.split()
        for _ in range(6):
            new = list(words)
            for _ in range(r.randrange(0, 14)):
                new[r.randrange(len(new))] = f"z{r.randrange(999)}"
            rows.append(" ".join(new[: r.randrange(90, 121)]))
    rows += [base[0]] * 20 + ["the common line of all"] * 30 + [None, "", "..."]
    rows = list(enumerate(rows))
    members, pairs = near_pairs(spark.createDataFrame([*rows, (None, base[0])], "doc_id long, text string"))
    sets = {k: frozenset(plain(t)) for k, t in rows if plain(t)}
    least = {}
    for k, s in sets.items():
        least.setdefault(s, k)
    assert {x.doc_id: x["class"] for x in members.collect()} == {k: least[s] for k, s in sets.items()}
    reps = sorted((k, s) for s, k in least.items())
    want = {(a, b) for i, (a, s) in enumerate(reps) for b, t in reps[i + 1 :] if len(s & t) >= 0.8 * len(s | t) - 1e-12}
    got = pairs.collect()
    assert {(x["class"], x.other_class) for x in got} == want and len(got) == len(want) > 20
    assert all(abs(x.likeness - alike(sets[x["class"]], sets[x.other_class])) < 1e-12 for x in got)
