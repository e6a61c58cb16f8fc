import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from convlake.llm.divergence import count_terms, divergence_audit, grouped, share, spans, xxh64

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [t.lower().decode() for t in TERM.findall((text or "").encode())]  # bytes.lower() changes A-Z only


def brute(rows, least=10, top=10):
    counts, found, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        counts[lang, source].update(terms(text))
        found[lang].update(set(terms(text)))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in found[lang].items() if n >= least]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 2) // (total[s] + 2 * len(kept)) for t in kept} for s in sources}
        q = {t: 1 + 10**9 * (sum(counts[lang, s][t] for s in sources) + 2) // (sum(total.values()) + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            over = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, part, item, -v, i) for part, found_ in (("pair", pairs), ("term", over)) for i, (v, _, item) in enumerate(found_, 1)}
    return out


def test_hashes_are_xxhash():
    r = np.random.default_rng(1)
    for length in range(1, 32):
        grid = r.integers(0, 256, (50, length), dtype=np.uint8)
        assert xxh64(grid).tolist() == [xxhash.xxh64_intdigest(g.tobytes()) for g in grid]


@pytest.mark.parametrize("mask", [(1 << 64) - 1, 3, 0])
def test_slices_with_equal_hashes_are_told_apart(mask):
    r = random.Random(2)
    words = ["".join(r.choice("abÉxyz") for _ in range(r.choice((1, 2, 3, 40)))) for _ in range(300)]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(40))) for _ in range(50)] + ["", "zz", "zz"]
    raw = [t.encode() for t in texts]
    data, begin, end, text = spans(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    term, first = grouped(data, begin, end, mask)
    got = [data[begin[first[t]] : end[first[t]]].tobytes().decode() for t in term]
    assert got == [w for t in texts for w in terms(t)]
    assert text.tolist() == [i for i, t in enumerate(texts) for _ in terms(t)] and len(first) == len(set(got))


def test_shares_are_exact():
    r = random.Random(4)
    for _ in range(300):
        total = r.randrange(1, 1 << r.randrange(1, 53))
        count = r.randrange(total + 1)
        assert share(np.array([count]), total)[0] == 1 + 10**9 * count // total


def table(r, n=1500):
    words = [f"{a}{b}" for a in "abcdefgh" for b in "ÄijKLmnoß"]
    rows = []
    for _ in range(n):
        lang = r.choice(("en", "en", "en", "de", None))
        source = r.choice(("hot",) * 8 + tuple(f"s{i}" for i in range(9)) + (None, "", "é"))
        many = r.randrange(25)
        rows.append((lang, source, " ".join(r.choice(words[: 40 if source == "hot" else 72]) + r.choice(("", "1", ",", "-x")) for _ in range(many))))
    rows += [("fr", "only", "le la le " * 5)] * 12 + [("it", f"s{i}", "x" if i else None) for i in range(4)] + [("en", "bare", None), ("en", "none", ""), ("en", "long", "word " * 200_000)]
    return rows


@pytest.mark.parametrize("options", [{}, {"entries": 50, "pairs": 20}])
def test_against_brute_force(spark, options):
    rows = table(random.Random(9))
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("term", F.lit("clash")).withColumn("n", F.lit("clash")).repartition(6)
    got = divergence_audit(docs, **options).collect()
    assert len(got) == len({tuple(x) for x in got}) and {tuple(x) for x in got} == brute(rows)


def test_sql_and_small_tables(spark):
    import duckdb
    import pandas as pd

    from convlake.llm.queries import OP12_SQL

    rows = table(random.Random(5), 200)
    documents = pd.DataFrame(rows, columns=["lang", "source", "text"])  # noqa: F841  the SQL reads it
    assert set(duckdb.sql(OP12_SQL).fetchall()) == brute(rows)
    kind = "lang string, source string, text string"
    assert divergence_audit(spark.createDataFrame([], kind)).collect() == []
    few = [("a", "x", "one two"), ("a", "y", None), ("b", "z", "one")]
    assert {tuple(x) for x in divergence_audit(spark.createDataFrame(few, kind)).collect()} == {("a", "x", "pair", "y", 0, 1), ("a", "y", "pair", "x", 0, 1)}
    assert sum(x.n for x in count_terms(spark.createDataFrame(few * 20, kind), mask=0).collect()) == 60
