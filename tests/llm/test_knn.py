import math
import random
from fractions import Fraction

from convlake.llm import knn


def test_against_brute_force(spark):
    r = random.Random(4)
    centres = [[r.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [c + r.gauss(0, 0.2) for c in r.choice(centres)]) for i in range(600)]
    rows += [(i, [0.5] * 8) for i in range(600, 900)] + [(i, [0.0] * 8) for i in range(900, 920)]
    rows += [(1000, None), (1001, [1.0, None] + [0.0] * 6), (1020, [math.nan] * 8), (1040, [math.inf] * 8), (None, [1.0] * 8), (1060, [9.0] * 8)]
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, a in good:
        if q % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)[:20]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    got = knn.top_inner(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), tile=64)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def by_sql(rows):
    import duckdb
    import pandas as pd

    from convlake.llm.queries import OP5_SQL

    embeddings = pd.DataFrame(rows, columns=["vec_id", "embedding"])  # noqa: F841  the SQL reads it
    return sorted(duckdb.sql(OP5_SQL).fetchall())


def test_repeated_rows(spark):
    r = random.Random(8)
    some = lambda: [float(r.randint(-9, 9)) for _ in range(6)]
    best, twice = some(), some()
    rows = [(0, best), (20, twice), (20, twice), (40, some()), (40, some())] + [(7, best)] * 30 + [(60, best)] * 25 + [(8, twice)] * 3
    rows += [(100 + i, some()) for i in range(57)]
    got = knn.top_inner(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), tile=16)
    assert sorted(map(tuple, got.collect())) == by_sql(rows)


def test_small_tables(spark):
    kind = "vec_id long, embedding array<float>, score int"
    assert knn.top_inner(spark.createDataFrame([], kind)).collect() == []
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, -0.01], 1), (1, [1.0, -0.01], 1)]
    got = knn.top_inner(spark.createDataFrame(rows, kind)).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 64 * 64 - 32), (0, 2, 1, 64 * 64 - 32)]  # every row is a candidate


def best(rows, k=20):
    good = [(i, [math.floor(Fraction(x) * 64) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % 20 == 0:
            scores = ((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)
            out += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(x for x in scores if -(1 << 63) < x[0] <= 1 << 63)[:k], 1)]
    return sorted(out)


def test_long_vectors_take_part(spark):
    kind = "vec_id long, embedding array<double>"
    some = [(0, [1.0, 0.5]), (1, [1e8, 0.0]), (2, [1.0, 1.0]), (3, [0.25, 0.0])]
    got = sorted(map(tuple, knn.top_inner(spark.createDataFrame(some, kind)).collect()))
    assert got == best(some) and got[0] == (0, 1, 1, 64 * 6_400_000_000)
    r = random.Random(12)
    size = lambda: r.choice((1.0, 1.0, 1e4, 1e8, 1e9, 2e10, 1e18, 1e200, 1.7e308))
    rows = [(i, [r.gauss(0, 1) * size() if r.random() < 0.5 else float(r.randint(-3, 3)) for _ in range(4)]) for i in range(300)]
    rows = [(i, [min(max(x, -1.7e308), 1.7e308) for x in v]) for i, v in rows] + [(400, [0.0, 0.0, 0.0, 1.0]), (401, [1.7e308, -1.7e308, 0.0, 0.0]), (420, [1.0, 1.0, 0.0, 0.0])]
    got = sorted(map(tuple, knn.top_inner(spark.createDataFrame(rows, kind), tile=32).collect()))
    assert got == best(rows)
    wide = [(i, [1e8 * r.gauss(0, 1) for _ in range(16)]) for i in range(500)]  # scores from 62 bits on
    assert sorted(map(tuple, knn.top_inner(spark.createDataFrame(wide, kind)).collect())) == best(wide)
