import math
import random

import numpy as np
import pyarrow as pa
import pytest

from convlake.llm.whitening import deviations, fit, integers, whiten, whitening_report


def brute(rows, most=32):
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    v = np.array([[c - s / n for c, s in zip(r, sums, strict=True)] for r in x])
    e, u = np.linalg.eigh(v.T @ v / n)
    order = np.argsort(-e)[:most]
    exact = [sum((n * c - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x]
    return n, exact, v @ (u[:, order] / np.sqrt(e[order])), e[order] / e.sum()


def test_against_eigenvectors_of_the_covariance(spark):
    r = np.random.default_rng(3)
    rows = (r.normal(0, 1, (900, 40)) @ r.normal(0, 1, (40, 40)) + 5 * r.normal(0, 1, 40)).tolist()
    bad = [(None, rows[0]), (7, None), (8, [math.nan] * 40), (9, [1.0, None] + [0.0] * 38), (10, [math.inf] + [0.0] * 39)]
    table = [(100 + i, v, "own") for i, v in enumerate(rows)] + [(*b, None) for b in bad]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, deviation string").repartition(70)  # a tree of three levels
    got = whitening_report(df).collect()
    n, exact, want, share = brute([*rows, rows[0]])
    assert len(got) == n * 32 and {x.n for x in got} == {n} and max(x.identity_error for x in got) < 1e-9
    assert {x.vec_id for x in got} == {None, *range(100, 1000)}
    seen = np.zeros((n, 32))
    for x in got:
        at = n - 1 if x.vec_id is None else x.vec_id - 100
        seen[at, x.component - 1] = x.whitened
        assert x.deviation == exact[at] and abs(x.explained / share[x.component - 1] - 1) < 1e-9
    sign = np.sign((seen * want).sum(0))
    assert np.abs(seen - sign * want).max() < 1e-6


def test_all_columns_stay(spark):
    df = spark.createDataFrame([(i, [float(i), float(i * i % 7)], "x", 1.0) for i in range(9)], "vec_id long, embedding array<double>, note string, Whitened double")
    out = whiten(df, fit(df))
    assert out.columns == ["vec_id", "embedding", "note", "deviation", "whitened"] and out.count() == 9


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, None)], [(1, []), (2, [])]])
def test_nothing_to_whiten(spark, rows):
    assert whitening_report(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect() == []


def test_flat_dimensions_and_short_vectors(spark):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 3), 2.0, r.gauss(0, 1)]) for i in range(50)] + [(50, [1.0]), (51, [1.0, 0.0])]
    got = whitening_report(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    _, exact, want, _ = brute([v + [0.0] * (3 - len(v)) for _, v in rows])
    for x in got:
        assert x.deviation == exact[x.vec_id] and abs(abs(x.whitened) - abs(want[x.vec_id, x.component - 1])) < 1e-9
    level = [(i, [float(i % 5), 3.0, float(i % 5) * 2]) for i in range(40)]  # one direction only
    assert {x.component for x in whitening_report(spark.createDataFrame(level, "vec_id long, embedding array<double>")).collect()} == {1}


def test_large_numbers_stay_exact(spark):
    rows = [(0, [1e8, 0.0]), (1, [2.0, 1.0]), (2, [-1e8, 3.0]), (3, [1e300, 0.0])]
    got = {x.vec_id: x for x in whitening_report(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert set(got) == {0, 1, 2}  # no long holds 64e300
    _, exact, _, _ = brute([v for _, v in rows[:3]])
    assert all(got[i].deviation == (exact[i] if exact[i] < 2**63 else None) for i in got)
    good, x = integers(pa.array([[2.0**55]]))
    assert good.all() and deviations(x, 1, [0]) == [None] and deviations(x, 1, [int(x[0, 0])]) == [0]
