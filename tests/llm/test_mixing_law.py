import random
from collections import Counter

import numpy as np
import pytest

from convlake.llm.mixing import corrected, dealt, drawn, mix_sources, permutation, slots


def test_permutations():
    for blocks in (1, 2, 3, 17, 64, 1000, 4097):
        for key in (0, 5, 2**64 - 1):
            index = permutation(blocks, key)(np.arange(blocks))
            assert sorted(index.tolist()) == list(range(blocks))
            assert (permutation(blocks, key, inverse=True)(index) == np.arange(blocks)).all()
    a, b = (permutation(4096, k)(np.arange(4096)) for k in (1, 2))
    assert (a == b).sum() < 20 and (np.diff(a) == 1).sum() < 20  # neither one permutation nor a lattice


def test_counts_follow_the_law():
    slots = np.array([300, 100, 0, 200])
    x = np.array([drawn(slots, 4, seed)[:, 0] for seed in range(4000)], float)
    p = slots / 600
    assert (x.sum(1) == 150).all() and (x[:, 2] == 0).all()
    assert abs(x.mean(0) - 150 * p).max() < 4 * 6 / 4000**0.5
    assert abs(np.cov(x.T) - 150 * (np.diag(p) - np.outer(p, p))).max() < 3
    for counts, room, want in (([5, 5, 5], [9, 9, 9], 15), ([5, 5, 5], [9, 9, 9], 22), ([5, 5, 5], [6, 9, 5], 20), ([5, 0, 9], [9, 9, 9], 3), ([9, 9], [4, 0], 9)):
        got = corrected(np.array(counts), np.array(room), want)
        assert got.sum() == min(want, sum(room)) and (got >= 0).all() and (got <= room).all()


def test_the_draw_decides_what_is_taken(spark):
    r = random.Random(1)
    rows = [(i, " ".join(["w"] * r.randint(0, 300)), r.choice(["a", "b", "c", "c", None])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seen = {}
    for seed in (1, 2):
        out, cuts, counts = mix_sources(docs, draw_seed=seed)
        got, cuts = out.collect(), cuts.collect()
        want = {(c.shard, c.source): c.blocks for c in counts.collect()}
        assert Counter((h, s) for h, s, _, _ in {(c.shard, c.source, c.epoch, c.slot) for c in cuts}) == want
        by, target = Counter(), {}
        for x in got:
            by[x.source] += x.taken
            target[x.source] = x.target
            assert x.taken <= 2 * x.size
        assert all(abs(by[s] - t) < 1 for s, t in target.items())
        once = Counter((c.source, c.epoch, c.index) for c in cuts if c.first == 0)
        assert len(once) > 20
        seen[seed] = ({x.doc_id: x.taken for x in got}, want)
    assert seen[1][0] != seen[2][0] and seen[1][1] != seen[2][1]


@pytest.mark.parametrize("share", [0.1, 0.9, 1.7, 9.0])
def test_blocks_are_taken_once_a_pass(spark, share):
    sizes = [1, 63, 64, 65, 640, 999, 5000]
    sources = spark.createDataFrame([(i, n, min(2.0 * n, n * share)) for i, n in enumerate(sizes)], "source_key long, source_size long, target double")
    draw = dealt(sources, 64, 16, 3)
    got = slots(draw, 64, 3).collect()
    assert len({(x.source_key, x.epoch, x.index) for x in got}) == len(got) and {x.epoch for x in got} <= {0, 1}
    words = Counter()
    for x in got:
        words[x.source_key] += x.length
        assert 0 < x.length <= 64
    assert all(abs(words[i] - min(2.0 * n, n * share)) <= 0.5 for i, n in enumerate(sizes))
