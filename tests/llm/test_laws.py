"""Laws and brute force: the shuffle's uniformity, the field's marginals, the fused language posterior."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np

from convlake.llm import langid, toxicity
from convlake.llm.sharding import uniform_shards


def test_the_shuffle_is_uniform(spark):
    n, shards = 16_000, 16
    got = uniform_shards(spark.range(n).repartition(7), shards).collect()
    cells = Counter((r.id // (n // 16), r.shard) for r in got)
    want = n / 16 / shards
    chi = sum((cells[b, s] - want) ** 2 / want for b in range(16) for s in range(shards))
    assert abs(chi - 225) < 5 * math.sqrt(2 * 225)  # 15 x 15 degrees of freedom
    order = defaultdict(dict)
    for r in got:
        order[r.shard][r.slot] = r.id
    rises = sum(a < b for s in order.values() for a, b in itertools.pairwise(s[i] for i in range(len(s))))
    pairs = n - shards
    assert abs(rises - pairs / 2) < 5 * math.sqrt(pairs / 12)
    # and slots tell nothing of where a row came from
    slots = Counter((r.id // (n // 4), r.slot * 4 // len(order[r.shard])) for r in got)
    chi = sum((slots[b, s] - n / 16) ** 2 / (n / 16) for b in range(4) for s in range(4))
    assert abs(chi - 9) < 5 * math.sqrt(18)


def test_marginals_by_enumeration():
    r = np.random.default_rng(3)
    for sizes in ((1,), (4,), (3, 1, 5), (2, 2, 2, 2)):
        n = sum(sizes)
        odds, step, start = r.normal(0, 2, n), r.normal(0, 1, 4), r.normal(0, 1, 2)
        first = np.zeros(n, bool)
        first[np.cumsum((0, *sizes[:-1]))] = True
        total, tag, steps = 0.0, np.zeros(n), np.zeros(4)
        for y in itertools.product((0, 1), repeat=n):
            z = sum(odds[i] * y[i] + (start[y[i]] if first[i] else step[2 * y[i - 1] + y[i]]) for i in range(n))
            w = math.exp(z)
            total += w
            tag += w * np.array(y)
            for i in range(n):
                if not first[i]:
                    steps[2 * y[i - 1] + y[i]] += w
        got, made = toxicity.marginals(odds, first, step, start)
        assert np.allclose(got, tag / total) and np.allclose(made, steps / total)


def test_language_posterior(spark):
    r = random.Random(2)
    said = {"en": "the house and the garden with the tree".split(), "de": "das haus und der garten mit dem baum".split(), "fr": "la maison et le jardin avec un arbre".split()}
    prose = lambda l, n: " ".join(r.choice(said[l]) for _ in range(n))
    docs = spark.createDataFrame([(prose(l, 40), l) for l in said for _ in range(3)], "text string, lang string")
    pages = []
    for i in range(60):
        l = r.choice(list(said))
        d = r.choice(["", f' lang="{l}"', ' lang="de"'])
        pages.append((i if i else None, f"http://w{i % 3}.s{i % 4}.{r.choice([l, 'com'])}/{r.choice(['', l + '/'])}x", f"<html{d}><body>{prose(l, r.randint(0, 6))}</body></html>"))
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumnRenamed("page_id", "page_id")
    names, model = langid.text_model(docs)
    rows = langid.evidence(table, names, model, "page_id", "url", "html").collect()
    p = np.array([x.p for x in rows])
    total = p.sum(0) + langid.SMOOTH
    share = total / total.sum()
    by = lambda get: {v: sum(p[i] for i, x in enumerate(rows) if get(x) == v) for v in {get(x) for x in rows}}
    declared, suffix, host, site = (by(lambda x, c=c: x[c]) for c in ("declared", "suffix", "host", "site"))
    want = {}
    for i, x in enumerate(rows):
        z = np.log(np.maximum(p[i], 1e-300))
        for sums, v in ((declared, x.declared), (suffix, x.suffix)):
            z += np.log((np.maximum(sums[v] - p[i], 0) + 2 * langid.SMOOTH * share) / (np.maximum(total - p[i], 0) + 1))
        many = lambda c, x=x: sum(y[c] == x[c] for y in rows)
        above = (site[x.site] + langid.PULL * share) / (many("site") + langid.PULL)
        z += np.log(np.maximum((np.maximum(host[x.host] - p[i], 0) + langid.PULL * above) / (many("host") - 1 + langid.PULL), 1e-12))
        q = np.exp(z - z.max())
        want[x.page_id] = (names[int(q.argmax())], round(float(q.max() / q.sum()), 9))
    got = {x.page_id: (x.lang, round(x.confidence, 9)) for x in langid.identify(table.withColumn("lang", table.url), docs.withColumn("p", docs.lang)).collect()}
    assert got == want
