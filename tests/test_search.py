"""Vector search and title matching against brute force."""

import math
import random

from convlake import queries
from convlake.functions.text import STOPWORDS
from convlake.operators import artifacts as art
from convlake.operators import retrieval


def test_top_vectors_of_each_key(spark):
    r = random.Random(5)
    vec = lambda: [r.choice((-1.0, 0.0, 0.5, 1.0, r.gauss(0, 1))) for _ in range(6)]
    rows = [("hot" if i % 3 else f"u{i % 5}", i, vec()) for i in range(700)] + [("hot", 9000, [0.0] * 6), ("hot", 9001, None), ("hot", 9002, [math.nan] * 6), ("alone", 9003, vec()), ("hot", 9004, [1.0, None, 0.0, 0.0, 0.0, 0.0])]
    asks = [("hot", f"q{i}", vec()) for i in range(40)] + [("u0", "q40", vec()), ("u1", "q41", [0.0] * 6), ("none", "q42", vec()), ("hot", "q43", None)]

    def cosine(a, b):
        d = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / d, 6) + 0.0 if d else 0.0

    whole = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    want = set()
    for user, q, a in asks:
        if whole(a):
            best = sorted((-cosine(a, b), i) for u, i, b in rows if u == user and whole(b))[:7]
            want |= {(user, q, n, i, -s + 0.0) for n, (s, i) in enumerate(best, 1)}
    q, v = spark.createDataFrame(asks, "user_id string, query_id string, vector array<double>"), spark.createDataFrame(rows, "user_id string, id long, vector array<double>")
    for tile in (50, 10_000):
        assert {tuple(x) for x in retrieval.top_k(q, v, 7, ("user_id",), tile).collect()} == want
    assert retrieval.top_k(q.where("false"), v, 7, ("user_id",)).collect() == []
    two = retrieval.top_k(q.where("query_id = 'q1'").drop("user_id"), v.drop("user_id"), 3).collect()
    assert [x["rank"] for x in sorted(two, key=lambda x: x["rank"])] == [1, 2, 3]


def test_a_word_in_every_title(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    title = lambda: " ".join(["report", *(["billing"] if r.random() < 0.5 else []), *r.sample(words, r.choice((0, 0, 1, 2, 3)))])
    rows = [(1, i, r.choice(("task", "task", "note", "other")), title()) for i in range(3000)] + [(2, 9000, "task", "report"), (2, 9001, "task", "nothing else")]
    kind = "conversation_id long, id long, artifact_type string, title string"
    a = spark.createDataFrame(rows, kind)
    new, old = a.where("id % 3 = 0"), a.where("id % 3 <> 1")  # some are on both sides
    found = {x.new_id: (x.old_id, round(x.similarity, 9)) for x in art.best_match(new, old, hot=20).collect()}
    bags = {i: set(t.split()) - set(STOPWORDS) for _, i, _, t in rows}
    for c, i, k, _ in rows:
        if i % 3 == 0:
            mates = [j for d, j, m, _ in rows if d == c and j % 3 != 1 and j != i and k == m and k != "other"]
            best = max(((len(bags[i] & bags[j]) / len(bags[i] | bags[j]), -j) for j in mates if bags[i] & bags[j]), default=(0.0, None))
            assert found[i] == (-best[1] if best[1] is not None else None, round(best[0], 9)), i
    pairs = art.title_candidates(new, old, hot=20).count()
    assert pairs < 40 * 1000  # a pair for every two titles would be some 700,000


def test_searches_meet_every_vector(spark, tmp_path):
    """Of 60 vectors, each with a label of its own, a query's best are those of all labels."""
    e = spark.range(60).selectExpr("id as vec_id", "cast(id as int) as label", "array(cast(sin(id) as float), cast(cos(id) as float)) as embedding")
    e.write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries.vector_searches(spark, str(tmp_path)).collect()
    assert sorted((x.query_id, x["rank"]) for x in found) == [(q, n) for q in (0, 20, 40) for n in range(1, 9)]
    assert {x.id for x in found if x.query_id == 0} == set(sorted(range(60), key=lambda i: -math.cos(i))[:8])
