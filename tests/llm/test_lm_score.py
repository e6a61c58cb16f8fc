import math
import random
import re
from collections import Counter

import numpy as np

from convlake.llm import lm


def softmax(z):
    top = max(z)
    e = [math.exp(v - top) for v in z]
    return [v / sum(e) for v in e]


def test_scores_by_hand(spark):
    r = random.Random(8)
    words = ["".join(r.choice("abcdef") for _ in range(r.randint(1, 6))) for _ in range(300)]
    rows = [(i, " ".join(r.choice(words[: 20 + i]) for _ in range(r.randint(0, 40)))) for i in range(120)] + [(900, "Unseen words éé go here"), (901, None), (902, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = docs.where(lm.training("doc_id")).selectExpr("coalesce(text, '') as text")
    model, counts = lm.train(train, rounds=1)
    got = {x.doc_id: x.score for x in lm.score(docs, model, counts).collect()}
    seen = Counter()
    for x in train.collect():
        seen.update([*re.findall(r"[^\x20\x09-\x0D]+", x.text.lower()), None])
    own = {int(h): int(k) for h, k in zip(model.head, model.rank) if k < lm.OWN}
    # words and tokens of each class that isn't a word's own
    tokens, kinds = Counter(), Counter()

    def token(text):
        data = np.frombuffer((text or "").encode(), np.uint8)
        return lm.token_stream(data, np.array([0, len(data)]))

    for word, c in seen.items():
        h, ending, _ = token(word or "")
        h, ending = (h[0], ending[0]) if word else (h[-1], 0)
        if int(h) not in own:
            tokens[ending] += c
            kinds[ending] += 1
    for key, text in rows:
        h, ending, owner = token(text)
        said = [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]
        want = 0.0
        for i, word in enumerate(said):
            c = own.get(int(h[i]), lm.OWN + int(ending[i]))
            group, inner = divmod(c, lm.WIDE)
            contexts = [x[i : i + 1] for x in lm.contexts(h, owner)]
            at = [lm.rows_of(x, k, np.array([group])) for k, x in enumerate(contexts)]
            first = softmax([float(model.bias[0][j]) + sum(float(model.weights[a[0]][j]) for a, _ in at) for j in range(lm.WIDE)])
            second = softmax([float(model.bias[1 + group][j]) + sum(float(model.weights[b[0]][j]) for _, b in at) for j in range(lm.WIDE)])
            want += math.log10(first[group]) + math.log10(second[inner])
            if c >= lm.OWN:
                want += math.log10((seen[word] + 1) / (tokens[ending[i]] + kinds[ending[i]] + 1))
        assert abs(got[key] - want) < 1e-3 * max(1.0, -want), key
