import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from convlake.llm import flac, packing, toxicity
from convlake.llm.langid import identify
from convlake.llm.lm import score_corpus
from convlake.llm.media import store_payloads
from convlake.llm.mixing import mix_sources, mixed_documents
from convlake.llm.packing import pack, pack_documents, plan
from convlake.llm.sharding import uniform_shards

ODD = [(1, None, "a"), (2, "", "a"), (3, "one two", None), (4, "one two", "b"), (None, "x", "b"), (5, "w " * 3000, "a"), (5, "w " * 3000, "a")]


def odd(spark, rows=ODD):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))


def test_shards(spark):
    df = spark.range(1003).repartition(7).withColumn("shard", F.lit("old"))
    got = uniform_shards(df, 16).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert sorted(r.id for r in got) == list(range(1003))
    assert sorted(map(len, by.values())) == [62] * 5 + [63] * 11
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert uniform_shards(spark.range(0), 16).collect() == []


def test_packing_plan_and_rows(spark):
    r = random.Random(2)
    for _ in range(20):
        counts = Counter(r.randint(1, 50) for _ in range(r.randint(1, 200)))
        used = defaultdict(int)
        for n, _, count, first, each, at in plan(counts, 50):
            for k in range(count):
                s, o = first + k // each, at + k % each * n
                assert used[s] == o
                used[s] += n
        assert max(used.values()) <= 50 and sum(used.values()) == sum(n * c for n, c in counts.items())
        least = -(-sum(n * c for n, c in counts.items()) // 50)
        assert len(used) <= 1.25 * least + 2
    got = pack_documents(odd(spark).drop("size"), with_ids=False).collect()
    assert all(x.length <= 2048 for x in got)
    assert pack(spark.createDataFrame([], "doc_id long, length long")).collect() == []
    spans = defaultdict(list)
    for x in got:
        spans[x.sequence_id].append((x.offset, x.length))
    for s in spans.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n


def test_packed_ids_are_the_tokenizers(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["Hello, World. It's 3.5% of x_y!", "Été à la plage; naïve ÀÉ", "", "a<|b|>c", "tabs\tand\nlines", "日本語 text"]
    got = pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in got:
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids + [0]
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r.ids, r.length, r.ids_crc32) == (raw, len(ids), zlib.crc32(raw))


def test_mixing(spark):
    r = random.Random(5)
    rows = [(i, " ".join(["w"] * r.randint(0, 300)), r.choice(["a", "a", "a", "b", None])) for i in range(300)]
    out, cuts, counts = mix_sources(odd(spark, rows))
    got = out.collect()
    sizes = Counter()
    for i, t, s in rows:
        sizes[s] += len(t.split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, total = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            free.discard(s)
    target |= {s: level * weight[s] for s in free}
    taken = Counter()
    for x in got:
        assert x.taken <= 2 * x.size and abs(x.target - target[x.source]) < 1e-6
        taken[x.source] += x.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    again = sorted((x.doc_id, x.taken) for x in mix_sources(odd(spark, rows))[0].collect())
    assert again == sorted((x.doc_id, x.taken) for x in got)
    texts = mixed_documents(odd(spark, rows)).collect()
    assert sum(len(x.text.split()) for x in texts) == sum(taken.values())
    assert mix_sources(odd(spark, []))[0].collect() == [] and mix_sources(odd(spark))[0].count() == len(ODD)


def test_flac_round_trip():
    r = random.Random(1)
    payloads = [b" " * 192, bytes(range(192)), bytes(r.randrange(256) for _ in range(192 * 70)), b"\xff\xf8\x19\x02" * 48, ("héllo wörld " * 400).encode().ljust(192 * 40, b" ")[: 192 * 40]]
    streams = flac.encode(payloads)
    assert flac.decode(streams) == payloads
    assert flac.read_samples(streams[2], 5000, 777) == payloads[2][5000:5777]
    damaged = bytearray(streams[1])
    damaged[-5] ^= 1
    with pytest.raises(flac.Damaged):
        flac.decode([bytes(damaged)])


def test_media(spark):
    rows = spark.createDataFrame([(1, None), (2, b""), (3, b"x" * 193), (None, b"x")], "doc_id long, payload binary")
    got = {r.doc_id: r for r in store_payloads(rows).collect()}
    want = (b"x" * 193).ljust(384)
    assert (got[3].n_bytes, got[3].payload_bytes, got[3].payload_sha256, got[3].tail_crc32) == (193, 384, hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))
    assert got[3].media_sha256 == hashlib.sha256(got[3].media).hexdigest() and got[1].payload_sha256 == got[2].payload_sha256


def test_language_model(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["the cat sat", "a dog ran", "It is so"]) for _ in range(r.randint(0, 30)))) for i in range(300)] + [(None, None), (300, "unseen zzz words")]
    got = score_corpus(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    words = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    import math

    text = dict(rows)
    for x in got:
        w = words(text[x.doc_id])
        base = sum(math.log10((counts[k] + 1) / (n + v + 1)) for k in w)
        assert (x.n_tokens, x.n_known, x.train_tokens, x.held_out) == (len(w), sum(counts[k] > 0 for k in w), n, held(x.doc_id))
        assert abs(x.base_score - base) < 1e-6 * max(1, -base)
    tested = [x for x in got if x.held_out]
    assert sum(x.score for x in tested) > sum(x.base_score for x in tested)


def test_toxicity(spark):
    r = random.Random(4)
    bad, plain = ["vile scum", "you idiot"], ["good day", "nice tree", "the sky", "we walk", "blue lake"]
    rows, labels = [], []
    for i in range(400):
        y = i % 3 == 0
        w = [r.choice(plain) for _ in range(20)] + [r.choice(bad)] * y
        r.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(y)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, toxicity.training_labels(known))
    got = toxicity.score(docs.unionByName(spark.createDataFrame([(None, None), (900, "")], "doc_id long, text string")), model).collect()
    right = [x.predicted == dict(labels)[x.doc_id] for x in got if x.doc_id is not None and x.doc_id < 400]
    assert sum(right) >= 0.98 * len(right)
    assert all(x.predicted == 0 and x.spans == [] for x in got if x.doc_id in (None, 900))
    text = dict(rows)
    assert all(any(text[x.doc_id][s.begin : s.end] in b or b.split()[0] in text[x.doc_id][s.begin : s.end] for b in bad) for x in got if x.predicted for s in x.spans[:1])


def test_toxicity_of_a_capped_draw(spark):
    r = random.Random(6)
    # a word that half of the toxic tenth has, and a tenth of the rest: its documents are toxic one time in three
    rows, labels = [], []
    for i in range(1500):
        y = i % 10 == 0
        hard = r.random() < (0.5 if y else 0.1)
        rows.append((i, " ".join([r.choice(["good day", "nice tree", "the sky", "we walk"]) for _ in range(8)] + ["grim"] * hard)))
        labels.append((i, int(y)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    whole = toxicity.score(docs, toxicity.train(docs, known), with_spans=False).agg(F.avg("score"), F.sum("predicted")).first()
    drawn = toxicity.score(docs, toxicity.train(docs, known, sample=120), with_spans=False).agg(F.avg("score"), F.sum("predicted")).first()
    assert abs(whole[0] - 0.1) < 0.03 and abs(drawn[0] - 0.1) < 0.05
    assert whole[1] <= 40 and drawn[1] <= 40
    same = toxicity.draw_weights(toxicity.np.array([True, False, False]), {0: 2, 1: 1})
    assert same.tolist() == [1, 1, 1]


def test_language_identification(spark):
    docs = spark.createDataFrame([("the house and the garden with the tree " * 5, "en"), ("das haus und der garten mit dem baum " * 5, "de")] * 3, "text string, lang string")
    page = lambda i, url, lang, t: (i, url, f"<html{lang}><body><script>der die das</script>{t}</body></html>")
    rows = [page(1, "http://a.de/x", ' lang="de"', "das haus mit dem baum und der garten"), page(2, "http://a.com/x", ' lang="de"', "the garden and the house with the tree"), (3, None, None), (None, "http://a.de/y", "")]
    got = {r.page_id: r for r in identify(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()}
    assert (got[1].lang, got[2].lang, len(got)) == ("de", "en", 4)
    assert identify(spark.createDataFrame([], "page_id long, url string, html string"), docs).collect() == []


def test_toxicity_draw_keeps_its_bound(spark):
    rows = [(1, f"plain words {i} here") for i in range(900)] + [(2, "vile words here")] * 900 + [(i, f"more text {i}") for i in range(3, 300)] + [(400, None), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (400, 1), (401, 1), (None, 0)] + [(i, int(i % 3 == 0)) for i in range(3, 300)], "doc_id long, toxic int")
    got, totals = toxicity.drawn(docs, labels, sample=50)
    got = got.collect()
    assert Counter(x.toxic for x in got) == {0: 50, 1: 50} and len({x.text for x in got}) == 100
    assert totals == {0: 900 + 198, 1: 900 + 99}
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {x.predicted for x in toxicity.score(docs.limit(3), none).collect()} <= {0, 1}


def whole_ids(path, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [t.encode(x, add_special_tokens=False).ids + [0] for x in texts]


def ids_by_run(path, texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ids, bounds = packing.document_ids(path, data, np.cumsum([0, *(len(x.encode()) for x in texts)]))
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def test_packed_ids_of_odd_words(monkeypatch):
    r = random.Random(4)
    bits = ["the", "Ab", "é", "É", "ÿß", "×", "÷", "é", "≠", "̸", "́", "İ", "ﬁ", "ª", "日本", "٣", "7", "42", "'", "'s", "'LL", "'re", ".", ",", "$$$", "&", "<", "|"]
    bits += ["<|", "<|endoftext|>", "<|ENDOFTEXT|>", "</w>", "🙂", "\x00", "\x01", "\x1c", "\x7f", "\x85", "\xa0", " ", "　", " ", " ", "\t", "\n", "\x0b", "\r\f"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 12))) for _ in range(4000)] + ["", "", "x" * 5000, "é." * 3000, "w " * 3000]
    path = packing.tokenizer_path()
    want = whole_ids(path, texts)
    for words, stretch in ((300_000, 1 << 20), (50, 64)):
        monkeypatch.setattr(packing, "CACHED_WORDS", words)
        monkeypatch.setattr(packing, "STRETCH", stretch)
        monkeypatch.setattr(packing, "_encoders", {})
        for _ in range(2):
            assert ids_by_run(path, texts) == want
        assert len(packing._encoders[path].known) <= words
        assert ids_by_run(path, []) == [] and ids_by_run(path, ["", " \n"]) == [[0], [0]]


def test_packing_encodes_a_word_once_and_letters_without_the_normalizer(monkeypatch):
    monkeypatch.setattr(packing, "_encoders", {})
    path, given = packing.tokenizer_path(), []
    ids = packing.Encoder.ids

    def counted(self, tokenizer, texts):
        given.append((tokenizer is self.whole, sorted(" ".join(texts).split())))
        return ids(self, tokenizer, texts)

    monkeypatch.setattr(packing.Encoder, "ids", counted)
    texts = ["Plage, plage. plage$$$ plage$$$x", "château château!! CHÂTEAU plage7", "plage", "château."] * 50
    assert ids_by_run(path, texts) == whole_ids(path, texts)
    assert given == [(False, ["château", "plage"]), (True, sorted(["!!", "$$$", "$$$x", ",", ".", "7", "chÂteau"]))]
    ids_by_run(path, texts)
    assert len(given) == 2


def test_packing_with_other_tokenizers(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.WordLevel({"<unk>": 1, "One": 2, "one": 3, "two.": 4, "two": 5, ".": 6}, unk_token="<unk>"))
    t.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    t.save(f"{tmp_path}/words.json")
    texts = ["One two.", "", "one two .", "ONE"]
    assert ids_by_run(f"{tmp_path}/words.json", texts) == whole_ids(f"{tmp_path}/words.json", texts) == [[2, 4, 0], [0], [3, 5, 6, 0], [1, 0]]
