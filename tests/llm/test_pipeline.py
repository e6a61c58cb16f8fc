import pathlib
import random

import corpus_pipeline


def test_stages_keep_clean_documents(spark, tmp_path):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(60)
    rows = [(i, prose(80), "en", "s" + str(i % 2), 0) for i in range(60)]
    rows += [(100, rows[0][1], "en", "s0", 0), (101, rows[1][1] + " more", "en", "s1", 0), (102, prose(30) + " " + passage, "en", "s0", 0), (103, passage + " " + prose(30), "en", "s1", 0), (104, None, None, None, None), (105, "", "en", "s0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    calm = stages["toxicity"](spark, docs, str(tmp_path))
    assert calm.columns == docs.columns and calm.count() == len(rows)
    once = stages["near_dedup"](spark, calm, str(tmp_path))
    assert {x.doc_id for x in once.collect()} == {x[0] for x in rows} - {100, 101}
    cut = {x.doc_id: x for x in stages["suffix_dedup"](spark, once, str(tmp_path)).collect()}
    assert len(cut) == len(rows) - 2 and cut[102].text == dict((x[0], x[1]) for x in rows)[102]
    assert passage not in cut[103].text and cut[103].n_chars == len(cut[103].text) and cut[104].text is None
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {x.doc_id for x in packed.collect()} <= set(cut) and packed.count() > 0
    folder = spark.sparkContext.getCheckpointDir()
    left = [p for p in pathlib.Path(folder.removeprefix("file:")).glob("stages-*/*")]
    assert {p.name for p in left} == {"mixing"}


def test_odd_rows(spark, tmp_path):
    """Repeated keys, nulls everywhere, a long text, other columns with clashing names, and no row at all."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, `__row` string, size string"
    rows = [(1, "one text of some words", "en", "a", 22, "x", "y"), (1, "one text of some words", "en", "a", 22, "x", "y"), (1, "another text", None, None, None, None, None)]
    rows += [(None, "no key here", "en", "a", 11, None, None), (2, None, None, None, None, None, None), (3, "", "en", "b", 0, "x", "y"), (4, " ".join(f"w{i}" for i in range(150_000)), "en", "b", None, None, None)]
    spark.createDataFrame([(1, 1, 0), (None, 0, 1), (99, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, some in (("odd", rows), ("none", [])):
        docs = spark.createDataFrame(some, kind)
        for stage, f in corpus_pipeline.STAGES:
            out = f(spark, docs, str(tmp_path))
            out.write.parquet(f"{tmp_path}/{name}-{stage}")
            if stage != "packing":
                assert out.columns == [c for c in docs.columns]
                docs = spark.read.parquet(f"{tmp_path}/{name}-{stage}")
        packed = spark.read.parquet(f"{tmp_path}/{name}-packing")
        assert {x.doc_id for x in packed.select("doc_id").distinct().collect()} == ({1, 2, 3, 4, None} if some else set())
