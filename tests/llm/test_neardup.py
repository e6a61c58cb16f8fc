import random
import re
import time

from convlake.llm.common import release
from convlake.llm.neardup import near_duplicates


def brute(rows, size, percent):
    sets = []
    for key, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((key, {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()))
    root = {k: k for k, _ in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {k: (len(s), find(k), find(k) == k) for k, s in sets}


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 5)))
    texts = [None, "", " \t\n", "one", "ONE", "One two", "one  two\n", "a b c d", "A b c D e"]
    base = [word() for _ in range(120)]
    for n in (5, 20, 60, 120):
        texts += [" ".join(base[:n])] * 3
        for _ in range(25):  # a group of near copies, near the threshold
            w = base[:n]
            for _ in range(r.randint(1, max(1, n // 25))):
                w[r.randrange(n)] = word()
            texts.append(" ".join(w))
    texts += [" ".join(word() for _ in range(r.randint(1, 40))) for _ in range(60)]
    r.shuffle(texts)
    return list(enumerate(texts, 10))


def test_against_brute_force(spark):
    for seed, size in ((1, 4), (2, 5)):
        rows = corpus(seed)
        got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=size).collect()
        assert {r.doc_id: tuple(r)[1:] for r in got} == brute(rows, size, 80)
        assert len(got) == len(rows)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(empty).collect() == []
    rows = [(1, "x y z", 5), (1, "x y z", 5), (None, "x y z", 6), (None, None, 7)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, kept int"))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 1, 1, True), (1, 1, 1, True), (None, 1, 1, False), (None, 0, None, False)], key=str)


def test_components(spark):
    from convlake.llm import common

    r = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + r.randrange(80), 100 + r.randrange(80)) for _ in range(50)] + [(500, 400 + i) for i in range(30)]
    table = spark.createDataFrame(edges, "a long, b long")
    root = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {n: c for n, c in map(tuple, common.components(table).collect())}
    assert got == {n: c for n, c in root.items() if n != c}
    assert common.components(table.limit(0)).collect() == []


def test_exact_mode(spark):
    for seed, size in ((4, 4), (5, 5)):
        rows = corpus(seed)
        got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=size, exact=True).collect()
        assert {r.doc_id: tuple(r)[1:] for r in got} == brute(rows, size, 80)


def test_large_sets_go_by_registers(spark, monkeypatch):
    from convlake.llm import neardup

    rows = corpus(6)
    monkeypatch.setattr(neardup, "SMALL", 8)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute(rows, 4, 80)


def test_rounds_leave_no_shuffles(spark):
    """What a run has left when it returns are the shuffles of its last steps, not those of all its rounds."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(corpus(3))], "doc_id long, text string")
    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    spark._jvm.System.gc()
    time.sleep(2)
    first, before = spark.sparkContext._jsc.sc().newShuffleId(), tracker.shuffleStatuses().size()
    found = near_duplicates(docs)
    made = spark.sparkContext._jsc.sc().newShuffleId() - first
    until = time.time() + 10
    while (left := tracker.shuffleStatuses().size() - before) > made // 2 and time.time() < until:
        time.sleep(0.2)
    assert made > 20 and left <= made // 2, (made, left)
    assert found.count() == docs.count()


def test_small_tables_take_few_tasks(spark):
    """Links and pairs are far fewer than documents: their steps take tasks by their rows, not one for each of the session's partitions."""
    docs = spark.createDataFrame(corpus(3), "doc_id long, text string")
    sc, tracker, held = spark.sparkContext, spark.sparkContext.statusTracker(), {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        sc.setJobGroup("few tasks", "")
        got = {r.doc_id: tuple(r)[1:] for r in near_duplicates(docs).collect()}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    stages = {s for j in tracker.getJobIdsForGroup("few tasks") for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s)))
    assert 0 < tasks <= 130 * 61, tasks
    assert got == brute(corpus(3), 5, 80)


def test_release_gives_native_memory_back(spark):
    """What the driver's JVM frees outside its heap goes back to the system, though what is still used lies around it."""
    jvm = spark._jvm
    status = f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup"

    def used():
        with open(status) as f:
            return int(re.search(r"Anonymous:\s+(\d+)", f.read())[1]) / 1024

    release(spark)
    buffers = [jvm.java.nio.ByteBuffer.allocateDirect(50_000) for _ in range(5000)]  # 240 MB
    for _ in range(3):  # the heap shrinks first, so that it doesn't count below
        jvm.System.gc()
        time.sleep(0.3)
    full, kept = used(), buffers[::50]
    del buffers
    until = time.time() + 15
    while (left := used()) > full - 150 and time.time() < until:
        release(spark)
        time.sleep(0.3)
    assert left <= full - 150, (full, left)
    assert len(kept) == 100
