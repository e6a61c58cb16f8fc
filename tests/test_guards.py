"""Quotas and counters: a plain loop over random rows, and the same on a stream."""

import random
from collections import defaultdict

from conftest import drain

from convlake.streaming import counters
from convlake.streaming import events as ev

LIMITS = {"rpm": 3, "rpd": 40, "tpm": 1500, "tpd": 14_000}


def requests(r, n=3000):
    start = 20_000 * 86_400 - 5_000  # so that days change in between
    return [(f"p{r.randrange(4)}", i, start + r.randrange(200_000) // r.choice((1, 40)), r.randrange(50, 900)) for i in range(n)]


def loop(rows):
    out, kept = {}, defaultdict(list)
    for provider, i, at, tokens in sorted(rows, key=lambda x: (x[2], x[1])):
        day = [x for x in kept[provider] if x[0] // 86_400 == at // 86_400]
        minute = [x for x in day if x[0] >= at - 60]
        ok = len(minute) < LIMITS["rpm"] and len(day) < LIMITS["rpd"] and sum(t for _, t in minute) + tokens <= LIMITS["tpm"] and sum(t for _, t in day) + tokens <= LIMITS["tpd"]
        if ok:
            kept[provider].append((at, tokens))
        out[i] = ok
    return out


def streamed(spark, tmp_path, batches, kind, make):
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # of state; a batch starts a Python process for each
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/in/{i:02}")
    out = make(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"))
    query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").start()
    drain(query, sum(map(len, batches)))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return spark.read.parquet(f"{tmp_path}/out")


def test_quotas_by_day(spark, tmp_path):
    rows, kind = requests(random.Random(3)), "provider string, request_id long, at long, tokens long"
    want = loop(rows)
    got = ev.admitted(spark.createDataFrame(rows, kind).repartition(5), "provider", **LIMITS)
    assert {x.request_id: x.admitted for x in got.collect()} == want and 0.05 < sum(want.values()) / len(want) < 0.95
    plan = got._jdf.queryExecution().toString()
    assert "hashpartitioning(provider" in plan and "day" in plan.split("hashpartitioning(provider")[1][:20]
    # micro-batches in order of time, cut anywhere
    rows.sort(key=lambda x: (x[2], x[1]))
    some = rows[:700]
    got = streamed(spark, tmp_path, [some[:400], some[400:]], kind, lambda s: ev.admitted_stream(s, "provider", **LIMITS))
    assert {x.request_id: x.admitted for x in got.collect()} == loop(some)


def test_counters_on_a_stream(spark, tmp_path):
    r = random.Random(6)
    rows = [(f"d{i}", i % 3, r.randrange(4), r.choice(("received", "completed", "failed")), i) for i in range(160)]
    batches = [rows[i : i + 60] + [x for x in rows[: i + 60] if r.random() < 0.4] for i in range(0, 160, 60)]  # what came before comes again
    kind = "delivery_id string, conversation_id long, sequence_number int, kind string, at long"
    want = defaultdict(lambda: [0, 0, 0])
    state = {}
    for _, c, n, k, _ in rows:
        was = state.get((c, n), (False, False))
        want[c][0] += k == "received" and not was[0]
        want[c][1] += k == "completed" and not was[1]
        want[c][2] += k == "failed"
        state[c, n] = (was[0] or k == "received", k == "completed" or (was[1] and k != "failed"))
    batch = counters.guarded_counters(spark.createDataFrame([x for b in batches for x in b], kind)).collect()
    assert {x.conversation_id: [x.received, x.completed, x.failed] for x in batch} == want
    steps = streamed(spark, tmp_path, batches, kind, counters.counter_steps).collect()
    got = defaultdict(lambda: [0, 0, 0])
    for x in steps:
        got[x.conversation_id][counters.COUNTERS.index(x.kind)] += 1
    assert got == want


def test_an_explicit_target_stream(spark):
    rows = [("stt.requested", None), ("stt.requested", "windows"), ("unknown", "audio"), ("stt.requested", "elsewhere"), ("unknown", " ")]
    got = ev.routed(spark.createDataFrame(rows, "event_type string, target string"), "target").collect()
    assert [(x.stream, x.accepted) for x in got] == [("stt", True), ("windows", True), ("audio", True), (None, False), (None, False)]
