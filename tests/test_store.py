"""Tables of slices and ledger sinks: what is rewritten, what is read, and what survives a crash."""

import re

import pytest
from pyspark.sql import functions as F

from convlake.sources import store
from convlake.streaming import ledger


def files(df):
    return set(df.inputFiles())


def make(spark, path, **options):
    table = store.Table(str(path), "conversation_id", ("sequence_number",), **({"slices": 8} | options))
    rows = spark.range(4000).selectExpr("id % 40 as conversation_id", "cast(id div 40 as int) as sequence_number", "concat('text ', id) as text", "if(id % 3 = 0, 'completed', 'pending') as status", "repeat('x', 50) as audio")
    store.create(table, rows)
    return table, rows


def test_an_upsert_rewrites_only_what_it_changes(spark, tmp_path):
    table, rows = make(spark, tmp_path / "t")
    before = files(store._folders(spark, table, store.current(spark, table)[1]))
    new = rows.where("conversation_id = 7").withColumn("text", F.upper("text")).unionByName(rows.where("conversation_id = 7 and sequence_number = 1").withColumn("sequence_number", F.lit(900)))
    assert store.upsert(table, new, ["conversation_id", "sequence_number"], ["text"]) == 2
    after = files(store._folders(spark, table, store.current(spark, table)[1]))
    of = lambda names: {re.search(r"slice=(\d+)", f)[1] for f in names}
    assert len(of(after - before)) == 1 and of(after - before) == of(before - after)
    got = {(r.conversation_id, r.sequence_number): r.text for r in store.read(spark, table).collect()}
    want = {(r.conversation_id, r.sequence_number): r.text for r in rows.collect()} | {(r.conversation_id, r.sequence_number): r.text for r in new.collect()}
    assert got == want
    # a second run changes nothing, and neither does an old row
    assert store.upsert(table, new, ["conversation_id", "sequence_number"], ["text"]) == 2
    assert store.upsert(table, rows.where("conversation_id = 3"), ["conversation_id", "sequence_number"], ["text"]) == 2
    assert files(store._folders(spark, table, store.current(spark, table)[1])) == after
    assert store.read(spark, table, 1).count() == 4000
    gone = store.expire(spark, table)
    assert len(gone) == 1 and store.read(spark, table).count() == 4001
    with pytest.raises(ValueError):
        store.read(spark, table, 1)


def test_a_version_shows_all_or_nothing(spark, tmp_path, monkeypatch):
    table, rows = make(spark, tmp_path / "t", slices=None)
    new = rows.where("conversation_id < 3 and sequence_number < 5").withColumn("text", F.lit("new"))
    with monkeypatch.context() as m:
        m.setattr(store, "_switch", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.replace(table, new)
    assert store.read(spark, table).count() == 4000
    assert store.replace(table, new) == 2
    got = store.read(spark, table)
    assert got.count() == 37 * 100 + 15 and got.where("conversation_id < 3 and text <> 'new'").count() == 0
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        store._switch(spark, table, 2, {})


def test_scans_read_only_what_they_need(spark, tmp_path):
    table, rows = make(spark, tmp_path / "t")
    got = store.scan(spark, table, [7], 10, 20, F.col("status") == "completed", columns=["conversation_id", "sequence_number"])
    assert sorted(map(tuple, got.collect())) == sorted((7, s) for s in range(10, 21) if (s * 40 + 7) % 3 == 0)
    plan = got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
    assert re.search(r"PartitionFilters: \[[^\]]*slice", plan) and re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(sequence_number,10\)", plan) and re.search(r"EqualTo\(conversation_id,7\)|In\(conversation_id, \[7\]\)", plan)
    assert "audio" not in re.search(r"ReadSchema: (.*)", plan)[1] and "text" not in re.search(r"ReadSchema: (.*)", plan)[1]
    read = {re.search(r"slice=(\d+)", r[0])[1] for r in store._folders(spark, table, store.current(spark, table)[1]).where("conversation_id = 7").select(F.col("_metadata.file_path")).distinct().collect()}
    assert len(read) == 1
    assert store.scan(spark, table, []).count() == 0 and store.scan(spark, table, [7, 8], without=("audio",)).columns == ["conversation_id", "sequence_number", "text", "status"]
    assert store.scan(spark, table, low=95).count() == 5 * 40


def test_each_event_once_over_a_crash(spark, tmp_path, monkeypatch):
    for i in range(4):
        spark.createDataFrame([(f"{i}-{k}", ["a", "b", "none"][k % 3]) for k in range(30)], "event_id string, route string").coalesce(1).write.json(f"{tmp_path}/in/{i}")
    stream = lambda: spark.readStream.schema("event_id string, route string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(f"{tmp_path}/in")
    run = lambda: ledger.deliver(stream(), ["a", "b"], f"{tmp_path}/out", f"{tmp_path}/check")
    write, calls = ledger.commit, []

    def failing(rows, folder, sink, batch):
        calls.append((sink, batch))
        if calls == [("a", 0), ("b", 0), ("a", 1), ("b", 1)]:
            rows.write.parquet(f"{folder}/data/{sink}/{batch}-lost")  # dies between its files and the entry
            raise OSError("killed")
        return write(rows, folder, sink, batch)

    monkeypatch.setattr(ledger, "commit", failing)
    with pytest.raises(Exception, match="killed"):
        run().awaitTermination(120)
    run().awaitTermination(120)
    assert calls[4:6] == [("a", 1), ("b", 1)] and calls[-1] == ("b", 3)
    for sink, k in (("a", 0), ("b", 1)):
        got = [r.event_id for r in ledger.delivered(spark, f"{tmp_path}/out", sink, "event_id string, route string").collect()]
        assert sorted(got) == sorted(f"{i}-{n}" for i in range(4) for n in range(k, 30, 3))
    assert [(r.sink, r.batch, r.events) for r in ledger.entries(spark, f"{tmp_path}/out").orderBy("sink", "batch").collect()] == [(s, b, 10) for s in "ab" for b in range(4)]
    run().awaitTermination(120)  # nothing new: nothing is written
    assert ledger.entries(spark, f"{tmp_path}/out").count() == 8
