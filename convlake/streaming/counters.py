"""Guarded counters: what a conversation has received, completed and failed, whatever is delivered twice."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from convlake.session import ready
from convlake.streaming.windows import ROCKS

COUNTERS = ["received", "completed", "failed"]
CHUNK = ["conversation_id", "sequence_number"]


def guarded_counters(deliveries: DataFrame) -> DataFrame:
    """(conversation_id, received, completed, failed) of deliveries (delivery_id, conversation_id, sequence_number, kind, at).

    A delivery counts once, however often it comes. A chunk is received once; it is completed where it wasn't just before; each failed
    attempt counts. Deliveries are deduplicated, then steps are taken chunk by chunk, so a busy conversation is as many groups as
    it has chunks, and only steps are summed by conversation.
    """
    once = deliveries.groupBy("delivery_id", *CHUNK, "kind").agg(F.min("at").alias("at"))
    by = Window.partitionBy(*CHUNK)
    before = F.lag("state").over(by.orderBy("at", "delivery_id"))
    # only completions and failures change a chunk's state
    done = once.where("kind <> 'received'").withColumn("state", F.col("kind")).withColumn("step", F.when(F.col("kind") == "failed", 1).otherwise((~(before.eqNullSafe(F.lit("completed")))).cast("int")))
    first = once.where("kind = 'received'").select(*CHUNK, "kind").distinct().withColumn("step", F.lit(1))
    steps = done.select(*CHUNK, "kind", "step").unionByName(first)
    total = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("step"))), F.lit(0)).cast("long").alias(k)
    return steps.groupBy("conversation_id").agg(*map(total, COUNTERS))


class Steps(StatefulProcessor):
    """A chunk's state: whether it was received, whether it is completed, and the deliveries seen of late."""

    def __init__(self, kept_seconds: float, columns: list[str]):
        self.kept_ms, self.columns = int(kept_seconds * 1000), columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "received boolean, completed boolean")
        self.seen = handle.getMapState("seen", "delivery_id string", "at long", self.kept_ms)

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        received, completed = self.state.get() or (False, False)
        out = []
        frame = pd.concat(list(rows)).drop_duplicates("delivery_id").sort_values(["at", "delivery_id"])
        for delivery, kind in zip(frame["delivery_id"].astype(str), frame["kind"], strict=True):
            if self.seen.containsKey((delivery,)):
                continue
            self.seen.updateValue((delivery,), (timerValues.getCurrentProcessingTimeInMs(),))
            step = {"received": not received, "completed": not completed, "failed": True}.get(kind, False)
            received, completed = received or kind == "received", kind == "completed" or (completed and kind != "failed")
            if step:
                out.append((*key, kind))
        self.state.update((received, completed))
        yield pd.DataFrame(out, columns=self.columns)


def counter_steps(deliveries: DataFrame, kept_seconds: float = 86_400) -> DataFrame:
    """The same on a stream: (conversation_id, sequence_number, kind), a row for each step of a counter, to be summed wherever they
    are kept. A delivery is known again for kept_seconds. Within a batch deliveries are taken in order of (at, delivery_id)."""
    spark = ready(deliveries.sparkSession)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    schema = T.StructType([*(deliveries.schema[c] for c in CHUNK), T.StructField("kind", T.StringType())])
    return deliveries.select("delivery_id", *CHUNK, "kind", "at").groupBy(*CHUNK).transformWithStateInPandas(Steps(kept_seconds, schema.names), schema, "append", "ProcessingTime")
