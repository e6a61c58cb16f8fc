"""Events: routing, idempotent acceptance, failure routing, retries, quotas, inactivity. Functions take batch or streaming frames alike
where nothing else is said."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from convlake.operators.folds import ordered_fold
from convlake.session import ready
from convlake.sources.tables import ROUTES
from convlake.streaming.windows import ROCKS

MAX_ATTEMPTS = 5
ENVELOPE = "event_id string, event_type string, correlation_id string, causation_id string, user_id string, space_id string, conversation_id string, event_version int, attempt int, payload string, created_at timestamp"


def route(kind: Column) -> Column:
    """The stream an event type goes to; null if the type isn't allowed."""
    return F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in ROUTES.items()])


def routed(events: DataFrame, target: str | None = None) -> DataFrame:
    """stream, and whether the event is accepted. With a `target` column, an event that names a stream goes there, whatever its type, if it
    is one of the known streams, and is rejected if it isn't."""
    stream = route(F.col("event_type"))
    if target:
        named = F.nullif(F.trim(target), F.lit(""))
        stream = F.when(named.isNull(), stream).when(named.isin(*dict.fromkeys(ROUTES.values())), named)
    return events.withColumn("stream", stream).withColumn("accepted", F.col("stream").isNotNull())


def accept_once(events: DataFrame, key: str = "idempotency_key", at: str = "created_at", within: str = "1 day") -> DataFrame:
    """The first event of each key: on a stream, with state kept for `within`; on a table, among all rows."""
    if events.isStreaming:
        return events.withWatermark(at, within).dropDuplicatesWithinWatermark([key])
    return events.groupBy(key).agg(F.min_by(F.struct(*[c for c in events.columns if c != key]), F.struct(at, "event_id")).alias("e")).select(key, "e.*")


def retry_delay(attempt: Column, base: float = 1.0, most: float = 300.0) -> Column:
    """Seconds before a retry, without the jitter."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt))


def parsed(events: DataFrame, kind: str = "k int") -> DataFrame:
    """payload as a struct, and whether it could be read."""
    out = events.withColumn("body", F.from_json("payload", f"{kind}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    return out.withColumn("readable", F.col("body").isNotNull() & F.col("body._corrupt").isNull())


def after_failure(events: DataFrame, most: int = MAX_ATTEMPTS) -> DataFrame:
    """Where a failed event goes: dead letters if it can't be read, may not be retried or has had its attempts, else a later retry."""
    dead = ~F.col("readable") | ~F.col("retryable") | (F.col("attempt") >= most)
    out = events.withColumn("route", F.when(dead, "dead_letter").otherwise("retry"))
    delay = retry_delay(F.col("attempt")).cast("long")
    return out.withColumn("next_attempt", F.when(~dead, F.col("attempt") + 1)).withColumn("not_before", F.when(~dead, F.timestamp_seconds(F.unix_timestamp("created_at") + delay)))


def due(events: DataFrame, now: Column) -> DataFrame:
    """Retries whose time has come, as new events that name their cause."""
    return events.where((F.col("route") == "retry") & (F.col("not_before") <= now)).withColumn("causation_id", F.col("event_id")).withColumn("event_id", F.sha1(F.concat_ws(":", "event_id", "next_attempt").cast("binary")))


def unacknowledged(deliveries: DataFrame, acks: DataFrame, now: Column, idle: int = 60) -> DataFrame:
    """Deliveries without an acknowledgement that have idled for `idle` seconds."""
    return deliveries.join(acks.select("event_id"), "event_id", "left_anti").where(F.unix_timestamp(now) - F.unix_timestamp("created_at") >= idle)


def late(events: DataFrame, states: DataFrame, terminal: tuple[str, ...] = ("COMPLETED", "PARTIAL", "FAILED")) -> DataFrame:
    """Events with `propagate`: false if their conversation had already ended."""
    out = events.join(states.select("conversation_id", "status"), "conversation_id", "left")
    return out.withColumn("propagate", ~F.coalesce(F.col("status").isin(*terminal), F.lit(False)))


def inactive_sessions(events: DataFrame, key: str, at: str = "created_at", gap: str = "15 minutes") -> DataFrame:
    """Sessions of a key that ended after `gap` without an event: begin, last event, events."""
    rows = events.withWatermark(at, gap) if events.isStreaming else events
    out = rows.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.max(at).alias("last_at"), F.count("*").alias("events"))
    return out.select(key, F.col("w.start").alias("begin"), "last_at", "events")


DAY = 86_400


class DayQuota:
    """What one provider has admitted on one UTC day: the day's sums, and the requests of the last minute."""

    def __init__(self, rpm: int, rpd: int, tpm: int, tpd: int, requests: int = 0, tokens: int = 0, recent: list[tuple[int, int]] | None = None):
        self.limits = (rpm, rpd, tpm, tpd)
        self.requests, self.tokens = requests, tokens
        self.recent = deque(recent or [])
        self.minute = sum(t for _, t in self.recent)

    def admit(self, at: int, tokens: int) -> bool:
        while self.recent and self.recent[0][0] < at - 60:
            self.minute -= self.recent.popleft()[1]
        rpm, rpd, tpm, tpd = self.limits
        ok = len(self.recent) < rpm and self.requests < rpd and self.minute + tokens <= tpm and self.tokens + tokens <= tpd
        if ok:
            self.recent.append((at, tokens))
            self.minute, self.requests, self.tokens = self.minute + tokens, self.requests + 1, self.tokens + tokens
        return ok


class _Quota:
    def __init__(self, key: str, limits: tuple[int, ...]):
        self.key, self.quota = key, DayQuota(*limits)

    def add_many(self, rows: pa.RecordBatch) -> list[dict]:
        keys, ids, times, tokens = (rows.column(c).to_pylist() for c in (self.key, "request_id", "at", "tokens"))
        return [{self.key: k, "request_id": i, "admitted": self.quota.admit(t, n)} for k, i, t, n in zip(keys, ids, times, tokens, strict=True)]

    def finish(self) -> list[dict]:
        return []


def _by_day(requests: DataFrame, key: str) -> DataFrame:
    return requests.select(key, "request_id", F.col("at").cast("long").alias("at"), F.col("tokens").cast("long").alias("tokens"), F.floor(F.col("at") / DAY).cast("long").alias("day"))


def admitted(requests: DataFrame, key: str, rpm: int = 12, rpd: int = 900, tpm: int = 10**12, tpd: int = 10**12) -> DataFrame:
    """(key, request_id, admitted): each request in order of (at, request_id) against sliding-minute and UTC-day quotas of requests
    and tokens. What is rejected uses up nothing. at: whole seconds.

    A new day empties the day's sums and the minute as well, so each key and day is a group of its own, and a provider is as many
    tasks as there are days; a group keeps a minute's requests, at most rpm, in memory.
    """
    kind = requests.schema[key].dataType.simpleString()
    return ordered_fold(_by_day(requests, key), [key, "day"], ["at", "request_id"], lambda _: _Quota(key, (rpm, rpd, tpm, tpd)), f"{key} {kind}, request_id long, admitted boolean")


class StreamQuota(StatefulProcessor):
    """The same fold as state of a stream: a value for the day, a list for the minute; both go some time after the day's last request."""

    def __init__(self, columns: list[str], limits: tuple[int, ...], kept_ms: int):
        self.columns, self.limits, self.kept_ms = columns, limits, kept_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.day = handle.getValueState("day", "requests long, tokens long", self.kept_ms)
        self.minute = handle.getListState("minute", "at long, tokens long", self.kept_ms)

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        sums = self.day.get()
        quota = DayQuota(*self.limits, *(sums or (0, 0)), [tuple(x) for x in self.minute.get()] if sums else [])
        frame = pd.concat(list(rows)).sort_values(["at", "request_id"])
        out = [(key[0], i, quota.admit(int(t), int(n))) for i, t, n in zip(frame["request_id"], frame["at"], frame["tokens"], strict=True)]
        self.day.update((quota.requests, quota.tokens))
        if quota.recent:
            self.minute.put(list(quota.recent))
        yield pd.DataFrame(out, columns=self.columns)


def admitted_stream(requests: DataFrame, key: str, rpm: int = 12, rpd: int = 900, tpm: int = 10**12, tpd: int = 10**12, kept_seconds: float = 2 * DAY) -> DataFrame:
    """admitted() on a stream: requests are taken in order within a micro-batch, and batches as they come."""
    spark = ready(requests.sparkSession)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    schema = T.StructType([requests.schema[key], T.StructField("request_id", T.LongType()), T.StructField("admitted", T.BooleanType())])
    processor = StreamQuota(schema.names, (rpm, rpd, tpm, tpd), int(kept_seconds * 1000))
    return _by_day(requests, key).groupBy(key, "day").transformWithStateInPandas(processor, schema, "append", "ProcessingTime")


def offered_load(requests: DataFrame, key: str) -> DataFrame:
    """Requests and tokens of the sixty seconds up to each request, whether admitted or not."""
    from pyspark.sql import Window

    by = Window.partitionBy(key).orderBy("at").rangeBetween(-60, 0)
    return requests.withColumn("requests", F.count("*").over(by)).withColumn("load", F.sum("tokens").over(by))


def first_success(attempts: DataFrame, key: str) -> DataFrame:
    """The first provider, in order `ord`, whose call was good, and how many were tried: a chain ends at the first error that isn't
    retryable."""
    from pyspark.sql import Window

    by = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    over = F.coalesce(F.max((F.col("ok") | ~F.col("retryable")).cast("int")).over(by), F.lit(0))
    tried = attempts.withColumn("__over", over).where("__over = 0")
    return tried.groupBy(key).agg(F.count("*").alias("tried"), F.max(F.when(F.col("ok"), F.col("provider"))).alias("provider"))


def read_envelopes(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of envelopes from JSON lines that come into a folder; what can't be read has a null event_id."""
    return spark.readStream.schema("value string").text(folder).select(F.from_json("value", ENVELOPE).alias("e"), "value").select("e.*", F.col("value").alias("raw"))


def write_envelopes(events: DataFrame, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """A sink of one JSON field a line."""
    out = events.select(F.to_json(F.struct(*[c for c in events.columns if c != "raw"])).alias("value")).writeStream.format("text").option("path", folder).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()
