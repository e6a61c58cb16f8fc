"""Windows closed while a conversation goes on: the window fold as state of a stream, keyed by conversation.

State is kept in parts, so that a batch writes what it changes: a conversation's place, the lines of its open window, and each chunk that
waits for one before it as an entry of its own. A gap has a timer; when it goes off, the missing numbers are given up. When a
conversation ends, all of it leaves the store but a mark that lives for a while, by which late chunks are known.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from convlake.operators.windows import WINDOW, Line, Sizes, WindowFold
from convlake.session import ready

FIELDS = ["sequence_number", "text", "useful", "terminal", "duration_ms", "expected_last"]
GAP_SECONDS, KEPT_SECONDS = 900, 86_400
PLACE = "next long, last long, index int, tokens int, length long, wall long, previous string, skipped string, empties string, lines int, waiting int, timer long"
NAMES = [f.split()[0] for f in PLACE.split(", ")]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def numbers(text: str) -> list[int]:
    return [int(x) for x in text.split(",") if x]


class ClosingWindows(StatefulProcessor):
    def __init__(self, key: str, columns: list[str], sizes: Sizes, gap_seconds: float, kept_seconds: float):
        self.key, self.columns, self.sizes, self.gap_ms, self.kept_ms = key, columns, sizes, int(gap_seconds * 1000), int(kept_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", PLACE)
        self.lines = handle.getListState("lines", "sequence long, raw string, duration long, owned boolean")
        self.waiting = handle.getMapState("waiting", "sequence_number long", "text string, useful boolean, terminal boolean, duration_ms long")
        self.over = handle.getValueState("over", "at long", self.kept_ms)

    def close(self) -> None:
        pass

    def load(self, key: tuple) -> tuple[dict, WindowFold, list]:
        fold = WindowFold(self.key, {self.key: key[0], "start_index": 0}, self.sizes, True)
        kept = self.place.get()
        if kept is None:
            return {"next": 0, "last": None, "waiting": 0, "timer": None}, fold, []
        p = dict(zip(NAMES, kept, strict=True))
        fold.lines = [Line(*x) for x in self.lines.get()] if p["lines"] else []
        fold.index, fold.tokens, fold.length, fold.wall, fold.previous = (p[k] for k in ("index", "tokens", "length", "wall", "previous"))
        fold.skipped, pairs = numbers(p["skipped"]), numbers(p["empties"])
        fold.empties = list(zip(pairs[::2], pairs[1::2], strict=True))
        return p, fold, list(fold.lines)

    def advance(self, p: dict, fold: WindowFold, fresh: dict[int, tuple]) -> list[dict]:
        """Take the chunks whose turn has come, from this batch or from those that wait; the rest of this batch waits then."""
        out: list[dict] = []
        while True:
            chunk = fresh.pop(p["next"], None)
            if chunk is None and p["waiting"] and self.waiting.containsKey((p["next"],)):
                chunk = tuple(self.waiting.getValue((p["next"],)))
                self.waiting.removeKey((p["next"],))
                p["waiting"] -= 1
            if chunk is None:
                break
            text, useful, terminal, duration = chunk
            if not terminal:
                out += fold.add({"sequence_number": p["next"], "text": text or "", "useful": useful, "duration_ms": duration, "context": False})
            p["next"] += 1
        for seq, chunk in fresh.items():
            self.waiting.updateValue((seq,), chunk)
        p["waiting"] += len(fresh)
        return out

    def save(self, p: dict, fold: WindowFold, before: list, came_from: int, now: int) -> list[dict]:
        """Keep what is needed; a conversation whose last number has passed ends, and leaves the store."""
        ended = p["last"] is not None and p["next"] > p["last"]
        gap = not ended and (p["waiting"] > 0 or p["last"] is not None)
        if p["timer"] is not None and (not gap or p["next"] != came_from):
            self.handle.deleteTimer(p["timer"])
            p["timer"] = None
        if ended:
            for state in (self.place, self.lines, *([self.waiting] if p["waiting"] else [])):
                state.clear()
            self.over.update((now,))
            return fold.finish()
        if gap and p["timer"] is None:
            p["timer"] = now + self.gap_ms
            self.handle.registerTimer(p["timer"])
        pairs = ",".join(f"{q},{d}" for q, d in fold.empties)
        self.place.update((p["next"], p["last"], fold.index, fold.tokens, fold.length, fold.wall, fold.previous, ",".join(map(str, fold.skipped)), pairs, len(fold.lines), p["waiting"], p["timer"]))
        if len(fold.lines) > len(before) and fold.lines[: len(before)] == before:
            self.lines.appendList([tuple(x) for x in fold.lines[len(before) :]])
        elif fold.lines and fold.lines != before:
            self.lines.put([tuple(x) for x in fold.lines])
        elif before and not fold.lines:
            self.lines.clear()
        return []

    def frame(self, rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.columns, dtype=object)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        p, fold, before = self.load(key)
        if "index" not in p and self.over.exists():
            return
        fresh: dict[int, tuple] = {}
        begun = p["next"]
        for frame in rows:
            known = frame["expected_last"].dropna()
            p["last"] = int(known.iloc[-1]) if len(known) else p["last"]
            numbered = frame[frame["sequence_number"].notna()]
            for seq, text, useful, terminal, duration in zip(*(numbered[c] for c in FIELDS[:5]), strict=True):
                if seq >= begun and int(seq) not in fresh and not (p["waiting"] and self.waiting.containsKey((int(seq),))):
                    fresh[int(seq)] = (None if pd.isna(text) else text, bool(useful), bool(terminal), None if pd.isna(duration) else int(duration))
        out = self.advance(p, fold, fresh)
        out += self.save(p, fold, before, begun, timerValues.getCurrentProcessingTimeInMs())
        yield self.frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        p, fold, before = self.load(key)
        if p["timer"] is None:
            return
        p["timer"] = None  # it has gone off
        # the numbers up to the next chunk that is there, or to the last, are given up
        there = [k[0] for k in self.waiting.keys()] if p["waiting"] else []
        begun, p["next"] = p["next"], min(there, default=p["next"] if p["last"] is None else p["last"] + 1)
        out = self.advance(p, fold, {})
        out += self.save(p, fold, before, begun, timerValues.getCurrentProcessingTimeInMs())
        yield self.frame(out)


def closing_windows(chunks: DataFrame, key: str = "conversation_id", sizes: Sizes = Sizes(), gap_seconds: float = GAP_SECONDS, kept_seconds: float = KEPT_SECONDS) -> DataFrame:
    """The windows that each conversation's chunks fill, as soon as they do; the last one once its last chunk is there.

    chunks, a stream: key, sequence_number (from 0), text, useful, terminal (failed for good), duration_ms and expected_last, null until
    the recording has stopped. Chunks may come in any order and more than once: each is taken at its turn, the first of its number.
    Where the next number has been lacking for gap_seconds, the numbers up to the next chunk there are given up, and so is what a stopped
    recording lacks at its end. An ended conversation leaves a mark for kept_seconds, and chunks that come in that time are dropped.

    Needs the RocksDB state store, which is set where nothing else is. A conversation's waiting chunks and open lines are entries of their own
    in it, not one value that is rewritten.
    """
    spark = ready(chunks.sparkSession)
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").rsplit(".", 1)[-1] != "RocksDBStateStoreProvider":
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kind = chunks.schema[key].dataType.simpleString()
    schema = T.StructType.fromDDL(f"{key} {kind}, {WINDOW}")
    processor = ClosingWindows(key, schema.names, sizes, gap_seconds, kept_seconds)
    return chunks.select(key, *FIELDS).groupBy(key).transformWithStateInPandas(processor, schema, "append", "ProcessingTime")
