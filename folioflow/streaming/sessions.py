"""Session state that depends on its own past: admission limits, attention windows and fragment buffers.

A machine says how a key's entries change with its next event. Streams run it with the entries as list state, and a timer
frees what has expired by event time; a table is run in one sorted pass, with the entries of one key
as all there is in memory. Events of a key go by time, then id; those without a time change nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Requests a minute; entries and seconds of an attention window and of a fragment buffer.
MOST_REQUESTS, LIMIT_SECONDS = 60, 60.0
WINDOW_SIZE, WINDOW_SECONDS = 20, 3600.0
MOST_FRAGMENTS, FRAGMENT_SECONDS = 200, 7 * 86400.0
#: Likeness from which an entry is activated again instead of a new one made.
ALIKE = 0.85


def cosine(a: list[float] | None, b: list[float] | None) -> float:
    """Over the shorter length; 0 without values."""
    if not a or not b:
        return 0.0
    size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(y * y for y in b))
    return sum(x * y for x, y in zip(a, b)) / size if size > 1e-12 else 0.0


class Limiter:
    """Admits an event if fewer than `most` were admitted in the `seconds` before it; one exactly `seconds` back is out. What is rejected doesn't count."""

    entry = "at double"
    result = "admitted boolean"

    def __init__(self, most: int = MOST_REQUESTS, seconds: float = LIMIT_SECONDS):
        self.most, self.seconds = most, seconds

    def live(self, entries: list[tuple], now: float) -> list[tuple]:
        return [e for e in entries if now - e[0] < self.seconds]

    def expiry(self, entries: list[tuple]) -> float:
        return max(e[0] for e in entries) + self.seconds

    def step(self, entries: list[tuple], event_id: int, now: float, vector: list[float] | None) -> tuple[list[tuple], tuple]:
        held = self.live(entries, now)
        ok = len(held) < self.most
        return [*held, (now,)] if ok else held, (ok,)

    nothing = (False,)


class Attention:
    """Entries (last, id, activations, created, vector): the `most` activated last, each for `seconds` after that.

    An event whose vector is alike to entries activates the one most alike (ties: the one activated last, then the
    greater id); else it is a new entry, and the one activated longest ago goes if there are too many.
    """

    entry = "last double, id bigint, activations bigint, created double, vector array<double>"
    result = "entry bigint, activations bigint, held int, evicted array<bigint>"
    nothing = (None, None, None, None)

    def __init__(self, most: int = WINDOW_SIZE, seconds: float = WINDOW_SECONDS, alike: float = ALIKE):
        self.most, self.seconds, self.alike = most, seconds, alike

    def live(self, entries: list[tuple], now: float) -> list[tuple]:
        return [e for e in entries if e[0] >= now - self.seconds]

    def expiry(self, entries: list[tuple]) -> float:
        return max(e[0] for e in entries) + self.seconds

    def step(self, entries: list[tuple], event_id: int, now: float, vector: list[float] | None) -> tuple[list[tuple], tuple]:
        held = self.live(entries, now)
        best = max(((s, e[0], e[1]) for e in held if (s := round(cosine(vector, e[4]), 9)) >= self.alike), default=None)
        if best:
            held = [(now, e[1], e[2] + 1, e[3], e[4]) if e[1] == best[2] else e for e in held]
            return held, (best[2], next(e[2] for e in held if e[1] == best[2]), len(held), [])
        held = sorted([*held, (now, event_id, 1, now, vector)], key=lambda e: (-e[0], -e[1]))
        return held[: self.most], (event_id, 1, min(len(held), self.most), [e[1] for e in held[self.most :]])


class Fragments(Attention):
    """Entries (created, id, resurrections, created, vector): the `most` made last, each for `seconds`, for good once it has been resurrected.

    An event alike to an entry resurrects the one most alike, which keeps its place.
    """

    def __init__(self, most: int = MOST_FRAGMENTS, seconds: float = FRAGMENT_SECONDS, alike: float = ALIKE):
        super().__init__(most, seconds, alike)

    def live(self, entries: list[tuple], now: float) -> list[tuple]:
        return [e for e in entries if e[0] >= now - self.seconds or e[2] > 0]

    def expiry(self, entries: list[tuple]) -> float:
        return max((e[0] for e in entries if not e[2]), default=math.inf) + self.seconds

    def step(self, entries: list[tuple], event_id: int, now: float, vector: list[float] | None) -> tuple[list[tuple], tuple]:
        held = self.live(entries, now)
        best = max(((s, e[0], e[1]) for e in held if (s := round(cosine(vector, e[4]), 9)) >= self.alike), default=None)
        if best:
            held = [(*e[:2], e[2] + 1, *e[3:]) if e[1] == best[2] else e for e in held]
            return held, (best[2], next(e[2] for e in held if e[1] == best[2]), len(held), [])
        held = sorted([*held, (now, event_id, 0, now, vector)], key=lambda e: (-e[0], -e[1]))
        return held[: self.most], (event_id, 0, min(len(held), self.most), [e[1] for e in held[self.most :]])


def columns(events: DataFrame) -> DataFrame:
    """(key, id, at, vector) of events (key, id, ts, and vector if the machine needs one)."""
    vector = F.col("vector").cast("array<double>") if "vector" in events.columns else F.lit(None).cast("array<double>")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return events.select(F.col("key").cast("string").alias("key"), F.col("id").cast("bigint").alias("id"), at.alias("at"), vector.alias("vector"))


def run_batch(events: DataFrame, machine: Limiter | Attention) -> DataFrame:
    """(key, id, and the machine's result) for each event of a table."""
    schema = f"key string, id bigint, {machine.result}"
    kinds = {"boolean": pa.bool_(), "bigint": pa.int64(), "int": pa.int32(), "array<bigint>": pa.list_(pa.int64())}
    fields = [f.split() for f in machine.result.split(", ")]

    def run(batches):
        now, begun, entries = None, False, []
        for batch in batches:
            out = []
            for key, event_id, at, vector in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not begun or key != now:
                    now, begun, entries = key, True, []
                result = machine.nothing
                if at is not None:
                    entries, result = machine.step(entries, event_id, at, vector)
                out.append(result)
            made = [pa.array([r[i] for r in out], kinds[t]) for i, (_, t) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["key", "id", *[n for n, _ in fields]])

    return columns(events).repartition("key").sortWithinPartitions("key", "at", "id").mapInArrow(run, schema)


class Sessions(StatefulProcessor):
    """A machine's entries as list state; a timer at the last expiry frees them."""

    def __init__(self, machine: Limiter | Attention):
        self.machine = machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("entries", self.machine.entry)

    def keep(self, entries: list[tuple]) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if not entries:
            self.held.clear()
            return
        self.held.put(entries)
        if math.isfinite(until := self.machine.expiry(entries)):
            self.handle.registerTimer(int(until * 1000) + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        entries, out = [tuple(e) for e in self.held.get()] if self.held.exists() else [], []
        for r in pd.concat(list(rows)).sort_values(["at", "id"]).itertuples():
            result = self.machine.nothing
            if not pd.isna(r.at):
                entries, result = self.machine.step(entries, int(r.id), float(r.at), None if r.vector is None else [float(x) for x in r.vector])
            out.append((key[0], r.id, *result))
        self.keep(entries)
        yield pd.DataFrame(out, columns=["key", "id", *[f.split()[0] for f in self.machine.result.split(", ")]])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() / 1000
        self.keep(self.machine.live([tuple(e) for e in self.held.get()] if self.held.exists() else [], now))
        yield pd.DataFrame([], columns=["key", "id", *[f.split()[0] for f in self.machine.result.split(", ")]])

    def close(self) -> None:
        pass


def run_stream(events: DataFrame, machine: Limiter | Attention, late: str = "2 minutes") -> DataFrame:
    """As run_batch, over a stream of events (key, id, ts, vector); needs the RocksDB state store.

    Events of a micro-batch are put in order; of several micro-batches the later ones come after.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    vector = F.col("vector").cast("array<double>") if "vector" in events.columns else F.lit(None).cast("array<double>")
    rows = timed.select(F.col("key").cast("string").alias("key"), F.col("id").cast("bigint").alias("id"), "ts", (F.unix_micros("ts") / 1e6).alias("at"), vector.alias("vector"))
    return rows.groupBy("key").transformWithStateInPandas(Sessions(machine), f"key string, id bigint, {machine.result}", "Append", "EventTime")
