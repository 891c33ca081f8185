"""Structured Streaming forms of the stateful behaviours; each has a batch twin among the queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupStateTimeout


def tumbling_counts(events: DataFrame, at: str, keys: list[str], width: str = "1 minute", late: str = "2 minutes", start: str | None = None) -> DataFrame:
    """Counts per window and key; `start` shifts the windows, as for days of another time zone."""
    window = F.window(at, width, width, start) if start else F.window(at, width)
    return events.withWatermark(at, late).groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sliding_counts(events: DataFrame, at: str, keys: list[str], width: str = "60 seconds", step: str = "10 seconds", late: str = "2 minutes") -> DataFrame:
    """Counts per sliding window: the limiter's load, off by one step at most."""
    return events.withWatermark(at, late).groupBy(F.window(at, width, step).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def idle_sessions(events: DataFrame, at: str, keys: list[str], gap: str = "120 seconds", late: str = "2 minutes") -> DataFrame:
    """Sessions that end after a gap without events."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def first_within(events: DataFrame, at: str, keys: list[str], horizon: str = "300 seconds") -> DataFrame:
    """The first event of a key within the horizon; repeats in it go."""
    return events.withWatermark(at, horizon).dropDuplicatesWithinWatermark(keys)


class BoundedMemory(StatefulProcessor):
    """Per session the latest `most` entries, each gone `seconds` after its last activation.

    An entry that comes again is activated once more, in place. Rows in: (session, entry, ts); out for
    each: (session, entry, activations, held), where held is the number of entries kept.
    """

    def __init__(self, most: int = 20, seconds: float = 3600.0):
        self.most, self.seconds = most, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "entry string", "activations bigint, last double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for r in pd.concat(list(rows)).sort_values("ts").itertuples():
            now = pd.Timestamp(r.ts).timestamp()
            for (entry,), (_, last) in list(self.held.iterator()):
                if last < now - self.seconds:
                    self.held.removeKey((entry,))
            before = self.held.getValue((r.entry,)) if self.held.containsKey((r.entry,)) else (0, 0.0)
            self.held.updateValue((r.entry,), (int(before[0]) + 1, now))
            entries = sorted((v[1], k[0]) for k, v in self.held.iterator())
            for _, old in entries[: max(0, len(entries) - self.most)]:
                self.held.removeKey((old,))
            out.append((key[0], r.entry, int(before[0]) + 1, min(len(entries), self.most)))
        yield pd.DataFrame(out, columns=["session", "entry", "activations", "held"])

    def close(self) -> None:
        pass


def bounded_memory(events: DataFrame, most: int = 20, seconds: float = 3600.0) -> DataFrame:
    """events (session, entry, ts); needs the RocksDB state store."""
    return events.groupBy("session").transformWithStateInPandas(BoundedMemory(most, seconds), "session string, entry string, activations bigint, held int", "Append", "none")


def accepted_after(seconds: float):
    """Cooldown: an attempt counts if the last accepted one is at least `seconds` back; one without a time never does."""

    def step(key, frames, state):
        last, out = (state.get[0] if state.exists else float("-inf")), []
        for r in pd.concat(list(frames)).sort_values(["ts", "id"]).itertuples():
            now = float("nan") if pd.isna(r.ts) else pd.Timestamp(r.ts).timestamp()
            ok = now - last >= seconds
            last = now if ok else last
            out.append((key[0], r.id, ok))
        state.update((last,))
        yield pd.DataFrame(out, columns=["key", "id", "accepted"])

    return step


def cooldown(events: DataFrame, seconds: float = 300.0) -> DataFrame:
    """events (key, id, ts) to (key, id, accepted), exactly, in event order within each batch."""
    return events.groupBy("key").applyInPandasWithState(accepted_after(seconds), "key string, id bigint, accepted boolean", "last double", "append", GroupStateTimeout.NoTimeout)


def cooldown_batch(events: DataFrame, seconds: float = 300.0) -> DataFrame:
    """The batch twin: one pass over each key's rows in order, with the last accepted time as all its state.

    A key's rows stand in one partition, sorted, and pass through as batches: none is gathered whole. Rows without a
    time are not accepted and change nothing; rows without a key are one key's.
    """

    def run(batches):
        key, last = object(), None
        for batch in batches:
            ok = []
            for k, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key:
                    key, last = k, None
                accepted = at is not None and (last is None or at - last >= seconds * 1e6)
                last = at if accepted else last
                ok.append(accepted)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ok, pa.bool_())], names=["key", "id", "accepted"])

    rows = events.select(F.col("key").cast("string").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("id").cast("bigint").alias("id"))
    return rows.repartition("key").sortWithinPartitions("key", "at", "id").mapInArrow(run, "key string, id bigint, accepted boolean")


def upsert_batches(path: str, keys: list[str]):
    """foreachBatch function: writes each micro-batch once, under its number, so a retry replaces it."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(keys).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
