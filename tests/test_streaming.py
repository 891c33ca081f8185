import datetime as dt

import pytest
from pyspark.sql import functions as F

from folioflow.streaming import stateful as S

SF = "/root/testdata/sf0.001"


def finish(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert query.awaitTermination(120)


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """The events as a stream of four files, in order."""
    folder = str(tmp_path_factory.mktemp("events"))
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for i in range(4):
        e.filter(f"event_id % 1000 div 250 = {i}").coalesce(1).write.mode("append").parquet(folder)
    return e, lambda: spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(folder)


def test_tumbling_counts_equal_the_batch(spark, events):
    batch, stream = events
    finish(S.tumbling_counts(stream(), "ts", ["user_id"], late="400 days"), "tumbling", "complete")
    want = batch.groupBy(F.window("ts", "1 minute")["start"].alias("start"), "user_id").count()
    assert sorted(map(tuple, spark.table("tumbling").collect())) == sorted(map(tuple, want.collect()))


def test_idle_sessions_and_first_within(spark, events):
    batch, stream = events
    finish(S.idle_sessions(stream(), "ts", ["user_id"], "1 hour", "400 days"), "idle", "complete")
    want = batch.groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).count()
    assert spark.table("idle").count() == want.count()
    finish(S.first_within(stream(), "ts", ["user_id"], "400 days"), "firsts")
    assert spark.table("firsts").count() == batch.select("user_id").distinct().count()


def test_cooldown_equals_its_batch_twin(spark, events):
    batch, stream = events
    keyed = lambda d: d.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), "ts")
    finish(S.cooldown(keyed(stream()), 86400.0), "cooled", "append")
    got = sorted(map(tuple, spark.table("cooled").collect()))
    twin = sorted(map(tuple, S.cooldown_batch(keyed(batch), 86400.0).collect()))
    assert len(got) == len(twin) and {x[:2] for x in got} == {x[:2] for x in twin}
    last, want = {}, set()
    for key, at, i in sorted((str(r["user_id"]), r["ts"], r["event_id"]) for r in batch.collect()):
        ok = key not in last or (at - last[key]).total_seconds() >= 86400.0
        last[key] = at if ok else last[key]
        want.add((key, i, ok))
    assert set(twin) == want


def test_cooldown_counts_from_the_last_accepted(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("a", i, at + dt.timedelta(seconds=s)) for i, s in enumerate((0, 200, 310, 400, 620))]
    df = spark.createDataFrame(rows, "key string, id bigint, ts timestamp")
    got = {r["id"]: r["accepted"] for r in S.cooldown_batch(df).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False, 4: True}
    odd = spark.createDataFrame([("a", 9, None), (None, 10, None), (None, 11, at), (None, 12, at)], df.schema)
    got = {r["id"]: r["accepted"] for r in S.cooldown_batch(df.union(odd)).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False, 4: True, 9: False, 10: False, 11: True, 12: False}


def test_micro_batches_are_written_once(spark, events, tmp_path):
    batch, stream = events
    write = S.upsert_batches(f"{tmp_path}/out", ["event_id"])

    def twice(df, n):
        write(df, n)
        write(df, n)

    q = stream().writeStream.foreachBatch(twice).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == batch.count()


def test_bounded_memory_keeps_the_latest(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        at = dt.datetime(2024, 1, 1)
        rows = [("s", f"e{i % 4}", at + dt.timedelta(seconds=i)) for i in range(8)]
        spark.createDataFrame(rows, "session string, entry string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("session string, entry string, ts timestamp").parquet(f"{tmp_path}/in")
        finish(S.bounded_memory(stream, most=3, seconds=100), "memory_rows")
        got = [tuple(r) for r in spark.table("memory_rows").collect()]
        assert len(got) == 8 and max(r[3] for r in got) == 3 and got[0][2] == 1
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
