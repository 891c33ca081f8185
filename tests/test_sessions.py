import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from folioflow.streaming import sessions as S

AT = dt.datetime(2024, 1, 1)
SCHEMA = "key string, id bigint, ts timestamp, vector array<double>"


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Events of four keys, one of them with half of all, many at one time; as a table and as a stream of files in order."""
    rng = random.Random(9)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    rows, t = [], 0
    for i in range(600):
        t += rng.choice([0, 0, 1, 5, 30, 300])
        rows.append((rng.choice(["a", "a", "a", "b", "c", None]), i, AT + dt.timedelta(seconds=t), None if rng.random() < 0.05 else [x + rng.gauss(0, 0.15) for x in rng.choice(centres)]))
    folder = str(tmp_path_factory.mktemp("sessions"))
    for i in range(3):
        spark.createDataFrame(rows[i * 200 : i * 200 + 200], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return rows, lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


MACHINES = {"limiter": S.Limiter(4, 60.0), "attention": S.Attention(5, 900.0, 0.9), "fragments": S.Fragments(6, 600.0, 0.93)}


def got(df):
    return {(r["key"], r["id"]): tuple(r)[2:] for r in df.collect()}


def plain(rows, name):
    """The rules again, over whole histories instead of states."""
    out, seen = {}, {}
    for key, i, at, v in sorted(rows, key=lambda r: (r[2], r[1])):
        now = at.timestamp()
        past = seen.setdefault(key, [])
        if name == "limiter":
            out[key, i] = (sum(1 for t in past if now - t < 60) < 4,)
            past += [now] * out[key, i][0]
            continue
        most, seconds, alike = (5, 900, 0.9) if name == "attention" else (6, 600, 0.93)
        kept = [e for e in past if e["gone"] is None and (e["at"] >= now - seconds or (name == "fragments" and e["n"] > 0))]
        near = sorted((-round(S.cosine(v, e["v"]), 9), -e["at"], -e["id"]) for e in kept if round(S.cosine(v, e["v"]), 9) >= alike)
        if near:
            one = next(e for e in kept if e["id"] == -near[0][2])
            one["n"] += 1
            one["at"] = now if name == "attention" else one["at"]
            out[key, i] = (one["id"], one["n"], len(kept), [])
        else:
            new = {"id": i, "n": 1 if name == "attention" else 0, "at": now, "v": v, "gone": None}
            past.append(new)
            order = sorted([*kept, new], key=lambda e: (-e["at"], -e["id"]))
            for e in order[most:]:
                e["gone"] = now
            out[key, i] = (i, new["n"], min(len(order), most), [e["id"] for e in order[most:]])
        for e in past:  # what has expired once stays away
            if e["gone"] is None and e not in kept and e["id"] != i:
                e["gone"] = now
    return out


@pytest.mark.parametrize("name", MACHINES)
def test_table_and_stream_are_the_plain_rules(spark, events, name, tmp_path):
    rows, stream = events
    want = plain(rows, name)
    assert got(S.run_batch(spark.createDataFrame(rows, SCHEMA).repartition(7), MACHINES[name])) == want
    if name == "limiter":
        assert 0 < sum(not v[0] for v in want.values())
    else:
        assert any(v[3] for v in want.values()) and max(v[1] for v in want.values()) > 2
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = S.run_stream(stream(), MACHINES[name], "1 second").writeStream.format("memory").queryName(f"s_{name}").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        assert q.awaitTermination(240)
        assert got(spark.table(f"s_{name}")) == want
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_events_without_a_time_change_nothing(spark):
    rows = [("a", 1, AT, None), ("a", 2, None, None), ("a", 3, AT + dt.timedelta(seconds=59), None), ("a", 4, AT + dt.timedelta(seconds=60), None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {k[1]: v[0] for k, v in got(S.run_batch(df, S.Limiter(1))).items()} == {1: True, 2: False, 3: False, 4: True}
    assert {k[1]: v[0] for k, v in got(S.run_batch(df, S.Attention())).items()} == {1: 1, 2: None, 3: 3, 4: 4}
    assert S.run_batch(df.filter(F.lit(False)), S.Attention()).collect() == []
