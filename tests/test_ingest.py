from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioflow.sources import tables as T
from folioflow.streaming import ingest as I


def arrive(spark, path, ids):
    spark.createDataFrame([(i, f"text {i}") for i in ids], "id bigint, text string").coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema("id bigint, text string").option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("when", ["before", "after"])
def test_a_killed_ingest_goes_on_and_stores_each_chunk_once(spark, tmp_path, when):
    at, calls = str(tmp_path), []
    for ids in ([1, 2, 3], [3, 4], [5, 1], [6, 6]):
        arrive(spark, f"{at}/in", ids)
    store = I.write_new(f"{at}/out", ["id"])

    def dies(batch, number):
        calls.append(number)
        if number == 2 and when == "before":
            raise RuntimeError("killed")
        store(batch, number)
        if number == 2:
            raise RuntimeError("killed")  # stored, but not yet committed

    with pytest.raises(Exception, match="killed"):
        I.ingest(stream(spark, f"{at}/in"), f"{at}/out", f"{at}/c", ["id"], dies)
    arrive(spark, f"{at}/in", [7, 2])
    got = I.ingest(stream(spark, f"{at}/in"), f"{at}/out", f"{at}/c", ["id"])
    assert calls == [0, 1, 2]
    assert sorted((r["id"], r["batch"]) for r in got.collect()) == [(1, 0), (2, 0), (3, 0), (4, 1), (5, 2), (6, 3), (7, 4)]


def test_a_hook_that_fails_leaves_the_others(spark, tmp_path):
    at = str(tmp_path)
    arrive(spark, f"{at}/in", [1, 2])
    arrive(spark, f"{at}/in", [3])

    def broken(batch):
        raise ValueError("no")

    write = I.with_hooks({"all": lambda b: b, "broken": broken, "odd": lambda b: b.filter("id % 2 = 1")}, f"{at}/out")

    def twice(batch, number):
        write(batch, number)
        write(batch, number)

    run = stream(spark, f"{at}/in").writeStream.foreachBatch(twice).option("checkpointLocation", f"{at}/c").trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    assert {r["hook"]: r["rows"] for r in I.hook_counts(spark, f"{at}/out", ["all", "broken", "odd"]).collect()} == {"all": 3, "broken": 0, "odd": 2}
    assert sorted(r["error"] for r in spark.read.parquet(f"{at}/out/errors").collect()) == ["ValueError"] * 2


def test_load_is_observed_by_micro_batch(spark, tmp_path):
    at = str(tmp_path)
    for ids in ([1, 2, 3], [4], [5, 6]):
        arrive(spark, f"{at}/in", ids)
    marked = stream(spark, f"{at}/in").withColumn("status", F.when(F.col("id") % 3 == 0, "done").otherwise("queued"))
    got = I.load_by_batch(marked, "status", ["queued", "done"], f"{at}/c", "queued", 4).collect()
    assert [tuple(r) for r in got] == [(0, 3, 2, 1, 2, 0.5, False), (1, 1, 1, 0, 3, 0.75, False), (2, 2, 1, 1, 4, 1.0, True)]


def test_rebuild_touches_one_tenant_only(spark, tmp_path):
    at = f"{tmp_path}/t"
    T.rebuild(spark.range(30).selectExpr("id", "id % 3 AS tenant"), "tenant", at)
    before = {p: p.stat().st_mtime_ns for p in Path(at).rglob("*.parquet")}
    got = T.rebuild(spark.range(100, 102).selectExpr("id", "1L AS tenant"), "tenant", at)
    assert sorted(r["id"] for r in got.collect()) == sorted([i for i in range(30) if i % 3 != 1] + [100, 101])
    after = {p: p.stat().st_mtime_ns for p in Path(at).rglob("*.parquet")}
    assert {p: m for p, m in before.items() if "tenant=1" not in str(p)} == {p: m for p, m in after.items() if "tenant=1" not in str(p)}
    T.clear(spark, "tenant", 2, at)
    assert spark.read.parquet(at).filter("tenant = 2").count() == 0


def test_sinks_have_a_folder_a_call(spark):
    from folioflow.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    for name in ("snk3_bulk_rows", "snk8_full_refresh", "ups2_replace_staged", "ups10_rebuild"):
        first = QUERIES[name](spark, sf)
        QUERIES[name](spark, sf)
        assert first.count() > 0
