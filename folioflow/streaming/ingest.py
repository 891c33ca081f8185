"""Ingest as a stream of files: each chunk once, whatever is sent or run again; hooks on what came in; load by micro-batch."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

# Fixed value: tasks in the queue at which new ones are refused.
MOST_QUEUED = 5000


def there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def chunk_hash(*columns: str) -> Column:
    """A digest of the columns as JSON, so that no two lists of values run together."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def write_new(target: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: of a micro-batch the rows whose keys no other one has stored, each once, under its number.

    A retried batch replaces what it had written, so a job that is killed at any point and started again stores no row twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, new = batch.sparkSession, batch.dropDuplicates(keys)
        if there(spark, target):
            done = spark.read.parquet(target).filter(F.col("batch") != number).select(*keys)
            new = new.join(done, keys, "left_anti")
        new.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    return write


def ingest(chunks: DataFrame, target: str, checkpoint: str, keys: list[str], write: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Store what is there of a stream of chunks and read the table back; run again, it goes on after the last finished micro-batch."""
    run = chunks.writeStream.foreachBatch(write or write_new(target, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return chunks.sparkSession.read.parquet(target)


def with_hooks(hooks: dict[str, Callable[[DataFrame], DataFrame]], root: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: every hook's rows of a micro-batch go to a table of its own, under the batch's number.

    A hook that fails leaves the others' rows: its error is kept as its row in the table `errors`.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            for name, hook in hooks.items():
                try:
                    hook(batch).write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")
                except Exception as e:  # noqa: BLE001 - a hook is foreign code
                    spark.createDataFrame([(name, number, type(e).__name__)], "hook string, batch bigint, error string").write.mode("overwrite").parquet(f"{root}/errors/hook={name}/number={number}")
        finally:
            batch.unpersist()

    return write


def hook_counts(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """(hook, rows): what each hook has stored so far; 0 for one that never ran."""
    held = [spark.read.parquet(f"{root}/{n}").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("hook"), "rows") if there(spark, f"{root}/{n}") else spark.createDataFrame([(n, 0)], "hook string, rows bigint") for n in names]
    out = held[0]
    for one in held[1:]:
        out = out.unionByName(one)
    return out


class Load(StreamingQueryListener):
    """Keeps a row of observed metrics for each micro-batch of the queries that report under `name`."""

    def __init__(self, name: str):
        self.name, self.rows, self.ended = name, {}, {}

    def onQueryStarted(self, event) -> None:
        self.ended.setdefault(str(event.runId), threading.Event())

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.name)
        if seen is not None:
            self.rows[str(event.progress.runId), event.progress.batchId] = seen.asDict()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.setdefault(str(event.runId), threading.Event()).set()


def load_by_batch(stream: DataFrame, status: str, states: list[str], checkpoint: str, queued: str, most: int = MOST_QUEUED) -> DataFrame:
    """(batch, seen, a count of each state, depth, utilization, refused): the queue's load after each micro-batch.

    What arrives is limited by the source (maxFilesPerTrigger). Counts are observed while the rows pass through, so nothing is read
    twice; a row a micro-batch reaches the driver. depth adds up the tasks in state `queued`; at `most` new ones are refused.
    """
    spark = stream.sparkSession
    listener = Load("load")
    spark.streams.addListener(listener)
    try:
        counted = stream.observe("load", F.count(F.lit(1)).alias("seen"), *[F.count_if(F.col(status) == s).alias(s) for s in states])
        run = counted.writeStream.format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        run.awaitTermination()
        listener.ended.setdefault(str(run.runId), threading.Event()).wait(60)  # its progress is reported before its end
        rows = [{"batch": b, **r} for (of, b), r in sorted(listener.rows.items(), key=lambda x: x[0][1]) if of == str(run.runId)]
    finally:
        spark.streams.removeListener(listener)
    schema = "batch bigint, seen bigint, " + ", ".join(f"`{s}` bigint" for s in states)
    depth, out = 0, []
    for r in rows:
        depth += r[queued]
        out.append((r["batch"], r["seen"], *[r[s] for s in states], depth, depth / most, depth >= most))
    return spark.createDataFrame(out, schema + ", depth bigint, utilization double, refused boolean")
