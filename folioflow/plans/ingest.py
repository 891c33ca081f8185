"""Streams of files that are run for what is there: chunks stored once, hooks, load."""

from pyspark.sql import functions as F

from folioflow.plans.registry import query
from folioflow.sources import tables as T
from folioflow.streaming import ingest as I


def files(df, path, parts, number):
    """The rows of each part as a file of its own, one after the other."""
    for i in range(parts):
        df.filter(number == i).coalesce(1).write.mode("append").parquet(path)


@query("stm8_resume", """SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"source":"' || source || '"}') AS chunk_hash FROM documents""")
def stm8(t):
    """Documents sent in four files, of which two are there at first; the second run goes on, and finds a fifth file with documents sent before."""
    root = T.fresh_path(t.spark, "ingest")
    rows = t.documents.select("doc_id", "source").withColumn("chunk_hash", I.chunk_hash("doc_id", "source"))
    arrivals = lambda: t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    files(rows.filter("doc_id % 2 = 0"), f"{root}/in", 2, F.floor(F.col("doc_id") / 2) % 2)
    I.ingest(arrivals(), f"{root}/out", f"{root}/checkpoint", ["doc_id", "chunk_hash"])
    files(rows.filter("doc_id % 2 = 1"), f"{root}/in", 2, F.floor(F.col("doc_id") / 2) % 2)
    rows.filter("doc_id % 3 = 0").coalesce(1).write.mode("append").parquet(f"{root}/in")
    return I.ingest(arrivals(), f"{root}/out", f"{root}/checkpoint", ["doc_id", "chunk_hash"]).select("doc_id", "chunk_hash")


HOOKS = {
    "attention": lambda b: b.filter("role = 'assistant'").select("conv_id", "turn"),
    "fragments": lambda b: b.filter("role = 'user' AND text LIKE '%,%'").select("conv_id", "turn"),
    "salience": lambda b: b.select("conv_id", "turn", F.least(F.lit(1.0), F.length("text") / 1000).alias("score")).filter("score >= 0.4"),
}


@query("udf6_hooks", "SELECT 'attention' AS hook, count(*) FILTER (role = 'assistant') AS rows FROM conversations UNION ALL SELECT 'fragments', count(*) FILTER (role = 'user' AND text LIKE '%,%') FROM conversations UNION ALL SELECT 'salience', count(*) FILTER (length(text) / 1000 >= 0.4) FROM conversations")
def udf6(t):
    """Turns as results of a chain, a stream of three files; each hook stores its rows of every micro-batch."""
    root = T.fresh_path(t.spark, "hooks")
    files(t.conversations, f"{root}/in", 3, F.col("conv_id") % 3)
    stream = t.spark.readStream.schema(t.conversations.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    run = stream.writeStream.foreachBatch(I.with_hooks(HOOKS, f"{root}/out")).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return I.hook_counts(t.spark, f"{root}/out", list(HOOKS))


@query("stm10_queue_depth", "SELECT *, round(depth / 5000, 9) AS utilization, depth >= 5000 AS refused FROM (SELECT batch, seen, O, F, P, CAST(sum(O) OVER (ORDER BY batch) AS BIGINT) AS depth FROM (SELECT o_orderkey % 4 AS batch, count(*) AS seen, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1))")
def stm10(t):
    """Orders as tasks that come in four files, a file a micro-batch; open ones are queued."""
    root = T.fresh_path(t.spark, "queue")
    orders = t.orders.select("o_orderkey", "o_orderstatus")
    files(orders, f"{root}/in", 4, F.col("o_orderkey") % 4)
    stream = t.spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    return I.load_by_batch(stream, "o_orderstatus", ["O", "F", "P"], f"{root}/checkpoint", "O").withColumn("utilization", F.round("utilization", 9))
