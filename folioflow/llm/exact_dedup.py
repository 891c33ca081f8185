"""Exact dedup by an extendible-hash index on shared files (DataFrame functions only).

A text's key is its 64-bit hash; a bucket holds the keys that share their leading `local_depth` bits.
The directory starts at the depth that the number of keys asks for; in every round the buckets that
hold more than `capacity` keys split in two and the directory doubles, until none is overfull (only
the split buckets' keys are counted again). A slot of the directory lists the buckets under it.

Owner tasks merge equal texts by comparing their bytes (grouping by the text itself, pre-aggregated
before the shuffle, so a group of copies of any size sends one row per task), number the different
texts of one key as a chain, and write the index to shared files, sorted by bucket and key. Every
document looks its entry up there by slot and key. Where the chain has one text, that is the
document's own, as it was put in; in longer chains the bytes decide.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.common import Scratch, join_groups, text_or_empty

KEY_BITS = 64


def prefix(key: Column, depth: int) -> Column:
    """The leading `depth` bits of a 64-bit key as a number."""
    return F.shiftrightunsigned(key, KEY_BITS - depth) if depth else F.lit(0).cast("bigint")


def directory(keys: DataFrame, scratch: Scratch, capacity: int) -> tuple[DataFrame, int]:
    """Rows (slot, buckets) for a table of distinct `key`s, and the bits that make a slot.

    buckets are structs (local_depth, start, keys), start being the bucket's leading bits. Keys that
    share all 64 bits are one key, so at the last depth no bucket is overfull.
    """
    first = min(KEY_BITS, max(0, math.ceil(math.log2(max(1, keys.count()) / capacity))))
    depth, open_, done = first, keys, []
    while True:
        counted = scratch.save(open_.groupBy(prefix(F.col("key"), depth).alias("start")).agg(F.count(F.lit(1)).alias("keys")), f"depth-{depth}")
        fits = F.col("keys") <= (capacity if depth < KEY_BITS else 2**62)
        slot = F.expr(f"shiftrightunsigned(start, {depth - first})")
        done.append(counted.filter(fits).select(slot.alias("slot"), F.struct(F.lit(depth).alias("local_depth"), "start", "keys").alias("b")))
        overfull = counted.filter(~fits).select("start")
        if overfull.isEmpty():
            break
        open_ = open_.join(overfull, prefix(F.col("key"), depth) == F.col("start"), "left_semi")
        depth += 1
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    return scratch.save(rows.groupBy("slot").agg(F.collect_list("b").alias("buckets")), "directory"), first


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(F.xxhash64(text).alias("key"), F.col(id_col).alias("_id"), text.alias("_text"))


def merged(rows: DataFrame) -> DataFrame:
    """A row for each distinct text, told apart by its bytes."""
    return rows.groupBy("key", "_text").agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def build_index(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", capacity: int = 50_000) -> tuple[DataFrame, int]:
    """Write the index: a row per distinct text, with the entry that stays and the number of rows; and a slot's bits.

    Columns: slot, bucket, local_depth, key, chain (place among the texts of one key, from 0),
    chain_length, text_sha256, n_bytes, keep_id, group_size. Null texts count as empty ones. Null ids
    count in group_size and never stay unless all of a group's ids are null.
    """
    texts = merged(keyed(docs, id_col, text_col))
    entries = texts.select("key", F.sha2("_text", 256).alias("text_sha256"), F.octet_length("_text").cast("bigint").alias("n_bytes"), "keep_id", "group_size")
    entries = scratch.save(entries, "entries")
    held, bits = directory(entries.select("key").distinct(), scratch, capacity)
    placed = entries.withColumn("slot", prefix(F.col("key"), bits)).join(held, "slot")
    mine = F.filter("buckets", lambda b: F.when(b["local_depth"] == 0, True).otherwise(F.call_function("shiftrightunsigned", F.col("key"), KEY_BITS - b["local_depth"]) == b["start"]))[0]
    placed = placed.withColumn("_b", mine).withColumn("local_depth", F.col("_b.local_depth"))
    # a bucket's name: its first key
    placed = placed.withColumn("bucket", F.when(F.col("local_depth") == 0, F.lit(0)).otherwise(F.call_function("shiftleft", F.col("_b.start"), KEY_BITS - F.col("local_depth"))))
    owned = placed.repartitionByRange("slot", "key")
    same = Window.partitionBy("slot", "key")
    owned = owned.withColumn("chain", F.row_number().over(same.orderBy("text_sha256", "n_bytes", "keep_id")) - 1).withColumn("chain_length", F.count(F.lit(1)).over(same))
    owned = owned.select("slot", "bucket", "local_depth", "key", "chain", "chain_length", "text_sha256", "n_bytes", "keep_id", "group_size")
    return scratch.save(owned.sortWithinPartitions("bucket", "key", "chain"), "index", keep=True), bits


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 50_000) -> DataFrame:
    """Each row of docs with keep_id, group_size, kept, text_sha256, bucket and chain.

    Texts are equal when identical, byte for byte, after no change; null counts as empty. Of equal
    texts the row with the largest id stays; rows that repeat that id all count as kept (they can't
    be told apart), and null ids stay only in groups without another. An empty table gives none.
    Columns of docs whose names clash with the added ones are replaced.
    """
    added = ["keep_id", "group_size", "kept", "text_sha256", "bucket", "chain"]
    with Scratch(docs.sparkSession, "exact-dedup") as scratch:
        index, bits = build_index(docs, scratch, id_col, text_col, capacity)
        own = [c for c in docs.columns if c not in added]
        key = F.xxhash64(text_or_empty(text_col))
        rows = docs.select(*own, prefix(key, bits).alias("_slot"), key.alias("_key"))
        found = [F.col("slot").alias("_slot"), F.col("key").alias("_key"), "keep_id", "group_size", "text_sha256", "bucket", "chain"]
        single = index.filter("chain_length = 1").select(*found, F.col("group_size").alias("n"))
        out = join_groups(rows, single, ["_slot", "_key"])
        chained = index.filter("chain_length > 1")
        if not chained.isEmpty():  # two texts of one key: their bytes, not a digest, lead to the entry
            several = chained.select(F.col("key").alias("_k")).distinct()
            texts = merged(keyed(docs, id_col, text_col).join(several, F.col("key") == F.col("_k"), "left_semi"))
            place = F.row_number().over(Window.partitionBy("key").orderBy(F.sha2("_text", 256), F.octet_length("_text"), "keep_id")) - 1
            texts = texts.select("key", F.col("_text"), place.alias("chain"))
            entries = chained.select(*found).join(texts.select(F.col("key").alias("_k"), F.col("chain").alias("_c"), F.col("_text").alias("_t")), (F.col("_key") == F.col("_k")) & (F.col("chain") == F.col("_c"))).drop("_k", "_c", "_slot").withColumnRenamed("_key", "_k")
            more = rows.join(entries, (F.col("_key") == F.col("_k")) & (text_or_empty(text_col) == F.col("_t"))).drop("_k", "_t")
            out = out.unionByName(more)
        kept = F.col(id_col).eqNullSafe(F.col("keep_id"))
        return out.select(*own, "keep_id", "group_size", kept.alias("kept"), "text_sha256", "bucket", "chain")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
