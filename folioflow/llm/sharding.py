"""Sharding by a k-d tree over document metadata.

Units are groups of equal texts (a group too heavy for the tolerance is split by its documents'
hashes). Each metadata dimension is a 62-bit coordinate: the place of the value among all in order (of
a size, its logarithm), then the text's hash, then the document's, so any weight can be cut off
exactly. All nodes of a level split at once: each along the dimension in which it is widest, as a share
of the whole table's width, at the weighted median (or the share of shards on either side), found by
narrowing a histogram of 2**ROUND bins a round until the cut is within tolerance. A node whose bytes reach
the target is a leaf, a shard. Histograms, cuts and the tree are tables; the driver only counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.common import Scratch, join_groups, numbered, placed_in_order, text_or_empty

#: Coordinate bits: value, text hash, document hash; and those that one histogram round resolves.
VALUE, TEXT, DOC, ROUND = 20, 22, 20, 21
BITS = VALUE + TEXT + DOC
DIMENSIONS = ("source", "lang", "size")
#: Tables of nodes are broadcast up to so many rows (tens of MB).
MOST_NODES = 1 << 19


def top_bits(hashed: Column, bits: int) -> Column:
    return F.shiftrightunsigned(hashed, 64 - bits)


def places(rows: DataFrame, name: str, scratch: Scratch) -> DataFrame:
    """Rows (<name>, n, p_<name>): the place of each distinct value in order, scaled to VALUE bits, and its count."""
    values = placed_in_order(rows.groupBy(name).agg(F.count(F.lit(1)).alias("n")), name, scratch, "_at")
    values = scratch.save(values, f"places-{name}")
    return values.select(name, "n", F.expr(f"_at * {2**VALUE} div {max(1, values.count())}").alias(f"p_{name}"))


def coordinates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Per document a coordinate for each dimension; equal texts share the value and text parts."""
    key = ["text_hash", "text_crc32", "size"]
    # of a group of equal texts the least source and language count
    groups = scratch.save(docs.groupBy(*key).agg(F.min("lang").alias("_lang"), F.min("source").alias("_source"), F.count(F.lit(1)).alias("n")), "groups")
    joined = scratch.save(join_groups(docs, groups, key).withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("_source", "_lang")}), "grouped")
    placed = join_groups(join_groups(joined, places(joined, "_source", scratch), ["_source"]), places(joined, "_lang", scratch), ["_lang"])
    value = {"source": F.col("p__source"), "lang": F.col("p__lang"), "size": F.floor(F.log2(F.col("size").cast("double")) * 2 ** (VALUE - 6)).cast("bigint")}
    tail = F.shiftleft(top_bits(F.xxhash64("text_hash", F.lit(1)), TEXT), DOC).bitwiseOR(top_bits(F.xxhash64("doc_id", F.lit(2)), DOC))
    return placed.select(*docs.columns, *[F.shiftleft(value[d], TEXT + DOC).bitwiseOR(tail).alias(f"x_{d}") for d in DIMENSIONS])


def at_nodes(points: DataFrame, nodes: DataFrame, n_nodes: int, how: str = "inner") -> DataFrame:
    """points joined with the nodes' table: with few nodes it is broadcast, with many no node is hot."""
    return points.join(F.broadcast(nodes) if n_nodes <= MOST_NODES else nodes, "node", how)


def cuts(points: DataFrame, state: DataFrame, n_nodes: int, tolerance: float, scratch: Scratch) -> DataFrame:
    """state (node, dim, want) with cut: the coordinate below which a node's share of the weight lies."""
    x = F.expr("CASE dim " + " ".join(f"WHEN '{d}' THEN x_{d}" for d in DIMENSIONS) + " END")
    state = state.select("*", F.lit(0).cast("bigint").alias("low"), F.lit(BITS).alias("bits"), F.lit(0).cast("bigint").alias("below"), F.lit(None).cast("bigint").alias("cut"))
    while True:
        here = at_nodes(points, state.filter("cut is null"), n_nodes).withColumn("x", x).filter("x >= low AND shiftright(x - low, bits) = 0")
        bins = here.withColumn("shift", F.expr(f"greatest(bits - {ROUND}, 0)")).groupBy("node", "want", "low", "below", "shift", F.expr("shiftright(x - low, shift)").alias("bin")).agg(F.sum("size").alias("w"))
        run = bins.withColumn("run", F.col("below") + F.sum("w").over(Window.partitionBy("node").orderBy("bin")))  # at most 2**ROUND rows a node
        hit = run.filter("run >= want").groupBy("node").agg(F.min(F.struct("bin", "run", "w", "want", "low", "shift")).alias("h")).select(F.col("node").alias("_node"), "h.*")
        start, end = "low + shiftleft(bin, shift)", "low + shiftleft(bin + 1, shift)"
        # a bin's edge that is near enough is the cut: groups inside it stay whole
        cut = f"CASE WHEN abs(run - w - want) <= {tolerance} OR (shift = 0 AND want - (run - w) < run - want) THEN {start} WHEN run - want <= {tolerance} OR shift = 0 THEN {end} END"
        hit = hit.select("_node", F.expr(start).alias("_low"), F.col("shift").alias("_bits"), F.expr("run - w").alias("_below"), F.expr(cut).alias("_cut"))
        more = state.join(hit, state["node"] == hit["_node"], "left")
        later = [F.coalesce(f"_{c}", c).alias(c) for c in ("low", "bits", "below", "cut")]
        state = scratch.save(more.select("node", "shares", "first", "dim", "want", *later), "cuts")
        if state.filter("cut is null").isEmpty():
            return state


def kd_shards(docs: DataFrame, scratch: Scratch, n_shards: int | None = None, target_bytes: int | None = None, slack: float = 0.001) -> DataFrame:
    """Assign rows (doc_id, size, text_hash, text_crc32, lang, source) to shards; adds shard.

    Leaves are numbered from 0 in tree order. With target_bytes the number of shards is the total
    over the target, rounded up. A cut may be off by `slack` of a shard's bytes.
    """
    total = docs.agg(F.sum("size")).first()[0]
    k = n_shards or max(1, math.ceil((total or 0) / target_bytes))
    if not total or k == 1:
        return docs.withColumn("shard", F.lit(0))
    points = scratch.save(coordinates(docs, scratch).withColumn("node", F.lit(0).cast("bigint")), "points", keep=True)
    whole = points.agg(*[F.greatest(F.max(f"x_{d}") - F.min(f"x_{d}"), F.lit(1)).alias(d) for d in DIMENSIONS]).first()
    width = {d: (F.max(f"x_{d}") - F.min(f"x_{d}")) / whole[d] for d in DIMENSIONS}
    nodes = docs.sparkSession.createDataFrame([(0, k, 0)], "node bigint, shares int, first int")
    n_nodes = 1
    while n_nodes < k:
        spread = points.groupBy("node").agg(F.sum("size").alias("w"), *[width[d].alias(d) for d in DIMENSIONS])
        widest = F.greatest(*DIMENSIONS)
        dim = F.when(F.col("source") == widest, "source").when(F.col("lang") == widest, "lang").otherwise("size")
        live = nodes.filter("shares > 1").join(spread, "node").select("node", "shares", "first", dim.alias("dim"), F.expr("w * (shares div 2) div shares").alias("want"))
        state = cuts(points, scratch.save(live, "live"), n_nodes, slack * total / k, scratch)
        split = at_nodes(points, state.select("node", "dim", "cut"), n_nodes, "left")
        side = " ".join(f"WHEN dim = '{d}' AND x_{d} < cut THEN 2 * node + 1" for d in DIMENSIONS)
        # children: 2n + 1 and 2n + 2; a leaf goes on as a left child of all its shards
        points = scratch.save(split.withColumn("node", F.expr(f"CASE WHEN cut IS NULL THEN 2 * node + 1 {side} ELSE 2 * node + 2 END")).select(points.columns), "points", keep=True)
        lower = state.selectExpr("2 * node + 1 AS node", "shares div 2 AS shares", "first")
        upper = state.selectExpr("2 * node + 2 AS node", "shares - shares div 2 AS shares", "first + shares div 2 AS first")
        rest = nodes.filter("shares = 1").selectExpr("2 * node + 1 AS node", "shares", "first")
        nodes = scratch.save(lower.union(upper).union(rest).select("node", F.col("shares").cast("int"), F.col("first").cast("int")), "nodes", keep=True)
        n_nodes = nodes.count()
    return at_nodes(points, nodes.select("node", F.col("first").alias("shard")), n_nodes).select(*docs.columns, "shard")


def shard_documents(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs.

    The law is `bytes`: shards' sizes are near equal. Size is the text's UTF-8 bytes (none for a null
    text) plus 1. Equal texts share a shard unless a cut has to go through their group. slot numbers
    a shard's rows from 0. Null ids, sources and languages are values like others; repeated rows are
    placed each; an empty table gives no rows; other columns are left out.
    """
    with Scratch(docs.sparkSession, "sharding") as scratch:
        text = text_or_empty(text_col)
        column = lambda c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")
        rows = docs.select(
            F.col(id_col).cast("bigint").alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.xxhash64(text).alias("text_hash"), F.crc32(text.cast("binary")).alias("text_crc32"),
            column("lang").alias("lang"), column("source").alias("source"),
        )
        rows = scratch.save(rows, "rows", keep=True)
        placed = scratch.save(kd_shards(rows, scratch, n_shards, target_bytes).select("doc_id", "size", "text_crc32", "text_hash", "shard"), "placed", keep=True)
        out = numbered(placed, ["shard"], ["doc_id", "text_hash"], "slot", placed.count())
        return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), n_shards=16)
