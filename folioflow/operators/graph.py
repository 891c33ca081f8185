"""Knowledge-graph operators over edge tables (source, target)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.sources import tables as T

# The order in which concepts are taught.
TEACHING_ORDER = ("definition", "explanation", "example", "application", "summary", "problem")
# Weights of the essential types.
ESSENTIAL = {"definition": 0.4, "example": 0.3, "application": 0.3}


def place(kind: Column) -> Column:
    """Place in the teaching order, -1 for other types."""
    return F.array_position(F.array(*map(F.lit, TEACHING_ORDER)), kind).cast("int") - 1


def progresses(a: Column, b: Column) -> Column:
    return (place(a) < 0) | (place(b) < 0) | (place(b) >= place(a))


def paths(nodes: DataFrame, edges: DataFrame, start: str = "definition", depth: int = 5) -> DataFrame:
    """All paths of 2 to `depth` nodes from start nodes along edges that keep the teaching order.

    nodes (id, kind), edges (source, target). A node is on a path once, so cycles end. One join a step.
    """
    kinds = edges.join(nodes.select(F.col("id").alias("source"), F.col("kind").alias("ka")), "source").join(nodes.select(F.col("id").alias("target"), F.col("kind").alias("kb")), "target")
    steps = kinds.filter(progresses(F.col("ka"), F.col("kb"))).select("source", "target").distinct()
    now = nodes.filter(F.col("kind") == start).select(F.array("id").alias("path"), F.col("id").alias("end"))
    found = None
    for _ in range(depth - 1):
        now = now.join(steps, F.col("end") == F.col("source")).filter(~F.array_contains("path", F.col("target")))
        now = now.select(F.concat("path", F.array("target")).alias("path"), F.col("target").alias("end"))
        found = now if found is None else found.unionByName(now)
    return found.select("path")


def relation_strength(citations: DataFrame, shared: DataFrame) -> DataFrame:
    """(a, b, strength): a citation 0.6, each further one 0.1 more up to 1; shared terms 0.05 each, alone from 0.3."""
    c = citations.groupBy("a", "b").agg(F.least(F.lit(1.0), 0.6 + 0.1 * (F.count(F.lit(1)) - 1)).alias("c"))
    s = shared.select("a", "b", F.col("shared").alias("n"))
    bonus = 0.05 * F.coalesce("n", F.lit(0))
    strength = F.when(F.col("c").isNotNull(), F.least(F.lit(1.0), F.col("c") + bonus)).otherwise(0.3 + bonus)
    return c.join(s, ["a", "b"], "full").select("a", "b", strength.alias("strength"))


def completeness(nodes: DataFrame, *more: Column) -> DataFrame:
    """One row: how complete the concepts' teaching is, and the essential types without any."""
    n = {k: F.count_if(F.col("kind") == k) for k in ESSENTIAL}
    score = sum((F.least(F.lit(1.0), n[k] / 2.0) * w for k, w in ESSENTIAL.items()), F.lit(0.0))
    missing = F.array_join(F.array_compact(F.array(*[F.when(n[k] == 0, k) for k in ESSENTIAL])), ",")
    return nodes.agg(F.count(F.lit(1)).alias("total"), F.round(score, 6).alias("completeness"), missing.alias("missing"), *more)


def ancestors(parents: DataFrame, most: int = 12) -> DataFrame:
    """(id, ancestor, distance) up to `most` levels; parents has (id, parent). One join a level, which is written to a table: no level
    is made again for the next one, and none passes through the driver as a broadcast."""
    spark = parents.sparkSession
    up = parents.filter("parent is not null")
    now = up.select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("distance"))
    found = now
    step = up.select(F.col("id").alias("_i"), F.col("parent").alias("_p")).hint("merge")
    for d in range(2, most + 1):
        now = now.join(step, F.col("ancestor") == F.col("_i")).select("id", F.col("_p").alias("ancestor"), F.lit(d).alias("distance"))
        now = T.refresh(now, T.fresh_path(spark, "level"))
        if now.isEmpty():
            break
        found = found.unionByName(now)
    return found


def depth_of(nodes: DataFrame, edges: DataFrame, most: int = 20) -> DataFrame:
    """One row: the longest path's number of edges; simple paths only, no longer than `most`."""
    now, longest = nodes.select(F.array("id").alias("path"), F.col("id").alias("end")), 0
    for d in range(1, most + 1):
        now = now.join(edges.hint("merge"), F.col("end") == F.col("source")).filter(~F.array_contains("path", F.col("target")))
        now = now.select(F.concat("path", F.array("target")).alias("path"), F.col("target").alias("end"))
        now = T.refresh(now, T.fresh_path(nodes.sparkSession, "level"))  # not made again for the next level
        if now.isEmpty():
            break
        longest = d
    return nodes.sparkSession.range(1).select(F.lit(longest).alias("depth"))
