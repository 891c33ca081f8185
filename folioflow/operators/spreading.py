"""Completion of retrieved rows by what is associated with them: in time, by likeness, in the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.operators import ordered as O
from folioflow.operators import retrieval as S
from folioflow.operators import rows as R

# Hops, associations of a kind and nodes a hop, the least likeness, seconds.
HOPS, EACH, LEAST, SECONDS = 2, 4, 0.72, 300
FOUND = ("seed", "hop", "place", "leg", "n", "source", "target", "weight", "kind")


def strongest(edges: DataFrame, of: DataFrame, each: int) -> DataFrame:
    """(source, target, weight, n): the `each` heaviest edges (a, b, weight) at either end of the rows (source) of `of`; ties by target."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("target")), F.struct(F.col("b").alias("source"), F.col("a").alias("target"))))
    both = edges.filter("a <> b").select(ends.alias("e"), "weight").select("e.source", "e.target", "weight").join(of, "source", "left_semi")
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("weight"), "target"))
    return both.withColumn("n", rank).filter(F.col("n") <= each)


def complete(seeds: DataFrame, items: DataFrame, fragments: DataFrame, edges: DataFrame, hops: int = HOPS, each: int = EACH, least: float = LEAST, seconds: int = SECONDS) -> DataFrame:
    """Rows (seed, rank, hop, source, target, kind, weight): at most hops * each associations of each seed, nearest hops first.

    seeds: (id, embedding) of the retrieved rows; items: (id, key, at), at in seconds; fragments: (id, embedding);
    edges: (a, b, weight). A node leads to the nearest items of its key in time, a seed also to the most
    similar fragments (of another id), then come a node's heaviest edges. The next hop goes on from the
    first `each` nodes that were not met before; what leads back to a node is an association too, but
    each (source, target, kind) counts once. Null ids lead nowhere.
    """
    seeds = seeds.filter("id IS NOT NULL").dropDuplicates(["id"])
    own = seeds.select("id").withColumn("id", F.col("id").cast("bigint"))
    node = lambda c: F.col(c).cast("string")
    front = own.select(F.col("id").alias("seed"), node("id").alias("source"), F.lit(0).alias("place"))
    met = own.select(F.col("id").alias("seed"), node("id").alias("target"))
    text_edges = edges.select(node("a").alias("a"), node("b").alias("b"), "weight")
    out = None
    for hop in range(1, hops + 1):
        sources = front.select("source").distinct()
        mine = items.join(sources.select(F.col("source").try_cast("bigint").alias("id")), "id", "left_semi")
        near = O.near_in_time(items, "key", "at", "id", seconds, each, left=mine)
        rank = F.row_number().over(Window.partitionBy("id").orderBy("delta", "other"))
        weight = F.greatest(F.lit(0.0), 1 - F.col("delta") / float(seconds))
        legs = [
            near.select(node("id").alias("source"), node("other").alias("target"), weight.alias("weight"), rank.alias("n"), F.lit(0).alias("leg"), F.lit("temporal").alias("kind")),
            strongest(text_edges, sources, each).select("source", "target", "weight", "n", F.lit(2).alias("leg"), F.lit("graph").alias("kind")),
        ]
        if hop == 1:  # only seeds bring a vector along
            like = S.nearest(seeds, fragments, "id", "embedding", each, least)
            rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
            legs.append(like.select(node("q").alias("source"), F.concat(F.lit("fragment:"), node("id")).alias("target"), F.col("score").alias("weight"), rank.alias("n"), F.lit(1).alias("leg"), F.lit("semantic").alias("kind")))
        led = legs[0]
        for leg in legs[1:]:
            led = led.unionByName(leg)
        found = front.join(led, "source").withColumn("hop", F.lit(hop)).select(*FOUND)
        out = found if out is None else out.unionByName(found)
        fresh = found.join(met, ["seed", "target"], "left_anti").groupBy("seed", "target").agg(F.min(F.struct("place", "leg", "n")).alias("at"))
        met = met.unionByName(fresh.select("seed", "target"))
        place = F.row_number().over(Window.partitionBy("seed").orderBy("at", "target"))
        front = fresh.select("seed", F.col("target").alias("source"), place.alias("place")).filter(F.col("place") <= each)
    once = R.first_per(out, ["seed", "source", "target", "kind"], [F.col("hop"), F.col("place"), F.col("leg"), F.col("n")])
    order = Window.partitionBy("seed").orderBy("hop", "place", "leg", "n", "target")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= hops * each).select("seed", "rank", "hop", "source", "target", "kind", "weight")
