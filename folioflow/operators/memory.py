"""Memory scoring: retention, salience, mismatch, novelty, replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Seconds of base strength; cut-offs of salience; weights of a replay's sources.
STRENGTH = {"slow": 345600.0, "fast": 21600.0}
NORMAL = 86400.0
SALIENCE = (("permanent", 0.85), ("slow", 0.65), ("normal", 0.40))
REPLAY = {"attention": (0.50, 6), "fragment": (0.30, 4), "vector": (0.20, 4)}


def retention(elapsed: Column, decay_class: Column, boost: Column) -> Column:
    """exp(-t / strength), where a boost of over 1 multiplies the strength; permanent rows are infinite."""
    base = F.when(decay_class == "slow", STRENGTH["slow"]).when(decay_class == "fast", STRENGTH["fast"]).otherwise(NORMAL)
    value = F.exp(-F.greatest(F.lit(0.0), elapsed) / (base * F.greatest(F.lit(1.0), F.coalesce(boost, F.lit(1.0)))))
    return F.when(decay_class == "permanent", F.lit(float("inf"))).otherwise(value)


def salience(novelty: Column, contradiction: Column, user: Column) -> Column:
    return 0.45 * novelty + 0.35 * contradiction + 0.20 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), user))


def salience_class(score: Column) -> Column:
    out = None
    for name, least in SALIENCE:
        out = F.when(score >= least, name) if out is None else out.when(score >= least, name)
    return out.otherwise("fast")


def mismatch(similarity: Column, confidence: Column) -> Column:
    """Distance weighted by confidence (0.05 at least), 0.1 at least."""
    return F.greatest(F.lit(0.10), (1 - similarity) * F.greatest(F.lit(0.05), confidence))


def surprise(effective: Column) -> Column:
    return F.when(effective >= 0.75, "flashbulb").when(effective >= 0.4, "high").when(effective >= 0.2, "moderate").otherwise("expected")


def modifier(effective: Column, weight: float = 0.3) -> Column:
    return F.when(effective >= 0.75, F.least(F.lit(0.5), effective * weight)).when(effective >= 0.4, effective * weight * 0.7).when(effective >= 0.2, effective * weight * 0.4).otherwise(0.0)


def fuse_salience(static: Column, mod: Column, weight: float = 0.3) -> Column:
    """Surprise can raise salience, never lower it."""
    return F.least(F.lit(1.0), F.greatest(static, (1 - weight) * static + weight * mod))


def novelty(max_similarity: Column, threshold: float = 0.55) -> Column:
    """1 without neighbours; raised by 30 percent where nothing is close."""
    n = 1 - max_similarity
    return F.when(max_similarity.isNull(), 1.0).when(max_similarity < threshold, F.least(F.lit(1.0), n * 1.3)).otherwise(n)


def replay_candidates(attention: DataFrame, fragments: DataFrame, vectors: DataFrame, most: int = 12) -> DataFrame:
    """Of each source (id, strength) the best few, weighted; the `most` best of all: (source, id, priority)."""
    parts = []
    for name, df in (("attention", attention), ("fragment", fragments), ("vector", vectors)):
        weight, k = REPLAY[name]
        parts.append(df.orderBy(F.desc("strength"), "id").limit(k).select(F.lit(name).alias("source"), "id", (F.lit(weight) * F.col("strength")).alias("priority")))
    all_ = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return all_.orderBy(F.desc("priority"), "source", "id").limit(most)


# A replay's boost and its cap; what the others lose, down to a floor; seconds that attention and activity last.
BOOST, MOST_BOOST, LOSS, FLOOR, ATTENTION, IDLE = 0.15, 2.5, 0.02, 0.5, 3600, 1800


def replay_cycle(vectors: DataFrame, attention: DataFrame, fragments: DataFrame, now: int) -> DataFrame:
    """The vectors after one cycle of replay.

    vectors: (id, content_hash, decay_factor, activation_count, salience, decay_class, at); attention: (id,
    content_hash, activation_count, at) of which the last hour counts; fragments: (id, strength). The best
    candidates are boosted: vectors themselves, attention by the least vector of its content, which is
    activated too; fragments have no vector. Idle active vectors that are neither lasting nor replayed lose a little.
    """
    recent = attention.filter(F.col("at") >= now - ATTENTION)
    active = vectors.filter("activation_count > 0 AND (decay_class IS NULL OR decay_class <> 'permanent')")
    chosen = replay_candidates(recent.select("id", F.col("activation_count").alias("strength")), fragments, active.select("id", F.coalesce(F.nullif("salience", F.lit(0.0)), F.lit(0.3)).alias("strength")))
    own = chosen.filter("source = 'vector'").select("id", F.lit(0).alias("activated"))
    hashes = chosen.filter("source = 'attention'").join(recent.select("id", "content_hash"), "id").select("content_hash", F.col("id").alias("_a"))
    led = vectors.join(hashes, "content_hash").groupBy("_a").agg(F.min("id").alias("id")).select("id", F.lit(1).alias("activated"))
    hits = own.unionByName(led).groupBy("id").agg(F.count(F.lit(1)).alias("times"), F.sum("activated").alias("activated"))
    factor, times = F.coalesce("decay_factor", F.lit(1.0)), F.coalesce("times", F.lit(0))
    idle = (F.col("activation_count") > 0) & ~F.coalesce(F.col("decay_class").isin("permanent", "slow"), F.lit(False)) & (F.col("at").isNull() | (F.col("at") < now - IDLE))
    after = F.when(times > 0, F.least(F.lit(MOST_BOOST), factor + BOOST * times)).when(idle, F.greatest(F.lit(FLOOR), factor - LOSS)).otherwise(F.col("decay_factor"))
    d = vectors.join(hits, "id", "left")
    return d.select("id", "content_hash", after.alias("decay_factor"), (F.col("activation_count") + F.coalesce("activated", F.lit(0))).alias("activation_count"), "salience", "decay_class", F.when(times > 0, F.lit(now)).otherwise(F.col("at")).alias("at"))
