"""Window computations: ranks, carried values, intervals, sessions, as-of and interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carried(value: Column, keys: list, order: list) -> Column:
    """The last value that is not null, up to this row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def sections(df: DataFrame, boundary: Column, keys: list, order: list, out: str = "section") -> DataFrame:
    """Number the sections: a new one starts where boundary holds."""
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(boundary.cast("int")).over(so_far))


def as_of(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, values: list[str]) -> DataFrame:
    """For each left row the values of the right row of its key with the greatest right_at <= left_at.

    Both sides go through one shuffle and one sort; nothing is multiplied.
    """
    a = left.select("*", F.col(left_at).alias("_at"), F.lit(1).alias("_side"), *[F.lit(None).cast(right.schema[v].dataType).alias(f"_{v}") for v in values])
    none = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != key else F.col(key) for f in left.schema]
    b = right.select(*none, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), *[F.col(v).alias(f"_{v}") for v in values])
    order = [F.col("_at"), F.col("_side")]
    both = a.unionByName(b)
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = F.last(F.when(F.col("_side") == 0, F.struct(*[F.col(f"_{v}").alias(v) for v in values])), ignorenulls=True).over(w)
    return both.withColumn("_found", found).filter("_side = 1").select(*left.columns, *[F.col("_found")[v].alias(v) for v in values])


def near_in_time(df: DataFrame, key: str, at: str, id_col: str, seconds: int, most: int, left: DataFrame | None = None) -> DataFrame:
    """Pairs (id, other, delta) of one key within `seconds`, the `most` nearest of each id (of `left`, if given).

    Ties go by other; ids are unique, and rows without a key or a time are near nothing. A row stands in its
    stretch of `seconds` and beside it in both neighbours. There the nearest are among the `most` rows
    before and after it and the first ones of its very time, so no pairs are made to choose from, and a
    hot key's stretches are dealt to several tasks.
    """
    rows = df.select(key, F.col(id_col).alias("id"), F.col(at).alias("t")).dropna().withColumn("own", F.floor(F.col("t") / seconds))
    held = rows.withColumn("bucket", F.explode(F.array(*[F.col("own") + d for d in (-1, 0, 1)])))
    if left is not None:
        held = held.join(left.select(key, F.floor(F.col(at) / seconds).alias("bucket")).distinct(), [key, "bucket"], "left_semi")
    me, w = F.struct("t", "id"), Window.partitionBy(key, "bucket")
    back, ahead = w.orderBy("t", F.desc("id")), w.orderBy("t", "id")  # of one time the lesser id is the nearer, either way
    same = Window.partitionBy(key, "bucket", "t").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    around = [F.lag(me, i).over(back) for i in range(1, most + 1)] + [F.lead(me, i).over(ahead) for i in range(1, most + 1)] + [F.nth_value(me, i).over(same) for i in range(1, most + 2)]
    d = held.withColumn("around", F.array(*around)).filter("own = bucket")
    near = F.filter("around", lambda x: x.isNotNull() & (x["id"] != F.col("id")) & (F.abs(x["t"] - F.col("t")) <= seconds))
    pairs = F.array_sort(F.array_distinct(F.transform(near, lambda x: F.struct(F.abs(x["t"] - F.col("t")).alias("delta"), x["id"].alias("other")))))
    out = d.select(key, "id", F.explode(F.slice(pairs, 1, most)).alias("p")).select(key, "id", "p.other", "p.delta")
    return out if left is None else out.join(left.select(F.col(id_col).alias("id")), "id", "left_semi").select(key, "id", "other", "delta")


def coverage_indices(n: Column, limit: int) -> Column:
    """Indices of a sample of `limit` from n ordered rows: both ends and evenly spaced ones between.

    Halves round to even. Rounding never meets an index twice while the sample is smaller than n.
    """
    m = limit - 2
    span = n - 1
    middle = F.transform(F.sequence(F.lit(1), F.lit(max(m, 1))), lambda i: F.bround(i / F.lit(m + 1) * span, 0).cast("int"))
    some = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), span.cast("int")), middle if m > 0 else F.array().cast("array<int>"))))
    all_ = F.sequence(F.lit(0), span.cast("int"))
    if limit == 1:
        some = F.array(F.lit(0))
    return F.when(n <= limit, all_).otherwise(some)


def global_rank(df: DataFrame, score: str, tie: str, out: str = "rank", rows_in_bucket: int = 100_000) -> DataFrame:
    """Rank all rows from 1 by score (descending), then tie (ascending), without a one-task window.

    Scores are cut at quantiles; a score that is a cut (a frequent one always is) has buckets of its
    own, cut by the tie. Buckets' counts give each its first rank.
    """
    n = df.count()
    k = max(1, n // rows_in_bucket)
    if k == 1:
        return df.withColumn(out, F.row_number().over(Window.orderBy(F.desc(score), tie)))  # a bucket's worth of rows
    at = [i / k for i in range(1, k)]
    r = df.agg(F.percentile_approx(score, at, 10_000), F.percentile_approx(tie, at, 10_000)).first()
    above = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(r[0]))]), lambda c: c > F.col(score)))
    equal = F.col(score).isin(sorted(set(r[0])))
    by_tie = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(r[1]))]), lambda c: c < F.col(tie)))
    keyed = df.withColumn("_b", F.struct((2 * above + F.when(equal, 0).otherwise(1)).alias("s"), F.when(equal, by_tie).otherwise(0).alias("t")))
    counts = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    first = counts.select(F.col("_b").alias("_c"), F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    inside = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(F.desc(score), tie)))
    return inside.join(first, F.col("_b") == F.col("_c")).select(*df.columns, (F.col("_first") + F.col("_r")).alias(out))
