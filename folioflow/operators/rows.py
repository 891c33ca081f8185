"""Filters, ordered selections, set operations and functional rewrites on any DataFrame."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def where_given(df: DataFrame, conditions: dict[str, object], ignored: tuple = (None, "all")) -> DataFrame:
    """Equality on the columns that have a value; None and "all" mean no condition."""
    given = [F.col(c) == v for c, v in conditions.items() if v not in ignored]
    return reduce(lambda d, c: d.filter(c), given, df)


def active_at(df: DataFrame, expires: str, as_of: Column) -> DataFrame:
    """Rows without an expiry or with one after as_of."""
    return df.filter(F.col(expires).isNull() | (F.col(expires) > as_of))


def first_per(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in the given order, which must be total."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", rank).filter(F.col("_n") <= n).drop("_n")


def top_k(df: DataFrame, score: str, tie: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(score), F.asc(tie)).limit(k)


def missing_from(new: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Write-if-missing: the rows of new whose keys aren't stored."""
    return new.join(stored.select(*keys).distinct(), keys, "left_anti")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace stored rows of the same key; the rest stay. new has one row a key."""
    return stored.join(new.select(*keys), keys, "left_anti").unionByName(new)


def add_up(stored: DataFrame, deltas: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Additive upsert: value = value + delta, a new key starts at its delta."""
    cols = [*keys, *values]
    return stored.select(cols).unionByName(deltas.select(cols)).groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])


def last_write(df: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The latest row of each key."""
    rest = [c for c in df.columns if c not in keys]
    latest = F.max_by(F.struct(*rest), F.struct(at, tie)).alias("_r")
    return df.groupBy(*keys).agg(latest).select(*keys, "_r.*")


def without_keys(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Cascade delete: rows whose keys aren't among those gone."""
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def batches(df: DataFrame, order: list[Column], size: int, keys: list[str] | None = None, out: str = "batch") -> DataFrame:
    """Number batches of `size` ordered rows from 0, within keys."""
    window = Window.partitionBy(*(keys or [])).orderBy(*order)
    return df.withColumn(out, F.floor((F.row_number().over(window) - 1) / size))


def keep_in_order(key: Column, value: Column, sep: str) -> Column:
    """Aggregate: the values joined in the order of their keys."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), value.alias("v")))), lambda x: x["v"]), sep)


#: Rows of a part in `dealt`.
PART = 50_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by keys into parts of about PART rows: a larger table has more parts, not larger ones, and Spark joins none of them."""
    return df.repartition(max(1, math.ceil(df.count() / PART)), *keys)
