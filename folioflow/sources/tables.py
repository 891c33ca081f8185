"""Tables of files that are appended to, refreshed and merged into."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from folioflow.operators import rows as R


def fresh_path(spark: SparkSession, name: str) -> str:
    """A folder of its own for each call, below the session's warehouse, which driver and executors share."""
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/folioflow/{name}-{uuid.uuid4().hex}"


def append_rows(df: DataFrame, path: str) -> DataFrame:
    """Add the rows to the table and read it back."""
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.parquet(path)


def refresh(df: DataFrame, path: str) -> DataFrame:
    """Replace the table's rows by these and read them back; df must not read from path."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def merge_staged(new: DataFrame, keys: list[str], at: str, tie: str, stored: str, staging: str, merged: str) -> DataFrame:
    """Write the new rows to staging, then stored with them to merged, and read that back.

    Of staged rows with equal keys the last by `at` wins (of equals the greatest `tie`), and it wins over the stored
    one. The stored table is left as it is, so a lost job is simply run again; the caller then reads merged.
    """
    spark = new.sparkSession
    staged = refresh(new, staging)
    return refresh(R.upsert(spark.read.parquet(stored), R.last_write(staged, keys, at, tie), keys), merged)


def rebuild(df: DataFrame, key: str, path: str) -> DataFrame:
    """Replace the stored rows of the keys that df has, and no others', and read the table back.

    The table is partitioned by key; Spark swaps only the partitions written. A key without new rows keeps its old ones: drop
    its partition with `clear`.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
    return df.sparkSession.read.parquet(path)


def clear(spark: SparkSession, key: str, value: object, path: str) -> None:
    """Delete the stored rows of one key."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{key}={value}")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
