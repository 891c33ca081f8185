"""Shared helpers: written tables, ranks without one-task windows, and text in Arrow buffers."""

from __future__ import annotations

import hashlib
import math
import random
import sys
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL_ROOT: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, or a folder of ours where none is set (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append(tempfile.mkdtemp(prefix="folioflow-"))
    return f"file://{_LOCAL_ROOT[0]}"


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors.

    Tables saved with keep=False go when the block ends; the others back the returned, lazy result.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.gone = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}", []
        self.saved = 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for path in self.gone:
            self.drop(path)

    def save(self, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        self.saved += 1
        path = f"{self.path}/{self.saved}-{name}"
        held = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")  # what is written needs its shuffle files no more
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, held)
        if not keep:
            self.gone.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self, df: DataFrame) -> None:
        """Drop a saved table before the block ends: nothing reads it any more."""
        for path in [p for p in self.gone if any(p.split(":")[-1].lstrip("/") in f for f in df.inputFiles()[:1])]:
            self.drop(path)
            self.gone.remove(path)

    def drop(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def buckets_for(rows: int, each: int = 100_000) -> int:
    """So many buckets that each holds about `each` rows, whatever the input."""
    return max(1, math.ceil(rows / each))


def numbered(df: DataFrame, group: list[str], order: list[str], out: str, rows: int, each: int = 100_000) -> DataFrame:
    """Number the rows of each group gaplessly from 0 in `out`, as bigint.

    A group is cut into hashed buckets of about `each` rows; the buckets' counts give every bucket
    its first number, so no task sorts a whole group. `order` must tell rows apart (equal rows are
    interchangeable). df is read twice: pass a written, narrow table.
    """
    n = buckets_for(rows, each)
    keyed = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(n)))
    counts = keyed.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_b").alias("_fb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    on = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)] + [F.col("_b") == F.col("_fb")]
    inside = keyed.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_b").orderBy(*order)))
    joined = inside.join(first, on)
    return joined.select(*df.columns, (F.col("_first") + F.col("_r") - 1).cast("bigint").alias(out))


def placed_in_order(values: DataFrame, by: str, scratch: Scratch, out: str) -> DataFrame:
    """values with each row's place, from 0, in the order of `by`: sorted by ranges, no task holds them all."""
    held = scratch.save(values.repartitionByRange(by).sortWithinPartitions(by).withColumn("_i", F.monotonically_increasing_id()), f"by-{by}")
    part = F.shiftright("_i", 33)
    counts = held.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    first = counts.select(F.col("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    there = F.col("_first") + F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))
    return held.withColumn("_p", part).join(first, "_p").withColumn(out, there).drop("_p", "_i", "_first")


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], most: int = 1000) -> DataFrame:
    """rows joined with groups, which has one row for each of the keys' values and counts its rows in n.

    Groups with more than one in `most` of all counted rows are at most `most` in number: they are
    broadcast, so their rows stay where they lie; the rest are joined by a shuffle. Both tables are
    read more than once: pass written ones.
    """
    total = groups.agg(F.sum("n")).first()[0] or 0
    named = groups.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)], *[c for c in groups.columns if c not in (*keys, "n")], "n")
    on = [F.col(k) == F.col(f"_g{i}") for i, k in enumerate(keys)]
    hot, held = F.col("n") * most > total, [f"_g{i}" for i in range(len(keys))]
    few = F.broadcast(named.filter(hot))
    rest = rows.join(F.broadcast(named.filter(hot).select(*held)), on, "left_anti")
    return rows.join(few, on).unionByName(rest.join(named.filter(~hot), on)).drop(*held, "n")


def worker_cache() -> dict:
    """One dict per Python worker; functions pickled by value have no module globals that last."""
    return sys.__dict__.setdefault("_folioflow_worker_cache", {})


# --- text as bytes: words and their hashes without a Python object per word ---

#: The six characters that part words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Hashes are elements of the field of this prime.
PRIME = (1 << 61) - 1
#: Bytes of a word that one lane holds, and the most lanes before a keyed digest takes over.
LANE, MOST_LANES = 7, 36


def fresh_seed() -> int:
    """A seed drawn by the driver for one run: whoever wrote the texts can't know it."""
    return random.SystemRandom().getrandbits(62)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A finaliser over uint64: every input bit moves every output bit."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for any uint64."""
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(PRIME), x - np.uint64(PRIME), x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, both below it: products of halves, as 2**61 is 1."""
    low, half = np.uint64((1 << 31) - 1), np.uint64(31)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    middle = a1 * b0 + a0 * b1
    return reduced(((a1 * b1) << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << half) + a0 * b0)


def powers(n: int, base: int, which: str) -> np.ndarray:
    """base**0 .. base**(n-1) modulo PRIME; the worker keeps those of the last base."""
    cache = worker_cache()
    held, x = cache.get(("powers", which), (None, None))
    if held != base or len(x) < n:
        x = np.ones(1, np.uint64)
        while len(x) < max(n, 1 << 18):
            x = np.concatenate([x, times(x, np.uint64(pow(base, len(x), PRIME)))])
        cache["powers", which] = (base, x)
    return x[:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash values[s:e] (all below PRIME) for each span: equal sequences hash equally wherever they stand.

    A polynomial over the prime field at a point drawn from the seed: two given sequences of n values
    are equal for n / 2**61 of the seeds at most.
    """
    base = random.Random(f"span {seed}").randrange(2, PRIME - 1)
    n = len(values)
    terms = times(values, powers(n, base, f"span {seed & 1}"))
    low, high = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
    np.cumsum(terms & np.uint64(0xFFFFFFFF), out=low[1:])
    np.cumsum(terms >> np.uint64(32), out=high[1:])
    low, high = low[ends] - low[starts], high[ends] - high[starts]
    total = reduced(reduced(low) + (high >> np.uint64(29)) + ((high & np.uint64((1 << 29) - 1)) << np.uint64(32)))
    return times(total, powers(n + 1, pow(base, -1, PRIME), f"back {seed & 1}")[starts])


def text_slices(array, most: int = 1 << 20):
    """Cut an Arrow string array into runs of rows of about `most` bytes.

    Yields (first row, offsets from 0, bytes); a longer text is a run of its own. Nulls must be gone.
    """
    n = len(array)
    if not n:
        return
    wide = np.int64 if str(array.type).startswith("large") else np.int32
    _, ends, data = array.buffers()
    off = np.frombuffer(ends, wide)[array.offset : array.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(off, off[row] + most, "right")) - 1)
        yield row, off[row : stop + 1] - off[row], data[off[row] : off[stop]]
        row = stop


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and for each document the index of its first word (with an end)."""
    n = len(data)
    word = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.zeros(n, bool)
    before[1:] = word[:-1]
    after = np.zeros(n, bool)
    after[:-1] = word[1:]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, off: np.ndarray, lower: bool = False, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A hash below PRIME for each word, and the documents' first words.

    A word's lanes of LANE bytes and its length are multiplied by numbers drawn from the seed and
    added up in the prime field: two words are equal for one in 2**61 seeds. Words of more than
    LANE * MOST_LANES bytes are digested under the seed as key.
    """
    cache = worker_cache()
    if cache.get("lanes", (None,))[0] != seed:
        rng = random.Random(f"word {seed}")
        cache["lanes"] = (seed, [rng.randrange(1, PRIME) for _ in range(MOST_LANES + 1)])
    *factors, by_length = cache["lanes"][1]
    if lower:
        data = LOWER[data]
    starts, ends, first = word_spans(data, off)
    size = ends - starts
    padded = np.zeros((len(data) // 8 + 3) * 8, np.uint8)
    padded[: len(data)] = data
    eights = padded.view("<u8")
    out = times(size.astype(np.uint64), np.full(1, by_length, np.uint64))
    todo = np.flatnonzero(size <= LANE * MOST_LANES)
    for i, factor in enumerate(factors):
        if i:
            todo = todo[size[todo] > LANE * i]
        if not len(todo):
            break
        at = starts[todo] + LANE * i
        shift = ((at & 7) << 3).astype(np.uint64)
        lane = (eights[at >> 3] >> shift) | ((eights[(at >> 3) + 1] << np.uint64(1)) << (np.uint64(63) - shift))
        held = (np.minimum(size[todo] - LANE * i, LANE) << 3).astype(np.uint64)
        lane &= (np.uint64(1) << held) - np.uint64(1)
        out[todo] = reduced(out[todo] + times(lane, np.full(1, factor, np.uint64)))
    for i in np.flatnonzero(size > LANE * MOST_LANES):
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=str(seed).encode())
        out[i] = int.from_bytes(digest.digest(), "little") % PRIME
    return out, first
