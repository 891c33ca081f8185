"""Document fingerprints by consistent weighted sampling.

A document's terms are its pairs of neighbouring words (its only word, if there is but one), as
64-bit hashes; a term's weight is how often it occurs. For each of `samples` positions k and each
term with weight w, with r and c drawn from Gamma(2, 1) and beta from [0, 1) by term and k alone:
t = floor(ln w / r + beta), ln a = ln c - r (t - beta) - r. The least ln a is the sample; two
documents share it with a probability of their generalised Jaccard similarity, sum(min) / sum(max)
of the weights. A fingerprint keeps 16 bits of each sample, as hex; the share of equal positions
estimates the similarity, with a standard error of at most 0.5 / sqrt(samples).

For weight 1, t is 0 and a = c exp(-r (1 - beta)) is exponential with mean 1. So that is drawn first,
as 32 uniform bits by tabulation (all 64 bits of the term count), whose least needs no logarithm; r
and beta are drawn given a, from a counter hash, where a weight is more than 1: v = r (1 - beta) is
ln(1 + e / a) and r is v + f, with e and f exponential of mean 1.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import buckets_for, mix, text_or_empty, text_slices, word_hashes, worker_cache

SAMPLES = 96
#: Terms are cut into as many parts of 16 bits.
PARTS = 4
#: Ranges of ids, and so tasks, at most: 800 KB of cuts.
MOST_RANGES = 100_000


def tables(samples: int) -> list[np.ndarray]:
    """Random 32-bit numbers for each value of each part of a term, 65536 x samples; kept by the worker."""
    cache, key = worker_cache(), ("cws", samples)
    if key not in cache:
        rng = np.random.Generator(np.random.PCG64(20240607))
        cache[key] = [rng.integers(0, 1 << 32, (1 << 16, samples), np.uint32) for _ in range(PARTS)]
    return cache[key]


def draws(terms: np.ndarray, samples: int) -> np.ndarray:
    """32 uniform bits for each term and sample."""
    first, *others = tables(samples)
    out = first[terms & np.uint64(0xFFFF)]
    for i, table in enumerate(others, 1):
        out ^= table[(terms >> np.uint64(16 * i)) & np.uint64(0xFFFF)]
    return out


def weighted_terms(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms, weights and each document's first row among them."""
    n_docs, n_words = len(first) - 1, np.diff(first)
    doc = np.repeat(np.arange(n_docs), n_words)
    pair = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, np.int64)
    single = first[:-1][n_words == 1]
    term = np.concatenate([mix(words[pair] * np.uint64(3) + words[pair + 1], 5), mix(words[single], 6)])
    doc = np.concatenate([doc[pair], doc[single]])
    order = np.lexsort((term, doc))
    term, doc = term[order], doc[order]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return term[at], np.diff(np.append(at, len(term))), np.searchsorted(doc[at], np.arange(n_docs + 1))


def exponential(bits: np.ndarray) -> np.ndarray:
    """Exponential numbers of mean 1, increasing with 32 uniform bits."""
    return -np.log1p((bits.astype(np.float64) + 0.5) * -(2.0**-32))


def sample(terms: np.ndarray, weights: np.ndarray, samples: int, rows_at_once: int = 1024) -> np.ndarray:
    """The sample at each position over one document's terms: its draw's 32 bits and, above them, t."""
    once, k = weights == 1, np.arange(samples, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    best, chosen = np.full(samples, np.inf), np.zeros(samples, np.uint64)
    some = terms[once]
    if len(some):
        least = np.min([draws(some[at : at + rows_at_once], samples).min(axis=0) for at in range(0, len(some), rows_at_once)], axis=0)
        best, chosen = np.log(exponential(least)), least.astype(np.uint64)
    some, logs = terms[~once], np.log(weights[~once])[:, None]
    for at in range(0, len(some), rows_at_once):
        part = some[at : at + rows_at_once]
        bits = draws(part, samples)
        a, more = exponential(bits), mix(part[:, None] + k, 11)
        v = np.log1p(exponential(more >> np.uint64(32)) / a)
        r = v + exponential(more & np.uint64(0xFFFFFFFF))
        t = np.floor((logs[at : at + rows_at_once] + r - v) / r)  # beta is (r - v) / r
        value = np.log(a) - r * t
        row = value.argmin(axis=0)
        there = (row, np.arange(samples))
        less = value[there] < best
        best = np.where(less, value[there], best)
        chosen = np.where(less, bits[there] | t[there].astype(np.uint64) << np.uint64(32), chosen)
    return chosen


def fingerprints(texts: list[str], samples: int) -> np.ndarray:
    """A row of 16-bit samples for each text; texts without words get zeros."""
    out = np.zeros((len(texts), samples), np.uint16)
    for row, off, data in text_slices(pa.array(texts, pa.string())):
        words, first = word_hashes(data, off)
        terms, weights, start = weighted_terms(words, first)
        for i in range(len(off) - 1):
            some = slice(start[i], start[i + 1])
            if some.start < some.stop:
                out[row + i] = (mix(sample(terms[some], weights[some], samples), 9) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def edited(text: str, after: str) -> str:
    """text with its last floor(n / 2) code points replaced by the first as many (or all) of after."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_neighbours(samples: int, rows_at_once: int = 256):
    """A mapInArrow function over rows (bucket, halo, doc_id, text) sorted by the first three.

    Each row is followed by the next document, at a bucket's end by its halo row.
    """

    def run(batches):
        carry = None
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                rows = list(zip(*(c.to_pylist() for c in batch.slice(at, rows_at_once).columns), strict=True))
                if carry:
                    rows.insert(0, carry)
                carry = rows[-1]
                pairs = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
                if not pairs:
                    continue
                own = fingerprints([r[3] for r in rows], samples)
                changed = [edited(rows[i][3], rows[i + 1][3]) for i in pairs]
                other = fingerprints(changed, samples)
                mine, following = own[pairs], own[[i + 1 for i in pairs]]
                hexes = lambda x: [row.astype(">u2").tobytes().hex() for row in x]
                # a document's own print against its empty self is 1: both are all zeros
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([rows[i][2] for i in pairs], pa.int64()), pa.array([len(rows[i][3]) for i in pairs], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed]),
                        pa.array(hexes(mine)), pa.array(hexes(other)), pa.array((mine == other).mean(axis=1)), pa.array((mine == following).mean(axis=1)),
                    ],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return run


def fingerprint_documents(docs: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text", rows_in_bucket: int = 5000) -> DataFrame:
    """Fingerprints of every document and of its text edited with the next one's.

    The next document is that with the next greater id, after the last the first; a single document
    is its own next. Rows that repeat an id follow each other by their text's hash; a null id comes
    first and stays null. A null text is empty; a text without words has the fingerprint of zeros.
    An empty table gives none. Other columns are left out.

    Ids are dealt into ranges of about rows_in_bucket rows (MOST_RANGES at most: the driver holds two
    numbers for each), a range to a task; each range's first document is sent to the range before it as
    well, so a text is shuffled once and no task orders the whole table.
    """
    spark = docs.sparkSession
    lowest = -(2**63)
    ids = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(lowest)).alias("i"))
    n = ids.count()
    if not n:
        return spark.createDataFrame([], OUT)
    p = min(MOST_RANGES, buckets_for(n, rows_in_bucket))
    cuts = []
    if p > 1:
        cuts = ids.select(F.percentile_approx("i", [k / p for k in range(1, p)], max(10_000, 5 * p))).first()[0]
    cuts = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf(T.IntegerType())
    def bucket_of(i):
        import pandas as pd

        return pd.Series(np.searchsorted(cuts, i.to_numpy(), "right").astype(np.int32))

    heads = ids.withColumn("b", bucket_of("i")).groupBy("b").agg(F.min("i").alias("i")).orderBy("b").collect()  # a row per range
    first = np.array([r["i"] for r in heads], np.int64)
    goes_to = np.array([r["b"] for r in heads], np.int32)  # the head of each range goes to the range before, the first head to the last

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def targets(i):
        import pandas as pd

        i = i.to_numpy()
        own, at = np.searchsorted(cuts, i, "right"), np.searchsorted(first, i)
        is_head = first[np.minimum(at, len(first) - 1)] == i
        return pd.Series([[int(b), int(goes_to[k - 1])] if h else [int(b)] for b, k, h in zip(own, at, is_head, strict=True)])

    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(lowest)).alias("_id"), text_or_empty(text_col).alias("_text"))
    rows = rows.select("_id", "_text", F.posexplode(targets("_id")).alias("_halo", "_bucket"))
    rows = rows.repartitionById(p, "_bucket").sortWithinPartitions("_bucket", "_halo", "_id", F.xxhash64("_text"))
    out = rows.select("_bucket", "_halo", "_id", "_text").mapInArrow(compare_neighbours(samples), OUT)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != lowest, F.col("doc_id")))


def likeness(a: str, b: str) -> float:
    """The share of equal samples of two fingerprints."""
    x, y = (np.frombuffer(bytes.fromhex(f), ">u2") for f in (a, b))
    return float((x == y).mean())


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
