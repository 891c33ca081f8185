"""A quality classifier: random Fourier features, ridge by summed normal equations, isotonic calibration.

Statistics of a document's text are standardised and mapped to cos(W x + b), W Gaussian: inner
products of the map approximate a Gaussian kernel over the statistics. Labelled rows are mapped where
they lie; each partition sums its share of the normal equations, groups of partitions add theirs, and
only those sums reach the driver, which solves the ridge system. Raw scores of labelled rows held
back from the fit are calibrated by isotonic regression over a histogram of BINS bins.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import SPACE, Scratch, text_or_empty, text_slices, word_hashes, word_spans

STATS = (
    "log_bytes", "log_words", "word_bytes", "word_bytes_sd", "letters", "upper", "digits", "spaces", "lines", "stops", "commas", "dashes",
    "symbols", "exclaims", "beyond_ascii", "distinct_words", "distinct_pairs", "top_word", "symbol_words", "upper_words", "long_words", "stop_words_end",
)
FEATURES, BINS = 256, 2000
#: At most about so many labelled rows teach, chosen by their id's hash.
MOST_LABELLED = 200_000


def byte_classes() -> np.ndarray:
    """A row of flags per class for each byte."""
    b = np.arange(256)
    chars = lambda s: np.isin(b, list(s.encode()))
    upper, lower, digit = (b >= 65) & (b <= 90), (b >= 97) & (b <= 122), (b >= 48) & (b <= 57)
    high = b >= 128
    common = chars(".,;:'\"()-!?")
    symbol = ~(upper | lower | digit | high | SPACE | common)
    return np.array([upper | lower | high, upper, digit, SPACE, b == 10, chars(".?"), chars(",;:"), chars("-'\"()"), symbol, b == 33, high])


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of STATS for each document of a slice."""
    n_docs = len(off) - 1
    out = np.zeros((n_docs, len(STATS)))
    size = np.diff(off)
    starts, ends, first = word_spans(data, off)
    words, _ = word_hashes(data, off)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(n_docs), n_words)
    per = lambda x: np.bincount(doc, x, n_docs)
    byte, word = np.maximum(size, 1), np.maximum(n_words, 1)
    out[:, 0], out[:, 1] = np.log1p(size), np.log1p(n_words)
    length = (ends - starts).astype(float)
    out[:, 2] = per(length) / word
    out[:, 3] = np.sqrt(np.maximum(per(length**2) / word - out[:, 2] ** 2, 0))
    flags = byte_classes()
    sums = {}
    for k, flag in enumerate(flags):
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flag[data], out=total[1:])
        sums[k] = total
        out[:, 4 + k] = (total[off[1:]] - total[off[:-1]]) / byte
    inside = lambda k: sums[k][ends] - sums[k][starts]
    for col, ids in ((15, words), (16, words * np.uint64(3) + np.roll(words, -1))):
        key = np.lexsort((ids, doc))
        new = np.ones(len(key), bool)
        new[1:] = (ids[key][1:] != ids[key][:-1]) | (doc[key][1:] != doc[key][:-1])
        out[:, col] = np.bincount(doc[key][new], minlength=n_docs) / word
        if col == 15 and len(key):
            runs = np.diff(np.append(np.flatnonzero(new), len(key)))
            top = np.zeros(n_docs)
            np.maximum.at(top, doc[key][new], runs)
            out[:, 17] = top / word
    out[:, 18] = per((inside(8) > 0).astype(float)) / word
    out[:, 19] = per((inside(1) >= np.maximum(2, 0.6 * length)).astype(float)) / word
    out[:, 20] = per((length > 14).astype(float)) / word
    last = np.isin(data[ends - 1], list(b".!?")) if len(ends) else np.zeros(0)
    out[:, 21] = per(last.astype(float)) / word
    return out


def stats_of(batches):
    """mapInArrow over (doc_id, text)."""
    for batch in batches:
        blocks = [statistics(data, off) for _, off, data in text_slices(batch.column(1))]
        x = np.concatenate(blocks) if blocks else np.zeros((0, len(STATS)))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(STATS), pa.int32()), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), flat], names=["doc_id", "stats"])


def stats_matrix(column) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), len(STATS)) if len(column) else np.zeros((0, len(STATS)))


class Model:
    """Standardisation, Fourier map, ridge weights and calibration steps: a few thousand numbers."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray, seed: int = 7, width: float = 6.0):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.mean, self.sd = mean, np.where(sd > 1e-9, sd, 1.0)
        self.w = rng.standard_normal((len(STATS), FEATURES)) / width
        self.b = rng.random(FEATURES) * 2 * np.pi
        self.theta = np.zeros(FEATURES + 1)
        self.edges, self.steps = np.array([np.inf]), np.array([0.5])

    def phi(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -8, 8)
        out = np.ones((len(x), FEATURES + 1))
        out[:, 1:] = np.cos(z @ self.w + self.b) * np.sqrt(2 / FEATURES)
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.phi(x) @ self.theta

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.steps[np.minimum(np.searchsorted(self.edges, self.raw(x), "right"), len(self.steps) - 1)]


def partial_sums(model: Model, batches):
    """mapInArrow over (stats, y): this partition's part of the normal equations, a row per coordinate."""
    a = np.zeros((FEATURES + 1, FEATURES + 2))
    for batch in batches:
        x, y = model.phi(stats_matrix(batch.column(0))), np.asarray(batch.column(1), float)
        a[:, :-1] += x.T @ x
        a[:, -1] += x.T @ y
    n = FEATURES + 2
    flat = pa.ListArray.from_arrays(pa.array(np.arange(FEATURES + 2) * n, pa.int32()), pa.array(a.ravel()))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1)), flat], names=["row", "sums"])


def isotonic(count: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing rates closest to hits / count, per bin."""
    stack: list[list[float]] = []
    for i in range(len(count)):
        if count[i]:
            stack.append([hits[i], count[i], i])
            while len(stack) > 1 and stack[-2][0] * stack[-1][1] >= stack[-1][0] * stack[-2][1]:
                h, c, last = stack.pop()
                stack[-1] = [stack[-1][0] + h, stack[-1][1] + c, last]
    out, at = np.full(len(count), 0.5), 0
    for h, c, last in stack:
        out[at : int(last) + 1] = (h + 1e-9) / (c + 2e-9)
        at = int(last) + 1
    out[at:] = out[at - 1] if at else 0.5
    return out


def fit(spark: SparkSession, labelled: DataFrame, ridge: float = 1e-4) -> Model:
    """Fit on rows (key, stats, y): one in four, by the key's hash, calibrates; the rest are fitted.

    Without labelled rows every score is 0.5.
    """
    n = labelled.count()
    if not n:
        return Model(np.zeros(len(STATS)), np.ones(len(STATS)))
    part = F.pmod(F.xxhash64(F.col("key"), F.lit("part")), F.lit(4))
    used = labelled.withColumn("part", part)
    moments = used.select([F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(len(STATS))] + [F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(len(STATS))]).first()
    model = Model(np.array(moments[: len(STATS)], float), np.array(moments[len(STATS) :], float))
    fitted = used.filter("part != 0") if n >= 40 else used
    sums = fitted.select("stats", "y").mapInArrow(partial(partial_sums, model), "row bigint, sums array<double>")
    added = sums.groupBy("row").agg(*[F.sum(F.col("sums")[i]).alias(f"c{i}") for i in range(FEATURES + 2)]).collect()
    a = np.zeros((FEATURES + 1, FEATURES + 2))
    for r in added:  # FEATURES + 1 rows
        a[r["row"]] = r[1:]
    count = max(a[0, 0], 1.0)
    model.theta = np.linalg.solve(a[:, :-1] / count + ridge * np.eye(FEATURES + 1), a[:, -1] / count)
    edges = np.linspace(-0.5, 1.5, BINS - 1)

    def binned(batches):
        for batch in batches:
            at = np.searchsorted(edges, model.raw(stats_matrix(batch.column(0))), "right")
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(batch.column(1)).cast(pa.int64())], names=["bin", "y"])

    held = used.filter("part = 0") if n >= 40 else used
    count, hits = np.zeros(BINS), np.zeros(BINS)
    for r in held.select("stats", "y").mapInArrow(binned, "bin bigint, y bigint").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("h")).collect():  # BINS rows at most
        count[r["bin"]], hits[r["bin"]] = r["n"], r["h"]
    model.edges, model.steps = edges, isotonic(count, hits)
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that never teach: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def classify(docs: DataFrame, labels: DataFrame, scratch: Scratch, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, score, predicted): a row per row of docs.

    Labels are learned from rows that are not held out; of several labels of a document the mean
    counts, rounded; null labels and null ids teach nothing. A null text is empty, an empty text has a
    score like any other. Repeated rows get a row each; an empty table gives none.
    """
    model = learn(docs, labels, scratch, id_col, text_col)
    scored = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), score_of(model, text_or_empty(text_col)).alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def learn(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_LABELLED) -> Model:
    """The model learned from docs' labelled rows: about `most` of them, those whose id's hash is lowest."""
    known = F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()
    marks = scratch.save(labels.filter(known).groupBy(F.col("doc_id").cast("bigint").alias("key")).agg(F.round(F.avg("quality")).cast("int").alias("y")), "marks")
    draw = F.pmod(F.xxhash64(F.col("key"), F.lit("draw")), F.lit(1_000_000))
    used = marks.filter(draw < int(1_000_000 * min(1.0, most / max(1, marks.count()))) + 1)
    # about `most` rows of two numbers: a bounded table
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text")).join(F.broadcast(used.select("key")), F.col("doc_id") == F.col("key"), "left_semi")
    stats = rows.mapInArrow(stats_of, "doc_id bigint, stats array<double>").join(F.broadcast(used), F.col("doc_id") == F.col("key"))
    return fit(docs.sparkSession, scratch.save(stats.select("key", "stats", "y"), "labelled"))


def score_of(model: Model, text: Column) -> Column:
    """A text's score, wherever the row lies: nothing is joined or shuffled."""

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        column = pa.array(texts, pa.string())
        out = np.zeros(len(column))
        for row, off, data in text_slices(column):
            out[row : row + len(off) - 1] = model.score(statistics(data, off))
        return pd.Series(np.clip(out, 0, 1))

    return scored(text)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark, "quality") as scratch:
        return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), scratch)
