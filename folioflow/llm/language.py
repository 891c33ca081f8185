"""Language identification by nearest centroid: TF-IDF n-gram vectors against clustered centroids.

A text's letters (A-Z lower-cased, bytes beyond ASCII as they are, a run of anything else as one space)
give its n-grams of one to four bytes, hashed into BINS. Weights are (1 + log tf) * idf, scaled to length 1.
Each language has CLUSTERS centroids, found by spherical k-means over a sample of labelled rows: a round
is one pass, each partition sums the vectors nearest to each centroid, the sums are added by centroid on
the executors, and the driver holds no more than the centroids. A text goes to the language of the
centroid with the highest cosine; one farther away than all but `outliers` of its language's
sample (at that quantile) is marked as rejected.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import LOWER, Scratch, text_slices

GRAMS, BINS, CLUSTERS, ROUNDS = 4, 1 << 14, 3, 4
#: At most about so many labelled rows of a language teach, and so many files hold them.
MOST_LABELLED, FILES = 5_000, 32
#: More values of the label than this aren't languages: 400 KB of centroids each.
MOST_LANGUAGES = 1_000
UNDETERMINED = "und"
#: Texts whose n-grams are counted at once.
AT_ONCE = 64

#: 0 for what isn't part of a letter, else the lower-case byte.
LETTER = np.where((np.arange(256) >= 128) | ((LOWER >= 97) & (LOWER <= 122)), LOWER, 0).astype(np.uint32)


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document of the slice, bin) of each n-gram; n-grams stay within a document and hold no two spaces in a row."""
    code = LETTER[data]
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    same = np.zeros(len(code), bool)  # goes with the byte before, in one document
    same[1:] = doc[1:] == doc[:-1]
    keep = (code != 0) | ~same
    keep[1:] |= code[:-1] != 0  # the first of a run of spaces stays
    code, doc = code[keep], doc[keep]
    docs, bins, value, n = [], [], np.zeros(len(code), np.uint64), len(code)
    for size in range(1, GRAMS + 1):
        if n < size:
            break
        value = (value[: n - size + 1] << np.uint64(8)) | code[size - 1 :]
        inside = (doc[: n - size + 1] == doc[size - 1 :]) & (value != 0)
        mixed = (value[inside] + np.uint64(size << 40)) * np.uint64(0x9E3779B97F4A7C15)
        docs.append(doc[: n - size + 1][inside])
        bins.append((mixed >> np.uint64(64 - 14)).astype(np.int64))
    return (np.concatenate(docs), np.concatenate(bins)) if docs else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def counted(texts: pa.Array):
    """Blocks (first row, counts): a row of BINS counts for each of at most AT_ONCE texts."""
    for row, off, data in text_slices(texts):
        for at in range(0, len(off) - 1, AT_ONCE):
            some = off[at : at + AT_ONCE + 1]
            doc, bins = grams(data[some[0] : some[-1]], some - some[0])
            n = len(some) - 1
            yield row + at, np.bincount(doc * BINS + bins, minlength=n * BINS).reshape(n, BINS)


class Model:
    """Languages in order, idf of each bin, centroids (CLUSTERS rows a language) and each language's least cosine."""

    def __init__(self, languages: list[str], idf: np.ndarray, centroids: np.ndarray):
        self.languages, self.idf, self.centroids = languages, idf, centroids
        self.least = np.full(len(languages), -1.0)
        self.weights = np.append(0.0, 1 + np.log(np.arange(1, 1024)))

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        out = self.weights[np.minimum(counts, len(self.weights) - 1)]
        often = np.nonzero(counts >= len(self.weights))
        out[often] = 1 + np.log(counts[often])
        out *= self.idf
        size = np.sqrt((out * out).sum(1))
        return out / np.where(size > 0, size, 1)[:, None]

    def cosines(self, counts: np.ndarray) -> np.ndarray:
        """By text, language and cluster."""
        return np.clip(self.vectors(counts) @ self.centroids.T, 0, 1).reshape(len(counts), len(self.languages), CLUSTERS)

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language's number (ties: the least), score, cosine. The score is the nearest language's share against the second's."""
        best = self.cosines(counts).max(2)
        first = best.argmax(1)
        top = best[np.arange(len(best)), first]
        best[np.arange(len(best)), first] = 0
        second = best.max(1)
        return first, np.where(top > 0, top / np.where(top > 0, top + second, 1), 0), top


def arrays(names: dict[str, np.ndarray | list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(v)) for v in names.values()], names=list(names))


def document_frequency(batches):
    """mapInArrow over (lang, key, text): in how many texts each bin is found, a row a partition."""
    total, n = np.zeros(BINS), 0
    for batch in batches:
        for _, counts in counted(batch.column("text")):
            total += (counts > 0).sum(0)
            n += len(counts)
    yield arrays({"cluster": [0], "n": [n], "sums": [total]})


def nearest_sums(model: Model, first: bool, batches):
    """mapInArrow over (lang, key, text): summed vectors of the texts nearest to each of their language's centroids.

    In the first round, texts go to clusters by their key.
    """
    sums, n = {}, {}
    number = {x: i for i, x in enumerate(model.languages)}
    for batch in batches:
        lang = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
        key = np.asarray(batch.column("key"))
        for row, counts in counted(batch.column("text")):
            own, rows = lang[row : row + len(counts)], slice(row, row + len(counts))
            v = model.vectors(counts)
            if first:
                at = key[rows] % CLUSTERS
            else:
                at = (v @ model.centroids.T).reshape(len(v), -1, CLUSTERS)[np.arange(len(v)), own].argmax(1)
            for c in np.unique(own * CLUSTERS + at).tolist():
                mine = v[own * CLUSTERS + at == c]
                sums[c] = sums.get(c, 0) + mine.sum(0)
                n[c] = n.get(c, 0) + len(mine)
    if sums:
        yield arrays({"cluster": list(sums), "n": [n[c] for c in sums], "sums": list(sums.values())})


def added(rows: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """Sums by cluster, added up on the executors: FILES rows of BINS numbers at most for each."""

    def total(table: pa.Table) -> pa.Table:
        parts = np.asarray(table.column("sums").combine_chunks().flatten()).reshape(len(table), BINS)
        return pa.Table.from_batches([arrays({"cluster": [table.column("cluster")[0].as_py()], "n": [sum(table.column("n").to_pylist())], "sums": [parts.sum(0)]})])

    out = rows.groupBy("cluster").applyInArrow(total, SUMS)
    return {r["cluster"]: (r["n"], np.array(r["sums"])) for r in out.collect()}  # a row for each centroid


SUMS = "cluster bigint, n bigint, sums array<double>"


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike("\\p{L}"), F.lit(False))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that never teach: crc32 of the id as text, mod 4, is 2; null ids too."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def sample_of(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, lang_col: str, most: int) -> DataFrame:
    """Rows (lang, key, text) that teach: about `most` of each language, those whose hash is lowest; equal rows once."""
    text = F.col(text_col).cast("string")
    rows = docs.filter(F.col(lang_col).isNotNull() & ~held_out(id_col) & has_letter(text)).select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("string"), text).alias("key"), text.alias("text"))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1)
    part = {r["lang"]: most / r["n"] for r in sizes.collect()}  # MOST_LANGUAGES rows at most
    if len(part) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} values of {lang_col}")
    if not part:
        return rows.limit(0)
    share = F.create_map(*[F.lit(x) for kv in part.items() for x in kv])[F.col("lang")]
    drawn = rows.filter(F.pmod(F.col("key"), F.lit(1_000_000)) <= share * 1_000_000)
    return scratch.save(drawn.groupBy("lang", "key").agg(F.min("text").alias("text")).repartition(FILES, "key"), "sample")


def learn(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = MOST_LABELLED, outliers: float = 0.001) -> Model | None:
    """The model of docs' labelled rows that aren't held out; None where there are none."""
    sample = sample_of(docs, scratch, id_col, text_col, lang_col, most)
    languages = sorted(r["lang"] for r in sample.select("lang").distinct().collect())  # MOST_LANGUAGES at most
    if not languages:
        return None
    n, df = added(sample.mapInArrow(document_frequency, SUMS))[0]
    model = Model(languages, np.log((1 + n) / (1 + df)) + 1, np.zeros((len(languages) * CLUSTERS, BINS)))
    for i in range(ROUNDS):
        for c, (_, total) in added(sample.mapInArrow(partial(nearest_sums, model, i == 0), SUMS)).items():
            model.centroids[c] = total / max(np.sqrt(total @ total), 1e-12)

    def own_cosine(batches):
        number = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            lang = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            for row, counts in counted(batch.column("text")):
                own = lang[row : row + len(counts)]
                yield arrays({"lang": own, "cosine": model.cosines(counts).max(2)[np.arange(len(own)), own]})

    spread = sample.mapInArrow(own_cosine, "lang bigint, cosine double").groupBy("lang").agg(F.percentile_approx("cosine", outliers, 10_000).alias("least"))
    for r in spread.collect():  # a row a language
        model.least[r["lang"]] = r["least"]
    return model


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score, cosine, rejected): a row per row of docs, where it lies.

    lang_pred is `und`, with score and cosine 0 and rejected, where the text is null or has no letter, or nothing
    was learned. Otherwise it is a learned language, even of a text that is rejected for its distance; a text none of whose n-grams
    shares a bin with any language has cosine and score 0 and the least language by name. Repeated rows get a row each; other
    columns of docs are not read.
    """
    text = F.col(text_col).cast("string")

    @F.pandas_udf("lang string, score double, cosine double, rejected boolean")
    def predicted(texts):
        import pandas as pd

        column = pa.array(texts, pa.string())
        first, score, cosine = np.zeros(len(column), np.int64), np.zeros(len(column)), np.zeros(len(column))
        for row, counts in counted(column):
            rows = slice(row, row + len(counts))
            first[rows], score[rows], cosine[rows] = model.predict(counts)
        return pd.DataFrame({"lang": np.array(model.languages, object)[first], "score": score, "cosine": cosine, "rejected": cosine < model.least[first]})

    nothing = F.struct(F.lit(UNDETERMINED).alias("lang"), F.lit(0.0).alias("score"), F.lit(0.0).alias("cosine"), F.lit(True).alias("rejected"))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"), has_letter(text).alias("known"))
    found = predicted(F.when(F.col("known"), F.col("text")).otherwise("")) if model else nothing
    out = rows.select("doc_id", "known", found.alias("p"))
    pick = lambda c, no: F.when(F.col("known"), F.col("p")[c]).otherwise(no).alias("lang_pred" if c == "lang" else c)
    return out.select("doc_id", held_out().alias("held_out"), pick("lang", UNDETERMINED), pick("score", 0.0), pick("cosine", 0.0), pick("rejected", True))


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark, "language") as scratch:
        return identify(docs, learn(docs, scratch))
