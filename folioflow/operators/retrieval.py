"""Hybrid retrieval: cosine and TF-IDF rankings, reciprocal-rank fusion, balance over documents."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import extract as E
from folioflow.functions import text as X
from folioflow.functions.embedding import hash_vector

# The fusion constant and the weights of chunk types.
RRF_K = 60
TYPE_WEIGHT = {"knowledge": 1.0, "example": 1.0, "filler": 0.4}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, least: float = 1e-8) -> Column:
    """Over the shorter length; 0 for a vector of (nearly) no length."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, 1, n), F.slice(b, 1, n)
    size = norm(a) * norm(b)
    return F.when((n <= 0) | (size < least), 0.0).otherwise(dot(a, b) / size)


def vector(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dense_scores(rows: DataFrame, query: list[float], embedding: str = "embedding") -> DataFrame:
    return rows.filter(F.size(embedding) > 0).withColumn("dense_score", cosine(F.col(embedding), vector(query)))


def nearness(query: list[float], embedding: str = "embedding") -> Column:
    """Struct (score) of a vector, null for one without length."""
    return F.when(F.size(embedding) > 0, F.struct(cosine(F.col(embedding), vector(query)).alias("score")))


def near_scores(rows: DataFrame) -> DataFrame:
    """dense_scores (id, dense_score) of rows that have the nearness as _near."""
    return rows.filter("_near IS NOT NULL").select("id", F.col("_near.score").alias("dense_score"))


def query_tokens(query: str) -> list[str]:
    return [t for t in re.split(r"[\W_]+", query.lower()) if len(t) > 1]


def term_counts(content: Column, query: str) -> Column:
    """Struct (n, hits): the tokens of a text, and how many of them are each of the query's words (by name)."""
    words = sorted(set(query_tokens(query)))
    hits = lambda t: F.array(*[F.size(t) - F.size(F.array_remove(t, w)) for w in words]).cast("array<int>")
    return X.once(X.tokens(content), lambda t: F.struct(F.size(t).alias("n"), hits(t).alias("hits")))


def sparse_scores(rows: DataFrame, query: str, content: str = "content") -> DataFrame:
    """TF-IDF scores; rows without tokens go, rows without a hit stay at 0; an empty query gives none.

    Only the query's tokens are counted, in one pass of conditional aggregates: no term is shuffled.
    """
    return counted_scores(rows.withColumn("_terms", term_counts(F.col(content), query)), query).drop("_terms")


def counted_scores(rows: DataFrame, query: str) -> DataFrame:
    """sparse_scores of rows that have the query's term_counts as _terms: these can be joined without their texts."""
    counts = Counter(query_tokens(query))
    words = sorted(counts)
    if not words:
        return rows.limit(0).withColumn("sparse_score", F.lit(0.0))
    stats = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("_terms.hits")[i] > 0).alias(f"df{i}") for i in range(len(words))]).first()
    score = F.lit(0.0)
    for i, w in enumerate(words):
        idf = math.log((stats["n"] + 1) / (stats[f"df{i}"] + 1)) + 1
        score = score + F.col("_terms.hits")[i] / F.col("_terms.n") * idf * counts[w]
    return rows.filter("_terms.n > 0").withColumn("sparse_score", score)


def best_first(score: str, id_col: str) -> Column:
    """A key that sorts rows by score, the highest first, then id."""
    return F.struct((-F.col(score)).alias("s"), F.col(id_col).alias("id"))


def ranked_top(rows: DataFrame, score: str, id_col: str, n: int, out: str = "rank") -> DataFrame:
    """The n best rows by score, ties by id, with their rank from 1."""
    return rows.orderBy(F.desc(score), id_col).limit(n).withColumn(out, F.row_number().over(Window.orderBy(F.desc(score), id_col)))  # n rows


def ranks_of(rows: DataFrame, score: str, ids: DataFrame, id_col: str, most: int, out: str) -> DataFrame:
    """(id, rank) among all rows of those of `ids`, of which there are `most` at most; ids that rows lack are left out.

    No row but theirs is ranked: every row finds by binary search before which of their sorted keys it stands, and the rows
    counted up to a key are its rank. Ids are unique, so a key's own row is the last of them.
    """
    asked = rows.join(F.broadcast(ids), id_col, "left_semi").select(best_first(score, id_col).alias("k"))
    sorted_keys = asked.agg(F.array_sort(F.collect_list("k")).alias("keys"))  # one row
    bits = [1 << b for b in reversed(range(most.bit_length()))]
    held = rows.select(best_first(score, id_col).alias("k"), sorted_keys.scalar().alias("keys"))
    step = lambda at, bit: F.when((at + bit <= F.size("keys")) & (F.get("keys", at + bit - 1) < F.col("k")), at + bit).otherwise(at)
    counts = held.select(F.aggregate(F.array(*map(F.lit, bits)), F.lit(0), step).alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("n"))
    so_far = counts.select("place", F.sum("n").over(Window.orderBy("place")).alias(out))  # a row for each key, and one more
    placed = sorted_keys.select(F.posexplode("keys").alias("place", "k"))
    return placed.join(so_far, "place").select(F.col("k.id").alias(id_col), out)


def fuse(dense: DataFrame, sparse: DataFrame, k: int, id_col: str = "id", weights: DataFrame | None = None, least: float = min(TYPE_WEIGHT.values()), most: float = max(TYPE_WEIGHT.values())) -> DataFrame:
    """Sum of 1 / (60 + rank) over both rankings, times the row's weight if given; the k best, ties by id.

    dense has (id, dense_score), sparse (id, sparse_score), weights (id, weight from `least` to `most`, else 1); ids are unique
    and the first two may lack some. A threshold algorithm: a row beyond the first n of both lists has at most most * 2 / (60 + n + 1),
    the k best of one list have at least least / (60 + k) each. With n so large that the first is less than the second only
    the first n of either list are candidates, and only candidates are ranked.
    """
    if weights is None:
        least = most = 1.0
    n = math.ceil(2 * most / least * (RRF_K + k)) - RRF_K
    lists = [(dense.select(id_col, "dense_score"), "dense_score"), (sparse.select(id_col, "sparse_score"), "sparse_score")]
    tops = [rows.orderBy(F.desc(score), id_col).limit(n).select(id_col) for rows, score in lists]
    ids = tops[0].unionByName(tops[1]).distinct()  # 2 n at most
    d, s = (ranks_of(rows, score, ids, id_col, 2 * n, score.replace("score", "rank")) for rows, score in lists)
    part = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    both = d.join(s, id_col, "full").withColumn("rrf_score", part("dense_rank") + part("sparse_rank"))
    if weights is not None:
        both = weights.join(F.broadcast(both), id_col, "right").withColumn("rrf_score", F.col("rrf_score") * F.coalesce("weight", F.lit(1.0)))
    return both.orderBy(F.desc("rrf_score"), id_col).limit(k).select(id_col, "rrf_score")


def rebalance(rows: DataFrame, k: int, doc: str, rank: str = "rank") -> DataFrame:
    """The k rows that cover most documents: each one's best first, then up to max(2, ceil(0.6 k)) each, then any.

    rows are a bounded ranked list (a few times k). Of no more than k rows the order stays.
    """
    cap = max(2, math.ceil(k * 0.6))
    n = F.row_number().over(Window.partitionBy(F.coalesce(F.col(doc).cast("string"), F.lit("__unknown__"))).orderBy(rank))
    tiered = rows.withColumn("_tier", F.when(n == 1, 1).when(n <= cap, 2).otherwise(3)).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    tier = F.when(F.col("_all") <= k, 0).otherwise(F.col("_tier"))
    return tiered.orderBy(tier, rank).limit(k).drop("_tier", "_all")


def hybrid_search(rows: DataFrame, query: str, query_vector: list[float], k: int = 8, vectors: DataFrame | None = None) -> DataFrame:
    """rows (id, document_id, content, embedding) to the k best (id, document_id, rrf_score, rank).

    With vectors (id, embedding) rows have none of their own, and those without one there are left out. What the search needs of a
    text and of a vector is counted where they lie, so neither is shuffled.
    """
    kind = X.chunk_class(F.col("content"), F.lit(""))
    weight = F.create_map(*[F.lit(x) for pair in TYPE_WEIGHT.items() for x in pair])[kind]
    near = nearness(query_vector).alias("_near")
    read = [F.col("id"), F.col("document_id"), term_counts(F.col("content"), query).alias("_terms"), weight.alias("weight")]
    found = rows.select(*read, near) if vectors is None else rows.select(*read).join(vectors.select("id", near), "id")
    fused = fuse(near_scores(found), counted_scores(found.select("id", "_terms"), query), max(4 * k, 24), weights=found.select("id", "weight"))
    ranked = found.select("id", "document_id").join(F.broadcast(fused), "id")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rrf_score"), "id")))  # at most max(4k, 24) rows
    return rebalance(ranked, k, "document_id").select("id", "document_id", "rrf_score", "rank")


# What a role, and a pair of question and answer, add to a row's score.
ROLE_BONUS = {"answer": 0.18, "analysis": 0.14, "question": 0.08}
PAIR_BONUS = 0.16


# Roles that make a pair, and the longest excerpt of a block.
QA_SIDES = ("question", "answer", "analysis")
BLOCK_EXCERPT = 240


def qa_focus(fused: DataFrame, k: int) -> DataFrame:
    """Candidates (id, document_id, question_id, qa_role, rrf_score) with pair and score: the k best.

    fused holds the max(3k, 18) best rows of the two rankings. A pair is a document's question with an answer or analysis among
    them; rows of a pair, and rows of a role, gain by it. Ties go by rrf_score, then id.
    """
    numbered = F.nullif(F.coalesce(F.col("question_id").cast("string"), F.lit("")), F.lit(""))
    same = Window.partitionBy("document_id", "question_id")
    has = lambda *names: F.max(F.coalesce(F.col("qa_role").isin(*names), F.lit(False))).over(same)
    rows = fused.withColumn("pair", numbered.isNotNull() & has("question") & has("answer", "analysis"))
    bonus = F.coalesce(F.create_map(*[F.lit(x) for pair in ROLE_BONUS.items() for x in pair])[F.col("qa_role")], F.lit(0.0))
    score = F.col("rrf_score") + bonus + F.when(F.col("pair"), PAIR_BONUS).otherwise(0.0)
    return rows.withColumn("score", score).orderBy(F.desc("score"), F.desc("rrf_score"), "id").limit(k)


def qa_blocks(focused: DataFrame, most: int) -> DataFrame:
    """(document_id, question_id, score, block) of the `most` best pairs among focused rows (content, title, section_path beside them).

    A block has the first question's excerpt and the first answer's and analysis', in the order of scores.
    """
    place = F.struct((-F.col("score")).alias("s"), (-F.col("rrf_score")).alias("r"), F.col("id"))
    excerpt = F.nullif(X.snippet(F.coalesce("content", F.lit("")), BLOCK_EXCERPT), F.lit(""))
    rows = focused.filter(F.col("qa_role").isin(*QA_SIDES) & F.col("question_id").isNotNull()).withColumn("_at", place).withColumn("_x", excerpt).filter("_x IS NOT NULL")
    first = lambda c, cond: F.min_by(c, F.when(cond, F.col("_at")))
    sides = [first(F.when(F.col("qa_role") == r, F.col("_x")), F.col("qa_role") == r).alias(r) for r in QA_SIDES]
    named = first(F.col("section_path"), F.coalesce(F.trim("section_path"), F.lit("")) != "").alias("path")
    pairs = rows.groupBy("document_id", "question_id").agg(F.max("score").alias("score"), F.min_by("title", "_at").alias("title"), named, *sides)
    pairs = pairs.filter("question IS NOT NULL AND (answer IS NOT NULL OR analysis IS NOT NULL)").orderBy(F.desc("score"), "document_id", "question_id").limit(most)
    head = F.concat(F.lit("[QA_FOCUS::"), F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("未命名资料")), F.lit("::"), F.coalesce("path", F.lit("exam/question")), F.lit("]\n题干："))
    return pairs.select("document_id", "question_id", "score", F.concat(head, "question", F.lit("\n答案与解析："), F.concat_ws(" ", "answer", "analysis")).alias("block"))


def nearest(queries: DataFrame, rows: DataFrame, id_col: str, embedding: str, k: int, least: float, block: int = 256, chunk: int = 2048) -> DataFrame:
    """(q, id, score): for each of a stated set of queries its k nearest other rows of at least `least`; ties by id.

    Blocks of queries (some 100 KB each) meet chunks of rows (about 1 MB), and a product of matrices
    passes on a chunk's k best for each query: no pair of single rows is made.
    """

    def grouped(df: DataFrame, each: int, ids: str, vectors: str) -> DataFrame:
        part = F.pmod(F.xxhash64(id_col), F.lit(-(-max(1, df.count()) // each)))
        row = F.struct(F.col(id_col).cast("bigint").alias("i"), F.col(embedding).cast("array<double>").alias("v"))
        held = df.filter(F.size(embedding) > 0).groupBy(part.alias("_p")).agg(F.collect_list(row).alias("r"))
        return held.select(F.col("r")["i"].alias(ids), F.col("r")["v"].alias(vectors))

    def unit(vectors) -> np.ndarray:
        v = np.array(list(map(np.asarray, vectors)))
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def best(frames):
        for frame in frames:
            out = []
            for qi, qv, ri, rv in zip(frame["qi"], frame["qv"], frame["ri"], frame["rv"], strict=True):
                score = unit(qv) @ unit(rv).T
                score[np.asarray(qi)[:, None] == np.asarray(ri)[None, :]] = -2
                for i, q in enumerate(qi):
                    out += [(q, ri[j], score[i, j]) for j in np.lexsort((ri, -score[i]))[:k] if score[i, j] >= least]
            yield pd.DataFrame(out, columns=["q", id_col, "score"])

    pairs = grouped(queries, block, "qi", "qv").crossJoin(grouped(rows, chunk, "ri", "rv"))
    found = pairs.mapInPandas(best, f"q bigint, {id_col} bigint, score double")
    w = Window.partitionBy("q").orderBy(F.desc("score"), id_col)
    return found.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")


def transfer(source: DataFrame, target: DataFrame, query: str, query_vector: list[float], k: int = 6, concepts: int = 5, each: int = 2, threshold: float = 0.6, vectors: DataFrame | None = None) -> DataFrame:
    """(concept, relevance, id, score, suggested): what rows of target say on the concepts of source's best rows.

    The k best rows of source give named terms; the `concepts` most relevant are searched for in target,
    `each` rows apiece. A concept is suggested for transfer if its relevance reaches the threshold. vectors as in hybrid_search.
    """
    hits = hybrid_search(source, query, query_vector, k, vectors).select("id", "rank")
    best = source.join(F.broadcast(hits), "id")  # k rows
    rows = dense_scores(best if vectors is None else vectors.join(F.broadcast(best), "id"), query_vector).withColumn("concept", F.explode(E.named_terms(F.col("content"))))
    _, relevance = E.concept_relevance(F.col("content"), F.col("concept"), F.col("dense_score"))
    named = rows.withColumn("relevance", relevance)
    first = named.withColumn("_n", F.row_number().over(Window.partitionBy("concept").orderBy("rank"))).filter("_n = 1")  # a concept counts where it is met first
    top = first.orderBy(F.desc("relevance"), "rank", "concept").limit(concepts).select("concept", "relevance").collect()  # `concepts` rows
    out = None
    for c in top:
        vector_of = hash_vector(c["concept"], len(query_vector))
        found = hybrid_search(target, c["concept"], vector_of, each, vectors).select(F.lit(c["concept"]).alias("concept"), F.lit(c["relevance"]).alias("relevance"), "id", F.round("rrf_score", 9).alias("score"), F.lit(c["relevance"] >= threshold).alias("suggested"))
        out = found if out is None else out.unionByName(found)
    empty = source.sparkSession.createDataFrame([], "concept string, relevance double, id bigint, score double, suggested boolean")
    return out if out is not None else empty
