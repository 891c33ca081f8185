"""Cross-tokenizer alignment: union-find over the bipartite graph of overlapping tokens, then pair counting.

Two tokenizers cut the same bytes. A token of one and a token of the other are joined by an edge where their
bytes overlap; the connected components are exactly the minimal groups, that is the stretches between the
byte offsets at which tokens of both end. A component's members are expanded into its links: the pairs of a
token of each whose bytes end together. Links are counted by pair of ids over the whole corpus: a task counts
within a document first, Spark adds up, and each document's pairs are joined with the counts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import Scratch, join_groups, text_or_empty, worker_cache
from folioflow.llm.packing import tokenizer

#: Bytes of text that are aligned at once; a longer text is aligned alone.
AT_ONCE = 1 << 20
#: Rows of pair counts (24 bytes each) that are broadcast at most; beyond, they are joined by a shuffle.
MOST_SENT = 2_000_000


class Side:
    """A tokenizer with its tokens' bytes: encode() gives the ids of several texts, as arrays."""

    def __init__(self, encode, tokens: list[bytes]):
        self.encode, self.tokens = encode, tokens
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.names = [str(i).encode() + end for i in range(len(tokens)) for end in (b",", b"|", b";", b"")]

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def byte_level(ranks_path: str, pattern: str) -> Side:
    """The byte-level tokenizer, given a space before the text; names of special tokens in texts are ordinary text."""
    words = tokenizer(ranks_path, pattern)
    tokens = [words.bpe.decode_single_token_bytes(i) if words.size[i] else b"" for i in range(len(words.size))]
    return Side(lambda texts: [np.frombuffer(x, "<u4").astype(np.int64) for x in words.encode([" " + t for t in texts])], tokens)


def pieces(model_path: str) -> Side:
    """The piece tokenizer, which adds the space itself; <0xHH> is a byte and U+2581 a space."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    tokens = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))]
    return Side(lambda texts: [np.array(x, np.int64) for x in model.encode(texts, num_threads=1)], tokens)


def components(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Union-find over n nodes and the edges (left, right), all at once: each node's component, named by its least node.

    Roots of joined nodes hook onto the lesser, paths are halved until they are flat, and only edges that
    still join two components take part in the next round.
    """
    parent = np.arange(n)
    while len(left):
        a, b = parent[left], parent[right]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            above = parent[parent]
            if np.array_equal(above, parent):
                break
            parent = above
        apart = parent[left] != parent[right]
        left, right = left[apart], right[apart]
    return parent


def aligned(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups of the tokens of a and of b (numbered in order, from 0), and the links as places in a and in b.

    Ends are byte offsets of tokens that are not empty and cover the same bytes.
    """
    n_a = len(ends_a)
    ends = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")  # the bytes up to each end lie in one token of each side
    ends = ends[np.append(True, ends[1:] != ends[:-1])] if n_a else ends
    of_a, of_b = np.searchsorted(ends_a, ends, "left"), np.searchsorted(ends_b, ends, "left")
    root = components(n_a + len(ends_b), of_a, of_b + n_a)
    number = np.cumsum(root[:n_a] == np.arange(n_a)) - 1  # each component's least node is a token of a
    group_a, group_b = number[root[:n_a]], number[root[n_a:]]
    # a component's members that end where its other side has an end, too
    at = np.minimum(np.searchsorted(ends_a, ends_b, "left"), max(n_a - 1, 0))
    link_b = np.flatnonzero((ends_a[at] == ends_b) & (group_a[at] == group_b)) if n_a else np.zeros(0, np.int64)
    return group_a, group_b, at[link_b] if n_a else link_b, link_b


def spelled(a: Side, b: Side, ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> bytes:
    """The groups in order as `a1,a2|b1;a3|b2,b3`."""

    def names(ids: np.ndarray, group: np.ndarray, last: int, table: list[bytes]) -> list[bytes]:
        end = np.zeros(len(ids), np.int64)
        end[:-1] = (group[1:] != group[:-1]) * last
        end[-1:] = last
        return list(map(table.__getitem__, (ids * 4 + end).tolist()))

    code = [*names(ids_a, group_a, 1, a.names), *names(ids_b, group_b, 2, b.names)]
    order = np.lexsort((np.repeat((0, 1), (len(ids_a), len(ids_b))), np.concatenate([group_a, group_b])))  # stable: tokens stay in order
    return b"".join(map(code.__getitem__, order.tolist()))[:-1]


ROWS = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, groups string, pairs array<bigint>, times array<int>"


def sides(ranks_path: str, pattern: str, model_path: str) -> tuple[Side, Side]:
    cache, key = worker_cache(), ("sides", ranks_path, model_path)
    if key not in cache:
        cache[key] = byte_level(ranks_path, pattern), pieces(model_path)
    return cache[key]


def align_texts(a: Side, b: Side, texts: list[str], spell: bool = False) -> list[tuple]:
    """For each text (n_a, n_b, n_groups, n_links, digest of the groups, groups if `spell`, pairs of ids, times of each)."""
    none = (0, 0, 0, 0, "", "" if spell else None, [], [])
    out: list[tuple] = [none] * len(texts)
    ids = [(i, x, y) for i, x, y in zip(range(len(texts)), a.encode(texts), b.encode(texts), strict=True) if texts[i]]
    ids = [(i, x, y) for i, x, y in ids if (raw := b" " + texts[i].encode()) == a.bytes_of(x) and raw == b.bytes_of(y)]
    if not ids:
        return out
    all_a, all_b = np.concatenate([x for _, x, _ in ids]), np.concatenate([y for *_, y in ids])
    # texts one behind the other: every text ends in both, so no group spans two
    group_a, group_b, link_a, link_b = aligned(np.cumsum(a.size[all_a]), np.cumsum(b.size[all_b]))
    stop_a, stop_b = np.cumsum([len(x) for _, x, _ in ids]), np.cumsum([len(y) for *_, y in ids])
    stop_link = np.searchsorted(link_a, stop_a)
    pair = all_a[link_a] << 32 | all_b[link_b]
    start_a = start_b = start_link = 0
    for (i, x, y), end_a, end_b, end_link in zip(ids, stop_a.tolist(), stop_b.tolist(), stop_link.tolist(), strict=True):
        in_a, in_b = group_a[start_a:end_a], group_b[start_b:end_b]
        groups = spelled(a, b, x, y, in_a - in_a[0], in_b - in_a[0])
        pairs, times = np.unique(pair[start_link:end_link], return_counts=True)
        out[i] = (len(x), len(y), int(in_a[-1] - in_a[0]) + 1, end_link - start_link, hashlib.sha256(groups).hexdigest(), groups.decode() if spell else None, pairs, times)
        start_a, start_b, start_link = end_a, end_b, end_link
    return out


def aligner(ranks_path: str, pattern: str, model_path: str, spell: bool):
    """A mapInArrow function over (doc_id, text) giving ROWS; `row` is unique: the task's number, then the row's within it."""

    def run(batches):
        a, b = sides(ranks_path, pattern, model_path)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            docs, texts, start = batch.column(0), batch.column(1), 0
            size = np.cumsum(np.asarray(pa.compute.binary_length(texts).fill_null(0)))
            while start < len(docs):
                before = size[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(size, before + AT_ONCE, "right")))
                found = align_texts(a, b, texts.slice(start, stop - start).to_pylist(), spell)
                cols = list(zip(*found, strict=True))
                lists = pa.array(cols[6], pa.list_(pa.int64())), pa.array(cols[7], pa.list_(pa.int32()))
                n = stop - start
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), docs.slice(start, n), *[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string()), *lists], names=[f.split()[0] for f in ROWS.split(", ")])
                row, start = row + n, stop

    return run


def align(docs: DataFrame, scratch: Scratch, ranks_path: str, pattern: str, model_path: str, id_col: str = "doc_id", text_col: str = "text", spell: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): a row per row of docs, and a row for each pair of ids that is linked anywhere.

    documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and `groups` spelled out if `spell`.
    pairs: a_id, b_id, count (links corpus-wide), best (no pair of b_id counts more). Null and empty texts, and those
    whose tokens of either side don't spell the text with a space before it, have no tokens: zeros and empty strings. Repeated
    and null ids keep their rows; other columns of docs are not read.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    held = scratch.save(rows.mapInArrow(aligner(ranks_path, pattern, model_path, spell), ROWS), "aligned", keep=True)
    links = held.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("n"))
    counts = scratch.save(links.groupBy("pair").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("n")), "counts")
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    top = counts.groupBy(b_id.alias("b_id")).agg(F.max("count").alias("top"))
    counts = scratch.save(counts.withColumn("b_id", b_id).join(top, "b_id").select("pair", "count", (F.col("count") == F.col("top")).alias("best"), "n"), "counted", keep=True)
    joined = links.withColumnRenamed("n", "times")
    joined = joined.join(F.broadcast(counts), "pair") if counts.count() <= MOST_SENT else join_groups(joined, counts, ["pair"])
    sums = joined.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    out = held.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("n_best", "count_sum")], "groups_sha256", *["groups"] * spell)
    return out, counts.select(F.shiftright("pair", 32).alias("a_id"), b_id.alias("b_id"), "count", "best")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with Scratch(spark, "alignment") as scratch:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        return align(docs, scratch, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))[0]
