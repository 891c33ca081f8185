"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

A document is the set of its distinct word shingles. Sketching throws every shingle into one of t
bins, in rounds with fresh hashes; each bin keeps its least value, a value of an earlier round being
less than any of a later one, and the rounds go on until every bin is filled. Round t + b throws
every shingle into bin b, so each bin fills whatever the set's size. Equal coordinates of two sketches
occur with a probability of the sets' Jaccard similarity, and concentrate as independent ones do.

Documents with equal sets are one vertex. Vertices that share a band of coordinates are candidates,
confirmed on their texts' own words. In at most ROUNDS rounds, every band bucket that still holds more
than one component picks a leader out of its largest one, anew each round, and holds the members of the
others against it: a round makes no more pairs than buckets have members, and its links join most of a
group. What is still in a bucket of several components is then joined exactly: with shingles ordered from
the rarest of these documents to the most common one, two sets as similar as asked share one of their
first n - ceil(n * similarity) + 1 shingles. How much of either set comes from there on bounds what the two can share,
so a shingle's documents are joined by ranges of sizes in which that may be enough, and those of other sizes never
meet; a bound from all shared places of the two then leaves few pairs of different components to confirm. Every pair of one bucket is thus confirmed, refuted or known to
be connected: the rounds only save work, and nothing is cut off by a cap.

Bands have as many coordinates as a chance of at most MISS allows that a pair at the threshold shares
none of the BANDS bands: 7 at a similarity of 0.85, 5 at 0.8.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import Scratch, fresh_seed, join_groups, mix, span_hashes, text_or_empty, text_slices, word_hashes

BANDS, MISS, ROUNDS = 36, 1e-6, 3
#: Rounds end after one that links fewer than one in SCARCE members: the exact join does the rest.
SCARCE = 20
#: Pairs of one leader that a task holds against its text.
PAIRS_IN_TASK = 5000


def band_rows(percent: int) -> int:
    """Coordinates a band."""
    return max([1, *(r for r in range(1, 20) if (1 - (percent / 100) ** r) ** BANDS <= MISS)])


def shingle_sets(data: np.ndarray, off: np.ndarray, words_in: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, and where each document's start."""
    words, first = word_hashes(data, off, lower=True, seed=seed)
    n_docs, n_words = len(first) - 1, np.diff(first)
    doc = np.repeat(np.arange(n_docs), n_words)
    at = np.flatnonzero(np.arange(len(words)) + words_in <= first[1:][doc]) if len(words) else np.zeros(0, np.int64)
    few = np.flatnonzero((n_words > 0) & (n_words < words_in))
    starts = np.concatenate([at, first[:-1][few]])
    ends = np.concatenate([at + words_in, first[1:][few]])
    owner = np.concatenate([doc[at], few])
    hashes = span_hashes(words, starts, ends, seed)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(n_docs + 1))


def sketches(hashes: np.ndarray, start: np.ndarray, bins: int) -> np.ndarray:
    """A row of `bins` values for each set; rows of empty sets stay at the largest value."""
    n = len(start) - 1
    out = np.full(n * bins, np.uint64(2**64 - 1))
    owner = np.repeat(np.arange(n), np.diff(start))
    for i in range(2 * bins):
        if not len(hashes):
            break
        h = mix(hashes, 1000 + i)
        value = (np.uint64(i) << np.uint64(50)) | (h >> np.uint64(14))
        if i < bins:
            at = owner * bins + (mix(hashes, 9000 + i) % np.uint64(bins)).astype(np.int64)
        else:
            at = owner * bins + (i - bins)
        np.minimum.at(out, at, value)
        open_ = (out.reshape(n, bins) == np.uint64(2**64 - 1)).any(axis=1)[owner]
        hashes, owner = hashes[open_], owner[open_]
    return out.reshape(n, bins)


SKETCHED = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>"


def sketch_batches(words_in: int, rows: int, seed: int):
    """mapInArrow over (doc_id, text): the set's size, a 128-bit digest of it, and its band keys."""

    def run(batches):
        for batch in batches:
            for row, off, data in text_slices(batch.column(1)):
                n = len(off) - 1
                hashes, start = shingle_sets(data, off, words_in, seed)
                size, raw = np.diff(start), hashes.tobytes()
                ends = (start * 8).tolist()
                digests = b"".join(hashlib.blake2b(raw[i:j], digest_size=16).digest() for i, j in zip(ends, ends[1:]))
                digests = np.frombuffer(digests, np.int64).reshape(n, 2)
                sk = sketches(hashes, start, BANDS * rows).reshape(n, BANDS, rows)
                key = np.zeros((n, BANDS), np.uint64)
                for r in range(rows):
                    key = mix(key * np.uint64(31) + sk[:, :, r], 40 + r)
                key = mix(key + np.arange(BANDS, dtype=np.uint64), 60)
                filled = np.where(size > 0, BANDS, 0)
                flat = key[size > 0].ravel().view(np.int64)
                ends = np.concatenate([[0], np.cumsum(filled)])
                bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array(size, pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), bands], names=["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return run


def set_batches(words_in: int, seed: int):
    """mapInArrow over (doc_id, root, text): the shingle set as a sorted array."""

    def run(batches):
        for batch in batches:
            for row, off, data in text_slices(batch.column(2)):
                hashes, start = shingle_sets(data, off, words_in, seed)
                sets = pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([c.slice(row, len(off) - 1) for c in batch.columns[:2]] + [sets], names=["doc", "root", "shingles"])

    return run


def shingles_of(text: str, words_in: int) -> set[tuple[bytes, ...]]:
    """The set itself: tuples of words, lower-cased (A-Z) and parted at the six ASCII spaces."""
    words = text.encode().lower().split()
    return set(zip(*(words[i:] for i in range(words_in)))) if len(words) >= words_in else {tuple(words)} - {()}


def confirm_batches(words_in: int, percent: int):
    """mapInArrow over (ra, rb, text of a, text of b): those with 100 |A and B| >= percent |A or B|."""

    def run(batches):
        last, held = None, set()
        for batch in batches:
            ok = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                b = b.as_py()
                if b != last:  # rows come sorted by b
                    last, held = b, shingles_of(b, words_in)
                x = shingles_of(a.as_py(), words_in)
                both = len(x & held)
                ok.append(bool(x) and 100 * both >= percent * (len(x) + len(held) - both))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["ra", "rb"])

    return run


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """Rows (v, root): the least vertex that each vertex of the edges (a, b) reaches.

    Alternating large-star and small-star steps; each halves paths, so the rounds grow as the
    logarithm of the longest. Every step is written, and degree-heavy vertices are only grouped for
    a minimum, never collected.
    """
    now = scratch.save(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0", keep=True)
    k, before = 0, None
    while True:
        k += 1
        # large star: every greater neighbour goes to the least one
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: every lesser neighbour, and the vertex itself, to the least one
        large = large.distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        now = scratch.save(small, f"{name}-{k}", keep=True)
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            return now.select(F.col("a").alias("v"), F.col("b").alias("root")).union(now.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())
        before = state


def within_bounds(placed: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of rows (token, r, root, n, rest, top) of different roots that meet at a token and may be alike, each once.

    A pair shares at most the lesser rest of a token at which it meets first, so for the row x with that rest all y of a certain
    range of sizes are in question: none where the rest is too small, which is known before anything is joined. Sizes are dealt to buckets that
    grow by a twentieth, and a row meets only those of its range.
    """
    bucket = lambda n: F.floor(F.log(n) / F.log(F.lit(1.05))).cast("int")
    low, high = F.expr(f"(n * {percent} + 99) div 100"), F.expr(f"({100 + percent} * rest - {percent} * n) div {percent}")
    asking = placed.withColumn("low", low).withColumn("high", high).filter("low <= high").withColumn("_b", F.explode(F.sequence(bucket(F.col("low")), bucket(F.col("high")))))
    xs = asking.select("token", "_b", F.col("r").alias("x"), F.col("root").alias("rx"), F.col("rest").alias("ex"), "low", "high", (F.col("root") == F.col("top")).alias("in_top"))
    ys = placed.select("token", bucket(F.col("n")).alias("_b"), F.col("r").alias("y"), F.col("root").alias("ry"), F.col("n").alias("ny"), F.col("rest").alias("ey"), "top")
    fits = F.expr("rx <> ry AND ex <= ey AND ny BETWEEN low AND high")
    # members of the largest component meet only those of others
    met = xs.filter("NOT in_top").join(ys, ["token", "_b"]).filter(fits).select("x", "y").unionByName(xs.filter("in_top").join(ys.filter("ry <> top"), ["token", "_b"]).filter(fits).select("x", "y"))
    return met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def near_dedup(docs: DataFrame, scratch: Scratch, words_in: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows doc_id, n_shingles, component_id, kept: a row per row of docs.

    Words are lower-cased (A-Z) runs without the six ASCII spaces. A document with fewer words than a
    shingle has its whole sequence as one; without words (or text) its set is empty and linked with
    nothing, not even another such. component_id is the least id reachable over links, kept whether it
    is the row's own. Rows that repeat an id count as copies if their sets are equal, else by either
    set; rows with a null id are left out of links, get a null component and are kept. An empty table gives
    none.
    """
    seed = fresh_seed()
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    base = scratch.save(source.mapInArrow(sketch_batches(words_in, band_rows(percent), seed), SKETCHED), "sketched", keep=True)
    own = ["n_shingles", "set_a", "set_b"]
    filled = base.filter("n_shingles > 0 and doc_id is not null")
    reps = scratch.save(filled.groupBy(*own).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "reps")
    member = scratch.save(join_groups(filled.select("doc_id", *own), reps, own).select("doc_id", "rep", *own).distinct(), "members", keep=True)
    vertex = filled.join(reps.drop("n"), (filled["doc_id"] == reps["rep"]) & (filled["set_a"] == reps["set_a"]) & (filled["set_b"] == reps["set_b"])).select("rep", filled["n_shingles"], "bands").dropDuplicates(["rep", "n_shingles", "bands"])
    banded = vertex.select("rep", "n_shingles", F.explode("bands").alias("band"))
    crowd = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band")
    bucket = scratch.save(banded.join(crowd, "band").withColumn("root", F.col("rep")), "buckets", keep=True)
    # texts of all vertices that share a bucket
    needed = bucket.select(F.col("rep").alias("_r")).distinct()
    texts = scratch.save(source.join(needed, source["doc_id"] == needed["_r"], "left_semi"), "texts", keep=True)
    alike = F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")  # others differ too much in size to be linked

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """Edges between the components of linked pairs; a leader of many pairs is dealt to several tasks."""
        once = scratch.save(pairs.select("a", "b", "ra", "rb").distinct(), f"{name}-pairs")
        loads = scratch.save(once.groupBy("b").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.expr(f"(n - 1) div {PAIRS_IN_TASK} + 1")), f"{name}-loads")
        dealt = join_groups(once, loads, ["b"]).withColumn("salt", F.pmod(F.xxhash64("a"), F.col("k")))
        x = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
        y = texts.join(loads, F.col("doc_id") == F.col("b")).select("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)).alias("salt"), F.col("text").alias("tb"))
        full = dealt.join(x, "a").join(y.hint("shuffle_merge"), ["b", "salt"]).select("ra", "rb", "ta", "tb")
        return scratch.save(full.mapInArrow(confirm_batches(words_in, percent), "ra bigint, rb bigint").distinct(), name, keep=True)

    def unsettled(rows: DataFrame, key: str, name: str) -> DataFrame:
        """Rows of buckets with more than one component, with the largest one as top."""
        parts = rows.groupBy(key, "root").agg(F.count(F.lit(1)).alias("c"))
        several = parts.groupBy(key).agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("c", "root")).alias("t")).filter("k > 1")
        return scratch.save(rows.join(several.select(key, F.col("t.root").alias("top")), key), name, keep=True)

    edges = member.select(F.col("doc_id").alias("ra"), F.col("rep").alias("rb")).filter("ra <> rb")  # repeated ids may join sets
    for k in range(ROUNDS):
        open_ = unsettled(bucket, "band", f"open-{k}")
        leader = open_.filter("root = top").groupBy("band").agg(F.min(F.struct(F.xxhash64("rep", F.lit(k)).alias("h"), F.col("rep").alias("b"), F.col("n_shingles").alias("nb"))).alias("l"))
        leader = leader.select("band", "l.b", "l.nb")
        rest = open_.filter("root <> top").select("band", F.col("rep").alias("a"), F.col("n_shingles").alias("na"), F.col("root").alias("ra"), F.col("top").alias("rb"))
        found = confirmed(rest.join(leader, "band").filter(alike), f"round-{k}")
        bucket = open_.drop("top")
        links = found.count()
        if not links:
            break
        edges = edges.union(found)
        joined = components(scratch, found.toDF("a", "b"), f"joined-{k}").select("v", F.col("root").alias("to"))
        bucket = bucket.join(joined, bucket["root"] == joined["v"], "left").select("rep", "n_shingles", "band", F.coalesce("to", "root").alias("root"))
        if links * SCARCE < rest.count():
            break
    left = unsettled(bucket, "band", "open-last").select(F.col("rep").alias("_v"), "root").distinct()
    sets = texts.join(left, F.col("doc_id") == F.col("_v")).select("doc_id", "root", "text").mapInArrow(set_batches(words_in, seed), "doc bigint, root bigint, shingles array<bigint>")
    sets = scratch.save(sets.withColumn("r", F.monotonically_increasing_id()), "sets")  # r tells rows of one id apart
    rows = scratch.save(sets.select("r", F.explode("shingles").alias("token")), "tokens")
    counts = scratch.save(rows.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("df", F.col("n")), "token-counts")
    shared = join_groups(rows, counts, ["token"]).groupBy("r").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("common"))
    sized = sets.select("r", F.col("doc").alias("a"), "root", F.size("shingles").cast("bigint").alias("na")).join(shared, "r")
    alone = F.col("na") - F.size("common")  # shingles of no other document come first of all
    prefix = F.expr(f"na - (na * {percent} + 99) div 100 + 1") - alone
    first = F.slice(F.col("common")["token"], F.lit(1), F.greatest(prefix, F.lit(0)).cast("int"))
    lists = scratch.save(sized.filter(prefix > 0).select("r", "a", "root", "na", alone.alias("alone"), first.alias("some")), "lists")
    # a row for each shingle of the prefix: what of the set comes from there on bounds what a pair that meets there first can share
    placed = lists.select("r", "root", F.col("na").alias("n"), "alone", F.posexplode("some").alias("place", "token"))
    placed = unsettled(placed.select("token", "r", "root", "n", (F.col("n") - F.col("alone") - F.col("place")).alias("rest")), "token", "prefixes")
    near = scratch.save(within_bounds(placed, percent), "met")
    # lists are fetched for the pairs left; no more can be shared than those of both lists, and what follows the last of them on either side
    x = near.join(lists.select(F.col("r").alias("x"), "a", F.col("root").alias("ra"), "na", F.col("alone").alias("la"), F.col("some").alias("pa")), "x")
    y = lists.select(F.col("r").alias("y"), F.col("a").alias("b"), F.col("root").alias("rb"), F.col("na").alias("nb"), F.col("alone").alias("lb"), F.col("some").alias("pb"))
    both = "array_intersect(pa, pb)"
    last = f"element_at({both}, -1)"
    bound = f"size({both}) + least(na - la - array_position(pa, {last}), nb - lb - array_position(pb, {last}))"
    met = x.join(y, "y").filter(F.expr(f"({bound}) * {100 + percent} >= {percent} * (na + nb)")).select("a", "b", "ra", "rb")
    edges = edges.union(confirmed(met, "across"))
    whole = components(scratch, edges.toDF("a", "b"), "last")
    least = base.select("doc_id", "n_shingles").join(whole, base["doc_id"] == whole["v"], "left")
    component = F.coalesce("root", "doc_id")
    return least.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark, "near-dedup") as scratch:
        return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch, words_in=3, percent=85)
