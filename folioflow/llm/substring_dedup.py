"""Removal of repeated passages by recompression.

A document's words are compressed in rounds, each locally: first runs of one word get a symbol, then
neighbouring symbols (a, b) with a on the left and b on the right side of a partition by their names'
hash are merged. A name is a hash of what it stands for, so equal runs and pairs get the same name in
every document and on every executor. Each symbol knows its context, the words that decided it; where
two texts agree on the context, both have the symbol.

Every window of `window` words takes as its anchor one symbol whose context it holds: of the highest
level that has any, that with the least hash (or itself, where no level has one). Equal windows have
equal anchors, so:

1. names of anchors are counted over the corpus; a window may repeat only if its anchor's name does;
2. long segments, cut where a symbol's hash says so, are compared: inside a segment that stands
   earlier too, every window repeats;
3. the other windows with a shared anchor are compared, and each that isn't the first of its kind
   marks its words.

Words, windows and segments are told apart by polynomials over a prime field of 2**61 at points that
the driver draws for the run: no text can be written to collide, and 93 bits (windows) or 122
(segments) leave no chance worth the name that two different ones ever do.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import Scratch, fresh_seed, join_groups, mix, span_hashes, text_or_empty, text_slices, word_hashes

PAIR_ROUNDS = 3
#: A segment ends at one in so many symbols of the highest level.
SEGMENT = 24
LOWEST = -(2**63)


class Symbols:
    """One level of all documents of a slice: names, spans and contexts, in words of the slice."""

    def __init__(self, name, start, end, left, right, doc):
        self.name, self.start, self.end, self.left, self.right, self.doc = name, start, end, left, right, doc


def runs(words: np.ndarray, doc: np.ndarray) -> Symbols:
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(words))
    name = mix(words[start] + np.uint64(0x9E37) * (end - start).astype(np.uint64), 21)
    # both neighbours show that the run ends; at a document's edge no window holds the context
    return Symbols(name, start, end, start - 1, end + 1, doc[start])


def merge_pairs(s: Symbols, rnd: int) -> Symbols:
    n = len(s.name)
    right_side = (mix(s.name, 300 + rnd) & np.uint64(1)).astype(bool)
    same = s.doc[1:] == s.doc[:-1]
    pair = np.zeros(n, bool)
    pair[:-1] = ~right_side[:-1] & right_side[1:] & same
    second = np.zeros(n, bool)
    second[1:] = pair[:-1]
    left, right = s.left.copy(), s.right.copy()
    # a left-side symbol stays single because of what follows it, a right-side one because of what precedes it
    single_l, single_r = ~right_side & ~pair, right_side & ~second
    right[:-1] = np.where(single_l[:-1] & same, s.right[1:], right[:-1])
    left[1:] = np.where(single_r[1:] & same, s.left[:-1], left[1:])
    name, end = s.name.copy(), s.end.copy()
    i = np.flatnonzero(pair)
    name[i] = mix(s.name[i] * np.uint64(5) + mix(s.name[i + 1], 23), 400 + rnd)
    end[i], right[i] = s.end[i + 1], s.right[i + 1]
    keep = ~second
    return Symbols(name[keep], s.start[keep], end[keep], left[keep], right[keep], s.doc[keep])


def levels(words: np.ndarray, doc: np.ndarray) -> list[Symbols]:
    out = [runs(words, doc)]
    for rnd in range(PAIR_ROUNDS):
        out.append(merge_pairs(out[-1], rnd))
    return out


def least_in_ranges(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The index of the least value in each [lo, hi), none of them empty."""
    best = np.arange(len(values))
    tables, width = [best], 1
    longest = int((hi - lo).max()) if len(lo) else 1
    while 2 * width <= longest:
        prev = tables[-1]
        a, b = prev[: len(prev) - width], prev[width:]
        tables.append(np.where(values[b] < values[a], b, a))
        width *= 2
    k = np.frexp((hi - lo).astype(float))[1] - 1
    out = np.empty(len(lo), np.int64)
    for level in np.unique(k):
        at = k == level
        a, b = tables[level][lo[at]], tables[level][hi[at] - (1 << level)]
        out[at] = np.where(values[b] < values[a], b, a)
    return out


def anchored_windows(words: np.ndarray, first: np.ndarray, window: int, seed: int = 0):
    """For each window its start, its anchor's key and the anchor itself; and the top level."""
    n_words = np.diff(first)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    starts = np.flatnonzero(np.arange(len(words)) + window <= first[1:][doc]) if len(words) else np.zeros(0, np.int64)
    key = np.zeros(len(starts), np.uint64)
    anchor = -1 - np.arange(len(starts))
    open_ = np.ones(len(starts), bool)
    all_ = levels(words, doc) if len(words) else []
    for depth in range(len(all_) - 1, -1, -1):
        s = all_[depth]
        todo = np.flatnonzero(open_)
        if not len(todo):
            break
        p = starts[todo]
        lo = np.searchsorted(s.left, p, "left")
        hi = np.searchsorted(s.right, p + window, "right")
        has = hi > lo
        todo, lo, hi = todo[has], lo[has], hi[has]
        if not len(todo):
            continue
        at = least_in_ranges(mix(s.name, 31), lo, hi)
        some = np.unique(at)
        context = np.zeros(len(s.name), np.uint64)
        context[some] = mix(span_hashes(words, s.left[some], s.right[some], seed) ^ s.name[some], 50 + depth)
        key[todo] = context[at]
        anchor[todo] = (depth << 40) + at
        open_[todo] = False
    rest = np.flatnonzero(open_)
    key[rest] = mix(span_hashes(words, starts[rest], starts[rest] + window, seed), 49)
    return starts, key, anchor, doc, all_[-1] if all_ else None


def segments(words: np.ndarray, top: Symbols, window: int):
    """Start, end and document of the segments of at least a window's length; they overlap by a window less a word."""
    cut = (mix(top.name, 33) % np.uint64(SEGMENT)) == 0
    edge = np.ones(len(top.name), bool)
    edge[1:] = cut[1:] | (top.doc[1:] != top.doc[:-1])
    at = np.flatnonzero(edge)
    start = top.start[at]
    last = np.append(at[1:], len(top.name)) - 1
    end = top.end[last]
    # up to window - 1 words of what follows in the document: then every window lies in a segment
    doc_end = np.zeros(int(top.doc.max()) + 1, np.int64)
    np.maximum.at(doc_end, top.doc, top.end)
    end = np.minimum(end + window - 1, doc_end[top.doc[at]])
    long = end - start >= window
    start, end, doc = start[long], end[long], top.doc[at][long]
    return start, end, doc


def lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.ListArray:
    ends = np.searchsorted(owner, np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


SCANNED = "doc_id bigint, th bigint, n_words bigint, sha string, keys array<bigint>, seg_hash array<bigint>, seg_other array<bigint>, seg_start array<bigint>"


def scan_batches(window: int, seed: int):
    """mapInArrow over (doc_id, th, text): words, their digest, anchor keys and segments."""

    def run(batches):
        for batch in batches:
            for row, off, data in text_slices(batch.column(2)):
                n, raw = len(off) - 1, data.tobytes()
                words, first = word_hashes(data, off, seed=seed)
                sha = [hashlib.sha256(b" ".join(raw[off[i] : off[i + 1]].split())).hexdigest() for i in range(n)]
                starts, key, anchor, doc, top = anchored_windows(words, first, window, seed)
                # all windows with one anchor count once: they stand in a row
                owner = doc[starts]
                new = np.ones(len(key), bool)
                new[1:] = anchor[1:] != anchor[:-1]
                keys = lists(key[new].view(np.int64), owner[new], n)
                if top is not None and len(top.name):
                    s, e, d = segments(words, top, window)
                    other, _ = word_hashes(data, off, seed=seed + 1)
                    h = [lists(span_hashes(w, s, e, k).view(np.int64), d, n) for w, k in ((words, seed), (other, seed + 1))]
                else:
                    s = d = np.zeros(0, np.int64)
                    h = [lists(s, d, n)] * 2
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n), batch.column(1).slice(row, n), pa.array(np.diff(first), pa.int64()), pa.array(sha), keys, *h, lists(s - first[d], d, n)],
                    names=["doc_id", "th", "n_words", "sha", "keys", "seg_hash", "seg_other", "seg_start"],
                )

    return run


WINDOWS = "doc_id bigint, th bigint, covered array<bigint>, h1 array<bigint>, h2 array<int>, pos array<int>"


def window_batches(window: int, seed: int):
    """mapInArrow over (doc_id, th, text, keys, segs): windows with a shared anchor outside the known segments.

    covered holds the starts of windows inside segments that stand earlier too.
    """

    def run(batches):
        for batch in batches:
            keys_of, segs_of = batch.column(3), batch.column(4)
            for row, off, data in text_slices(batch.column(2)):
                n = len(off) - 1
                words, first = word_hashes(data, off, seed=seed)
                other, _ = word_hashes(data, off, seed=seed + 1)
                starts, key, _, doc, top = anchored_windows(words, first, window, seed)
                owner = doc[starts]
                key = key.view(np.int64)
                known = np.zeros(len(words) + 1, np.int64)
                if top is not None and len(top.name):
                    s, e, d = segments(words, top, window)
                    mine = segs_of.slice(row, n)
                    wanted = np.asarray(mine.flatten()) + np.repeat(first[:-1], np.diff(np.asarray(mine.offsets)))
                    dup = np.isin(s, wanted)
                    np.add.at(known, s[dup], 1)
                    np.add.at(known, e[dup] - window + 1, -1)
                inside = np.cumsum(known)[starts] > 0
                some = keys_of.slice(row, n)
                pairs = np.asarray(some.flatten()), np.repeat(np.arange(n), np.diff(np.asarray(some.offsets)))
                # (document, key) pairs as one number; a false match only compares one window more
                fold = lambda k, o: mix(k.view(np.uint64) + o.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 3)
                shared = np.isin(fold(key, owner), fold(pairs[0], pairs[1])) & ~inside
                p = starts[shared]
                h1 = span_hashes(words, p, p + window, seed).view(np.int64)
                h2 = span_hashes(other, p, p + window, seed + 1).view(np.int64).astype(np.int32)  # 93 bits in all
                c = starts[inside]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n), batch.column(1).slice(row, n), lists(c - first[owner[inside]], owner[inside], n), lists(h1, owner[shared], n), lists(h2, owner[shared], n), lists((p - first[owner[shared]]).astype(np.int32), owner[shared], n)],
                    names=["doc_id", "th", "covered", "h1", "h2", "pos"],
                )

    return run


REMOVED = "doc_id bigint, th bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string"


def remove_batches(window: int):
    """mapInArrow over (doc_id, th, text, starts of repeated windows)."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc, th, text, starts in zip(*batch.columns, strict=True):
                words = text.as_py().encode().split()  # of bytes: parts at the six ASCII spaces
                gone = np.zeros(len(words) + 1, np.int64)
                p = np.asarray(starts.values)
                np.add.at(gone, p, 1)
                np.add.at(gone, p + window, -1)
                gone = np.cumsum(gone)[:-1] > 0
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                rows.append((doc.as_py(), th.as_py(), len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "th", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, scratch: Scratch, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Remove each word that a repeated window covers.

    Returns two tables: (doc_id, n_words, n_removed, kept_sha256) with a row per row of docs, and
    (doc_id, n_words, n_removed, kept_sha256, kept_text) for the documents that lose words.

    Words are runs of anything but the six ASCII spaces, unchanged. A window repeats if its words also
    start earlier: in a smaller doc_id or earlier in the same document; windows are judged on the
    input. A null text has no words, a null id is smaller than any other. Rows that repeat an id are
    not earlier than each other. An empty table gives none; other columns are left out.
    """
    source = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(LOWEST)).alias("doc_id"), text_or_empty(text_col).alias("text"))
    source = source.select("doc_id", F.xxhash64("text").alias("th"), "text")
    seed = 2 * fresh_seed()
    scanned = scratch.save(source.mapInArrow(scan_batches(window, seed), SCANNED), "scanned")
    base = scratch.save(scanned.select("doc_id", "th", "n_words", "sha"), "base", keep=True)
    unique = scanned.agg((F.count(F.lit(1)) == F.count_distinct("doc_id")).alias("u")).first()["u"]
    row = ["doc_id"] if unique else ["doc_id", "th"]  # repeated ids: tell rows apart by their text
    anchors = scanned.select(*row, F.explode("keys").alias("key"))
    shared = scratch.save(anchors.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "anchor-counts")
    mine = scratch.save(join_groups(anchors, shared, ["key"]).groupBy(*row).agg(F.collect_set("key").alias("keys")), "shared")  # within one document
    seg = scanned.select(*row, F.explode(F.arrays_zip("seg_hash", "seg_other", "seg_start")).alias("s")).select(*row, F.col("s.seg_hash").alias("hash"), F.col("s.seg_other").alias("other"), F.col("s.seg_start").alias("start"))
    firsts = seg.groupBy("hash", "other").agg(F.min(F.struct("doc_id", "start")).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash", "other", F.col("f.doc_id").alias("fd"), F.col("f.start").alias("fs"), "n")
    firsts = scratch.save(firsts, "first-segments")
    again = join_groups(seg, firsts, ["hash", "other"]).filter("doc_id <> fd or start <> fs").groupBy(*row).agg(F.collect_set("start").alias("segs"))
    again = scratch.save(again, "segments")
    both = mine.join(again, row, "left").select(*row, "keys", F.coalesce("segs", F.array().cast("array<bigint>")).alias("segs"))
    near = scratch.save(source.join(both, row), "near")
    scratch.forget(scanned)
    found = scratch.save(near.select("doc_id", "th", "text", "keys", "segs").mapInArrow(window_batches(window, seed), WINDOWS), "windows")
    one = found.select(*row, F.explode(F.arrays_zip("h1", "h2", "pos")).alias("w")).select(*row, "w.h1", "w.h2", "w.pos")
    first = one.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "pos")).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2", F.col("f.doc_id").alias("fd"), F.col("f.pos").alias("fp"), "n")
    first = scratch.save(first, "first-windows")
    marks = join_groups(one, first, ["h1", "h2"]).filter("doc_id <> fd or pos <> fp").groupBy(*row).agg(F.collect_set("pos").alias("marks"))
    marks = scratch.save(marks, "marks")
    covered = found.filter(F.size("covered") > 0).select(*row, "covered")
    starts = marks.join(covered, row, "full").select(*row, F.concat(F.coalesce("marks", F.array().cast("array<bigint>")), F.coalesce("covered", F.array().cast("array<bigint>"))).alias("starts"))
    removed = near.join(starts, row).select("doc_id", near["th"], "text", "starts").mapInArrow(remove_batches(window), REMOVED)
    removed = scratch.save(removed, "removed", keep=True)
    lost = removed.select(*row).distinct()
    own = F.when(F.col("doc_id") != LOWEST, F.col("doc_id")).alias("doc_id")
    rest = base.join(lost, row, "left_anti").select(own, "n_words", F.lit(0).cast("bigint").alias("n_removed"), F.col("sha").alias("kept_sha256"))
    removed = removed.select(own, "n_words", "n_removed", "kept_sha256", "kept_text")
    return rest.unionByName(removed.drop("kept_text")), removed


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark, "substring-dedup") as scratch:
        return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch)[0]
