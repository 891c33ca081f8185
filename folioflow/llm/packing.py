"""Packing token sequences by minimum bin slack.

Every document is tokenized where it is read. Whole windows of `capacity` ids are sequences of
their own; the remainders, each shorter than the window, are packed. All that packing needs of them
is how many there are of each length: at most capacity - 1 counts, whatever the corpus. On these the
driver plans: a window is seeded with the longest length left, and a bitset subset-sum (a bit per
reachable fill) over the remaining lengths finds the multiset that fills it closest to capacity,
which backtracking turns into a count per length. That pattern is used as often as the counts allow,
which exhausts one length at least, so there are fewer than 2 * capacity patterns. Each remainder
then finds its window and offset from its rank among the remainders of its length.
"""

from __future__ import annotations

import base64
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.common import Scratch, text_or_empty, worker_cache

END = 0
#: The vocabulary's added token: the library cuts texts at it and gives its id.
ADDED, ADDED_ID = "<|endoftext|>", 50256
#: A space before a character that can't be white space: no pre-token of the vocabulary's pattern spans it.
CUT = re.compile(r"(?= [!-~À-߿])")
#: A space that anything else follows.
ODD = re.compile(r" (?![!-~À-߿])")
#: Words whose ids a worker keeps (about 60 MB).
WORDS_KEPT = 250_000
#: Rows of counts (24 bytes each) that are broadcast at most.
MOST_SENT = 2_000_000


class WordTokenizer:
    """Ids of the byte-level BPE as bytes (32 bit, little endian), word by word from a bounded memory.

    Texts are cut only where the vocabulary's own pattern always cuts, so a text's ids are those of
    its words in turn; the words not yet known in a batch are encoded together. A test holds the ids
    against the tokenizers library's. To encode() the added token's name is ordinary text; encode_added()
    is the library's default.
    """

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, rank in ranks.items():
            self.size[rank] = len(piece)
        self.known: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        if not words:
            return
        joined = [w.encode() for w in words]
        ids = self.bpe.encode_to_numpy(b"".join(joined).decode(), disallowed_special=())
        ends = np.cumsum(np.fromiter(map(len, joined), np.int64, len(joined)))
        at = np.searchsorted(np.cumsum(self.size[ids]), ends, "left") + 1
        raw = ids.astype("<u4").tobytes()
        stops = (at * 4).tolist()
        self.known.update(zip(words, map(raw.__getitem__, map(slice, [0, *stops[:-1]], stops)), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        split = []
        for text in texts:
            if ODD.search(text):
                split.append(CUT.split(text))
            else:
                first, *rest = text.split(" ")
                split.append([first, *[" " + w for w in rest]])
        new = set(itertools.chain.from_iterable(split))
        new.discard("")
        new.difference_update(self.known)
        if len(self.known) + len(new) > WORDS_KEPT:
            self.known, new = {}, set(itertools.chain.from_iterable(split)) - {""}
        new = list(new)
        # only words that start as CUT does are safe after any other: the rest are encoded alone
        self.learn([w for w in new if CUT.match(w)])
        for w in new:
            if not CUT.match(w):
                self.known[w] = self.bpe.encode_to_numpy(w, disallowed_special=()).astype("<u4").tobytes()
        self.known[""] = b""
        return [b"".join(map(self.known.__getitem__, words)) for words in split]

    def encode_added(self, texts: list[str]) -> list[bytes]:
        parts = [text.split(ADDED) for text in texts]
        ids = iter(self.encode(list(itertools.chain.from_iterable(parts))))
        added = np.array([ADDED_ID], "<u4").tobytes()
        return [added.join(itertools.islice(ids, len(p))) for p in parts]


def tokenizer(ranks_path: str, pattern: str) -> WordTokenizer:
    cache, key = worker_cache(), ("bpe", ranks_path)
    if key not in cache:
        cache[key] = WordTokenizer(ranks_path, pattern)
    return cache[key]


PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, part bigint, rank bigint"


def pieces_of(ranks_path: str, pattern: str, capacity: int, rows_at_once: int = 400):
    """A mapInArrow function over (doc_id, text): the pieces of each document.

    `part` is this task's number and `rank` numbers its remainders of each length from 0: the same
    files in the same splits give the same places.
    """

    def run(batches):
        bpe, part = tokenizer(ranks_path, pattern), TaskContext.get().partitionId()
        used = np.zeros(capacity + 1, np.int64)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                some = batch.slice(at, rows_at_once)
                out = []
                for doc, raw in zip(some.column(0).to_pylist(), bpe.encode_added(some.column(1).to_pylist()), strict=True):
                    raw += end
                    n = len(raw) // 4
                    for start in range(0, n, capacity):
                        ids = raw[4 * start : 4 * (start + capacity)]
                        size = len(ids) // 4
                        out.append((doc, start, size, ids, n, part, used[size].item()))
                        used[size] += 1
                cols = list(zip(*out, strict=True))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "part", "rank"])

    return run


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths (at most counts[length] of each) whose sum is closest to room from below."""
    full, reach, steps = (1 << (room + 1)) - 1, 1, []
    for size in sorted((s for s in counts if s <= room), reverse=True):
        left, take = min(counts[size], room // size), 1
        while left > 0:  # 1, 2, 4, ... copies at a time reach every count
            take = min(take, left)
            steps.append((size, take, reach))
            reach |= (reach << (size * take)) & full
            left -= take
            take *= 2
        if reach >> room:
            break
    at, used = reach.bit_length() - 1, {}
    for size, take, before in reversed(steps):
        if not before >> at & 1:
            at -= size * take
            used[size] = used.get(size, 0) + take
    return used


def plan_windows(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (count per length) and how many windows use each, together using every piece once."""
    left, plan = {s: n for s, n in counts.items() if n > 0}, []
    while left:
        seed = max(left)
        rest = left | {seed: left[seed] - 1}
        pattern = fill({s: n for s, n in rest.items() if n}, capacity - seed)
        pattern[seed] = pattern.get(seed, 0) + 1
        times = min(left[s] // k for s, k in pattern.items())
        plan.append((pattern, times))
        for s, k in pattern.items():
            left[s] -= k * times
            if not left[s]:
                del left[s]
    return plan


def places(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first sequence, pieces a sequence, offset): where ranks of a length go."""
    rows, given, sequence = [], {}, 0
    for pattern, times in plan:
        offset = 0
        for size in sorted(pattern, reverse=True):
            k, first = pattern[size], given.get(size, 0)
            rows.append((size, first, first + k * times, sequence, k, offset))
            given[size] = first + k * times
            offset += k * size
        sequence += times
    return rows


def pack(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Pack the token ids of docs, each document's followed by id 0, into windows of `capacity` ids.

    Rows: doc_id, start, length, ids (unsigned 32-bit, little endian), doc_tokens, sequence_id,
    offset, padding (ids to add after the sequence: up to capacity, none if its length is a power of
    two). A null or empty text is the one id 0. Repeated rows are packed as often as they occur; null
    ids stay null. An empty table gives no rows; other columns are left out.
    """
    spark = docs.sparkSession
    with Scratch(spark, "packing") as scratch:
        source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
        cut = scratch.save(source.mapInArrow(pieces_of(ranks_path, pattern, capacity), PIECES), "pieces", keep=True)
        short = cut.filter(F.col("length") < capacity)
        counts = short.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
        before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        counts = scratch.save(counts.select("part", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")), "counts", keep=True)
        totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # below capacity rows
        plan = plan_windows(totals, capacity)
        filled = [sum(s * k for s, k in p.items()) for p, _ in plan]
        rows = [(*r, 0) for r in places(plan)]
        ends = list(itertools.accumulate(t for _, t in plan))
        fill_of = lambda seq: filled[int(np.searchsorted(ends, seq, "right"))]
        rows = [(a, b, c, d, e, f, fill_of(d)) for a, b, c, d, e, f, _ in rows]
        table = spark.createDataFrame(rows, "_l bigint, _from bigint, _to bigint, _seq bigint, _each bigint, _off bigint, _fill bigint")
        # rows by task and length: broadcast within a checked size, else joined by a shuffle
        how = "broadcast" if counts.count() <= MOST_SENT else "shuffle_hash"
        ranked = short.join(counts.hint(how).select(F.col("part").alias("_p"), F.col("length").alias("_pl"), "ahead"), (F.col("part") == F.col("_p")) & (F.col("length") == F.col("_pl")))
        ranked = ranked.withColumn("_rank", F.col("ahead") + F.col("rank"))
        # fewer than 2 * capacity patterns of at most 45 lengths (1 + 2 + ... + 45 > 1024): a bounded table
        put = ranked.join(F.broadcast(table), (F.col("length") == F.col("_l")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
        nth = F.col("_rank") - F.col("_from")
        size = F.col("_fill")
        padding = F.when(F.bit_count(size) == 1, 0).otherwise(capacity - size)
        out = ["doc_id", "start", "length", "ids", "doc_tokens"]
        packed = put.select(*out, (F.col("_seq") + F.expr("(_rank - _from) div _each")).alias("sequence_id"), (F.col("_off") + nth % F.col("_each") * F.col("length")).alias("offset"), padding.cast("bigint").alias("padding"))
        # whole windows: numbered after all packed ones, by the parts' counts of them
        whole = cut.filter(F.col("length") == capacity)
        fulls = whole.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
        first = fulls.select(F.col("part").alias("_p"), (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n") + (ends[-1] if ends else 0)).alias("_first"))  # a row per task
        first = scratch.save(first, "first", keep=True)
        full = whole.join(first, F.col("part") == F.col("_p")).select(*out, (F.col("_first") + F.col("rank")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"), F.lit(0).cast("bigint").alias("padding"))
        return packed.unionByName(full)


#: Two numbers for each stretch are broadcast up to so many stretches.
MOST_STRETCHES = 500_000
PLACED = "stretch bigint, doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence bigint, offset bigint, padding bigint"


def packed_stretch(ranks_path: str, pattern: str, capacity: int, rows_at_once: int = 400):
    """An applyInArrow function over a stretch's rows (stretch, row, doc_id, text): its pieces, placed.

    Pieces of a length take their places in the order of rows, and sequences are numbered from 0 by
    their first piece in that order.
    """

    def run(table: pa.Table) -> pa.Table:
        bpe, end = tokenizer(ranks_path, pattern), np.array([END], "<u4").tobytes()
        table = table.sort_by("row")
        pieces = []
        for at in range(0, table.num_rows, rows_at_once):
            some = table.slice(at, rows_at_once)
            for doc, raw in zip(some.column("doc_id").to_pylist(), bpe.encode_added(some.column("text").to_pylist()), strict=True):
                raw += end
                pieces += [(doc, start, min(capacity, len(raw) // 4 - start), raw[4 * start : 4 * (start + capacity)], len(raw) // 4) for start in range(0, len(raw) // 4, capacity)]
        size = np.array([p[2] for p in pieces], np.int64)
        lengths, counts = np.unique(size[size < capacity], return_counts=True)
        plan = plan_windows(dict(zip(lengths.tolist(), counts.tolist(), strict=True)), capacity)
        n = sum(times for _, times in plan)
        sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        at = {s: np.flatnonzero(size == s) for s in lengths.tolist()}
        for s, first, stop, seq, each, off in places(plan):
            nth = np.arange(stop - first)
            sequence[at[s][first:stop]] = seq + nth // each
            offset[at[s][first:stop]] = off + nth % each * s
        whole = np.flatnonzero(size == capacity)
        sequence[whole] = n + np.arange(len(whole))
        filled = np.bincount(sequence, size, n + len(whole)).astype(np.int64)
        padding = np.where(filled & (filled - 1) == 0, 0, capacity - filled)[sequence]
        _, head = np.unique(sequence, return_index=True)
        number = np.empty(len(head), np.int64)
        number[np.argsort(head)] = np.arange(len(head))
        doc, start, length, ids, tokens = zip(*pieces, strict=True)
        stretch = np.full(len(size), table.column("stretch")[0].as_py(), np.int64)
        cols = [pa.array(stretch), *[pa.array(c, pa.int64()) for c in (doc, start, length)], pa.array(ids, pa.binary()), pa.array(tokens, pa.int64()), pa.array(number[sequence]), pa.array(offset), pa.array(padding)]
        return pa.Table.from_arrays(cols, names=["stretch", "doc_id", "start", "length", "ids", "doc_tokens", "sequence", "offset", "padding"])

    return run


def stretches(docs: DataFrame, row_col: str, text_col: str, scratch: Scratch, rows_in_stretch: int, bytes_in_stretch: int) -> DataFrame:
    """docs with the column stretch: numbers ascend with the rows' order; a stretch has rows_in_stretch consecutive numbers at most.

    Where these rows hold more than bytes_in_stretch, they are cut further, at rows by whose start so many bytes are full.
    """
    row = F.col(row_col).cast("bigint")
    run = F.floor(row / rows_in_stretch).cast("bigint")
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("bigint")
    sizes = docs.select(run.alias("run"), row.alias("row"), size.alias("size"))
    heavy = sizes.groupBy("run").agg(F.sum("size").alias("all")).filter(F.col("all") > bytes_in_stretch).select("run")
    heavy = scratch.save(heavy, "heavy")
    before = Window.partitionBy("run").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)  # rows_in_stretch numbers at most
    parts = sizes.join(heavy, "run", "left_semi").withColumn("part", F.floor(F.coalesce(F.sum("size").over(before), F.lit(0)) / bytes_in_stretch))
    cuts = parts.groupBy("run", "part").agg(F.min("row").alias("row")).groupBy("run").agg(F.collect_list("row").alias("_cuts"))
    cuts = scratch.save(cuts.select(F.col("run").alias("_run"), "_cuts"), "cuts", keep=True)
    nth = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= row)) - 1, F.lit(0))
    return docs.withColumn("_at", run).join(cuts, F.col("_at") == F.col("_run"), "left").withColumn("stretch", F.col("_at") * rows_in_stretch + F.when(F.col("_cuts").isNull(), 0).otherwise(nth)).drop("_at", "_run", "_cuts")


def pack_in_order(docs: DataFrame, row_col: str, ranks_path: str, pattern: str, capacity: int = 1024, rows_in_stretch: int = 2048, bytes_in_stretch: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """pack(), with sequences that follow the order of docs' rows by the number row_col, which must be unique.

    Documents whose numbers fall into the same rows_in_stretch of them are a stretch, or several where
    they have more than bytes_in_stretch: packed by one task, among themselves, and numbered after the
    stretches before.
    """
    spark = docs.sparkSession
    with Scratch(spark, "packing") as scratch:
        source = docs.select(F.col(row_col).cast("bigint").alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
        source = stretches(source, "row", "text", scratch, rows_in_stretch, bytes_in_stretch).select("stretch", "row", "doc_id", "text")
        cut = scratch.save(source.groupBy("stretch").applyInArrow(packed_stretch(ranks_path, pattern, capacity), PLACED), "pieces", keep=True)
        # a stretch's first number: what the thousands before it have, and what its thousand has before it
        thousand = F.floor(F.col("_s") / (1000 * rows_in_stretch)).alias("_t")
        sizes = scratch.save(cut.groupBy(F.col("stretch").alias("_s")).agg((F.max("sequence") + 1).alias("n")).withColumn("_t", thousand), "sizes", keep=True)
        before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        thousands = sizes.groupBy("_t").agg(F.sum("n").alias("n"))
        thousands = thousands.select(F.col("_t").alias("_of"), before(Window.orderBy("_t")).alias("_base"))  # a row for about two million documents
        inside = sizes.withColumn("_in", before(Window.partitionBy("_t").orderBy("_s")))
        first = inside.join(thousands, F.col("_t") == F.col("_of")).select("_s", (F.col("_base") + F.col("_in")).alias("_first"))
        first = scratch.save(first, "first", keep=True)
        few = first.count() <= MOST_STRETCHES
        joined = cut.join(F.broadcast(first) if few else first, F.col("stretch") == F.col("_s"))
        return joined.select("doc_id", "start", "length", "ids", "doc_tokens", (F.col("_first") + F.col("sequence")).alias("sequence_id"), "offset", "padding")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padding")
