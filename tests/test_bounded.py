"""What a task or the driver holds doesn't grow with the input."""

import pyarrow as pa

from folioflow.operators import chunking as C
from folioflow.sources import batches as B


def test_batches_of_made_rows_are_bounded_and_made_one_row_at_a_time(monkeypatch):
    monkeypatch.setattr(B, "ROWS", 10)
    seen = []

    def rows(i, t):
        seen.append(i)
        return ((i, piece) for piece in t.split(" "))

    texts = ["a b c"] * 20 + [None] + ["x" * (5 << 20)] * 2
    batch = pa.RecordBatch.from_arrays([pa.array(range(23), pa.int64()), pa.array([t or "" for t in texts])], names=["id", "text"])
    out = B.by_row(rows, "id bigint, piece string")(iter([batch]))
    first = next(out)
    assert (first.num_rows, seen) == (10, [0, 1, 2, 3])
    got = [first, *out]
    assert all(b.num_rows <= 10 for b in got) and [b.num_rows for b in got][-2:] == [2, 1]
    assert sum(b.num_rows for b in got) == 63 and pa.Table.from_batches(got)["id"].to_pylist() == [i for i, t in enumerate(texts) for _ in (t or "").split(" ")]
    assert list(B.by_row(rows, "id bigint, piece string")(iter([]))) == []


def test_splitters_hand_on_small_batches(spark):
    text = "One sentence of words. " * 40000
    assert C.chunks_of(spark.createDataFrame([(i, text) for i in range(4)] + [(9, None)], "id long, text string").coalesce(1), "id", "text", C.windows()).count() == 4 * len(list(C.windows()(text)))


def test_parts_grow_in_number_not_in_size(spark, monkeypatch):
    from folioflow.operators import rows as R

    monkeypatch.setattr(R, "PART", 100)
    small, large = (R.dealt(spark.range(n).withColumnRenamed("id", "k"), "k") for n in (250, 2500))
    assert (small.rdd.getNumPartitions(), large.rdd.getNumPartitions()) == (3, 25)
    assert large.distinct().count() == 2500 and R.dealt(spark.range(0), "id").count() == 0
