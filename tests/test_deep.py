import random

from pyspark.sql import functions as F

from folioflow.operators import deep as D

ROWS = [(1, s, 1 + s // 2, f"Row {s}. more" if s % 3 else "Same. text") for s in range(12)] + [(2, 0, 9, "alone"), (2, 1, 9, None), (3, 0, 1, "far")]
CHAPTERS = [(1, 1, "One", 1, 3), (1, 2, "Two", 3, 5), (3, 1, "Elsewhere", 50, 60)]


def setup(spark, size=4):
    rows = spark.createDataFrame(ROWS, "id long, seq int, page int, content string")
    return D.batches(rows, spark.createDataFrame(CHAPTERS, "id long, at int, title string, start int, end int"), size)


def candidate(content):
    return F.split_part(content, F.lit("."), F.lit(1))


def test_batches_follow_overlapping_chapters(spark):
    got = {}
    for r in sorted(setup(spark).collect(), key=lambda r: r["seq"]):
        got.setdefault((r["id"], r["batch"], r["hint"]), []).append(r["seq"])
    # page 3 (rows 4 and 5) lies in both; page 6 in none; a batch that begins on page 3 is still called after the first chapter
    assert got == {(1, 0, "One"): [0, 1, 2, 3], (1, 1, "One"): [4, 5], (1, 2, "One"): [4, 5, 6, 7], (1, 3, "Two"): [8, 9], (2, 0, "Page 9"): [0, 1]}


def test_fold_carries_the_summary(spark):
    got = {(r["id"], r["batch"]): (r["context"], r["points"]) for r in D.folded(setup(spark), candidate).collect()}
    assert got[1, 0] == ("", ["Same", "Row 1", "Row 2"])
    assert got[1, 1] == ("Same\nRow 1\nRow 2", ["Row 4", "Row 5"])
    assert got[1, 2] == ("Row 4\nRow 5", ["Same", "Row 7"])  # what the batch before said is left out
    assert got[2, 0] == ("", ["alone"])


def test_python_step_is_the_same_fold(spark):
    def step(offered, summary):
        return [x for i, x in enumerate(offered) if x not in offered[:i] and x not in summary.split("\n")]

    key = lambda r: (r["id"], r["batch"])
    for size in (1, 3, 30):
        batched = setup(spark, size)
        assert sorted(map(tuple, D.folded_by(batched, candidate, step).collect())) == sorted(map(tuple, D.folded(batched, candidate).collect()))
        assert sorted(D.folded(batched, candidate).collect(), key=key)[0]["context"] == ""


def test_tree(spark):
    nodes = D.tree(D.folded(setup(spark), candidate)).collect()
    paths = {(r["id"], r["path"]): r for r in nodes}
    assert len(paths) == len(nodes)
    assert paths[1, "/chapter/one"]["batch"] == 0 and paths[1, "/chapter/one/detail_2"]["body"] == "- Same\n- Row 7"
    assert paths[1, "/synthesis/one"]["body"].split("\n") == ["Same", "Row 1", "Row 2", "Row 4", "Row 5", "Same", "Row 7"]
    assert (1, "/synthesis/two") not in paths and (2, "/synthesis/page-9") not in paths  # too few facts
    assert D.tree(D.folded(setup(spark).limit(0), candidate)).collect() == []


def test_outline_ends_where_the_next_chapter_begins(spark):
    rows = spark.createDataFrame(ROWS, "id long, seq int, page int, content string")
    found = D.outline(D.samples(rows), lambda s: F.when(s.startswith("Same"), s)).orderBy("id", "at").collect()
    assert [tuple(r) for r in found] == [(1, 1, "Same. text", 1, 4), (1, 2, "Same. text", 4, 2**31 - 1)]


def plainly(rows, chapters, size):
    """Batches (id, batch, hint, seqs), one document after the other."""
    out = []
    for doc in sorted({r[0] for r in rows if r[0] is not None}):
        own = sorted((c[1:] for c in chapters if c[0] == doc), key=lambda c: c[0])
        read = sorted(((seq, page) for i, seq, page, _ in rows if i == doc))[: D.MOST_ROWS]
        groups = [[r for r in read if start <= r[1] <= end] for _, _, start, end in own] if own else [read]
        cut = [g[i : i + size] for g in groups for i in range(0, len(g), size)]
        for n, g in enumerate(cut):
            names = [title for _, title, start, end in own if start <= g[0][1] <= end]
            out.append((doc, n, names[0] if names else f"Page {g[0][1]}", [seq for seq, _ in g]))
    return out


def test_batches_as_done_plainly(spark):
    draw = random.Random(22)
    rows = [(i, s, draw.randint(1, 30), "x") for i in range(6) for s in range(draw.choice([1, 40, 700]))] + [(None, 0, 1, "x")]
    chapters = [(i, n, f"{i}.{n}", s := draw.randint(1, 30), s + draw.randint(0, 12)) for i in (1, 2, 3, 5, 9) for n in range(1, draw.randint(2, 9))]
    draw.shuffle(rows)
    table = spark.createDataFrame(rows, "id long, seq int, page int, content string")
    for size in (1, 4):
        got = {}
        for r in sorted(D.batches(table, spark.createDataFrame(chapters, "id long, at int, title string, start int, end int"), size).collect(), key=lambda r: (r["id"], r["batch"], r["seq"])):
            got.setdefault((r["id"], r["batch"], r["hint"]), []).append(r["seq"])
        assert [(*k, v) for k, v in got.items()] == plainly(rows, chapters, size)


def test_tree_of_hints_with_one_path(spark):
    read = [(1, 2, "A b", ["p", "q"]), (1, 0, "a-B", ["r"]), (1, 1, "A b", ["s"]), (1, 3, "a-B", None), (2, 0, "甲", [str(i) for i in range(60)])]
    nodes = D.tree(spark.createDataFrame(read, "id long, batch int, hint string, points array<string>").repartition(3), lambda texts: F.array_join(texts, "+")).collect()
    got = sorted((r["id"], r["path"], r["parent"] or "", r["title"], r["body"], r["batch"]) for r in nodes if r["type"] != "detail")
    assert got == [
        (1, "/", "", D.ROOT_TITLE, None, 0), (1, "/chapter/a-b", "/", "a-B", None, 0), (1, "/synthesis/a-b", "/", D.SYNTHESIS_TITLE + "A b", "s+p+q", 999),
        (2, "/", "", D.ROOT_TITLE, None, 0), (2, "/chapter/甲", "/", "甲", None, 0), (2, "/synthesis/甲", "/", D.SYNTHESIS_TITLE + "甲", "+".join(map(str, range(50))), 999),
    ]
    shown = {(r["id"], r["batch"]): r["body"] for r in nodes if r["type"] == "detail"}
    assert len(shown) == 5 and shown[1, 2] == "- p\n- q" and shown[2, 0].count("\n") == 49
