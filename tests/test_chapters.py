"""Headings and chapters worked out by hand."""

from pyspark.sql import functions as F

from folioflow.operators import chapters as H


def test_headings(spark):
    cases = [
        (("/page3/academic/12/my-long_title/x", "1 One", "t"), "my long title"),
        (("page3/section", "text ## 2.1 Deep heading\nmore", "t"), "2.1 Deep heading"),
        (("", "好。第三章 开始\n正文", "t"), "第三章 开始"),
        (("x", "## Abstract of all", "t"), "Abstract"),
        ((None, "- plain start\nA. lettered\n", "t"), "A. lettered"),
        ((None, "* plain start\n" + "w" * 95, "t"), "plain start"),
        ((None, "? \n!", " <b>Own</b> title ..... 12 "), "Own title"),
        ((None, None, None), ""),
    ]
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, p string, c string, t string")
    got = df.select("i", H.heading(F.col("p"), F.col("c"), F.col("t")).alias("h")).orderBy("i").collect()
    assert [r["h"] for r in got] == [want for _, want in cases]


def test_chapters_without_pages_and_by_title(spark):
    rows = [
        (1, 1, 0, "答案", None, None),  # the first weak title opens a chapter
        (1, 2, 0, "Part One", None, None),  # held by an item of the contents
        (1, 3, 0, "示例: x", None, None),  # carried on
        (1, 4, 0, None, None, None),
        (1, 5, 0, "附录", None, None),  # the document's own chapter is carried on too
        (1, 6, 9, "other", None, None),  # by page
        (2, 1, 13, None, "!", None),
    ]
    df = spark.createDataFrame(rows, "id int, seq int, page int, section_path string, content string, title string")
    toc = spark.createDataFrame([(1, 7, "1. PART one!"), (1, 8, "part"), (3, 1, "x")], "id int, at int, title string")
    got = {(r["id"], r["seq"]): r["chapter_key"] for r in H.chapters(df, toc).collect()}
    assert got == {(1, 1): "section:答案", (1, 2): "toc:7:1-part-one", (1, 3): "toc:7:1-part-one", (1, 4): "document:文档内容", (1, 5): "document:文档内容", (1, 6): "toc:8:part", (2, 1): "pages:13-24"}
    many = spark.createDataFrame([(1, i, 0, "c", "C") for i in range(11)], "id int, seq int, page int, chapter_key string, chapter_title string")
    parts = sorted((r["segment"], r["label"], r["rows"]) for r in H.segments(many, 2).collect())
    assert parts == [(1, "C 第1/4段", 3), (2, "C 第2/4段", 3), (3, "C 第3/4段", 3), (4, "C 第4/4段", 2)]
