from pyspark.sql import functions as F

from folioflow.functions import titles as N


def one(spark, rows, column, schema="a string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_title_scores(spark):
    lines = ["基于深度学习的图像识别", "Department of Physics", "System design", "12-34", "abc", "王小明 学号 1", "清华大学", "第三班 名单表格", "A study of mixed 方法"]
    assert one(spark, [(x,) for x in lines], N.title_score(F.col("a"))) == [11, -100, 7, -100, -100, -100, -100, 4, 15]


def test_titles(spark):
    rows = [
        ("", "book", "/tmp/ref_深度学习研究.pdf"),
        (None, None, "x.pdf"),
        ("short\n\n  A study of models  \nother line here", "book", "f1.pdf"),
        ("Harvard Campus North\nabc", "paper", "notes on things.txt"),
        ("Harvard Campus North\nabc", "book", "n.txt"),
        ("12\n--", "book", "plain name"),
        ("T" * 70 + " " + "x" * 200, "exam", ""),
    ]
    df = spark.createDataFrame(rows, "text string, kind string, name string")
    got = [r["title"] for r in N.with_title(df, F.col("text"), F.col("kind"), F.col("name")).collect()]
    assert got == ["ref_深度学习研究", "x", "A study of models", "notes on things", "n", "plain name", "T" * 70 + " " + "x" * 109]


def test_headings_points_and_the_rest(spark):
    text = "1.2 Scope\nNOTES\nNotes\n结论：\nplain\n" + "A" * 36 + "\n3.  \nend:"
    assert one(spark, [(text,)], N.heading_lines(F.col("a"))) == [["1.2 Scope", "NOTES", "结论：", "end:"]]
    long = "x" * 120
    points = f"- {long}tail one\r\n* {long}tail two\r\nshort\r\n# Twenty characters or so\t"
    assert one(spark, [(points,)], N.key_points(F.col("a"))) == [[long + "tail one", "Twenty characters or so"]]
    assert one(spark, [("Too short. This sentence is long enough! no\nx",), (None,)], N.key_points(F.col("a"))) == [["Too short. This sentence is long enough! no"], []]
    assert one(spark, [("a\nb. This is a sentence\nThat goes on.",)], N.key_points(F.col("a"))) == [["b. This is a sentence"]]
    assert one(spark, [("a\nb\nThis is one.",), ("x" * 40 + "汉" * 13,), ("x" * 40 + "汉" * 14,)], N.mostly_english(F.col("a"))) == [False, True, False]
    assert one(spark, [("期末试卷",), ("tech-api",), ("里程碑",), ("notes",)], N.type_by_name(F.col("a"))) == ["exam", "technical", "project", "academic"]
    assert one(spark, [("x " * 80,), ("x " * 79,), (None,), ("No Stable Report" + "x" * 90,), ("未生成稳定报告" + "x" * 90,)], N.report_valid(F.col("a"))) == [True, False, False, False, False]
