"""Exams on a text worked out by hand."""

from pyspark.sql import functions as F

from folioflow.operators import exam

TEXT = """期末考试
一、选择题 共20分
1. 下列正确的是
A. 甲
B. 乙
C. 丙
2. 二加二 3. 三加三
二、材料题：阅读下面的材料
(1) 为什么
(2) 推导 derive
十二、试论
4. 最后____
"""


def test_questions_by_hand(spark):
    df = spark.createDataFrame([(1, TEXT), (2, "no marks here\nat all"), (3, ""), (4, None)], "k bigint, body string")
    rows = sorted(exam.questions(df, "k", "body").collect(), key=lambda r: (r["id"], r["question"]))
    # kinds by frequency: paren_num twice, zh_big three times, num_dot four times
    got = [(r["id"], r["question"], r["marker"], r["level"], r["number_path"], r["parent_path"], r["type"]) for r in rows]
    assert got == [
        (1, 1, "num_dot", 3, "1.1.1", None, "choice"),
        (1, 2, "num_dot", 3, "1.1.2", None, "standard"),
        (1, 3, "num_dot", 3, "1.1.3", None, "standard"),
        (1, 4, "zh_big", 2, "1.2", None, "standard"),
        (1, 5, "paren_num", 1, "1", None, "standard"),
        (1, 6, "paren_num", 1, "2", None, "standard"),
        (1, 7, "zh_big", 2, "2.12", "2", "essay"),
        (1, 8, "num_dot", 3, "2.12.4", "2.12", "fill_blank"),
        (2, 1, "none", 1, "1", None, "standard"),
    ]
    assert [tuple(o) for o in rows[0]["options"]] == [("A", "甲"), ("B", "乙"), ("C", "丙")] and rows[1]["options"] == []
    assert rows[8]["text"] == "no marks here\nat all"
    # 0.35 + 0.5 * length / 220 + 0.13 for each of two hard words
    assert rows[5]["score"] == round(0.35 + 0.5 * len("(2) 推导 derive") / 220 + 0.26, 3)


def test_material_goes_to_the_questions_below(spark):
    text = "一、根据下列材料\n1. 什么\n2. 计算\n二、其他\n3. 什么"
    rows = sorted(exam.questions(spark.createDataFrame([(1, text)], "k bigint, body string"), "k", "body").collect(), key=lambda r: r["question"])
    assert [(r["question"], r["number_path"], r["type"], r["material_id"], r["material"], r["section_title"]) for r in rows] == [
        (2, "1.1", "material_analysis", "mat_1", "一、根据下列材料", "一、根据下列材料"),
        (3, "1.2", "calculation", "mat_1", "一、根据下列材料", "一、根据下列材料"),
        (4, "2", "standard", None, None, None),
        (5, "2.3", "standard", None, None, "二、其他"),
    ]


def test_numbers(spark):
    given = {"7": 7, "⑫": 12, "十": 10, "十三": 13, "二十": 20, "九十九": 99, "五": 5, "零": 0, "百": None, "二三": None, "其": None}
    df = spark.createDataFrame([(k,) for k in given], "raw string").select("raw", exam.number_of(F.col("raw")).alias("n"))
    assert {r["raw"]: r["n"] for r in df.collect()} == given
