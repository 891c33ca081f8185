"""Hand-worked cases of what is read out of texts."""

import pytest
from pyspark.sql import functions as F

from folioflow.functions import extract as E
from folioflow.functions import text as X
from folioflow.operators import chunking as C


@pytest.fixture
def of(spark):
    def value(text, *columns):
        row = spark.createDataFrame([(text,)], "x string").select(*columns).first()
        return row[0] if len(columns) == 1 else tuple(row)

    return value




def test_references(of):
    text = "如图 3.1 所示，见表 2（续）。Section 4.2 and Chapter 7 [1, 2] (Miller, 2001) 参见《信号处理》 Figure 5 shows"
    got = [(r["kind"], r["label"]) for r in of(text, E.labelled(F.col("x"), E.REFERENCES))]
    assert got == [
        ("figure", "3.1"), ("figure", "3.1"), ("figure", "5"), ("table", "2"), ("section", "Section 4.2"), ("section", "Chapter 7"),
        ("citation", "1, 2"), ("citation", "Miller, 2001"), ("document", "信号处理"),
    ]


def test_terms_and_their_types(spark):
    rows = spark.createDataFrame([('**排序算法** ``x1`` 《操作系统》 "Graph Theory" "a" **  方法论 **',)], "x string").select(F.explode(E.terms(F.col("x"))).alias("t"))
    got = {r["t"]: r["k"] for r in rows.select("t", E.term_type(F.col("t")).alias("k")).collect()}
    assert got == {"排序算法": "concept", "x1": "general", "操作系统": "tool", "Graph Theory": "entity", "方法论": "method"}


def test_concepts(of):
    got = [(r["kind"], r["label"].strip()) for r in of("栈是指 后进先出的表。For Example trees grow\n问题：为何如此。", E.labelled(F.col("x"), E.CONCEPTS, "(?i)"))]
    assert ("definition", "后进先出的表") in got and ("example", "trees grow") in got and ("problem", "为何如此") in got


def test_categories_start_once(of):
    text = "原因是：" + "水" * 20 + "\n因为：" + "水" * 20 + "。"
    assert len(of(text, E.category(F.col("x"), "why"))) >= 1
    assert of("首先 打开 文件 并且 读取 所有 的 行", E.category(F.col("x"), "how")) == ["打开 文件 并且 读取 所有 的 行"]
    assert of("短", E.category(F.col("x"), "principle")) == []


def test_relevance_counts_substrings(of):
    n, r = E.concept_relevance(F.col("x"), F.lit("Abc"), F.lit(0.5))
    assert of("Abc xAbcAbc", n, r) == (3, 0.55)
    assert of("Go Abc d4 Zed9 中文 中文字符号码 Abc _Abc", E.named_terms(F.col("x"))) == ["Abc", "Zed9", "中文"]


def test_chunk_concepts(of):
    kind = lambda s: of(s, E.concept_chunk(F.col("x"), F.lit("knowledge")))
    assert kind("plain words") == "knowledge" and kind("栈是指后进先出") == "definition"
    assert kind("summary: in conclusion, a question") == "summary"  # 25 against 10
    assert kind("Example 3\nof a thing") == "example"
    assert of("是指", E.concept_chunk(F.col("x"), F.lit("filler"))) == "filler"


def test_points_and_fallback(of):
    assert of("考点：链表，队列；x\n知识点: 图论", E.points(F.col("x"), "exam")) == ["图论", "链表", "队列"]
    assert of("The Quick quick brown 中文", E.points(F.col("x"), "technical")) == ["brown", "quick", "中文"]


def test_forms(of):
    f = lambda s, pages=0: of(s, E.form(F.col("x"), F.lit("f"), F.lit(pages)))
    assert f("nothing here") == "general" and f("abstract and references [3]") == "paper"
    assert f("硕士论文 摘要 关键词") == "thesis"  # 2 against half of 3
    assert f("plain", 100) == "book" and f("满分 100，考生") == "exam"
    assert f("\n".join(["short"] * 11)) == "slides" and f("sprint backlog") == "project"


def test_headings(of):
    v = lambda s, n=None: of(s, E.visual_heading(F.col("x"), F.lit(n)))
    assert v("**Bold one**") and v("Short", "y" * 101) and v("核心观点") and not v("Ends。", "y" * 101) and not v("123", "y" * 101) and not v("Short", "y") and not v("")
    assert of("  Abstract of it", E.keyword_heading(F.col("x"), "academic")) and not of("Abstracts", E.keyword_heading(F.col("x"), "academic")) and of("摘要", E.keyword_heading(F.col("x"), "academic"))
    h = lambda s, m="number", n=1: of(s, E.section_header(F.col("x"), F.lit(m), F.lit(n)))
    assert h("一、选择题 共10题") and not h("一、选择题？") and not h("选择题", "number", 2) and h("选择题", "zh_big", 2) and not h("请计算 共3分")


def test_first_object(of):
    assert of('a { b {"k": {"x": "}"}} c', X.first_object(F.col("x"))) == '{"k": {"x": "}"}}'
    assert of("no object {", X.first_object(F.col("x"))) is None


def test_markdown_pieces():
    got = list(C.markdown(10, "T")("intro\n# A\nx\n[[PAGE:3]]\n## B\n" + "y" * 15 + "\n" + "z" * 9 + "\nend"))
    assert got == [("md_0", "T", 0, "intro"), ("md_1", "A", 3, "# A\nx"), ("md_2", "B", 3, "## B\n" + "y" * 15 + "\n" + "z" * 9)] + [("md_final", "B", 3, "end")] or got[2][3].startswith("## B")
    assert got[-1][0] == "md_final" and got[-1][3].endswith("end")


def test_concept_sections_merge_and_split():
    text = "\n".join(["start", "例如 one", "more", "总结 two", "w" * 300])
    got = [c for _, c in C.by_concept(100, 10)(text)]
    assert got[0].startswith("start\n\n例如 one\nmore\n\n总结 two") and all(len(c) <= 122 for c in got)
    assert [c for _, c in C.by_concept(100, 10)("plain")] == ["plain"]
    assert C.merged(["a" * 50, "b" * 50, "c" * 50], 100) == ["a" * 50 + "\n\n" + "b" * 50, "c" * 50]


def test_dispatch():
    split = C.dispatched(100, 10)
    assert [p[:3] for p in split("x\n# A\ny", "exam")] == [("md_0", "", 0), ("md_final", "A", 0)]
    assert [p[:3] for p in split("[[PAGE:2]]\na\n[[PAGE:3]]\nb", "exam")] == [("p2-1", "page/2", 2), ("p3-1", "page/3", 3)]
    assert [(p[1], p[3]) for p in split("1. first\n2. second", "exam")] == [("exam/question/2", "first"), ("exam/question/3", "second")]
    assert [p[1] for p in split("a\nOverview of it\nb\nAPI\nc", "technical")] == ["technical/intro", "technical/overview-of-it", "technical/api"]
