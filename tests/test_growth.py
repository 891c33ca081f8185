"""What a query costs grows no faster than its input: nothing is computed anew for each use, line, term or reader."""

import re

import pytest
from pyspark.sql import functions as F

from folioflow.functions import extract as E
from folioflow.functions import text as X
from folioflow.functions import titles as N
from folioflow.operators import chunking as C
from folioflow.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def one(spark, texts, c):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "a string").select(c).collect()]


def test_marks_are_counted_once(spark):
    """F10."""
    texts = ["", None, "a", "DEFINED as: it; definition", "in conclusion, for Example e.g. 1", "例如 即 定义为 例12", "Problems and questions", "explain s", "use case usage", "e g", "İssue"]
    for _, p in (*E.CONCEPT_MARKS, ("", E.DEFINED)):
        got = one(spark, texts, E.count_marks(F.col("a"), F.lower("a"), F.col("a").rlike("[一-鿿]"), p))
        assert got == [None if t is None else len(re.findall(f"(?ia:{p})", t)) for t in texts]
    rows = spark.createDataFrame([(t, "") for t in texts], "a string, s string")
    kinds = rows.select(E.concept_chunk(F.col("a"), X.chunk_class(F.col("a"), F.col("s"))))
    assert plan(kinds).count("regexp_extract_all") <= len(E.CONCEPT_MARKS) + 2


def test_white_space_at_both_ends(spark):
    texts = [" \t\n\x0b\f\ra b \r\n", "", None, "  ", "　a　"]
    assert one(spark, texts, X.strip_all(F.col("a"))) == ["a b", "", None, "", "　a　"]


def stages(spark):
    held = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return {held.apply(i).stageId(): held.apply(i) for i in range(held.size())}


def shuffled(spark, name):
    """Bytes that a query writes to shuffles where no table is small enough to be sent along by itself."""
    before = set(stages(spark))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        QUERIES[name](spark, SF).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return sum(s.shuffleWriteBytes() for i, s in stages(spark).items() if i not in before)


@pytest.mark.parametrize("name", ["q1_hybrid_search", "q3_agent_context", "q1b_sparse_scores", "q1c_fusion", "mth2_idf"])
def test_search_shuffles_no_text(spark, name):
    """mth2_idf wrote 338,406 bytes before."""
    assert shuffled(spark, name) < 100_000


def test_lines_are_cut_once(spark):
    """F16: the lines were cut anew for each line."""
    text = "\r\n".join(["x" * 200 + str(i % 3) for i in range(9)] + ["- " + "y" * 30, "short"])
    rows = spark.createDataFrame([(text,)], "a string")
    points = rows.select(N.key_points(F.col("a"), 3).alias("x"))
    assert points.first()[0] == ["x" * 200 + "0", "y" * 30]
    assert plan(points).count("split(") <= 2
    statements = rows.select(E.category(F.col("a"), "principle").alias("x"))
    assert plan(statements).count("regexp_extract_all(") <= len(E.CATEGORIES["principle"])


def test_terms_are_counted_without_overlap():
    """F21."""
    text = "AbaAbaAba Theory The theThe TheThe 概念概念概 概念 THE1 x1The"
    terms = ["Aba", "AbaAba", "AbaAbaAba", "The", "Theory", "TheThe", "概念", "概念概", "THE1", "Zzz"]
    assert dict(E.occurrences(text, terms)) == {w: text.count(w) for w in terms}
    assert E.occurrences("", []) == []


def test_relevance_shuffles_no_text(spark):
    """texts were joined, and copied for each term."""
    assert "text" not in plan(QUERIES["str9_relevance"](spark, SF)).split("Join ")[0]
    assert spark.createDataFrame([(None,), ("Abc",)], "a string").select(E.term_frequencies(F.col("a")).alias("t")).collect() == [(None,), ([("Abc", 1)],)]


def test_questions_read_the_texts_once(spark):
    """blocks were made three times, for marked texts, for plain ones and to tell them apart."""
    assert plan(QUERIES["str27_question_blocks"](spark, SF)).count("Relation [") == 1


def test_a_title_is_lowered_once(spark):
    """it was for each word looked for."""
    rows = spark.createDataFrame([("A study of 模型",), (None,)], "a string").select(N.title_score(F.col("a")).alias("x"))
    assert plan(rows).count("lower(") == 1 and rows.first()[0] == 15


def test_deep_pipeline_reads_the_fold_once(spark):
    """the plan had four folds and read the texts 36 times; 1,893,558 bytes were shuffled."""
    found = plan(QUERIES["q14_deep_pipeline"](spark, SF))
    assert found.count("Relation [") == 2 and found.count("aggregate(batches") == 1
    assert shuffled(spark, "q14_deep_pipeline") < 500_000


@pytest.mark.parametrize(("size", "stride"), [(3, 3), (5, 2), (2, 4), (900, 720), (60_000, 50_000)])
def test_windows_are_cut_in_one_walk(spark, size, stride):
    """each window was a substring, found by a walk from the text's beginning."""
    texts = ["", None, "a", "abc", "abcd", "line\r\n\n\u2028end \x00", "a😀é例" * 500, "x" * 720, "x" * 721, "a😀" * 100_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, a string")
    cut = C.fixed_stride(rows, "i", "a", size, stride)
    want = [(i, n, t if t is None else t[at : at + size]) for i, t in enumerate(texts) for n, at in enumerate(range(0, max(1, len(t or "")), stride))]
    assert sorted(map(tuple, cut.collect()), key=lambda r: r[:2]) == want
    assert "substring(" not in plan(cut) and plan(cut).count("regexp_extract_all(") == 1
