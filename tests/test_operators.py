"""Operators without oracle SQL, on inputs small enough to work out by hand."""

import math
import random

from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.functions.embedding import hash_vector, separate
from folioflow.operators import chunking as C
from folioflow.operators import graph as G
from folioflow.operators import memory as M
from folioflow.operators import ordered as O
from folioflow.operators import retrieval as S


def test_splitters_cover_the_text():
    rng = random.Random(1)
    for split in (C.windows(90, 20), C.sentences(80, 15), C.recursive(80, 10)):
        assert list(split("")) == []
        for _ in range(30):
            text = "".join(rng.choice(["word ", "longer word. ", "line\n", "\n\n", "中文。", "x" * 30]) for _ in range(40))
            pieces = list(split(text))
            covered = set()
            for start, piece in pieces:
                at = text.find(piece.strip(), start)
                assert at >= 0 and not text[start:at].strip()
                covered.update(range(at, at + len(piece.strip())))
            assert all(i in covered for i, c in enumerate(text) if not c.isspace())


def test_window_prefers_a_late_break():
    first = next(C.windows(20, 5)("a" * 14 + ". " + "b" * 30))
    assert first == (0, "a" * 14 + ".")
    assert next(C.windows(20, 5)("aa. " + "b" * 40))[1] == "aa. " + "b" * 16


def test_natural_key(spark):
    names = ["lc-10", "lc-2", "10a", "", "b", "2"]
    df = spark.createDataFrame([(n,) for n in names], "n string").orderBy(X.natural_key(F.col("n")))
    assert [r[0] for r in df.collect()] == ["", "2", "10a", "b", "lc-2", "lc-10"]


def test_layout_noise(spark):
    text = "A\r\n![image](x.png)\n---\n[OCR_WARN] low\n\n\n\nB  "
    assert spark.createDataFrame([(text,)], "t string").select(X.strip_layout_noise(F.col("t"))).first()[0] == "A\n\nB"


def test_cosine_guards(spark):
    rows = [([1.0, 0.0], [1.0, 0.0, 9.0]), ([0.0, 0.0], [1.0, 2.0]), ([], [1.0]), ([3.0, 4.0], [4.0, 3.0])]
    got = [r[0] for r in spark.createDataFrame(rows, "a array<double>, b array<double>").select(S.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[:3] == [1.0, 0.0, 0.0] and math.isclose(got[3], 24 / 25)


def test_rebalance_tiers(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "a", 3), (4, "a", 4), (5, "b", 5), (6, None, 6)], "id int, doc string, rank int")
    ids = lambda k: [r["id"] for r in S.rebalance(rows, k, "doc").collect()]
    assert ids(3) == [1, 5, 6] and ids(5) == [1, 5, 6, 2, 3] and ids(8) == [1, 2, 3, 4, 5, 6]


def test_fusion_and_hybrid_search(spark):
    rows = spark.createDataFrame([(i, f"d{i % 2}", f"alpha {'beta ' * i} example text that is long enough to be no filler at all", [float(i), 1.0]) for i in range(6)], "id int, document_id string, content string, embedding array<double>")
    dense, sparse = S.dense_scores(rows, [1.0, 0.0]), S.sparse_scores(rows, "beta gamma")
    assert [r["id"] for r in dense.orderBy(F.desc("dense_score")).collect()][0] == 5
    assert sparse.filter("sparse_score = 0").count() == 1 and S.sparse_scores(rows, "a ,").count() == 0
    top = S.fuse(dense, sparse, 1).first()
    assert top["id"] == 5 and math.isclose(top["rrf_score"], 2 / 61)
    assert S.hybrid_search(rows, "beta", [1.0, 0.0], 2).count() == 2


def test_global_rank_with_frequent_scores(spark):
    rows = [(i, float(i % 7 if i % 3 else 0)) for i in range(5000)]
    got = O.global_rank(spark.createDataFrame(rows, "id int, s double"), "s", "id", rows_in_bucket=200)
    want = {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    assert {r["id"]: r["rank"] for r in got.collect()} == want


def test_coverage_sample(spark):
    def plain(n, limit):
        if limit >= n:
            return list(range(n))
        if limit == 1:
            return [0]
        return sorted({0, n - 1} | {round(i / (limit - 1) * (n - 1)) for i in range(1, limit - 1)})

    for limit in (1, 2, 3, 5, 12):
        df = spark.range(1, 40).select("id", O.coverage_indices(F.col("id"), limit).alias("x"))
        for r in df.collect():
            assert r["x"] == plain(r["id"], limit), (r["id"], limit)


def test_paths_stop_at_cycles(spark):
    nodes = spark.createDataFrame([(1, "definition"), (2, "example"), (3, "application"), (4, "definition")], "id int, kind string")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 1)], "source int, target int")
    assert sorted(tuple(r["path"]) for r in G.paths(nodes, edges).collect()) == [(1, 2), (1, 2, 3)]
    assert G.depth_of(nodes, edges).first()[0] == 2


def test_memory_bands(spark):
    e = [(0.05,), (0.2,), (0.4,), (0.75,), (1.0,)]
    got = spark.createDataFrame(e, "e double").select(M.surprise(F.col("e")), M.modifier(F.col("e"))).collect()
    assert [r[0] for r in got] == ["expected", "moderate", "high", "flashbulb", "flashbulb"]
    assert [round(r[1], 6) for r in got] == [0.0, 0.024, 0.084, 0.225, 0.3]


def test_paged_lines(spark):
    df = spark.createDataFrame([(1, "x\n[[PAGE:1]]\na\nb\n[[PAGE:7]]\nc")], "id int, text string")
    assert [(r["line"], r["page"]) for r in C.paged_lines(df, "id", "text").orderBy("n").collect()] == [("x", None), ("a", 1), ("b", 1), ("c", 7)]


def test_hash_vectors(spark):
    v = hash_vector("abc", 100)
    assert v == hash_vector("abc", 100) != hash_vector("abd", 100) and math.isclose(sum(x * x for x in v), 1)
    df = spark.createDataFrame([([1.0] * 8,), ([2.0] + [1.0] * 7,)], "e array<double>").select(separate(F.col("e"), 32).alias("s"))
    assert all(math.isclose(sum(x * x for x in r["s"]), 1) for r in df.collect())
