"""Searches against brute force."""

import numpy as np

from folioflow.operators import retrieval as S


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((90, 8)).round(3)
    v[7] = v[40]  # a tie
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<float>")
    got = {}
    for r in S.nearest(rows.filter("vec_id % 20 = 0"), rows, "vec_id", "embedding", 4, 0.1, block=2, chunk=13).collect():
        got.setdefault(r["q"], []).append((-round(r["score"], 5), r["vec_id"]))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(0, 90, 20):
        sims = unit @ unit[q]
        best = sorted((-round(float(s), 5), i) for i, s in enumerate(sims) if i != q and s >= 0.1)[:4]
        assert sorted(got.get(q, [])) == best


def test_transfer_searches_the_best_concepts(spark):
    rows = [(1, "a", "Kernel Kernel Kernel methods map inputs", [1.0, 0.0]), (2, "a", "nothing else to see", [0.0, 1.0]), (3, "b", "a kernel of truth", [1.0, 0.0]), (4, "b", "other words", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id bigint, document_id string, content string, embedding array<double>")
    got = S.transfer(df.filter("document_id = 'a'"), df.filter("document_id = 'b'"), "kernel inputs", [1.0, 0.0]).collect()
    assert {r["concept"] for r in got} == {"Kernel"} and {r["id"] for r in got} == {3, 4}
    assert all(r["relevance"] == 0.8 and r["suggested"] for r in got)  # 3 times .1 and half of 1
    assert max(got, key=lambda r: r["score"])["id"] in (3, 4)


def test_question_focus_rewards_pairs(spark):
    rows = [(1, 0, 10, 0, "question", 0.5), (1, 1, 11, 0, "answer", 0.4), (2, 0, 20, 0, "other", 0.9)]
    df = spark.createDataFrame(rows, "document_id bigint, turn int, id bigint, question_id int, qa_role string, sparse_score double")
    none = spark.createDataFrame([], "id bigint, dense_score double")
    fused = df.join(S.fuse(none, df.select("id", "sparse_score"), 18), "id")
    got = [(r["document_id"], r["turn"], r["pair"], round(r["score"], 9)) for r in S.qa_focus(fused, 2).collect()]
    assert got == [(1, 1, True, round(1 / 63 + 0.18 + 0.16, 9)), (1, 0, True, round(1 / 62 + 0.08 + 0.16, 9))]


def test_fusion_is_brute_force(spark):
    import random

    rng = random.Random(3)
    for size in (5, 400, 3000):
        dense = {i: rng.randrange(size // 3 + 1) / 7 for i in range(size) if rng.random() < 0.9}
        sparse = {i: rng.randrange(3) / 3 for i in range(size) if rng.random() < 0.8}
        weights = {i: rng.choice([0.4, 1.0]) for i in range(size) if rng.random() < 0.9}
        rank = lambda x: {i: n for n, (_, i) in enumerate(sorted((-v, i) for i, v in x.items()), 1)}
        d, s = rank(dense), rank(sparse)
        for w in (None, weights):
            total = {i: (sum(1 / (60 + r[i]) for r in (d, s) if i in r)) * (w.get(i, 1.0) if w else 1.0) for i in {*d, *s}}
            want = [(i, round(v, 12)) for i, v in sorted(total.items(), key=lambda x: (-round(x[1], 15), x[0]))[:7]]
            frame = lambda x, c: spark.createDataFrame(list(x.items()), f"id long, {c} double")
            got = S.fuse(frame(dense, "dense_score"), frame(sparse, "sparse_score"), 7, weights=frame(w, "weight") if w else None)
            assert [(r["id"], round(r["rrf_score"], 12)) for r in got.collect()] == want
    none = spark.createDataFrame([], "id long, sparse_score double")
    assert S.fuse(frame(dense, "dense_score"), none, 3).count() == 3


def test_question_focus_and_blocks(spark):
    rows = [
        (1, 7, "1", "question", 0.010, "What  is it?"),
        (2, 7, "1", "answer", 0.011, "This."),
        (3, 7, "1", "analysis", 0.012, "Since that."),
        (4, 7, "1", "answer", 0.020, "Better."),
        (5, 7, "2", "question", 0.020, "Alone"),
        (6, 8, None, "answer", 0.030, "No number"),
        (7, 8, "3", "other", 0.030, "Other"),
        (8, 9, "1", "question", 0.001, "Q9"),
        (9, 9, "1", "analysis", 0.001, " "),
    ]
    df = spark.createDataFrame(rows, "id long, document_id long, question_id string, qa_role string, rrf_score double, content string")
    got = S.qa_focus(df, 8)
    assert [(r["id"], r["pair"], round(r["score"], 3)) for r in got.collect()] == [(4, True, 0.36), (2, True, 0.351), (3, True, 0.312), (9, True, 0.301), (1, True, 0.25), (8, True, 0.241), (6, False, 0.21), (5, False, 0.1)]
    named = got.selectExpr("*", "'T' AS title", "CASE WHEN id = 3 THEN 'a/b' ELSE '' END AS section_path")
    blocks = [tuple(r) for r in S.qa_blocks(named, 5).collect()]
    assert [b[:2] for b in blocks] == [(7, "1")] and round(blocks[0][2], 3) == 0.36
    assert blocks[0][3] == "[QA_FOCUS::T::a/b]\n题干：What is it?\n答案与解析：Better. Since that."
    assert S.qa_blocks(named.limit(0), 5).collect() == []
