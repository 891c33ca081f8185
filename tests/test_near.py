"""Nearest in time, and what it leads to, against plain versions."""

import random

import pytest

from folioflow.operators import ordered as O
from folioflow.operators import spreading as P


def nearest(rows, ids, seconds, most):
    out = set()
    for key, i, t in rows:
        if i in ids:
            others = sorted((abs(t - u), j) for k, j, u in rows if k == key and j != i and abs(t - u) <= seconds)
            out |= {(key, i, j, delta) for delta, j in others[:most]}
    return out


@pytest.mark.parametrize("spread", [3, 40, 4000])  # many ties, some, few
def test_near_in_time_is_brute_force(spark, spread):
    rng = random.Random(spread)
    rows = [(rng.choice("aab"), i, rng.randrange(spread)) for i in rng.sample(range(1000), 120)]
    df = spark.createDataFrame([*rows, (None, 1001, 1), ("a", 1002, None)], "k string, i bigint, t bigint")
    got = {tuple(r) for r in O.near_in_time(df, "k", "t", "i", 60, 4).collect()}
    assert got == nearest(rows, {i for _, i, _ in rows}, 60, 4)
    few = {i for _, i, _ in rows if i % 5 == 0}
    got = {tuple(r) for r in O.near_in_time(df, "k", "t", "i", 60, 4, left=df.filter("i % 5 = 0 AND i < 1001")).collect()}
    assert got == nearest(rows, few, 60, 4)


def test_completion_by_hand(spark):
    seeds = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0])], "id bigint, embedding array<double>")
    items = spark.createDataFrame([(1, "u", 100), (2, "u", 160), (3, "u", 700), (4, "v", 100), (5, "u", 450)], "id bigint, key string, at bigint")
    fragments = spark.createDataFrame([(1, [1.0, 0.0]), (8, [0.9, 0.1]), (9, [0.0, 1.0])], "id bigint, embedding array<double>")
    edges = spark.createDataFrame([(1, 4, 0.5), (7, 1, 0.9), (2, 6, 0.4), (4, 4, 1.0)], "a bigint, b bigint, weight double")
    got = [(r["rank"], r["hop"], r["source"], r["target"], r["kind"], round(r["weight"], 3)) for r in P.complete(seeds, items, fragments, edges).orderBy("seed", "rank").collect()]
    assert got == [
        (1, 1, "1", "2", "temporal", 0.8),
        (2, 1, "1", "fragment:8", "semantic", 0.994),
        (3, 1, "1", "7", "graph", 0.9),
        (4, 1, "1", "4", "graph", 0.5),
        (5, 2, "2", "1", "temporal", 0.8),
        (6, 2, "2", "5", "temporal", 0.033),
        (7, 2, "2", "6", "graph", 0.4),
        (8, 2, "7", "1", "graph", 0.9),
    ]
