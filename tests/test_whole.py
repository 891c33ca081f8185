"""Queries do their whole job: no cap drops partners."""

import duckdb

from folioflow.plans.queries import QUERIES, SQL
from tests.test_queries import plain


def test_all_orders_of_a_part_are_linked_once(spark, tmp_path):
    """only the first 12 orders of a part were."""
    lines = [(o, p) for o in range(40) for p in (1, 1, 2 + o % 3, 9 if o % 2 else None)] + [(None, 1), (50, 8)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = [tuple(r) for r in QUERIES["jn6_shared_points"](spark, str(tmp_path)).collect()]
    assert len(got) == 40 * 39 // 2 and set(got) == {(a, b) for a in range(40) for b in range(a + 1, 40)}


def test_all_documents_of_a_point_and_all_its_points_are_linked(spark, tmp_path):
    """only the first 12 documents of a point were, and the first 25 points of a document."""
    words = [f"W{chr(97 + i)}rd" for i in range(26)] + [f"X{chr(97 + i)}rd" for i in range(5)]
    texts = [(i, " ".join(words[:28] if i < 20 else [*words[20 + i % 2 :][::-1], "Last"]) + f" of {i}", "en") for i in range(30)]
    spark.createDataFrame([*texts, (30, None, "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = QUERIES["q6_build_graph"](spark, str(tmp_path))
    links = [tuple(plain(v) for v in r) for r in got.collect()]
    assert sorted(links, key=repr) == sorted((tuple(plain(v) for v in r) for r in con.execute(SQL["q6_build_graph"]).fetchall()), key=repr)
    assert {(a, b) for a, b, kind, *_ in links if kind == "cross_discipline"} == {(f"doc:{a}", f"doc:{b}") for a in range(30) for b in range(a + 1, 30)}
    assert sum(x[2] == "related" and x[0] == "doc:0" for x in links) == 28
