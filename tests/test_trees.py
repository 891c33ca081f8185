import json

from folioflow.operators import trees as T

NODE = "doc long, id string, parent string, level int, ord int, title string"


def trees(spark, rows, levels=4):
    got = T.nested(spark.createDataFrame(rows, NODE), levels, ["title"]).collect()
    return sorted((r["doc"], r["ord"], json.loads(r["tree"])) for r in got)


def leaf(title, *kids):
    return {"title": title, "child_count": len(kids), "children": list(kids)}


def test_nested_to_any_depth_with_skipped_levels(spark):
    rows = [(1, "a", None, 0, 1, "A"), (1, "b", "a", 1, 2, 'B "q"'), (1, "c", "a", 2, 1, None), (1, "d", "b", 3, 1, "D"), (1, "e", "b", 3, 1, "E"), (1, "x", "lost", 2, 5, "X"), (2, "a", None, 0, 7, "other"), (None, "a", None, 0, 1, "N"), (None, "b", "a", 1, 1, "M")]
    got = T.nested(spark.createDataFrame(rows, NODE), 4, ["title"]).collect()
    by = {(r["doc"], r["ord"]): json.loads(r["tree"]) for r in got}
    assert by == {(1, 1): leaf("A", leaf(None), leaf('B "q"', leaf("D"), leaf("E"))), (1, 5): leaf("X"), (2, 7): leaf("other"), (None, 1): leaf("N", leaf("M"))}
    deep = [(1, str(i), str(i - 1) if i else None, i, 0, str(i)) for i in range(9)]
    tree = trees(spark, deep, 9)[0][2]
    for i in range(9):
        assert tree["title"] == str(i)
        tree = tree["children"][0] if tree["children"] else None
    assert trees(spark, rows[:0]) == []


def test_first_distinct_keeps_the_first_met(spark):
    rows = [("g", "x", 3), ("g", "y", 1), ("g", "x", 2), ("g", "z", 5), ("g", None, 4), ("h", "x", 9)]
    df = spark.createDataFrame(rows, "k string, v string, at int").repartition(3)
    got = {r["k"]: r["all"] for r in T.listed(T.first_distinct(df, ["k"], ["v"], ["at"], 3), ["k"], T.F.col("v"), "all").collect()}
    assert got == {"g": ["y", "x", None], "h": ["x"]}


def question(path, parent, level, **more):
    row = {"id": 1, "path": path, "parent_path": parent, "level": level, "text": f"text  of {path}", "answer": "own", "reasons": [], "evidence": [], "steps": [], "passed": True, "failed": []} | more
    return tuple(row.values())


def test_answers_roll_up(spark):
    e = lambda *x: [dict(zip(("title", "section_path", "discipline"), y)) for y in x]
    rows = [
        question("1", None, 1, failed=["own_check"]),
        question("1.2", "1", 2, reasons=["second"], evidence=e(("A", None, "x"), (" ", "s", "d")), steps=["read", " "], passed=False),
        question("1.10", "1", 2, reasons=["tenth", "second"], evidence=e(("A", "", "x"), ("B", "p", None), ("C", "", ""), ("D", "", ""), ("E", "", "")), steps=["read", "check"]),
        question("1.3", "1", 2, passed=None),
        question("2", None, 1),
    ]
    schema = "id long, path string, parent_path string, level int, text string, answer string, reasons array<string>, evidence array<struct<title:string,section_path:string,discipline:string>>, steps array<string>, passed boolean, failed array<string>"
    got = {r["path"]: r for r in T.roll_up_answers(spark.createDataFrame(rows, schema), 2).collect()}
    top = got["1"]
    assert top["answer"] == "本题为题组，共 3 个子题，建议按顺序递归作答。\n优先处理：Q1.2 text of 1.2；Q1.3 text of 1.3；Q1.10 text of 1.10\n共性抓手：second；tenth"
    assert top["reasons"] == ["second", "tenth"] and top["steps"] == ["read", "check"]
    assert [tuple(x) for x in top["evidence"]] == [("A", "N/A", "x"), ("B", "p", "all"), ("C", "N/A", "all"), ("D", "N/A", "all")]
    assert top["child_pass_rate"] == 0.333 and top["passed"] is False and top["failed"] == ["own_check", "subquestion_consistency"]
    assert got["2"]["answer"] == "own" and got["2"]["child_pass_rate"] == 1.0
