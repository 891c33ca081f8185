"""Graph queries: concepts are parts; a part refers to others by its number."""

from pyspark.sql import functions as F

from folioflow.operators import graph as G
from folioflow.plans.registry import Tables, query

KINDS = ("definition", "explanation", "example", "application", "summary", "problem")
NODES = "(SELECT p_partkey AS id, ['definition','explanation','example','application','summary','problem'][CAST(p_partkey % 6 AS INTEGER) + 1] AS kind FROM part)"
EDGES = "(SELECT p_partkey AS source, p_partkey * 3 + 1 AS target FROM part WHERE p_partkey * 3 + 1 < (SELECT count(*) FROM part) AND p_size % 3 > 0 UNION SELECT p_partkey, p_partkey + 7 FROM part WHERE p_size % 5 = 0 AND p_partkey + 7 < (SELECT count(*) FROM part))"


def nodes(t: Tables):
    return t.part.select(F.col("p_partkey").alias("id"), F.element_at(F.array(*map(F.lit, KINDS)), (F.col("p_partkey") % 6 + 1).cast("int")).alias("kind"))


def edges(t):
    n = t.part.count()
    k = F.col("p_partkey")
    a = t.part.filter((k * 3 + 1 < n) & (F.col("p_size") % 3 > 0)).select(k.alias("source"), (k * 3 + 1).alias("target"))
    return a.union(t.part.filter((F.col("p_size") % 5 == 0) & (k + 7 < n)).select(k, k + 7)).distinct()


REC1 = f"""WITH RECURSIVE n AS {NODES}, e AS {EDGES}, o AS (SELECT unnest(['definition','explanation','example','application','summary','problem']) AS kind, unnest(range(6)) AS i),
s AS (SELECT source, target FROM e JOIN n a ON a.id = source JOIN n b ON b.id = target JOIN o x ON x.kind = a.kind JOIN o y ON y.kind = b.kind WHERE y.i >= x.i),
w AS (SELECT [id] AS path, id AS last FROM n WHERE kind = 'definition' UNION ALL SELECT list_append(path, target), target FROM w JOIN s ON last = source WHERE len(path) < 5 AND NOT list_contains(path, target))
SELECT array_to_string(path, '>') AS path FROM w WHERE len(path) >= 2"""


@query("rec1_teaching_paths", REC1)
def rec1(t):
    return G.paths(nodes(t), edges(t)).select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))



@query("rec2_depth", f"WITH RECURSIVE e AS {EDGES}, w AS (SELECT DISTINCT target, 1 AS d FROM e UNION SELECT e.target, d + 1 FROM w JOIN e ON w.target = e.source WHERE d < 8) SELECT CAST(max(d) AS INTEGER) AS depth FROM w")
def rec2(t):
    """Edges lead to greater numbers here, so there is no cycle; at most 8 steps."""
    return G.depth_of(nodes(t), edges(t), 8)


REC3 = "WITH RECURSIVE a AS (SELECT p_partkey AS id, p_partkey // 4 AS ancestor, 1 AS distance FROM part WHERE p_partkey > 0 UNION ALL SELECT id, ancestor // 4, distance + 1 FROM a WHERE ancestor > 0 AND distance < 12) SELECT id, ancestor, distance FROM a"


@query("rec3_ancestors", REC3)
def rec3(t):
    k = F.col("p_partkey")
    return G.ancestors(t.part.select(k.alias("id"), F.when(k > 0, F.expr("p_partkey div 4")).alias("parent")))


@query("agg18_completeness", f"SELECT count(*) AS total, round(0.4 * least(1.0, count(*) FILTER (kind = 'definition') / 2.0) + 0.3 * least(1.0, count(*) FILTER (kind = 'example') / 2.0) + 0.3 * least(1.0, count(*) FILTER (kind = 'application') / 2.0), 6) AS completeness, '' AS missing FROM {NODES}")
def agg18(t):
    return G.completeness(nodes(t))


@query("agg18_types", f"SELECT kind, count(*) AS n, round(count(*) FILTER (id IN (SELECT source FROM {EDGES})) / count(*), 6) AS connectivity FROM {NODES} GROUP BY kind")
def agg18t(t):
    out = edges(t).select(F.col("source").alias("id")).distinct().withColumn("c", F.lit(1))
    return nodes(t).join(out, "id", "left").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.count("c") / F.count(F.lit(1)), 6).alias("connectivity"))


@query("agg19_patterns", f"SELECT a.kind || '->' || b.kind AS pattern, count(*) AS n FROM {EDGES} JOIN {NODES} a ON a.id = source JOIN {NODES} b ON b.id = target GROUP BY 1 ORDER BY n DESC, pattern LIMIT 10")
def agg19(t):
    n = nodes(t)
    j = edges(t).join(n.select(F.col("id").alias("source"), F.col("kind").alias("a")), "source").join(n.select(F.col("id").alias("target"), F.col("kind").alias("b")), "target")
    return j.groupBy(F.concat_ws("->", "a", "b").alias("pattern")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "pattern").limit(10)


@query("agg20_isolated", f"SELECT id FROM {NODES} WHERE id NOT IN (SELECT source FROM {EDGES}) AND id NOT IN (SELECT target FROM {EDGES})")
def agg20(t):
    ends = edges(t).select(F.explode(F.array("source", "target")).alias("id"))
    return nodes(t).join(ends, "id", "left_anti").select("id")


@query("agg21_degrees", f"SELECT id, count(*) FILTER (d = 'out') AS n_out, count(*) FILTER (d = 'in') AS n_in FROM (SELECT source AS id, 'out' AS d FROM {EDGES} UNION ALL SELECT target, 'in' FROM {EDGES}) GROUP BY id")
def agg21(t):
    ends = edges(t).select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit("out").alias("d")), F.struct(F.col("target").alias("id"), F.lit("in").alias("d")))).alias("e")).select("e.*")
    return ends.groupBy("id").agg(F.count_if(F.col("d") == "out").alias("n_out"), F.count_if(F.col("d") == "in").alias("n_in"))


CITES = "(SELECT l_suppkey AS a, l_partkey % 50 AS b FROM lineitem WHERE l_linenumber = 1)"


@query("agg22_strength", f"SELECT coalesce(c.a, s.a) AS a, coalesce(c.b, s.b) AS b, round(CASE WHEN c.n IS NOT NULL THEN least(1.0, least(1.0, 0.6 + 0.1 * (c.n - 1)) + 0.05 * coalesce(s.n, 0)) ELSE 0.3 + 0.05 * s.n END, 6) AS strength FROM (SELECT a, b, count(*) AS n FROM {CITES} GROUP BY 1, 2) c FULL JOIN (SELECT l_suppkey AS a, l_partkey % 50 AS b, count(*) AS n FROM lineitem WHERE l_linenumber = 2 GROUP BY 1, 2) s ON c.a = s.a AND c.b = s.b")
def agg22(t):
    pair = lambda i: t.lineitem.filter(f"l_linenumber = {i}").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 50).alias("b"))
    shared = pair(2).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    return G.relation_strength(pair(1), shared).withColumn("strength", F.round("strength", 6))


@query("q7_insights", "SELECT source, doc_id, CASE WHEN length(text) > 160 THEN substr(text, 1, 159) || '…' ELSE text END AS clip FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents) WHERE n = 1 ORDER BY doc_id LIMIT 40")
def q7(t):
    from folioflow.operators import rows as R

    first = R.first_per(t.documents, ["source", "lang"], [F.col("doc_id")])
    return first.select("source", "doc_id", F.when(F.length("text") > 160, F.concat(F.substring("text", 1, 159), F.lit("…"))).otherwise(F.col("text")).alias("clip")).orderBy("doc_id").limit(40)
