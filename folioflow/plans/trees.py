"""Document trees and profiles, nested trees of chapters, segments and pages, answers rolled up with their evidence."""

from pyspark.sql import functions as F

from folioflow.operators import chapters as H
from folioflow.operators import trees as T
from folioflow.plans.registry import query
from folioflow.plans.report import CHAPTERED, chaptered

ITEMS = ((1, " Abstract ", 1, 0), (2, "Introduction", 2, 1), (3, "", 3, 1), (4, "Data", None, 3))
CONTENTS = "(SELECT doc_id AS id, unnest([1, 2, 3, 4]) AS at_, unnest(['Abstract', 'Introduction', '', 'Data']) AS title, unnest([1, 2, 3, 0]) AS page, unnest([1, 1, 1, 3]) AS level FROM documents WHERE doc_id % 4 = 0)"
ENTRIES = f"""(SELECT id, at_, title, page AS page_start, page AS page_end, level, 'toc' AS source FROM {CONTENTS} WHERE title <> ''
 UNION ALL SELECT id, row_number() OVER (PARTITION BY id ORDER BY f, chapter_key), title, s, e, 1, 'derived' FROM (SELECT id, chapter_key, arg_min(chapter_title, page) AS title, min(page) AS f, min(page) AS s, max(page) AS e FROM {CHAPTERED} WHERE id % 4 <> 0 GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY id ORDER BY f, chapter_key) <= 24)"""
SPAN = "CASE WHEN page_start IS NULL OR page_start = 0 THEN '' WHEN page_start = page_end THEN ' (p. ' || page_start || ')' ELSE ' (p. ' || page_start || '-' || page_end || ')' END"


def tree(t):
    """Documents that 4 divides have contents; the others' chapters are derived."""
    items = F.array(*[F.struct(F.lit(at).alias("at"), F.lit(title).alias("title"), F.lit(page).cast("int").alias("page"), F.lit(level).alias("level")) for at, title, page, level in ITEMS])
    contents = t.documents.filter("doc_id % 4 = 0").select(F.col("doc_id").alias("id"), F.explode(items).alias("x")).select("id", "x.*")
    return T.document_tree(chaptered(t), contents)


@query("q12_tree", f"SELECT id, at_::INT AS at, title, page_start::INT AS page_start, page_end::INT AS page_end, level, source FROM {ENTRIES}")
def q12(t):
    return tree(t)


@query("q12_profile", f"""WITH f AS (SELECT d.doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'academic' ELSE 'exam' END AS type, CASE WHEN doc_id % 4 = 0 THEN 4 ELSE 0 END AS toc, count(*) FILTER (regexp_matches(lower(title), '{'|'.join(T.PAPER_MARKERS)}')) AS hits, coalesce(bool_or(contains(lower(title), 'abstract')), false) AS a, count(title) AS n FROM documents d LEFT JOIN {ENTRIES} e ON e.id = d.doc_id GROUP BY 1, 2, 3),
o AS (SELECT id, string_agg(repeat('  ', least(level - 1, 3)) || '- ' || title || {SPAN}, chr(10) ORDER BY at_) AS outline FROM {ENTRIES} WHERE at_ <= 18 OR source = 'toc' GROUP BY id)
SELECT f.id, kind, CASE kind WHEN 'paper' THEN '论文/学术文章' WHEN 'book' THEN '书籍/长篇著作' ELSE '学术长文档' END AS label, CASE kind WHEN 'generic' THEN 6 ELSE 5 END AS parts, outline
FROM (SELECT *, CASE WHEN type = 'academic' AND (hits >= 2 OR a) THEN 'paper' WHEN toc >= 3 OR n >= 5 THEN 'book' ELSE 'generic' END AS kind FROM f) f LEFT JOIN o ON o.id = f.id""")
def q12_profile(t):
    kind = F.when(F.col("doc_id") % 3 == 0, "academic").otherwise("exam")
    docs = t.documents.select(F.col("doc_id").alias("id"), kind.alias("type"), F.when(F.col("doc_id") % 4 == 0, len(ITEMS)).otherwise(0).alias("toc_items"))
    return T.profile(docs, tree(t)).select("id", "kind", "label", F.size("blueprint").alias("parts")).join(T.shown(tree(t)), "id", "left")


SEGMENT_ROWS = f"""(SELECT id, page, chapter_key, chapter_title, CAST((r - 1) // each + 1 AS INTEGER) AS segment FROM (SELECT *, CASE WHEN n <= 2 OR (span <= 24 AND n <= 4) THEN n ELSE greatest(2, (n + w - 1) // w) END AS each FROM (
  SELECT *, CASE WHEN span <= 48 THEN 2 WHEN span <= 90 THEN 3 ELSE 4 END AS w FROM (SELECT *, count(*) OVER c AS n, max(page) OVER c - min(page) OVER c + 1 AS span, row_number() OVER (PARTITION BY id, chapter_key ORDER BY page) AS r FROM {CHAPTERED} WINDOW c AS (PARTITION BY id, chapter_key)))))"""
KIDS = "',\"child_count\":' || {n} || ',\"children\":[' || {kids} || ']}}'"


@query("js5_nested_tree", f"""WITH s AS (SELECT * FROM {SEGMENT_ROWS}),
g AS (SELECT id, chapter_key, segment, min(page) AS f, '{{"title":"' || segment || '"' || {KIDS.format(n="count(*)", kids="string_agg('{\"title\":\"p. ' || page || '\",\"child_count\":0,\"children\":[]}', ',' ORDER BY page)")} AS j FROM s GROUP BY 1, 2, 3),
c AS (SELECT g.id, g.chapter_key, min(f) AS f, '{{"title":' || CAST(to_json(any_value(k.title)) AS VARCHAR) || {KIDS.format(n="count(*)", kids="string_agg(j, ',' ORDER BY segment)")} AS j FROM g JOIN (SELECT id, chapter_key, arg_min(chapter_title, page) AS title FROM s GROUP BY 1, 2) k ON k.id = g.id AND k.chapter_key = g.chapter_key GROUP BY 1, 2)
SELECT id AS doc, id AS ord, '{{"title":"' || id || '"' || {KIDS.format(n="count(*)", kids="string_agg(j, ',' ORDER BY f, chapter_key)")} AS tree FROM c GROUP BY id""")
def js5(t):
    """Each document's chapters, their segments and the segments' pages as one tree, from the pages up."""
    s = H.in_segments(chaptered(t), 2)
    key = F.concat_ws("#", "chapter_key", F.col("segment").cast("string"))
    text = lambda c: F.col(c).cast("string")
    pages = s.select(F.col("id").alias("doc"), F.concat(F.lit("p"), text("page")).alias("id"), key.alias("parent"), F.lit(3).alias("level"), F.col("page").alias("ord"), F.concat(F.lit("p. "), text("page")).alias("title"))
    parts = s.select(F.col("id").alias("doc"), key.alias("id"), F.col("chapter_key").alias("parent"), F.lit(2).alias("level"), F.col("segment").alias("ord"), text("segment").alias("title")).distinct()
    chapters = s.groupBy(F.col("id").alias("doc"), F.col("chapter_key").alias("id")).agg(F.min("page").alias("ord"), F.min_by("chapter_title", "page").alias("title")).select("doc", "id", F.col("doc").cast("string").alias("parent"), F.lit(1).alias("level"), "ord", "title")
    documents = s.select(F.col("id").alias("doc"), text("id").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("level"), F.col("id").alias("ord"), text("id").alias("title")).distinct()
    return T.nested(pages.unionByName(parts).unionByName(chapters).unionByName(documents), 4, ["title"])


@query("agg30_ordered_merge", "SELECT l_suppkey, string_agg(k || '/' || l_returnflag, ',' ORDER BY o, k || '/' || l_returnflag) AS kinds FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY o, k, l_returnflag) AS n FROM (SELECT l_suppkey, l_partkey % 40 AS k, l_returnflag, min(l_orderkey * 100 + l_linenumber) AS o FROM lineitem GROUP BY 1, 2, 3)) WHERE n <= 4 GROUP BY 1")
def agg30(t):
    """A supplier's first four distinct kinds of line, by where they are met first."""
    rows = t.lineitem.select("l_suppkey", (F.col("l_partkey") % 40).alias("k"), "l_returnflag", "l_orderkey", "l_linenumber")
    first = T.first_distinct(rows, ["l_suppkey"], ["k", "l_returnflag"], ["l_orderkey", "l_linenumber"], 4)
    return T.listed(first, ["l_suppkey"], F.concat_ws("/", F.col("k").cast("string"), "l_returnflag"), "kinds").withColumn("kinds", F.array_join("kinds", ","))


def merged(kids: str, name: str) -> str:
    """SQL of a group's rows made from its children's (id, up, n, path, text, evidence, reasons, steps, passed)."""
    firsts = lambda col, most: f"(SELECT id, up, list(v ORDER BY a)[1:{most}] AS {col} FROM (SELECT id, up, v, min(ROW(n, i)) AS a FROM (SELECT id, up, n, generate_subscripts({col}, 1) AS i, unnest({col}) AS v FROM {kids}) GROUP BY 1, 2, 3) GROUP BY 1, 2)"
    return f"""{name} AS (SELECT s.id, s.up AS path, s.of_, s.rate, titles, evidence, reasons, steps FROM (SELECT id, up, count(*) AS of_, round(count(*) FILTER (passed) / count(*), 3) AS rate, list('Q' || path || ' ' || text ORDER BY n)[1:4] AS titles FROM {kids} GROUP BY 1, 2) s
  JOIN {firsts('evidence', 4)} e ON e.id = s.id AND e.up = s.up JOIN {firsts('reasons', 3)} r ON r.id = s.id AND r.up = s.up JOIN {firsts('steps', 8)} t ON t.id = s.id AND t.up = s.up)"""


ANSWER = "'本题为题组，共 ' || of_ || ' 个子题，建议按顺序递归作答。' || chr(10) || '优先处理：' || array_to_string(titles, '；') || chr(10) || '共性抓手：' || array_to_string(reasons[1:2], '；')"


@query("q16_answers", f"""WITH leaf AS (SELECT p_partkey // 100 AS id, '1.' || (p_partkey // 10 % 10) || '.' || (p_partkey % 10) AS path, '1.' || (p_partkey // 10 % 10) AS up, p_partkey % 10 AS n, p_name AS text, [p_brand || '|' || p_type || '|all', p_brand || '|N/A|' || p_size % 3] AS evidence, [p_type] AS reasons, ['read', p_brand, p_type] AS steps, p_size > 20 AS passed FROM part),
{merged('leaf', 'm')}, mid AS (SELECT id, path, '1' AS up, CAST(string_split(path, '.')[2] AS BIGINT) AS n, 'group ' || path AS text, evidence, reasons, steps, CAST(string_split(path, '.')[2] AS INT) % 4 > 0 AND rate >= 0.5 AS passed, {ANSWER} AS answer, rate FROM m),
{merged('mid', 'top')}
SELECT id, path, 'a: ' || text AS answer, evidence[1] || '; ' || evidence[2] AS evidence, reasons[1] AS reasons, array_to_string(steps, '>') AS steps, 1.0 AS child_pass_rate, passed, '' AS failed FROM leaf
UNION ALL SELECT id, path, answer, array_to_string(evidence, '; '), array_to_string(reasons, '; '), array_to_string(steps, '>'), rate, passed, CASE WHEN rate < 1 THEN 'subquestion_consistency' ELSE '' END FROM mid
UNION ALL SELECT id, path, {ANSWER}, array_to_string(evidence, '; '), array_to_string(reasons, '; '), array_to_string(steps, '>'), rate, rate >= 0.5, CASE WHEN rate < 1 THEN 'subquestion_consistency' ELSE '' END FROM top""")
def q16_answers(t):
    """Each hundred of parts is an exam of ten groups of ten questions; a group's answer, reasons, evidence and steps are its children's."""
    up = F.expr("'1.' || (p_partkey div 10 % 10)")
    source = lambda title, section, discipline: F.struct(title.alias("title"), section.alias("section_path"), discipline.alias("discipline"))
    evidence = F.array(source(F.col("p_brand"), F.col("p_type"), F.lit("")), source(F.col("p_brand"), F.lit(" "), (F.col("p_size") % 3).cast("string")))
    none, text = F.array().cast("array<string>"), F.col("p_name")
    part = t.part.withColumn("id", F.expr("p_partkey div 100")).withColumn("up", up)
    leaf = part.select("id", F.concat_ws(".", "up", (F.col("p_partkey") % 10).cast("string")).alias("path"), F.col("up").alias("parent_path"), F.lit(3).alias("level"), text.alias("text"), F.concat(F.lit("a: "), text).alias("answer"), F.array("p_type").alias("reasons"), evidence.alias("evidence"), F.array(F.lit("read"), "p_brand", "p_type", F.lit("read "), F.lit("")).alias("steps"), (F.col("p_size") > 20).alias("passed"), none.alias("failed"))
    bare = lambda d, path, parent, level, passed: d.select("id", path.alias("path"), parent.alias("parent_path"), F.lit(level).alias("level"), F.concat(F.lit("group "), path).alias("text"), F.lit("").alias("answer"), none.alias("reasons"), F.array().cast(leaf.schema["evidence"].dataType).alias("evidence"), none.alias("steps"), passed.alias("passed"), none.alias("failed")).distinct()
    middle = bare(part, F.col("up"), F.lit("1"), 2, F.split_part("up", F.lit("."), F.lit(2)).cast("int") % 4 > 0)
    root = bare(part, F.lit("1"), F.lit(None).cast("string"), 1, F.lit(True))
    done = T.roll_up_answers(leaf.unionByName(middle).unionByName(root), 3)
    shown = F.transform("evidence", lambda e: F.concat_ws("|", e["title"], F.coalesce(F.nullif(F.trim(e["section_path"]), F.lit("")), F.lit("N/A")), F.coalesce(F.nullif(e["discipline"], F.lit("")), F.lit("all"))))
    steps = F.array_join(F.array_distinct(F.filter(F.transform("steps", lambda x: F.trim(x)), lambda x: x != "")), ">")
    return done.select("id", "path", "answer", F.array_join(shown, "; ").alias("evidence"), F.array_join("reasons", "; ").alias("reasons"), steps.alias("steps"), "child_pass_rate", "passed", F.array_join("failed", ",").alias("failed"))
