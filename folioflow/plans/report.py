"""Chunking and report queries: pages of a document are its stretches of 500 characters."""

from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import chapters as H
from folioflow.operators import chunking as C
from folioflow.operators import rows as R
from folioflow.plans.registry import Tables, query

PAGES = "(SELECT doc_id AS id, i AS page, substr(text, 500 * (i - 1) + 1, 500) AS text FROM (SELECT *, unnest(range(1, (length(text) - 1) // 500 + 2)) AS i FROM documents))"


def pages(t: Tables):
    return C.fixed_stride(t.documents, "doc_id", "text", 500, 500).select("id", (F.col("chunk") + 1).alias("page"), F.col("content").alias("text"))


@query("chk3_fixed_stride", "SELECT id, CAST(i AS INTEGER) AS chunk, substr(text, i * 720 + 1, 900) AS content FROM (SELECT doc_id AS id, text, unnest(range(0, (length(text) - 1) // 720 + 1)) AS i FROM documents)")
def chk3(t):
    return C.fixed_stride(t.documents, "doc_id", "text", 900, 720)


@query("chk3_windows")
def chk3w(t):
    return C.chunks_of(t.documents, "doc_id", "text", C.windows())


@query("chk7_sentences")
def chk7(t):
    return C.chunks_of(t.documents, "doc_id", "text", C.sentences())


@query("chk8_recursive")
def chk8(t):
    return C.chunks_of(t.documents, "doc_id", "text", C.recursive())


@query("chk4_page_groups", f"SELECT id, (page - 1) // 4 * 4 + 1 AS start, count(*) AS pages, string_agg(text, chr(10) ORDER BY page) AS content FROM {PAGES} GROUP BY 1, 2")
def chk4(t):
    return C.page_groups(pages(t), size=4)


@query("chk4_by_contents", f"SELECT id, start, count(*) AS pages, string_agg(text, chr(10) ORDER BY page) AS content FROM (SELECT id, page, text, CASE WHEN page >= 7 THEN 7 WHEN page >= 3 THEN 3 WHEN page >= 1 THEN 1 END AS start FROM {PAGES}) GROUP BY 1, 2")
def chk4t(t):
    toc = t.documents.select(F.col("doc_id").alias("id"), F.explode(F.array(F.lit(1), F.lit(3), F.lit(7))).alias("page"))
    return C.page_groups(pages(t), toc)


@query("chk9_rows", "SELECT id, CAST(i AS INTEGER) AS chunk, sha256('text|' || i || '|' || c) AS hash FROM (SELECT doc_id AS id, i, substr(text, i * 480 + 1, 480) AS c FROM (SELECT *, unnest(range(0, (length(text) - 1) // 480 + 1)) AS i FROM documents))")
def chk9(t):
    c = C.fixed_stride(t.documents, "doc_id", "text", 480, 480)
    return c.select("id", "chunk", F.sha2(F.concat_ws("|", F.lit("text"), F.col("chunk").cast("string"), "content"), 256).alias("hash"))


@query("q9_summary", r"SELECT source, doc_id, CASE WHEN length(c) > 240 THEN substr(c, 1, 239) || '…' ELSE c END AS excerpt, length(c) AS characters FROM (SELECT source, doc_id, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS c FROM documents)")
def q9(t):
    """A source's overview as rows in the order of ids: a clean excerpt of each text, and the text's length."""
    clean = X.strip_all(F.regexp_replace("text", r"\s+", " "))
    return t.documents.select("source", "doc_id", X.snippet(F.col("text"), 240).alias("excerpt"), F.length(clean).cast("bigint").alias("characters"))


# Pages of even documents have a table of contents; those of others are titled by their number: a chapter of its
# own, a generic title, none, an appendix. The oracle states each page's chapter outright.
CHAPTERED = f"""(SELECT id, page, CASE WHEN id % 2 = 0 AND page >= 5 THEN 'toc:5:body' WHEN id % 2 = 0 THEN 'toc:1:front' WHEN page % 4 = 3 THEN 'pages:' || ((page - 1) // 12 * 12 + 1) || '-' || ((page - 1) // 12 * 12 + 12)
 ELSE 'section:chapter-' || (page - CASE page % 4 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 3 END) END AS chapter_key, CASE WHEN id % 2 = 0 AND page >= 5 THEN 'Body' WHEN id % 2 = 0 THEN 'Front'
 WHEN page % 4 = 3 THEN '页 ' || ((page - 1) // 12 * 12 + 1) || '-' || ((page - 1) // 12 * 12 + 12) ELSE 'chapter ' || (page - CASE page % 4 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 3 END) END AS chapter_title FROM {PAGES})"""
SEGMENTED = f"""(SELECT id, chapter_key, chapter_title, CAST((r - 1) // each + 1 AS INTEGER) AS segment, chapter_title || CASE WHEN n > each THEN ' 第' || CAST((r - 1) // each + 1 AS INTEGER) || '/' || CAST((n + each - 1) // each AS INTEGER) || '段' ELSE '' END AS label, min(page) AS "first", max(page) AS "last", count(*) AS "rows"
 FROM (SELECT *, CASE WHEN n <= 2 OR (span <= 24 AND n <= 4) THEN n WHEN span <= 48 THEN greatest(2, (n + 1) // 2) WHEN span <= 90 THEN greatest(2, (n + 2) // 3) ELSE greatest(2, (n + 3) // 4) END AS each FROM (SELECT *, count(*) OVER w AS n, max(page) OVER w - min(page) OVER w + 1 AS span,
 row_number() OVER (PARTITION BY id, chapter_key ORDER BY page) AS r FROM {CHAPTERED} WINDOW w AS (PARTITION BY id, chapter_key))) GROUP BY ALL)"""


def chaptered(t):
    n = F.col("page") % 4
    path = F.when(F.col("id") % 2 == 1, F.when(n == 1, F.concat(F.lit("/page1/academic/chapter-"), F.col("page").cast("string"))).when(n == 2, "答案").when(n == 0, "附录_一"))
    none = F.lit(None).cast("string")
    rows = pages(t).select("id", F.lit(0).alias("seq"), F.col("page").cast("int").alias("page"), path.alias("section_path"), none.alias("content"), none.alias("title"))
    items = F.array(*[F.struct(F.lit(at).alias("at"), F.lit(title).alias("title")) for at, title in ((1, "Front"), (5, "Body"))])
    contents = t.documents.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.explode(items).alias("x")).select("id", "x.*")
    return H.chapters(rows, contents)


@query("q10_chapters", f"SELECT * FROM {SEGMENTED}")
def q10(t):
    return H.segments(chaptered(t), 2)


@query("q11_regroup", f"""SELECT id, key, arg_min(title, ROW("first", title)) AS title, min("first") AS "first", max("last") AS "last", count(*) AS parts FROM (SELECT id, CASE segment % 3 WHEN 0 THEN 'pages:' || "first" || '-' || "last" WHEN 1 THEN chapter_key ELSE label END AS key,
 CASE segment % 3 WHEN 0 THEN '章节' WHEN 1 THEN chapter_title ELSE label END AS title, "first", "last" FROM {SEGMENTED}) GROUP BY 1, 2""")
def q11(t):
    """Every third part lost its chapter, every third its label too."""
    s = H.segments(chaptered(t), 2)
    n = F.col("segment") % 3
    parts = s.select("id", F.when(n == 1, F.col("chapter_key")).alias("chapter_key"), F.when(n == 1, F.col("chapter_title")).alias("chapter_title"), F.when(n != 0, F.col("label")).alias("label"), "first", "last", F.lit("").alias("content"))
    return H.regroup(parts, "content")


@query("q13_map_reduce", rf"SELECT id, string_agg(part, ' / ' ORDER BY batch) AS report FROM (SELECT id, (page - 1) // 3 AS batch, string_agg(CASE WHEN length(c) > 120 THEN substr(c, 1, 119) || '…' ELSE c END, ' ' ORDER BY page) AS part FROM (SELECT id, page, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS c FROM {PAGES}) GROUP BY 1, 2) GROUP BY id")
def q13(t):
    return map_reduce(pages(t), lambda text: X.snippet(text, 120))


def map_reduce(rows, each, batch: int = 3):
    """Map every page (id, page, text) by `each`, a function of Column, where a model's call would plug in; reduce by batches, then to one report a document."""
    b = rows.groupBy("id", F.expr(f"(page - 1) div {batch}").alias("batch")).agg(R.keep_in_order(F.col("page"), each(F.col("text")), " ").alias("part"))
    return b.groupBy("id").agg(R.keep_in_order(F.col("batch"), F.col("part"), " / ").alias("report"))


# Trees of documents that 3 divides: a front matter, a node of unknown page, a chapter; the others have none.
TREES = "(SELECT doc_id AS id, unnest([1, 2, 3]) AS node, unnest(['FRONT', 'x', 'chapter 5']) AS title, unnest([1, NULL, 5]) AS page_start, unnest([4, NULL, 5]) AS page_end FROM documents WHERE doc_id % 3 = 0)"
SUMMARIES = f"""(SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY "first", chapter_key, segment) AS INTEGER) AS seq, label AS title, "first" AS page_start, "last" AS page_end FROM {SEGMENTED})"""


@query("q22_navigation", f"""WITH s AS (SELECT * FROM {SUMMARIES}), x AS (SELECT t.*, s.seq, s.title AS matched, CASE WHEN replace(lower(t.title), ' ', '') = replace(lower(s.title), ' ', '') THEN 1000 ELSE 0 END + CASE WHEN t.page_start <= s.page_end AND s.page_start <= t.page_end THEN 100 + CASE WHEN t.page_start = s.page_start THEN 20 ELSE 0 END ELSE 0 END AS score FROM {TREES} t LEFT JOIN s ON s.id = t.id)
SELECT id, node, title, page_start, page_end, CASE WHEN score > 0 THEN matched END AS matched, score FROM (SELECT *, row_number() OVER (PARTITION BY id, node ORDER BY score DESC, seq) AS n FROM x) WHERE n = 1 UNION ALL SELECT id, seq, title, page_start, page_end, title, 0 FROM s WHERE id % 3 > 0""")
def q22(t):
    from pyspark.sql import Window

    s = H.segments(chaptered(t), 2)
    order = F.row_number().over(Window.partitionBy("id").orderBy("first", "chapter_key", "segment"))
    summaries = s.select("id", order.alias("seq"), F.col("label").alias("title"), F.col("first").alias("page_start"), F.col("last").alias("page_end"))
    none = F.lit(None).cast("int")
    given = ((1, "FRONT", F.lit(1), none), (2, "x", none, none), (3, "chapter 5", F.lit(5), none))
    nodes = F.array(*[F.struct(F.lit(n).alias("node"), F.lit(title).alias("title"), a.alias("page_start"), b.alias("page_end")) for n, title, a, b in given])
    tree = t.documents.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.explode(nodes).alias("x")).select("id", "x.*")
    return H.navigation(tree, summaries)
