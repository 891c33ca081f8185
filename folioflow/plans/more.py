"""Listings, rewrites, trees, nested JSON, working memory and the pluggable steps."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import chunking as C
from folioflow.operators import graph as G
from folioflow.operators import rows as R
from folioflow.operators import spreading as P
from folioflow.plans.graph import EDGES, NODES, edges, nodes
from folioflow.plans.registry import Tables, query
from folioflow.sources import tables as T


@query("snk1_document_ids", "SELECT doc_id, substr(sha256(source || '|' || doc_id), 1, 16) AS id FROM documents")
def snk1(t: Tables):
    """Ids come from the content's key, so a retried append gives the same."""
    return t.documents.select("doc_id", F.substring(F.sha2(F.concat_ws("|", "source", F.col("doc_id").cast("string")), 256), 1, 16).alias("id"))


@query("snk3_bulk_rows", "SELECT vec_id, label, len(embedding) AS dim, round(embedding[1], 6) AS first FROM embeddings")
def snk3(t):
    """Vectors written in two lots to one table, and read back."""
    path = T.fresh_path(t.spark, "vectors")
    T.refresh(t.embeddings.filter("vec_id % 2 = 0"), path)
    stored = T.append_rows(t.embeddings.filter("vec_id % 2 <> 0"), path)
    return stored.select("vec_id", "label", F.size("embedding").cast("bigint").alias("dim"), F.round(F.get("embedding", F.lit(0)), 6).alias("first"))


@query("snk4_staging_upsert", "SELECT doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def snk4(t):
    stored = t.documents.select("doc_id", F.lit(-1).alias("quality"))
    return R.upsert(stored, t.labels.select("doc_id", "quality"), ["doc_id"])


@query("snk8_full_refresh", "SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1, 2")
def snk8(t):
    """The index is built anew over what was there: rows first, then the summary from the rows stored."""
    path = T.fresh_path(t.spark, "index")
    T.refresh(t.documents.select("doc_id", F.lit("old").alias("source"), "lang", "n_chars"), path)
    stored = T.refresh(t.documents.select("doc_id", "source", "lang", "n_chars"), path)
    return stored.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("srt2_physical_order", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey % 3 = 0, l_partkey % 3, l_suppkey, l_linenumber, l_partkey) AS n FROM lineitem")
def srt2(t):
    """Rows with a page first, by page, then by section and id."""
    page = F.col("l_partkey") % 3
    return t.lineitem.select("l_orderkey", "l_linenumber", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(page == 0, page, "l_suppkey", "l_linenumber", "l_partkey")).alias("n"))


@query("ups2_replace_staged", "WITH staged AS (SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations WHERE conv_id % 3 > 0 GROUP BY conv_id) SELECT coalesce(s.conv_id, o.conv_id) AS conv_id, coalesce(s.turn, o.turn) AS turn, coalesce(s.role, o.role) AS role FROM (SELECT DISTINCT conv_id, -1 AS turn, 'old' AS role FROM conversations WHERE conv_id % 2 = 0) o FULL JOIN staged s ON s.conv_id = o.conv_id")
def ups2(t):
    """Conversations staged in a table of their own, then merged into the stored ones: the last turn of each wins."""
    stored, staging, merged = (T.fresh_path(t.spark, f"conversations-{x}") for x in ("stored", "staging", "merged"))
    c = t.conversations.select("conv_id", "turn", "role")
    T.refresh(c.filter("conv_id % 2 = 0").select("conv_id", F.lit(-1).alias("turn"), F.lit("old").alias("role")).distinct(), stored)
    return T.merge_staged(c.filter("conv_id % 3 > 0"), ["conv_id"], "turn", "role", stored, staging, merged)


@query("ups3_report_cache", """WITH d AS (SELECT source, doc_id // 1000 AS block, sha256(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id)) AS h FROM documents GROUP BY 1, 2),
n AS (SELECT source, sha256(string_agg(h, ',' ORDER BY block)) AS cache_key, 'new' AS report FROM d GROUP BY source)
SELECT coalesce(n.source, o.source) AS source, coalesce(n.cache_key, o.cache_key) AS cache_key, coalesce(n.report, o.report) AS report FROM n FULL JOIN (SELECT 'src0' AS source, 'stale' AS cache_key, 'old' AS report UNION ALL SELECT 'gone', 'kept', 'old') o ON n.source = o.source""")
def ups3(t):
    """Reports kept under a digest of what they were made of: blocks of 1000 ids are digested, then the blocks' digests."""
    block = F.expr("doc_id div 1000").alias("block")
    blocks = t.documents.groupBy("source", block).agg(F.sha2(R.keep_in_order(F.col("doc_id"), F.col("doc_id").cast("string"), ","), 256).alias("h"))
    new = blocks.groupBy("source").agg(F.sha2(R.keep_in_order(F.col("block"), F.col("h"), ","), 256).alias("cache_key")).withColumn("report", F.lit("new"))
    held = t.spark.createDataFrame([("src0", "stale", "old"), ("gone", "kept", "old")], "source string, cache_key string, report string")
    return R.upsert(held, new, ["source"])


@query("ups12_tree_rows", "SELECT 'root' AS path, NULL AS parent, CAST(0 AS BIGINT) AS sort_order UNION ALL SELECT 'root/' || source, 'root', row_number() OVER (ORDER BY source) FROM (SELECT DISTINCT source FROM documents)")
def ups12(t):
    s = t.documents.select("source").distinct()
    rows = s.select(F.concat(F.lit("root/"), "source").alias("path"), F.lit("root").alias("parent"), F.row_number().over(Window.orderBy("source")).cast("bigint").alias("sort_order"))  # the few sources
    root = t.spark.range(1).select(F.lit("root").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("bigint").alias("sort_order"))
    return root.unionByName(rows)


@query("win13_sentence_packing")
def win13(t):
    return C.chunks_of(t.documents, "doc_id", "text", C.sentences(900, 0))


@query("win14_outline_numbers", "SELECT l_orderkey, l_linenumber, l_partkey, top || '.' || row_number() OVER (PARTITION BY l_orderkey, top ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS number FROM (SELECT *, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS top FROM lineitem)")
def win14(t):
    """Two-level numbers: a flagged row starts a new first level and resets the second."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    d = t.lineitem.withColumn("top", F.sum((F.col("l_returnflag") == "R").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    second = F.row_number().over(Window.partitionBy("l_orderkey", "top").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return d.select("l_orderkey", "l_linenumber", "l_partkey", F.concat_ws(".", F.col("top").cast("string"), second.cast("string")).alias("number"))


@query("chk1_dispatch")
def chk1(t):
    """A document's kind follows its number here, so that each of the four is used; every fifth has page marks."""
    n = F.col("doc_id")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("exam", "technical", "project", "academic")]), (n % 4 + 1).cast("int"))
    marked = F.when(n % 5 == 0, F.concat(F.lit("[[PAGE:1]]\n"), F.replace("text", F.lit("\n\n"), F.lit("\n[[PAGE:2]]\n")))).otherwise(F.col("text"))
    return C.sections_of(t.documents.select("doc_id", marked.alias("text"), kind.alias("kind")), "doc_id", "text", C.dispatched(), "kind")


def as_markdown(t):
    return t.documents.select("doc_id", F.concat(F.lit("# "), F.replace("text", F.lit("\n\n"), F.lit("\n# "))).alias("text"))


# Without a cut by size, a piece is a heading's: the oracle counts them, and how many characters they have.
@query("chk2_markdown", "SELECT doc_id AS id, len(regexp_extract_all(chr(10) || t, '\\n#')) AS sections, length(t) AS characters FROM (SELECT doc_id, '# ' || replace(text, chr(10) || chr(10), chr(10) || '# ') AS t FROM documents)")
def chk2(t):
    out = C.sections_of(as_markdown(t), "doc_id", "text", C.markdown(10**9))
    return out.groupBy("id").agg(F.count(F.lit(1)).alias("sections"), (F.sum(F.length("content")) + F.count(F.lit(1)) - 1).alias("characters"))


@query("chk2_markdown_cut")
def chk2_cut(t):
    return C.sections_of(as_markdown(t), "doc_id", "text", C.markdown())


@query("chk6_merge_small")
def chk6(t):
    """Sections by concept; long ones in windows, short neighbours merged up to 1.2 times the target size."""
    return C.chunks_of(t.documents, "doc_id", "text", C.by_concept())


@query("js6_metadata_merge", "SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || ',\"kind\":\"' || event_type || '\"}' AS meta FROM events")
def js6(t):
    old = F.from_json("props", "k bigint")
    return t.events.select("event_id", F.to_json(F.struct(old["k"].alias("k"), F.col("event_type").alias("kind"))).alias("meta"))


@query("q8_network", f"SELECT count(*) AS total, round(0.4 * least(1.0, count(*) FILTER (kind = 'definition') / 2.0) + 0.3 * least(1.0, count(*) FILTER (kind = 'example') / 2.0) + 0.3 * least(1.0, count(*) FILTER (kind = 'application') / 2.0), 6) AS completeness, '' AS missing, count(*) FILTER (id NOT IN (SELECT source FROM {EDGES} UNION SELECT target FROM {EDGES})) AS isolated, (SELECT count(*) FROM {EDGES}) AS edges FROM {NODES}")
def q8(t):
    n, e = nodes(t), edges(t)
    ends = e.select(F.explode(F.array("source", "target")).alias("id")).distinct().withColumn("linked", F.lit(1))
    return G.completeness(n.join(ends, "id", "left"), F.count_if(F.col("linked").isNull()).alias("isolated"), F.lit(e.count()).alias("edges"))


ASSOCIATED = """WITH seeds AS (SELECT vec_id AS s FROM embeddings WHERE vec_id % 20 = 0), i AS (SELECT event_id AS id, user_id AS u, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events),
e AS (SELECT l_orderkey AS a, l_partkey AS b, max(l_discount) AS w FROM lineitem WHERE l_orderkey <> l_partkey GROUP BY 1, 2),
near AS (SELECT * FROM (SELECT x.id AS src, CAST(y.id AS VARCHAR) AS dst, 1 - abs(x.t - y.t) / 43200.0 AS w, row_number() OVER (PARTITION BY x.id ORDER BY abs(x.t - y.t), y.id) AS n FROM i x JOIN i y ON x.u = y.u AND x.id <> y.id AND abs(x.t - y.t) <= 43200) WHERE n <= 4),
graph AS (SELECT * FROM (SELECT src, dst, w, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS n FROM (SELECT a AS src, CAST(b AS VARCHAR) AS dst, w FROM e UNION ALL SELECT b, CAST(a AS VARCHAR), w FROM e)) WHERE n <= 4),
alike AS (SELECT * FROM (SELECT q.vec_id AS src, 'fragment:' || r.vec_id AS dst, list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS w, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) DESC, r.vec_id) AS n FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0) WHERE n <= 4 AND w >= 0.3),
legs AS (SELECT src, dst, w, n, 0 AS leg, 'temporal' AS kind FROM near UNION ALL SELECT src, dst, w, n, 2, 'graph' FROM graph),
one AS (SELECT s, 1 AS hop, 0 AS place, leg, n, CAST(s AS VARCHAR) AS source, dst AS target, kind, w FROM seeds JOIN (FROM legs UNION ALL SELECT src, dst, w, n, 1, 'semantic' FROM alike) ON s = src),
front AS (SELECT * FROM (SELECT s, target, row_number() OVER (PARTITION BY s ORDER BY min(leg * 10 + n), target) AS place FROM one WHERE target <> CAST(s AS VARCHAR) GROUP BY s, target) WHERE place <= 4),
two AS (SELECT s, 2, place, leg, n, target, dst, kind, w FROM front JOIN legs ON target = CAST(src AS VARCHAR)),
once AS (SELECT *, row_number() OVER (PARTITION BY s, source, target, kind ORDER BY hop, place, leg, n) AS first FROM (FROM one UNION ALL FROM two))
SELECT * FROM (SELECT s AS seed, row_number() OVER (PARTITION BY s ORDER BY hop, place, leg, n, target) AS rank, hop, source, target, kind, round(w, 6) AS weight FROM once WHERE first = 1) WHERE rank <= 8"""


@query("q17_pattern_completion", ASSOCIATED)
def q17(t):
    """What the vectors whose id 20 divides bring along: events of their number, similar vectors, parts of orders."""
    items = t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    vectors = t.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    edges = t.lineitem.groupBy(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b")).agg(F.max("l_discount").alias("weight"))
    found = P.complete(vectors.filter("id % 20 = 0"), items, vectors, edges, least=0.3, seconds=43200)
    return found.withColumn("weight", F.round("weight", 6))


@query("stm6_decay_pass", "SELECT event_id FROM events WHERE exp(-(epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts))) / 864000.0) >= 0.05")
def stm6(t):
    from folioflow.plans.memory import age

    return t.events.filter(F.exp(-age() / 864000.0) >= 0.05).select("event_id")


@query("udf1_embed")
def udf1(t):
    from folioflow.functions.embedding import hash_embedding

    return t.conversations.select("conv_id", "turn", hash_embedding(F.col("text"), 32).alias("embedding"))


@query("udf2_answer", "SELECT conv_id, string_agg(split_part(text, '.', 1), '. ' ORDER BY turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def udf2(t):
    """The deterministic answer where no model is plugged in: the first sentences, in order."""
    a = t.conversations.filter("role = 'assistant'")
    return a.groupBy("conv_id").agg(R.keep_in_order(F.col("turn"), F.split_part("text", F.lit("."), F.lit(1)), ". ").alias("answer"))


@query("udf4_transform_chain", r"SELECT doc_id, lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS clean, length(text) AS characters FROM documents WHERE length(text) > 20")
def udf4(t):
    """Steps of DataFrame to DataFrame, named by whoever plugs them in."""
    steps = [lambda d: d.filter("length(text) > 20"), lambda d: d.select("doc_id", X.strip_all(F.col("text")).alias("clean"), F.length("text").cast("bigint").alias("characters")), lambda d: d.withColumn("clean", F.lower("clean"))]
    out = t.documents
    for step in steps:
        out = out.transform(step)
    return out


@query("udf5_plugged_splitter", "SELECT doc_id AS id, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS lines FROM documents")
def udf5(t):
    lines = C.chunks_of(t.documents, "doc_id", "text", lambda s: ((0, x) for x in s.split("\n")))
    return lines.groupBy("id").agg(F.count(F.lit(1)).alias("lines"))


@query("src13_content_hash", "SELECT page_id, sha256(html) AS sha256, strlen(html) AS size FROM pages")
def src13(t):
    return t.pages.select("page_id", F.sha2("html", 256).alias("sha256"), F.octet_length("html").cast("bigint").alias("size"))


@query("src4_page_text", "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '<[^>]*>', ' ', 'g'), '[ \\n\\t\\r]+', ' ', 'g') AS text FROM pages")
def src4(t):
    plain = F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>", ""), "<[^>]*>", " ")
    return t.pages.select("page_id", F.regexp_replace(plain, r"[ \n\t\r]+", " ").alias("text"))


@query("src7_outline", "SELECT page_id, level, title FROM (SELECT page_id, unnest(regexp_extract_all(html, '<h([1-6])[^>]*>([^<]*)</h', 1)) AS level, unnest(regexp_extract_all(html, '<h([1-6])[^>]*>([^<]*)</h', 2)) AS title FROM pages)")
def src7(t):
    pattern = F.lit(r"<h([1-6])[^>]*>([^<]*)</h")
    both = F.arrays_zip(F.regexp_extract_all("html", pattern, F.lit(1)).alias("level"), F.regexp_extract_all("html", pattern, F.lit(2)).alias("title"))
    return t.pages.select("page_id", F.explode(both).alias("h")).select("page_id", F.col("h")["level"].alias("level"), F.col("h")["title"].alias("title"))
