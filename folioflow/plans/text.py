"""Text queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import rows as R
from folioflow.operators.chapters import heading
from folioflow.plans.registry import Tables, query

TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query("str1_strip_layout_noise")
def str1(t: Tables):
    return t.documents.select("doc_id", X.strip_layout_noise(F.col("text")).alias("clean"))


@query("str2_normalise", r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n|\r', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS clean FROM documents")
def str2(t):
    return t.documents.select("doc_id", X.normalise(F.col("text")).alias("clean"))


TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: length(x) > 1)"


@query("str3_tokens", f"SELECT doc_id, len({TOKENS}) AS n, array_to_string({TOKENS}[1:5], ' ') AS head FROM documents")
def str3(t):
    k = X.tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(k).cast("bigint").alias("n"), F.array_join(F.slice(k, 1, 5), " ").alias("head"))


@query("str4_snippet", r"SELECT doc_id, CASE WHEN length(c) > 160 THEN substr(c, 1, 159) || '…' ELSE c END AS clip FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS c FROM documents)")
def str4(t):
    return t.documents.select("doc_id", X.snippet(F.col("text"), 160).alias("clip"))


@query("str6_keywords", "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{4,}|[一-鿿]{2,8}')) AS word FROM documents) WHERE word NOT IN ('that', 'with', 'this', 'from') GROUP BY word ORDER BY n DESC, word LIMIT 50")
def str6(t):
    words = t.documents.select(F.explode(X.keywords(F.col("text"))).alias("word")).filter(~F.col("word").isin("that", "with", "this", "from"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(50)


def sql_any(col, words):
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


def sql_hits(col, words):
    return "(" + " + ".join(f"CAST(contains({col}, '{w}') AS INTEGER)" for w in words) + ")"


CONTENT = "CASE " + " ".join(f"WHEN {sql_any('lower(text)', w)} THEN '{n}'" for n, w in X.CONTENT_TYPES) + " ELSE 'general' END"


@query("str10_content_type", f"SELECT doc_id, {CONTENT} AS kind FROM documents")
def str10(t):
    return t.documents.select("doc_id", X.first_class(F.lower("text"), X.CONTENT_TYPES, "general").alias("kind"))


ROLES = "CASE " + " ".join(f"WHEN {sql_any('lower(text)', w)} THEN '{n}'" for n, w in X.QA_ROLES) + " ELSE 'other' END"


@query("str11_qa_role", f"SELECT conv_id, turn, {ROLES} AS qa_role, nullif(regexp_extract('exam/question/' || conv_id, 'exam/question/([0-9]+)', 1), '') AS question_id FROM conversations")
def str11(t):
    qid = F.nullif(F.regexp_extract(F.concat(F.lit("exam/question/"), "conv_id"), r"exam/question/(\d+)", 1), F.lit(""))
    return t.conversations.select("conv_id", "turn", X.first_class(F.lower("text"), X.QA_ROLES, "other").alias("qa_role"), qid.alias("question_id"))


@query("str13_chunk_class", """SELECT doc_id, CASE WHEN CAST(contains(h, 'copyright') AS INTEGER) + CAST(contains(h, 'all rights reserved') AS INTEGER) + CAST(contains(h, 'isbn') AS INTEGER) + CAST(contains(h, 'publisher') AS INTEGER) >= 2
 OR (length(s) < 60 AND NOT e) THEN 'filler' WHEN e THEN 'example' ELSE 'knowledge' END AS kind FROM (SELECT doc_id, substr(lower(text), 1, 200) AS h, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s, regexp_matches(text, '(?i)(^|[^a-z])(example|exercise|problem) *[0-9]*') AS e FROM documents)""")
def str13(t):
    return t.documents.select("doc_id", X.chunk_class(F.col("text"), F.col("source")).alias("kind"))


BEST = ", ".join(f"{sql_hits('x', w)} AS h{i}" for i, w in enumerate(X.DISCIPLINES.values()))
PICK = " ".join(f"WHEN h{i} = greatest(h0, h1, h2, h3, h4) THEN '{n}'" for i, n in enumerate(X.DISCIPLINES))


@query("str21_discipline", f"SELECT doc_id, CASE WHEN greatest(h0, h1, h2, h3, h4) = 0 THEN 'general' {PICK} END AS discipline FROM (SELECT doc_id, {BEST} FROM (SELECT doc_id, lower(substr(text, 1, 2000)) AS x FROM documents))")
def str21(t):
    return t.documents.select("doc_id", X.most_hits(F.lower(F.substring("text", 1, 2000)), X.DISCIPLINES, "general").alias("discipline"))


@query("str23_quality", r"SELECT doc_id, round((len(regexp_extract_all(text, '[A-Za-z一-鿿]')) - len(regexp_extract_all(text, '[�?\x01-\x08\x0b\x0c\x0e-\x1f]'))) / length(text), 6) AS quality FROM documents")
def str23(t):
    return t.documents.select("doc_id", F.round(X.text_quality(F.col("text")), 6).alias("quality"))


@query("str24_encoding", r"""SELECT doc_id, array_to_string(list_filter([CASE WHEN len(regexp_extract_all(text, '�')) / n > 0.02 THEN 'replacement' END, CASE WHEN len(regexp_extract_all(text, '[\x01-\x08\x0b\x0c\x0e-\x1f]')) / n > 0.01 THEN 'control' END,
 CASE WHEN len(regexp_extract_all(text, '[Ã-ÿ]{2,}|â€[’“”]')) > 5 THEN 'mojibake' END, CASE WHEN n > 200 AND len(regexp_extract_all(text, '[^\x01-\x7f一-鿿　-〿＀-￯]')) / n > 0.15 THEN 'high_non_cjk' END], lambda x: x IS NOT NULL), ',') AS issues FROM (SELECT doc_id, text, length(text) AS n FROM documents)""")
def str24(t):
    return t.documents.select("doc_id", F.array_join(X.encoding_issues(F.col("text")), ",").alias("issues"))


@query("str26_heading", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang || ' ' || source WHEN 1 THEN doc_id || ' ' || lang ELSE 'Own ' || source END AS heading FROM documents")
def str26(t):
    """From a path, from a heading between the paragraphs of a text, from the row's title: a third each."""
    n = F.col("doc_id") % 3
    path = F.when(n == 0, F.concat(F.lit("/page7/academic/3/"), "lang", F.lit("-_"), "source", F.lit("/more"))).otherwise("page7/section")
    content = F.when(n == 1, F.concat(F.lit("? ## "), F.col("doc_id").cast("string"), F.lit("  "), "lang", F.lit(" ..... 9\n"), "text")).otherwise("?\n" + "w" * 120)
    title = F.concat(F.lit("# <b>Own</b>  "), "source", F.lit("....12"))
    return t.documents.select("doc_id", heading(path, content, title).alias("heading"))


@query("str30_safe_name", "SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') AS name FROM pages")
def str30(t):
    return t.pages.select("page_id", F.regexp_replace(F.regexp_replace(F.lower("url"), "[^a-z0-9._-]+", "_"), "^_+|_+$", "").alias("name"))


@query("str32_page_fallback", "SELECT page_id, coalesce(nullif(CAST(page_id % 3 AS INTEGER), 0), TRY_CAST(regexp_extract('page' || page_id, 'page([0-9]+)', 1) AS INTEGER)) AS page FROM pages")
def str32(t):
    return t.pages.select("page_id", X.page_number((F.col("page_id") % 3).cast("int"), F.concat(F.lit("page"), "page_id")).alias("page"))


@query("str33_page_span", "SELECT l_orderkey, CASE WHEN min(l_linenumber) = max(l_linenumber) THEN 'p. ' || min(l_linenumber) ELSE 'p. ' || min(l_linenumber) || '-' || max(l_linenumber) END AS span FROM lineitem GROUP BY 1")
def str33(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.min("l_linenumber").alias("a"), F.max("l_linenumber").alias("b")).select("l_orderkey", X.page_span(F.col("a"), F.col("b")).alias("span"))


@query("str35_comparable_title", "SELECT doc_id, regexp_replace(lower(split_part(text, '.', 1)), '[^a-z0-9]+', '', 'g') AS title, regexp_extract(text, '^([0-9]+)', 1) AS prefix FROM documents")
def str35(t):
    return t.documents.select("doc_id", F.regexp_replace(F.lower(F.split_part("text", F.lit("."), F.lit(1))), "[^a-z0-9]+", "").alias("title"), F.regexp_extract("text", "^([0-9]+)", 1).alias("prefix"))


@query("agg12_document_frequency", f"SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({TOKENS}) AS token FROM documents) GROUP BY token")
def agg12(t):
    return t.documents.select(F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


@query("agg13_term_frequency", f"SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS token FROM documents) GROUP BY 1, 2")
def agg13(t):
    return t.documents.select("doc_id", F.explode(X.tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("tf"))


@query("agg14_ranked_keywords", f"SELECT token, df FROM (SELECT token, count(*) AS df FROM (SELECT DISTINCT source, unnest({TOKENS}) AS token FROM documents) GROUP BY token) ORDER BY df DESC, token LIMIT 40")
def agg14(t):
    pairs = t.documents.select("source", F.explode(X.tokens(F.col("text"))).alias("token")).distinct()
    return pairs.groupBy("token").agg(F.count(F.lit(1)).alias("df")).orderBy(F.desc("df"), "token").limit(40)


@query("agg16_structure", """SELECT p.conv_id, total, leaves, depth, types FROM (SELECT conv_id, count(*) AS total, count(*) FILTER (turn % 4 > 0) AS leaves, max(turn % 4 + 1) AS depth FROM conversations GROUP BY 1) p
 JOIN (SELECT conv_id, string_agg(role, ' / ' ORDER BY n DESC, role) AS types FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, role) AS r FROM (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY 1, 2)) WHERE r <= 3 GROUP BY 1) q ON p.conv_id = q.conv_id""")
def agg16(t):
    """Leaves, depth and the three commonest types of a tree; each fourth turn is a parent here, the next ones its levels."""
    level = F.col("turn") % 4 + 1
    roles = t.conversations.groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("n"), F.count_if(level > 1).alias("l"), F.max(level).alias("d"))
    top = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "role"))), 1, 3), lambda x: x["role"])
    return roles.groupBy("conv_id").agg(F.sum("n").alias("total"), F.sum("l").alias("leaves"), F.max("d").alias("depth"), F.array_join(top, " / ").alias("types"))


@query("agg27_type_histogram", f"SELECT kind, count(*) AS n FROM (SELECT {CONTENT} AS kind FROM documents) GROUP BY kind")
def agg27(t):
    return t.documents.groupBy(X.first_class(F.lower("text"), X.CONTENT_TYPES, "general").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("srt3_natural_order")
def srt3(t):
    keyed = t.supplier.select("s_suppkey", F.row_number().over(Window.partitionBy("s_nationkey").orderBy(X.natural_key(F.col("s_name")), "s_suppkey")).alias("n"))
    return keyed


@query("arr1_arrays", "SELECT doc_id, array_to_string(list_sort(list_distinct(string_split(text, ' ')))[1:4], '|') AS words FROM documents")
def arr1(t):
    return t.documents.select("doc_id", F.array_join(F.slice(F.array_sort(F.array_distinct(F.split("text", " "))), 1, 4), "|").alias("words"))


@query("hsh1_digests", "SELECT doc_id, sha256(text) AS sha, substr(md5(text), 1, 8) AS short, substr(sha256(text), 1, 16) AS content_hash FROM documents")
def hsh1(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha"), F.substring(F.md5(F.col("text").cast("binary")), 1, 8).alias("short"), F.substring(F.sha2("text", 256), 1, 16).alias("content_hash"))


@query("js1_safe_parse", "SELECT event_id, coalesce(TRY_CAST(json_extract_string(CASE WHEN event_id % 5 = 0 THEN '{bad' ELSE props END, '$.k') AS BIGINT), -1) AS k FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE props END AS props, event_id FROM events) WHERE event_id % 5 > 0 UNION ALL SELECT event_id, -1 FROM events WHERE event_id % 5 = 0")
def js1(t):
    doc = F.when(F.col("event_id") % 5 == 0, "{bad").otherwise(F.col("props"))
    return t.events.select("event_id", F.coalesce(F.from_json(doc, "k bigint")["k"], F.lit(-1)).cast("bigint").alias("k"))


@query("js3_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def js3(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("js4_canonical_key", "SELECT event_id, sha256('{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}') AS key FROM events")
def js4(t):
    return t.events.select("event_id", F.sha2(F.to_json(F.struct("event_type", "user_id")), 256).alias("key"))


@query("map1_lookup", "SELECT p_partkey, coalesce(CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'SMALL' THEN 2 END, 0) AS weight FROM part")
def map1(t):
    m = F.create_map(F.lit("ECONOMY"), F.lit(1), F.lit("SMALL"), F.lit(2))
    return t.part.select("p_partkey", F.coalesce(F.try_element_at(m, F.col("p_type")), F.lit(0)).alias("weight"))
