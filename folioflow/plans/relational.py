"""Scans, filters, projections, joins, sets and rewrites."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioflow.operators import rows as R
from folioflow.plans.registry import Tables, query
from folioflow.sources import tables as T

# tasks: orders seen as ingestion tasks; ledger: events seen as account entries
TASKS = """(SELECT o_orderkey AS task_id, o_custkey AS tenant, o_totalprice AS size, o_orderdate AS started,
  CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'completed' ELSE 'running' END AS status,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE
    CASE CAST(o_orderkey % 4 AS INTEGER) WHEN 0 THEN 'parsing' WHEN 1 THEN 'splitting' WHEN 2 THEN 'indexing' ELSE 'failed' END END AS phase,
  CAST(o_orderkey % 11 AS BIGINT) AS total_chunks, CAST(o_orderkey % 7 AS BIGINT) AS done_chunks FROM orders)"""


def tasks(t: Tables):
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "F", "completed").otherwise("running")
    k = F.col("o_orderkey")
    running = F.when(k % 4 == 0, "parsing").when(k % 4 == 1, "splitting").when(k % 4 == 2, "indexing").otherwise("failed")
    phase = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "queued").otherwise(running)
    return t.orders.select(k.alias("task_id"), F.col("o_custkey").alias("tenant"), F.col("o_totalprice").alias("size"), F.col("o_orderdate").alias("started"), status.alias("status"), phase.alias("phase"), (k % 11).alias("total_chunks"), (k % 7).alias("done_chunks"))


@query("src1_fetch_rows", "SELECT e.vec_id, d.doc_id, d.source, d.n_chars FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id WHERE d.lang = 'en'")
def src1(t):
    d = R.where_given(t.documents, {"lang": "en", "source": None})
    return t.embeddings.join(d, F.col("vec_id") == F.col("doc_id")).select("vec_id", "doc_id", "source", "n_chars")


@query("src2_document_meta", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def src2(t):
    return t.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("src3_turns_grouped", "SELECT conv_id, count(*) AS n, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def src3(t):
    return t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), R.keep_in_order(F.col("turn"), F.col("role"), ",").alias("roles"))


@query("src11_needs_ocr", "SELECT doc_id, n < 200 AS needs_ocr FROM (SELECT doc_id, length(regexp_replace(text, '[ \\t\\n\\r]', '', 'g')) AS n FROM documents)")
def src11(t):
    return t.documents.select("doc_id", (F.length(F.regexp_replace("text", r"[ \t\n\r]", "")) < 200).alias("needs_ocr"))


@query("src12_embedded_counts", "SELECT page_id, len(regexp_extract_all(html, '<img')) AS images, len(regexp_extract_all(html, '<(script|iframe)')) AS objects FROM pages")
def src12(t):
    return t.pages.select("page_id", F.regexp_count("html", F.lit("<img")).cast("bigint").alias("images"), F.regexp_count("html", F.lit("<(script|iframe)")).cast("bigint").alias("objects"))


@query("snk2_write_if_missing", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def snk2(t):
    return R.missing_from(t.documents, t.labels, ["doc_id"]).select("doc_id", "source")


@query("snk5_summary_json", "SELECT source, '{\"documents\":' || count(*) || ',\"chars\":' || CAST(sum(n_chars) AS BIGINT) || '}' AS payload FROM documents GROUP BY source")
def snk5(t):
    s = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"))
    return s.select("source", F.to_json(F.struct("documents", "chars")).alias("payload"))


@query("flt1_optional_filter", "SELECT doc_id FROM documents WHERE source = 'src3'")
def flt1(t):
    return R.where_given(t.documents, {"lang": "all", "source": "src3"}).select("doc_id")


@query("flt2_json_equality", "SELECT event_id, user_id FROM events WHERE json_extract_string(props, '$.k') = '3'")
def flt2(t):
    return t.events.filter(F.get_json_object("props", "$.k") == "3").select("event_id", "user_id")


@query("flt3_document_boundary", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey = 7")
def flt3(t):
    return t.lineitem.filter("l_orderkey = 7").select("l_orderkey", "l_linenumber")


@query("flt4_active", "SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN ts + INTERVAL 10 DAY END AS expires FROM events) WHERE expires IS NULL OR expires > TIMESTAMP '2024-01-20 00:00:00'")
def flt4(t):
    e = t.events.withColumn("expires", F.expr("CASE WHEN event_id % 3 > 0 THEN ts + INTERVAL 10 DAY END"))
    return R.active_at(e, "expires", F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'")).select("event_id")


@query("flt5_storage_rows", "SELECT o_orderkey FROM orders WHERE coalesce(o_orderstatus, '') <> 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate >= TIMESTAMP '1995-01-01'")
def flt5(t):
    return t.orders.filter((F.coalesce("o_orderstatus", F.lit("")) != "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_orderdate") >= F.expr("TIMESTAMP_NTZ '1995-01-01'"))).select("o_orderkey")


@query("flt6_stale_tasks", f"SELECT task_id FROM {TASKS} WHERE status IN ('queued', 'running') AND started < TIMESTAMP '1996-01-01' AND tenant NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def flt6(t):
    stale = tasks(t).filter("status IN ('queued', 'running') AND started < TIMESTAMP_NTZ '1996-01-01'")
    return stale.join(t.customer.filter("c_acctbal > 0"), F.col("tenant") == F.col("c_custkey"), "left_anti").select("task_id")


@query("flt7_price_band", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice BETWEEN 1000 AND 50000 AND o_orderdate >= TIMESTAMP '1997-01-01' - INTERVAL 30 MINUTE")
def flt7(t):
    return t.orders.filter("o_orderstatus = 'O' AND o_totalprice BETWEEN 1000 AND 50000 AND o_orderdate >= TIMESTAMP_NTZ '1997-01-01' - INTERVAL 30 MINUTE").select("o_orderkey")


@query("flt8_ttl_keep", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15' OR event_type = 'purchase'")
def flt8(t):
    return t.events.filter("ts >= TIMESTAMP_NTZ '2024-01-15' OR event_type = 'purchase'").select("event_id")


@query("flt9_relevance_keep", "SELECT event_id FROM events WHERE NOT ((user_id IS NULL OR user_id % 5 <= 1) AND (value IS NULL OR value <= 50) AND (event_type IS NULL OR event_type NOT IN ('purchase', 'signup')))")
def flt9(t):
    gone = "(user_id IS NULL OR user_id % 5 <= 1) AND (value IS NULL OR value <= 50) AND (event_type IS NULL OR event_type NOT IN ('purchase', 'signup'))"
    return t.events.filter(f"NOT ({gone})").select("event_id")


@query("flt10_substring_search", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'blue') OR contains(lower(p_type), 'steel')")
def flt10(t):
    return t.part.filter(F.contains(F.lower("p_name"), F.lit("blue")) | F.contains(F.lower("p_type"), F.lit("steel"))).select("p_partkey")


@query("flt11_age_bucket", "SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS bucket, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-12-01') AS BIGINT) AS days FROM orders WHERE date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-12-01') > 7")
def flt11(t):
    days = F.datediff(F.lit("1998-12-01").cast("date"), F.col("o_orderdate").cast("date"))
    return t.orders.select("o_orderkey", F.element_at(F.split("o_orderpriority", "-"), 1).alias("bucket"), days.cast("bigint").alias("days")).filter("days > 7")


@query("flt12_endpoint_like", "SELECT p_partkey FROM part WHERE contains(p_name, 'a')")
def flt12(t):
    return t.part.filter(F.contains("p_name", F.lit("a"))).select("p_partkey")


@query("flt13_number_or_zero", "SELECT event_id, coalesce(TRY_CAST(regexp_extract(json_extract_string(props, '$.k'), '^[0-9]+$') AS BIGINT), 0) AS k FROM events")
def flt13(t):
    k = F.get_json_object("props", "$.k")
    return t.events.select("event_id", F.when(k.rlike("^[0-9]+$"), k.try_cast("bigint")).otherwise(0).cast("bigint").alias("k"))


PROGRESS = f"""SELECT task_id, e AS extract_pct, i AS index_pct, CAST(round_even(0.35 * e + 0.65 * i, 0) AS BIGINT) AS overall_pct FROM (
 SELECT task_id, CASE WHEN status = 'completed' OR phase IN ('completed', 'indexing') THEN 100 WHEN phase = 'splitting' THEN 95 WHEN phase = 'parsing' THEN 50 WHEN phase = 'queued' THEN 0 ELSE 50 END AS e,
 CASE WHEN status = 'completed' THEN 100 WHEN total_chunks > 0 THEN CAST(trunc(done_chunks * 100.0 / total_chunks) AS INTEGER) ELSE 0 END AS i FROM {TASKS})"""


@query("prj2_task_progress", PROGRESS)
def prj2(t):
    extract = F.when((F.col("status") == "completed") | F.col("phase").isin("completed", "indexing"), 100).when(F.col("phase") == "splitting", 95).when(F.col("phase") == "parsing", 50).when(F.col("phase") == "queued", 0).otherwise(50)
    index = F.when(F.col("status") == "completed", 100).when(F.col("total_chunks") > 0, F.expr("done_chunks * 100 div total_chunks")).otherwise(0)
    p = tasks(t).select("task_id", extract.alias("extract_pct"), index.cast("int").alias("index_pct"))
    return p.withColumn("overall_pct", F.expr("cast(bround(cast(0.35 * extract_pct + 0.65 * index_pct as decimal(10, 4)), 0) as bigint)"))


@query("prj1_task_dto", f"SELECT task_id, status, phase, round(size / 1048576.0, 6) AS mb, upper(status) || ':' || phase AS label FROM {TASKS}")
def prj1(t):
    return tasks(t).select("task_id", "status", "phase", F.round(F.col("size") / 1048576.0, 6).alias("mb"), F.concat_ws(":", F.upper("status"), "phase").alias("label"))


@query("prj3_guarded_ratios", f"SELECT task_id, CASE WHEN total_chunks > 0 THEN size / total_chunks END AS per_chunk FROM {TASKS}")
def prj3(t):
    return tasks(t).select("task_id", F.try_divide("size", "total_chunks").alias("per_chunk"))


@query("prj4_evidence", "SELECT doc_id, coalesce(nullif(trim(source), ''), 'unknown') AS origin, substr(text, 1, 40) AS excerpt FROM documents")
def prj4(t):
    return t.documents.select("doc_id", F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit("unknown")).alias("origin"), F.substring("text", 1, 40).alias("excerpt"))


@query("prj5_task_listing", f"SELECT task_id, tenant, coalesce(status, 'queued') AS status FROM {TASKS} ORDER BY started DESC, task_id LIMIT 50")
def prj5(t):
    return tasks(t).orderBy(F.desc("started"), "task_id").limit(50).select("task_id", "tenant", F.coalesce("status", F.lit("queued")).alias("status"))


@query("jn1_vectors_documents", "SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'")
def jn1(t):
    return t.lineitem.join(t.orders.filter("o_orderpriority = '1-URGENT'"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_orderstatus")


@query("jn2_latest_tree", "SELECT c_custkey, o_orderkey FROM customer JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders WHERE o_orderstatus = 'F') o ON c_custkey = o_custkey WHERE n = 1")
def jn2(t):
    latest = R.first_per(t.orders.filter("o_orderstatus = 'F'"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return t.customer.join(latest, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey")


@query("jn3_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def jn3(t):
    return t.customer.join(t.orders.filter("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("jn4_semi", "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def jn4(t):
    return t.supplier.join(t.lineitem.filter("l_quantity > 49"), F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey")


@query("jn5_tenant_scope", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_nationkey = 3))")
def jn5(t):
    mine = t.orders.join(t.customer.filter("c_nationkey = 3"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return t.lineitem.join(mine, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_orderkey", "l_linenumber")


@query("jn16_parent_child", "SELECT c.p_partkey, p.p_partkey AS parent, p.p_partkey IS NULL AS is_root FROM part c LEFT JOIN part p ON c.p_partkey // 10 = p.p_partkey")
def jn16(t):
    parent = t.part.select(F.col("p_partkey").alias("parent"))
    c = t.part.select("p_partkey", F.expr("p_partkey div 10").alias("up"))
    return c.join(parent, F.col("up") == F.col("parent"), "left").select("p_partkey", "parent", F.col("parent").isNull().alias("is_root"))


@query("jn17_membership", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def jn17(t):
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("jn18_pair_roles", "SELECT conv_id, max(CASE WHEN role = 'user' THEN text END) AS question, max(CASE WHEN role = 'assistant' THEN text END) AS answer, count(DISTINCT role) >= 2 AS paired FROM conversations GROUP BY conv_id")
def jn18(t):
    of = lambda r: F.max(F.when(F.col("role") == r, F.col("text")))
    return t.conversations.groupBy("conv_id").agg(of("user").alias("question"), of("assistant").alias("answer"), (F.count_distinct("role") >= 2).alias("paired"))


@query("jn19_existence_flag", "SELECT d.doc_id, l.doc_id IS NOT NULL AS has_label FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def jn19(t):
    l = t.labels.select("doc_id").distinct().withColumn("x", F.lit(1))
    return t.documents.join(l, "doc_id", "left").select("doc_id", F.col("x").isNotNull().alias("has_label"))


@query("jn15_hash_lookup", "SELECT d.doc_id, min(e.doc_id) AS first_doc FROM documents d JOIN documents e ON sha256(d.text) = sha256(e.text) GROUP BY d.doc_id")
def jn15(t):
    h = t.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    first = h.groupBy("h").agg(F.min("doc_id").alias("first_doc"))
    return h.join(first, "h").select("doc_id", "first_doc")


@query("set1_keep_first", "SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def set1(t):
    return R.first_per(t.documents, ["source", "lang"], [F.col("doc_id")]).select("source", "doc_id")


@query("set2_prefix_key", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY substr(text, 1, 80) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def set2(t):
    return R.first_per(t.documents.withColumn("p", F.substring("text", 1, 80)), ["p"], [F.col("doc_id")]).select("doc_id")


@query("set3_intersection", "SELECT doc_id, len(list_intersect(list_distinct(string_split(text, ' ')), ['the', 'of', 'and', 'de', 'que'])) AS shared FROM documents")
def set3(t):
    words = F.array_distinct(F.split("text", " "))
    return t.documents.select("doc_id", F.size(F.array_intersect(words, F.array(*map(F.lit, ["the", "of", "and", "de", "que"])))).cast("bigint").alias("shared"))


@query("set5_union", "SELECT c_nationkey AS nation, 'customer' AS kind, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, 'supplier', count(*) FROM supplier GROUP BY 1")
def set5(t):
    c = t.customer.groupBy(F.col("c_nationkey").alias("nation"), F.lit("customer").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return c.unionByName(t.supplier.groupBy(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("kind")).agg(F.count(F.lit(1)).alias("n")))


@query("set6_difference", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def set6(t):
    return t.part.join(t.lineitem.filter("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query("set7_chunk_hash", "SELECT conv_id, turn, sha256('turn|' || role || '|' || turn || '|' || text) AS hash FROM conversations")
def set7(t):
    return t.conversations.select("conv_id", "turn", F.sha2(F.concat_ws("|", F.lit("turn"), "role", F.col("turn").cast("string"), "text"), 256).alias("hash"))


@query("set8_back_edges", "SELECT l_partkey AS source, l_suppkey AS target, 'cites' AS relation FROM lineitem WHERE l_linenumber = 1 UNION SELECT l_suppkey, l_partkey, 'cited_by' FROM lineitem WHERE l_linenumber = 1")
def set8(t):
    e = t.lineitem.filter("l_linenumber = 1").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.lit("cites").alias("relation"))
    return e.union(e.select("target", "source", F.lit("cited_by"))).distinct()


@query("set4_node_ids", "SELECT DISTINCT 'doc:' || l_orderkey AS id FROM lineitem UNION SELECT DISTINCT 'kp:' || l_partkey FROM lineitem")
def set4(t):
    return t.lineitem.select(F.explode(F.array(F.concat(F.lit("doc:"), "l_orderkey"), F.concat(F.lit("kp:"), "l_partkey"))).alias("id")).distinct()


@query("set9_title_dedupe", "SELECT title, min(doc_id) AS doc_id FROM (SELECT doc_id, lower(trim(split_part(text, '.', 1))) AS title FROM documents) GROUP BY title")
def set9(t):
    return t.documents.select("doc_id", F.lower(F.trim(F.split_part("text", F.lit("."), F.lit(1)))).alias("title")).groupBy("title").agg(F.min("doc_id").alias("doc_id"))


@query("ups1_checkpoint_upsert", "SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'pending' WHEN l.quality = 1 THEN 'done' ELSE 'retry' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def ups1(t):
    stored = t.documents.select("doc_id", F.lit("pending").alias("status"))
    new = t.labels.select("doc_id", F.when(F.col("quality") == 1, "done").otherwise("retry").alias("status"))
    return R.upsert(stored, new, ["doc_id"])


@query("ups4_additive", "SELECT custkey, round(sum(v), 2) AS balance FROM (SELECT c_custkey AS custkey, c_acctbal AS v FROM customer UNION ALL SELECT o_custkey, o_totalprice FROM orders) GROUP BY custkey")
def ups4(t):
    base = t.customer.select(F.col("c_custkey").alias("custkey"), F.col("c_acctbal").alias("balance"))
    return R.add_up(base, t.orders.select(F.col("o_custkey").alias("custkey"), F.col("o_totalprice").alias("balance")), ["custkey"], ["balance"]).withColumn("balance", F.round("balance", 2))


@query("ups5_cache", "SELECT d.doc_id, coalesce(l.toxic, -1) AS cached FROM documents d LEFT JOIN labels l USING (doc_id)")
def ups5(t):
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", F.coalesce("toxic", F.lit(-1)).alias("cached"))


@query("ups6_last_write", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def ups6(t):
    return R.last_write(t.events.select("user_id", "event_id", "event_type", "ts"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


@query("ups7_insert_or_ignore", "SELECT doc_id, 0 AS toxic FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, toxic FROM labels")
def ups7(t):
    new = t.documents.select("doc_id", F.lit(0).alias("toxic"))
    stored = t.labels.select("doc_id", "toxic")
    return stored.unionByName(R.missing_from(new, stored, ["doc_id"]))


@query("ups8_clamped_update", "SELECT event_id, CASE WHEN event_type = 'purchase' THEN least(1.0, greatest(value / 100, 0.5)) ELSE value / 100 END AS factor FROM events")
def ups8(t):
    v = F.col("value") / 100
    return t.events.select("event_id", F.when(F.col("event_type") == "purchase", F.least(F.lit(1.0), F.greatest(v, F.lit(0.5)))).otherwise(v).alias("factor"))


@query("ups9_cascade_delete", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def ups9(t):
    gone = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return R.without_keys(t.lineitem, gone, ["l_orderkey"]).select("l_orderkey", "l_linenumber")


@query("ups10_rebuild", "SELECT c_custkey, c_nationkey AS tenant, CASE WHEN c_nationkey = 7 THEN 'new' ELSE 'old' END AS made FROM customer WHERE c_nationkey <> 7 OR c_acctbal > 0")
def ups10(t):
    """A stored table by tenant, of which one tenant is rebuilt in place; the others' files stay as they are."""
    path = T.fresh_path(t.spark, "relations")
    rows = t.customer.select("c_custkey", F.lit("old").alias("made"), F.col("c_nationkey").alias("tenant"))
    T.rebuild(rows, "tenant", path)
    fresh = t.customer.filter("c_nationkey = 7 AND c_acctbal > 0").select("c_custkey", F.lit("new").alias("made"), F.col("c_nationkey").alias("tenant"))
    return T.rebuild(fresh, "tenant", path).select("c_custkey", "tenant", "made")


@query("ups11_retention", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def ups11(t):
    end = t.events.agg(F.max("ts")).first()[0]
    return t.events.filter(F.col("ts") >= F.lit(end).cast("timestamp_ntz") - F.expr("INTERVAL 7 DAY")).select("event_id")


@query("srt1_top_k", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def srt1(t):
    return R.top_k(t.documents.select("doc_id", "n_chars"), "n_chars", "doc_id", 10)


@query("srt4_number_path", "SELECT p, row_number() OVER (ORDER BY list_transform(string_split(p, '.'), lambda x: TRY_CAST(x AS INTEGER))) AS n FROM (SELECT DISTINCT l_linenumber || '.' || CAST(l_quantity AS INTEGER) AS p FROM lineitem)")
def srt4(t):
    p = t.lineitem.select(F.concat_ws(".", F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string")).alias("p")).distinct()
    key = F.transform(F.split("p", r"\."), lambda x: x.try_cast("int"))
    return p.select("p", F.row_number().over(Window.orderBy(key)).alias("n"))  # a few hundred paths


@query("srt5_two_keys", "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_extendedprice DESC, l_quantity DESC, l_orderkey, l_linenumber LIMIT 25")
def srt5(t):
    return t.lineitem.orderBy(F.desc("l_extendedprice"), F.desc("l_quantity"), "l_orderkey", "l_linenumber").limit(25).select("l_orderkey", "l_linenumber")


@query("srt6_listing", "SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 1 ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def srt6(t):
    return t.orders.filter("o_custkey % 10 = 1").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20).select("o_orderkey")


@query("srt7_hash_sample", "SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 200")
def srt7(t):
    return t.documents.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(200).select("doc_id")


@query("srt9_tree_order", "SELECT n_name, row_number() OVER (ORDER BY r_name, n_nationkey) AS n FROM nation JOIN region ON n_regionkey = r_regionkey")
def srt9(t):
    j = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select("n_name", F.row_number().over(Window.orderBy("r_name", "n_nationkey")).alias("n"))  # the 25 nations


@query("srt10_frequency", "SELECT event_type, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY event_type ORDER BY n DESC, first_seen LIMIT 3")
def srt10(t):
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_seen")).orderBy(F.desc("n"), "first_seen").limit(3)
