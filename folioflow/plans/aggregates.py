"""Aggregations over the operational tables."""

from pyspark.sql import functions as F

from folioflow.operators import rows as R
from folioflow.plans.registry import Tables, query
from folioflow.plans.relational import TASKS, tasks


@query("agg1_counts", "SELECT count(*) AS n, count(*) FILTER (lang = 'en') AS n_en FROM documents")
def agg1(t: Tables):
    return t.documents.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lang") == "en").alias("n_en"))


@query("agg2_status_counts", f"SELECT status, count(*) AS n FROM {TASKS} GROUP BY status")
def agg2(t):
    return tasks(t).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("agg3_distinct_per_key", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def agg3(t):
    return t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@query("agg4_two_source_sum", "SELECT nation, CAST(sum(n) AS BIGINT) AS n FROM (SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, count(*) FROM supplier GROUP BY 1) GROUP BY nation")
def agg4(t):
    part = lambda d, c: d.groupBy(F.col(c).alias("nation")).agg(F.count(F.lit(1)).alias("n"))
    return part(t.customer, "c_nationkey").unionByName(part(t.supplier, "s_nationkey")).groupBy("nation").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


@query("agg5_conditional", f"SELECT tenant, count(*) FILTER (status = 'running') AS active, count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (phase = 'failed') AS failed FROM {TASKS} GROUP BY tenant")
def agg5(t):
    return tasks(t).groupBy("tenant").agg(F.count_if(F.col("status") == "running").alias("active"), F.count_if(F.col("status") == "queued").alias("queued"), F.count_if(F.col("phase") == "failed").alias("failed"))


@query("agg6_rollup_metrics", f"SELECT count(*) AS completed, round(sum(size), 2) AS bytes, round(sum(size) / count(*), 4) AS mean FROM {TASKS} WHERE status = 'completed'")
def agg6(t):
    return tasks(t).filter("status = 'completed'").agg(F.count(F.lit(1)).alias("completed"), F.round(F.sum("size"), 2).alias("bytes"), F.round(F.sum("size") / F.count(F.lit(1)), 4).alias("mean"))


@query("agg7_balances", "SELECT user_id, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS balance FROM events GROUP BY user_id")
def agg7(t):
    return t.events.groupBy("user_id").agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("balance"))


@query("agg8_refund_states", """SELECT c_custkey, credited, reverted, round(credited - reverted, 2) AS net, CASE WHEN reverted = 0 THEN 'active' WHEN c_acctbal < reverted / 100 THEN 'refund_pending_settlement' WHEN reverted >= credited THEN 'refunded' ELSE 'partly_refunded' END AS status
FROM (SELECT o_custkey, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus <> 'O'), 0), 2) AS credited, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 0), 2) AS reverted FROM orders GROUP BY 1) JOIN customer ON o_custkey = c_custkey""")
def agg8(t):
    """Per tenant what was credited and what was taken back, and where that leaves it; a balance too low leaves a refund pending."""
    total = lambda cond: F.round(F.coalesce(F.sum(F.when(cond, F.col("o_totalprice"))), F.lit(0)), 2)
    sums = t.orders.groupBy("o_custkey").agg(total(F.col("o_orderstatus") != "O").alias("credited"), total(F.col("o_orderstatus") == "P").alias("reverted"))
    status = F.when(F.col("reverted") == 0, "active").when(F.col("c_acctbal") < F.col("reverted") / 100, "refund_pending_settlement").when(F.col("reverted") >= F.col("credited"), "refunded").otherwise("partly_refunded")
    both = sums.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return both.select("c_custkey", "credited", "reverted", F.round(F.col("credited") - F.col("reverted"), 2).alias("net"), status.alias("status"))


@query("agg9_daily_usage", "SELECT strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def agg9(t):
    return t.events.groupBy(F.date_format(F.col("ts") + F.expr("INTERVAL 8 HOURS"), "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("agg9_monthly_usage", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def agg9m(t):
    return t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("agg10_quota", "SELECT source, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS used, CAST(greatest(0, 50000 + 1000 * count(*) - sum(n_chars)) AS BIGINT) AS left_over FROM documents GROUP BY source")
def agg10(t):
    n, used = F.count(F.lit(1)), F.sum("n_chars")
    return t.documents.groupBy("source").agg(n.alias("docs"), used.alias("used"), F.greatest(F.lit(0), 50000 + 1000 * n - used).cast("bigint").alias("left_over"))


@query("agg11_activation_sum", "SELECT user_id, event_type, CAST(sum(event_id % 5) AS BIGINT) AS activation FROM events GROUP BY 1, 2")
def agg11(t):
    return t.events.groupBy("user_id", "event_type").agg(F.sum(F.col("event_id") % 5).alias("activation"))


@query("agg15_histogram", "SELECT round(avg(l_discount), 6) AS mean, count(*) FILTER (l_discount < 0.03) AS easy, count(*) FILTER (l_discount >= 0.03 AND l_discount < 0.07) AS medium, count(*) FILTER (l_discount >= 0.07) AS hard FROM lineitem")
def agg15(t):
    d = F.col("l_discount")
    return t.lineitem.agg(F.round(F.avg(d), 6).alias("mean"), F.count_if(d < 0.03).alias("easy"), F.count_if((d >= 0.03) & (d < 0.07)).alias("medium"), F.count_if(d >= 0.07).alias("hard"))


@query("agg17_pass_rates", "SELECT lang, round(avg(CAST(n_chars > 500 AS INTEGER)), 3) AS long_rate, round(avg(CAST(contains(text, '.') AS INTEGER)), 3) AS sentence_rate FROM documents GROUP BY lang")
def agg17(t):
    rate = lambda c: F.round(F.avg(c.cast("int")), 3)
    return t.documents.groupBy("lang").agg(rate(F.col("n_chars") > 500).alias("long_rate"), rate(F.contains("text", F.lit("."))).alias("sentence_rate"))


@query("agg23_spans", "SELECT l_orderkey, min(l_linenumber) AS first, max(l_linenumber) AS last, count(*) AS n, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY 1")
def agg23(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.min("l_linenumber").alias("first"), F.max("l_linenumber").alias("last"), F.count(F.lit(1)).alias("n"), R.keep_in_order(F.struct("l_linenumber", "l_partkey"), F.col("l_partkey").cast("string"), ",").alias("parts"))


@query("agg24_clusters", "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, count(*) OVER (PARTITION BY l_suppkey) AS c, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE c >= 3 AND n <= 50")
def agg24(t):
    big = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("c")).filter("c >= 3").select("l_suppkey")
    return R.first_per(t.lineitem.join(big, "l_suppkey", "left_semi"), ["l_suppkey"], [F.col("l_orderkey"), F.col("l_linenumber")], 50).select("l_suppkey", "l_orderkey", "l_linenumber")


@query("agg25_concat", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def agg25(t):
    return t.conversations.groupBy("conv_id").agg(R.keep_in_order(F.col("turn"), F.concat_ws(": ", "role", "text"), "\n").alias("transcript"))


@query("agg26_coverage", f"SELECT tenant, round(sum(CASE WHEN status = 'completed' THEN 1 ELSE 0 END) * 1.0 / count(*), 6) AS ratio FROM {TASKS} GROUP BY tenant")
def agg26(t):
    return tasks(t).groupBy("tenant").agg(F.round(F.count_if(F.col("status") == "completed") / F.count(F.lit(1)), 6).alias("ratio"))


@query("agg28_lengths", "SELECT source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY source")
def agg28(t):
    return t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("agg29_top3_mean", "SELECT l_suppkey, round(avg(l_extendedprice), 3) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n <= 3 GROUP BY l_suppkey")
def agg29(t):
    top = R.first_per(t.lineitem, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 3)
    return top.groupBy("l_suppkey").agg(F.round(F.avg("l_extendedprice"), 3).alias("mean"))


@query("agg31_audit", "SELECT user_id, event_id FROM events WHERE user_id = 5 AND ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-02-01'")
def agg31(t):
    return t.events.filter("user_id = 5 AND ts BETWEEN TIMESTAMP_NTZ '2024-01-01' AND TIMESTAMP_NTZ '2024-02-01'").select("user_id", "event_id")


@query("agg32_pending", f"SELECT count(*) FILTER (coalesce(status, 'queued') NOT IN ('completed', 'failed')) AS pending FROM {TASKS}")
def agg32(t):
    return tasks(t).agg(F.count_if(~F.coalesce("status", F.lit("queued")).isin("completed", "failed")).alias("pending"))


@query("agg33_gates", "SELECT source, bool_and(n_chars > 20) AS all_long, bool_or(contains(text, '@')) AS any_mail, array_to_string(list_filter([CASE WHEN NOT bool_and(n_chars > 20) THEN 'length' END, CASE WHEN bool_or(contains(text, '@')) THEN 'mail' END], lambda x: x IS NOT NULL), ',') AS failed FROM documents GROUP BY source")
def agg33(t):
    long, mail = F.every(F.col("n_chars") > 20), F.some(F.contains("text", F.lit("@")))
    failed = F.array_join(F.array_compact(F.array(F.when(~long, "length"), F.when(mail, "mail"))), ",")
    return t.documents.groupBy("source").agg(long.alias("all_long"), mail.alias("any_mail"), failed.alias("failed"))


@query("agg34_progress_means", f"SELECT tenant, round(avg(done_chunks), 6) AS mean, bool_or(phase = 'failed') AS any_slow, max(size) AS largest FROM {TASKS} GROUP BY tenant")
def agg34(t):
    return tasks(t).groupBy("tenant").agg(F.round(F.avg("done_chunks"), 6).alias("mean"), F.some(F.col("phase") == "failed").alias("any_slow"), F.max("size").alias("largest"))


@query("agg35_page_sums", "SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS tokens, count(*) FILTER (l_returnflag = 'R') AS failed FROM lineitem GROUP BY 1")
def agg35(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("tokens"), F.count_if(F.col("l_returnflag") == "R").alias("failed"))


@query("agg_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def agg_rollup(t):
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("agg_cube", "SELECT lang, source, count(*) AS n FROM documents GROUP BY CUBE (lang, source)")
def agg_cube(t):
    return t.documents.cube("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query("q19_queue_metrics", f"SELECT count(*) FILTER (status = 'queued') AS queued, round(count(*) FILTER (status = 'running') / 5000.0, 6) AS utilisation, round(count(*) FILTER (status = 'queued') * avg(size), 2) AS eta FROM {TASKS}")
def q19(t):
    queued = F.count_if(F.col("status") == "queued")
    return tasks(t).agg(queued.alias("queued"), F.round(F.count_if(F.col("status") == "running") / 5000.0, 6).alias("utilisation"), F.round(queued * F.avg("size"), 2).alias("eta"))


@query("q20_admission", "SELECT event_id, tenant_n <= 3 AND all_n <= 60 AS admitted FROM (SELECT event_id, row_number() OVER (PARTITION BY date_trunc('minute', ts), user_id ORDER BY ts, event_id) AS tenant_n, row_number() OVER (PARTITION BY date_trunc('minute', ts) ORDER BY ts, event_id) AS all_n FROM events)")
def q20(t):
    """Per minute at most 3 requests a user and 60 in all are admitted."""
    from pyspark.sql import Window

    minute = F.date_trunc("minute", "ts")
    n = lambda *keys: F.row_number().over(Window.partitionBy(minute, *keys).orderBy("ts", "event_id"))
    return t.events.select("event_id", ((n("user_id") <= 3) & (n() <= 60)).alias("admitted"))
