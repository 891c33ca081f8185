"""Window queries, as-of and interval joins."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioflow.operators import knowledge as K
from folioflow.operators import ordered as O
from folioflow.operators import rows as R
from folioflow.plans.registry import Tables, query

EPOCH = "epoch(ts)"


@query("win1_ranks", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents")
def win1(t: Tables):
    return t.documents.select("doc_id", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).alias("n"))


@query("win3_last_n", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 5")
def win3(t):
    return R.first_per(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id")


@query("win4_latest", "SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS latest FROM orders GROUP BY o_custkey")
def win4(t):
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", "o_orderkey").alias("latest"))


@query("win5_last_turns", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3")
def win5(t):
    last = R.first_per(t.conversations, ["conv_id"], [F.desc("turn")], 3)
    return last.select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("n"))


@query("win6_forward_fill", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events")
def win6(t):
    v = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return t.events.select("event_id", O.carried(v, ["user_id"], ["ts", "event_id"]).alias("carried"))


@query("win7_sections", "SELECT event_id, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section FROM events")
def win7(t):
    return O.sections(t.events, F.col("event_type") == "signup", ["user_id"], ["ts", "event_id"]).select("event_id", "section")


@query("win8_look_ahead", "SELECT conv_id, turn, length(trim(lead(text) OVER (PARTITION BY conv_id ORDER BY turn))) > 100 AS heads_long FROM conversations")
def win8(t):
    return t.conversations.select("conv_id", "turn", (F.length(F.trim(F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))) > 100).alias("heads_long"))


@query("win9_interval_end", "SELECT event_id, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until FROM events")
def win9(t):
    return t.events.select("event_id", F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("until"))


@query("win10_batches", "SELECT doc_id, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 30) AS BIGINT) AS batch FROM documents")
def win10(t):
    return R.batches(t.documents, [F.col("doc_id")], 30, ["source"]).select("doc_id", "batch")


SEGMENTS = """WITH s AS (SELECT l_suppkey, l_orderkey, l_linenumber, count(*) OVER w AS n, max(l_linenumber) OVER w - min(l_linenumber) OVER w + 1 AS span,
 row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)),
d AS (SELECT *, CASE WHEN n <= 24 OR (span <= 24 AND n <= 48) THEN n WHEN span <= 48 THEN greatest(24, (n + 1) // 2) WHEN span <= 90 THEN greatest(24, (n + 2) // 3) ELSE greatest(24, (n + 3) // 4) END AS size FROM s)
SELECT l_orderkey, l_linenumber, CAST((r - 1) // size AS BIGINT) AS segment FROM d"""


@query("win11_segments", SEGMENTS)
def win11(t):
    """Chapters split by their page span and rows: small ones stay whole, larger ones go into 2 to 4 segments."""
    w = Window.partitionBy("l_suppkey")
    n, span = F.count(F.lit(1)).over(w), F.max("l_linenumber").over(w) - F.min("l_linenumber").over(w) + 1
    d = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", n.alias("n"), span.alias("span"), F.row_number().over(w.orderBy("l_orderkey", "l_linenumber")).alias("r"))
    size = "CASE WHEN n <= 24 OR (span <= 24 AND n <= 48) THEN n WHEN span <= 48 THEN greatest(24, (n + 1) div 2) WHEN span <= 90 THEN greatest(24, (n + 2) div 3) ELSE greatest(24, (n + 3) div 4) END"
    return d.select("l_orderkey", "l_linenumber", F.expr(f"(r - 1) div ({size})").alias("segment"))


COVERAGE = """WITH d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id FROM d WHERE n <= 12 OR r = 0 OR r = n - 1 OR list_contains(list_transform(range(1, 11), lambda i: CAST(round_even(i / 11.0 * (n - 1), 0) AS BIGINT)), r)"""


@query("win12_coverage", COVERAGE)
def win12(t):
    w = Window.partitionBy("source")
    d = t.documents.select("doc_id", (F.row_number().over(w.orderBy("doc_id")) - 1).alias("r"), F.count(F.lit(1)).over(w).alias("n"))
    return d.filter(F.array_contains(O.coverage_indices(F.col("n"), 12), F.col("r"))).select("doc_id")


@query("win15_boost", "SELECT event_id, round(least(3.0, 1 + log2(n) * 0.5), 6) AS boost FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM events)")
def win15(t):
    n = F.count(F.lit(1)).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return t.events.select("event_id", F.round(F.least(F.lit(3.0), 1 + F.log2(n) * 0.5), 6).alias("boost"))


@query("win16_sliding_minute", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS n FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)")
def win16(t):
    s = t.events.withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp")))
    return s.select("event_id", F.count(F.lit(1)).over(Window.partitionBy("user_id").orderBy("s").rangeBetween(-59, 0)).alias("n"))


@query("win17_cooldown", "SELECT event_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 300000000, false) AS cooling FROM events")
def win17(t):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = us - F.lag(us).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.select("event_id", F.coalesce(gap < 300000000, F.lit(False)).alias("cooling"))


@query("win18_running_balance", "SELECT event_id, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS balance FROM events")
def win18(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("event_id", F.sum(F.col("value").cast("decimal(18,2)")).over(w).cast("double").alias("balance"))


@query("jn9_as_of", "SELECT e.event_id, p.purchase FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS purchase FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts")
def jn9(t):
    e = t.events.select("event_id", "user_id", "ts")
    p = t.events.filter("event_type = 'purchase'").groupBy("user_id", F.col("ts").alias("at")).agg(F.max("event_id").alias("purchase"))
    return O.as_of(e, p, "user_id", "ts", "at", ["purchase"]).select("event_id", "purchase")


@query("jn10_range", "SELECT o_orderkey, band FROM orders JOIN (SELECT r_regionkey AS band, r_regionkey * 90000.0 AS lo, (r_regionkey + 1) * 90000.0 AS hi FROM region) ON o_totalprice >= lo AND o_totalprice < hi")
def jn10(t):
    b = t.region.select(F.col("r_regionkey").alias("band"), (F.col("r_regionkey") * 90000.0).alias("lo"), ((F.col("r_regionkey") + 1) * 90000.0).alias("hi"))
    return t.orders.join(F.broadcast(b), (F.col("o_totalprice") >= F.col("lo")) & (F.col("o_totalprice") < F.col("hi"))).select("o_orderkey", "band")  # five regions


OVERLAP = """WITH a AS (SELECT l_orderkey AS k, l_linenumber AS s, l_linenumber + 2 AS e FROM lineitem),
b AS (SELECT l_orderkey AS k, l_suppkey AS item, min(l_linenumber) AS s, max(l_linenumber) + 1 AS e FROM lineitem GROUP BY 1, 2)
SELECT k, s, item FROM (SELECT a.k, a.s, item, row_number() OVER (PARTITION BY a.k, a.s ORDER BY least(a.e, b.e) - greatest(a.s, b.s) DESC, item) AS n FROM a JOIN b ON a.k = b.k AND a.s <= b.e AND b.s <= a.e) WHERE n = 1"""


@query("jn11_best_overlap", OVERLAP)
def jn11(t):
    lines = R.dealt(t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey"), "l_orderkey")
    a = lines.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("s"), (F.col("l_linenumber") + 2).alias("e"))
    b = lines.groupBy(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("item")).agg(F.min("l_linenumber").alias("bs"), (F.max("l_linenumber") + 1).alias("be"))
    both = a.join(b, "k").filter("s <= be AND bs <= e").withColumn("score", F.least("e", "be") - F.greatest("s", "bs"))
    return R.first_per(both, ["k", "s"], [F.desc("score"), F.col("item")]).select("k", "s", "item")


LABELS = "(SELECT split_part(p_name, ' ', 2) AS label, min(p_partkey) AS k FROM part GROUP BY 1 UNION ALL SELECT split_part(p_name, ' ', 1), min(p_partkey) FROM part GROUP BY 1)"


def labels(t):
    """The few distinct words of part names."""
    word = lambda i: t.part.groupBy(F.split_part("p_name", F.lit(" "), F.lit(i)).alias("label")).agg(F.min("p_partkey").alias("k"))
    return word(2).unionByName(word(1))


@query("jn8_containment", f"SELECT p.p_partkey, min(k) AS first_match FROM part p JOIN {LABELS} l ON contains(p.p_name, l.label) AND k <> p.p_partkey GROUP BY p.p_partkey")
def jn8(t):
    """Labels are looked up by their rarest n-gram among the names."""
    found = K.containing(t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), labels(t))
    held = found.join(labels(t), "label").filter("k <> id")
    return held.groupBy(F.col("id").alias("p_partkey")).agg(F.min("k").alias("first_match"))


NEAR = """WITH e AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)
SELECT id, other, greatest(0.0, 1 - delta / 3600.0) AS weight FROM (SELECT a.event_id AS id, b.event_id AS other, abs(a.s - b.s) AS delta,
 row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.s - b.s), b.event_id) AS n FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND abs(a.s - b.s) <= 3600) WHERE n <= 4"""


@query("jn13_near_in_time", NEAR)
def jn13(t):
    e = t.events.select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    return O.near_in_time(e, "user_id", "s", "event_id", 3600, 4).select("id", "other", F.greatest(F.lit(0.0), 1 - F.col("delta") / 3600.0).alias("weight"))


PAIRS = """SELECT DISTINCT a.l_orderkey AS a, b.l_orderkey AS b FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_orderkey < b.l_orderkey"""


@query("jn6_shared_points", PAIRS)
def jn6(t):
    """Documents (orders) sharing a point (part): all of each point are linked, once by the least of the points they share."""
    sets = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("points"))
    k = R.dealt(sets.select("l_orderkey", "points", F.explode("points").alias("l_partkey")), "l_partkey")
    b = k.select("l_partkey", F.col("l_orderkey").alias("b"), F.col("points").alias("other"))
    both = k.join(b.hint("merge"), "l_partkey").filter("l_orderkey < b")
    return both.filter(F.array_intersect("points", "other")[0] == F.col("l_partkey")).select(F.col("l_orderkey").alias("a"), "b")


@query("jn7_term_overlap", "SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS shared FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) a JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) b ON a.l_partkey = b.l_partkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2")
def jn7(t):
    a = R.dealt(t.lineitem.select(F.col("l_suppkey").alias("a"), "l_partkey"), "l_partkey").distinct()
    b = a.withColumnRenamed("a", "b")
    return a.join(b, "l_partkey").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
