"""Memory, exam, date and arithmetic queries."""

from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import exam
from folioflow.operators import memory as M
from folioflow.operators import retrieval as S
from folioflow.operators import rows as R
from folioflow.plans.registry import Tables, query

KLASS = "CASE event_type WHEN 'purchase' THEN 'slow' WHEN 'error' THEN 'fast' WHEN 'signup' THEN 'permanent' ELSE 'normal' END"
AGE = "epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts))"


def klass():
    e = F.col("event_type")
    return F.when(e == "purchase", "slow").when(e == "error", "fast").when(e == "signup", "permanent").otherwise("normal")


def age():
    return F.unix_seconds(F.lit("2024-02-01").cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))


@query("mth1_retention", f"SELECT event_id, CASE WHEN k = 'permanent' THEN 'infinite' ELSE CAST(round(exp(-greatest(0.0, a) / (CASE k WHEN 'slow' THEN 345600.0 WHEN 'fast' THEN 21600.0 ELSE 86400.0 END * greatest(1.0, value / 10))) * 1000000) AS BIGINT)::VARCHAR END AS retention FROM (SELECT *, {KLASS} AS k, {AGE} AS a FROM events)")
def mth1(t: Tables):
    r = M.retention(age(), klass(), F.col("value") / 10)
    return t.events.select("event_id", F.when(klass() == "permanent", "infinite").otherwise(F.round(r * 1000000).cast("bigint").cast("string")).alias("retention"))


@query("mth4_salience", "SELECT event_id, round(s, 6) AS score, CASE WHEN s >= 0.85 THEN 'permanent' WHEN s >= 0.65 THEN 'slow' WHEN s >= 0.4 THEN 'normal' ELSE 'fast' END AS klass FROM (SELECT event_id, 0.45 * (event_id % 10 / 9.0) + 0.35 * (user_id % 7 / 6.0) + 0.2 * greatest(0.0, least(1.0, value / 50)) AS s FROM events)")
def mth4(t):
    s = M.salience(F.col("event_id") % 10 / 9.0, F.col("user_id") % 7 / 6.0, F.col("value") / 50)
    return t.events.select("event_id", F.round(s, 6).alias("score"), M.salience_class(s).alias("klass"))


@query("mth5_mismatch", "SELECT event_id, round(e, 6) AS effective, CASE WHEN e >= 0.75 THEN 'flashbulb' WHEN e >= 0.4 THEN 'high' WHEN e >= 0.2 THEN 'moderate' ELSE 'expected' END AS level, round(least(1.0, greatest(0.5, 0.7 * 0.5 + 0.3 * m)), 6) AS fused FROM (SELECT *, CASE WHEN e >= 0.75 THEN least(0.5, e * 0.3) WHEN e >= 0.4 THEN e * 0.3 * 0.7 WHEN e >= 0.2 THEN e * 0.3 * 0.4 ELSE 0 END AS m FROM (SELECT event_id, greatest(0.1, (1 - event_id % 13 / 12.0) * greatest(0.05, user_id % 11 / 10.0)) AS e FROM events))")
def mth5(t):
    e = M.mismatch(F.col("event_id") % 13 / 12.0, F.col("user_id") % 11 / 10.0)
    return t.events.select("event_id", F.round(e, 6).alias("effective"), M.surprise(e).alias("level"), F.round(M.fuse_salience(F.lit(0.5), M.modifier(e)), 6).alias("fused"))


@query("mth6_novelty", "SELECT q AS vec_id, round(CASE WHEN m < 0.55 THEN least(1.0, (1 - m) * 1.3) ELSE 1 - m END, 6) AS novelty FROM (SELECT q.vec_id AS q, max(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(s.embedding AS DOUBLE[]))) AS m FROM embeddings q JOIN embeddings s ON q.vec_id <> s.vec_id WHERE q.vec_id % 20 = 0 GROUP BY 1)")
def mth6(t):
    """Novelty of each vector whose id 20 divides against all others."""
    top = S.nearest(t.embeddings.filter("vec_id % 20 = 0"), t.embeddings, "vec_id", "embedding", 1, -1.0)
    return top.select(F.col("q").alias("vec_id"), F.round(M.novelty(F.col("score")), 6).alias("novelty"))


@query("srt8_replay", "SELECT * FROM (SELECT * FROM (SELECT 'attention' AS source, user_id AS id, 0.5 * count(*) AS priority FROM events GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 6) UNION ALL SELECT * FROM (SELECT 'fragment', o_custkey, 0.3 * (count(*) + 1) FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey LIMIT 4) UNION ALL SELECT * FROM (SELECT 'vector', doc_id, 0.2 * n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 4)) ORDER BY priority DESC, source, id LIMIT 12")
def srt8(t):
    a = t.events.groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("strength"))
    f = t.orders.groupBy(F.col("o_custkey").alias("id")).agg((F.count(F.lit(1)) + 1).alias("strength"))
    return M.replay_candidates(a, f, t.documents.select(F.col("doc_id").alias("id"), F.col("n_chars").alias("strength")))


NOW = 1_000_000


@query("q18_replay_cycle", f"""WITH v AS (SELECT vec_id AS id, 'h' || vec_id // 2 AS content_hash, 1 + label / 10.0 AS decay_factor, vec_id % 4 AS activation_count, (vec_id * 37 % 997) / 997.0 AS salience, CASE vec_id % 5 WHEN 0 THEN 'permanent' WHEN 1 THEN 'slow' WHEN 2 THEN NULL ELSE 'fast' END AS decay_class, {NOW} - vec_id * 10 AS "at" FROM embeddings),
a AS (SELECT event_id AS id, 'h' || event_id AS content_hash, event_id * 7 % 11 AS strength FROM events WHERE event_id * 30 <= 3600),
c AS (SELECT * FROM (SELECT 'attention' AS source, id, 0.5 * strength AS p FROM a ORDER BY strength DESC, id LIMIT 6) UNION ALL SELECT * FROM (SELECT 'fragment', conv_id, 0.3 * count(*) FROM conversations GROUP BY conv_id ORDER BY count(*) DESC, conv_id LIMIT 4) UNION ALL SELECT * FROM (SELECT 'vector', id, 0.2 * coalesce(nullif(salience, 0), 0.3) FROM v WHERE activation_count > 0 AND decay_class IS DISTINCT FROM 'permanent' ORDER BY coalesce(nullif(salience, 0), 0.3) DESC, id LIMIT 4)),
best AS (SELECT * FROM c ORDER BY p DESC, source, id LIMIT 12),
hit AS (SELECT id, 0 AS act FROM best WHERE source = 'vector' UNION ALL SELECT min(v.id), 1 FROM best JOIN a ON a.id = best.id JOIN v ON v.content_hash = a.content_hash WHERE source = 'attention' GROUP BY best.id),
h AS (SELECT id, count(*) AS times, sum(act) AS act FROM hit GROUP BY id)
SELECT v.id, round(CASE WHEN times > 0 THEN least(2.5, decay_factor + 0.15 * times) WHEN activation_count > 0 AND coalesce(decay_class, '') NOT IN ('permanent', 'slow') AND "at" < {NOW} - 1800 THEN greatest(0.5, decay_factor - 0.02) ELSE decay_factor END, 6) AS decay_factor,
 CAST(activation_count + coalesce(act, 0) AS BIGINT) AS activation_count, CASE WHEN times > 0 THEN {NOW} ELSE "at" END AS "at" FROM v LEFT JOIN h ON h.id = v.id""")
def q18(t):
    """One cycle over the vectors; what is not stored (salience, times) follows their numbers here."""
    n = F.col("vec_id")
    kind = F.when(n % 5 == 0, "permanent").when(n % 5 == 1, "slow").when(n % 5 > 2, "fast")
    hashed = lambda c: F.concat(F.lit("h"), c.cast("string"))
    vectors = t.embeddings.select(n.alias("id"), hashed(F.expr("vec_id div 2")).alias("content_hash"), (1 + F.col("label") / 10.0).alias("decay_factor"), (n % 4).alias("activation_count"), (n * 37 % 997 / 997.0).alias("salience"), kind.alias("decay_class"), (NOW - n * 10).alias("at"))
    e = F.col("event_id")
    attention = t.events.select(e.alias("id"), hashed(e).alias("content_hash"), (e * 7 % 11).alias("activation_count"), (NOW - e * 30).alias("at"))
    fragments = t.conversations.groupBy(F.col("conv_id").alias("id")).agg(F.count(F.lit(1)).alias("strength"))
    return M.replay_cycle(vectors, attention, fragments, NOW).select("id", F.round("decay_factor", 6).alias("decay_factor"), "activation_count", "at")


DIFFICULTY = "round(greatest(0.0, least(1.0, 0.35 + 0.5 * least(length(text) / 220.0, 1.0) + 0.13 * (CAST(contains(lower(text), 'optimize') AS INTEGER) + CAST(contains(lower(text), 'derive') AS INTEGER)) - CASE WHEN regexp_matches(text, '\\b[ABCD][.)]') THEN 0.15 ELSE 0 END)), 3)"


def difficulty(text):
    hits = X.hits(F.lower(text), ("optimize", "derive"))
    score = 0.35 + 0.5 * F.least(F.length(text) / 220.0, F.lit(1.0)) + 0.13 * hits - F.when(text.rlike(r"\b[ABCD][.)]"), 0.15).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3)


def level(score):
    return F.when(score < 0.45, "easy").when(score < 0.72, "medium").otherwise("hard")


@query("mth7_difficulty", f"SELECT conv_id, turn, s AS score, CASE WHEN s < 0.45 THEN 'easy' WHEN s < 0.72 THEN 'medium' ELSE 'hard' END AS level FROM (SELECT conv_id, turn, {DIFFICULTY} AS s FROM conversations)")
def mth7(t):
    s = difficulty(F.col("text"))
    return t.conversations.select("conv_id", "turn", s.alias("score"), level(s).alias("level"))


@query("mth8_step_targets", "SELECT doc_id, CASE WHEN n_chars < 2000 THEN 3 WHEN n_chars < 6000 THEN 6 WHEN n_chars < 20000 THEN 10 ELSE 14 END AS target FROM documents")
def mth8(t):
    n = F.col("n_chars")
    return t.documents.select("doc_id", F.when(n < 2000, 3).when(n < 6000, 6).when(n < 20000, 10).otherwise(14).alias("target"))


@query("mth9_money", "SELECT o_orderkey, CAST(round(CAST(o_totalprice AS DECIMAL(18,4)) * 0.855, 2) AS DOUBLE) AS price FROM orders")
def mth9(t):
    return t.orders.select("o_orderkey", F.round(F.col("o_totalprice").cast("decimal(18,4)") * F.lit(0.855).cast("decimal(4,3)"), 2).cast("double").alias("price"))


@query("mth10_bonuses", "SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 0.18 WHEN 'system' THEN 0.14 ELSE 0.08 END AS bonus FROM conversations")
def mth10(t):
    return t.conversations.select("conv_id", "turn", F.when(F.col("role") == "assistant", 0.18).when(F.col("role") == "system", 0.14).otherwise(0.08).alias("bonus"))


@query("mth11_eta", "SELECT o_custkey, queued, CASE WHEN queued > 0 AND average > 0 THEN round(queued * average, 1) END AS eta, round(queued / 300.0, 6) AS utilisation FROM (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS queued, avg(o_orderkey % 60 + 1) FILTER (o_orderstatus = 'F') AS average FROM orders GROUP BY 1)")
def mth11(t):
    """Per tenant the tasks in the queue, the wait at the mean of its finished ones, and the share of its limit in use."""
    open_, done = F.col("o_orderstatus") == "O", F.col("o_orderstatus") == "F"
    q = t.orders.groupBy("o_custkey").agg(F.count_if(open_).alias("queued"), F.avg(F.when(done, F.col("o_orderkey") % 60 + 1)).alias("average"))
    return q.select("o_custkey", "queued", F.when((F.col("queued") > 0) & (F.col("average") > 0), F.round(F.col("queued") * F.col("average"), 1)).alias("eta"), F.round(F.col("queued") / 300.0, 6).alias("utilisation"))


@query("mth3_rrf", "SELECT doc_id, round(CASE WHEN source = 'src0' THEN 0.4 ELSE 1.0 END / (60 + row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id)), 9) AS score FROM documents")
def mth3(t):
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return t.documents.select("doc_id", F.round(F.when(F.col("source") == "src0", 0.4).otherwise(1.0) / (60 + r), 9).alias("score"))


@query("dt1_elapsed", "SELECT event_id, greatest(0, epoch_us(TIMESTAMP '2024-01-10') - epoch_us(ts)) AS us FROM events")
def dt1(t):
    return t.events.select("event_id", F.greatest(F.lit(0), F.unix_micros(F.lit("2024-01-10").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))).alias("us"))


@query("dt2_keys", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts + INTERVAL 8 HOUR, '%Y-%m') AS month8, strftime(ts, '%Y-%m-%d %H:%M') AS minute FROM events")
def dt2(t):
    return t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format(F.col("ts") + F.expr("INTERVAL 8 HOURS"), "yyyy-MM").alias("month8"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("minute"))


@query("dt3_cutoffs", "SELECT count(*) FILTER (ts >= TIMESTAMP '2024-01-20' - INTERVAL 36 HOUR) AS recent, count(*) FILTER (ts < TIMESTAMP '2024-01-20' - INTERVAL 7 DAY) AS old FROM events")
def dt3(t):
    return t.events.agg(F.count_if(F.expr("ts >= TIMESTAMP_NTZ '2024-01-20' - INTERVAL 36 HOURS")).alias("recent"), F.count_if(F.expr("ts < TIMESTAMP_NTZ '2024-01-20' - INTERVAL 7 DAYS")).alias("old"))


@query("dt4_age_days", f"SELECT event_id, CAST(floor(({AGE}) / 86400) AS BIGINT) AS days FROM events")
def dt4(t):
    return t.events.select("event_id", F.floor(age() / 86400).alias("days"))


@query("q16_rollup", """WITH k AS (SELECT p_partkey // 100 AS a, p_partkey // 10 % 10 AS b, p_partkey % 10 AS c, p_size > 20 AS ok FROM part), m AS (SELECT a, b, count(*) AS n, round(count(*) FILTER (ok) / count(*), 3) AS r, b % 4 > 0 AND round(count(*) FILTER (ok) / count(*), 3) >= 0.5 AS ok FROM k GROUP BY 1, 2)
SELECT a AS id, '1' AS path, count(*) AS children, round(count(*) FILTER (ok) / count(*), 3) AS child_pass_rate, round(count(*) FILTER (ok) / count(*), 3) >= 0.5 AS passed FROM m GROUP BY a
UNION ALL SELECT a, '1.' || b, n, r, ok FROM m UNION ALL SELECT a, '1.' || b || '.' || c, 0, 1.0, ok FROM k""")
def q16(t):
    """Each hundred of parts is an exam: a question of ten groups of ten; large parts pass, every fourth group fails."""
    k = t.part.select(F.expr("p_partkey div 100").alias("id"), F.expr("'1.' || (p_partkey div 10 % 10)").alias("up"), F.expr("p_partkey % 10").cast("string").alias("c"), (F.col("p_size") > 20).alias("ok"))
    leaf = k.select("id", F.concat_ws(".", "up", "c").alias("path"), F.col("up").alias("parent_path"), F.col("ok").alias("passed"))
    group = k.select("id", F.col("up").alias("path"), F.lit("1").alias("parent_path"), (F.split_part("up", F.lit("."), F.lit(2)).cast("int") % 4 > 0).alias("passed")).distinct()
    root = k.select("id", F.lit("1").alias("path"), F.lit(None).cast("string").alias("parent_path"), F.lit(True).alias("passed")).distinct()
    return exam.roll_up(leaf.unionByName(group).unionByName(root)).drop("parent_path")
