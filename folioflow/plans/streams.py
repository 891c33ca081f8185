"""Batch twins of the streaming operators over events."""

from pyspark.sql import functions as F

from folioflow.plans.registry import Tables, query


@query("stm1_minute_counter", "SELECT date_trunc('minute', ts) AS start, user_id, count(*) AS n FROM events GROUP BY 1, 2")
def stm1(t: Tables):
    return t.events.groupBy(F.window("ts", "1 minute").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "user_id", "n")


@query("stm2_shifted_days", "SELECT CAST(date_trunc('day', ts + INTERVAL 8 HOUR) AS TIMESTAMP) - INTERVAL 8 HOUR AS start, count(*) AS n FROM events GROUP BY 1")
def stm2(t):
    return t.events.groupBy(F.window("ts", "1 day", "1 day", "16 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


@query("stm3_sliding", "SELECT date_trunc('minute', ts) - INTERVAL 1 MINUTE * k AS start, count(*) AS n FROM events, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1")
def stm3(t):
    return t.events.groupBy(F.window("ts", "3 minutes", "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


COOLDOWN = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT user_id, event_id, i, us AS last, true AS accepted FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN us - last >= 86400000000 THEN us ELSE last END, us - last >= 86400000000 FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
SELECT CAST(user_id AS VARCHAR) AS key, event_id AS id, accepted FROM w"""


@query("stm7_cooldown", COOLDOWN)
def stm7(t):
    from folioflow.streaming.stateful import cooldown_batch

    return cooldown_batch(t.events.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), "ts"), 86400.0)


IDLE = """SELECT user_id, s AS start, count(*) AS n FROM (SELECT *, min(ts) OVER (PARTITION BY user_id, g) AS s FROM (SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g
 FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events))) GROUP BY 1, 2"""


@query("stm9_idle_sessions", IDLE)
def stm9(t):
    return t.events.groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("stm11_latest_state", "SELECT user_id, arg_max(event_type, event_id) AS state FROM events GROUP BY user_id")
def stm11(t):
    return t.events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("state"))


@query("stm12_chat_ttl", "SELECT event_id, ts + INTERVAL 1 HOUR * (event_id % 5) AS expires FROM events WHERE event_id % 5 > 0")
def stm12(t):
    return t.events.filter("event_id % 5 > 0").select("event_id", (F.col("ts") + F.expr("make_dt_interval(0, cast(event_id % 5 as int))")).alias("expires"))
