"""Admission limits, attention windows and fragment buffers over the events of a user; an event's vector is that of its number."""

from pyspark.sql import functions as F

from folioflow.plans.registry import query
from folioflow.streaming import sessions as S

VECTORS = 400
LIMITER = S.Limiter(3, 86_400.0)
ATTENTION = S.Attention(5, 10 * 86_400.0, 0.85)
FRAGMENTS = S.Fragments(4, 7 * 86_400.0, 0.85)


def events(t):
    vector = t.embeddings.select(F.col("vec_id").alias("_v"), F.col("embedding").alias("vector"))
    return t.events.join(vector, F.col("event_id") % VECTORS == F.col("_v"), "left").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts", "vector")


def result(df):
    return df.withColumn("key", F.col("key").cast("bigint"))


ORDERED = f"""WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) / 1e6 AS at_, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events LEFT JOIN embeddings ON event_id % {VECTORS} = vec_id)"""
LIMITED = f"""{ORDERED},
w AS (SELECT key, id, i, true AS admitted, [at_] AS held FROM e WHERE i = 1
  UNION ALL SELECT key, id, i, len(live) < {LIMITER.most}, CASE WHEN len(live) < {LIMITER.most} THEN list_append(live, at_) ELSE live END
    FROM (SELECT e.*, list_filter(held, lambda x: e.at_ - x < {LIMITER.seconds}) AS live FROM w JOIN e ON e.key = w.key AND e.i = w.i + 1))
SELECT key, id, admitted FROM w"""


def remembered(m: S.Attention, fresh: int, again: str, live: str) -> str:
    """SQL of an attention window or a fragment buffer, an event of each user a round."""
    near = f"list_filter(list_transform(live, lambda s: {{'sim': round(coalesce(list_cosine_similarity(v, s.v), 0), 9), 't': s.t, 'id': s.id}}), lambda z: z.sim >= {m.alike})"
    return f"""{ORDERED},
w AS (SELECT key, id, i, id AS entry, {fresh}::BIGINT AS activations, 1::BIGINT AS held, []::BIGINT[] AS evicted, [{{'t': at_, 'id': id, 'n': {fresh}::BIGINT, 'v': v}}] AS state FROM e WHERE i = 1
  UNION ALL SELECT key, id, i, coalesce(best.id, id), coalesce(list_filter(state, lambda s: s.id = best.id)[1].n, {fresh}), least(len(state), {m.most}), list_transform(state[{m.most + 1}:], lambda s: s.id), state[1:{m.most}] FROM (
    SELECT key, id, i, best, CASE WHEN best IS NULL THEN list_reverse_sort(list_append(live, {{'t': at_, 'id': id, 'n': {fresh}::BIGINT, 'v': v}})) ELSE list_transform(live, lambda s: CASE WHEN s.id = best.id THEN {again} ELSE s END) END AS state
    FROM (SELECT *, list_max({near}) AS best FROM (
      SELECT e.*, list_filter(state, lambda s: {live}) AS live FROM w JOIN e ON e.key = w.key AND e.i = w.i + 1))))
SELECT key, id, entry, activations, held::INT AS held, array_to_string(evicted, ',') AS evicted FROM w"""


@query("stm3_limiter", LIMITED)
def stm3_limiter(t):
    """Of a user's events those that the limiter admits: what it rejects doesn't count."""
    return result(S.run_batch(events(t).drop("vector"), LIMITER))


@query("stm4_working_memory", remembered(ATTENTION, 1, "{'t': at_, 'id': s.id, 'n': s.n + 1, 'v': s.v}", f"s.t >= e.at_ - {ATTENTION.seconds}"))
def stm4(t):
    return result(S.run_batch(events(t), ATTENTION)).withColumn("evicted", F.array_join("evicted", ","))


@query("stm5_fragment_buffer", remembered(FRAGMENTS, 0, "{'t': s.t, 'id': s.id, 'n': s.n + 1, 'v': s.v}", f"s.t >= e.at_ - {FRAGMENTS.seconds} OR s.n > 0"))
def stm5(t):
    return result(S.run_batch(events(t), FRAGMENTS)).withColumn("evicted", F.array_join("evicted", ","))
