"""Retrieval queries; rows are documents with the embedding of the same number."""

from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import retrieval as S
from folioflow.operators import rows as R
from folioflow.plans.registry import Tables, query

QUERY = "the thing and of the world"
ROWS = "(SELECT doc_id AS id, source AS document_id, text AS content, CAST(embedding AS DOUBLE[]) AS e FROM documents JOIN embeddings ON doc_id = vec_id)"
Q = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 3)"


def corpus(t: Tables):
    return t.documents.join(t.embeddings, F.col("doc_id") == F.col("vec_id")).select(F.col("doc_id").alias("id"), F.col("source").alias("document_id"), F.col("text").alias("content"), "embedding")


def texts(t: Tables):
    return t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("document_id"), F.col("text").alias("content"))


def vectors(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("id"), "embedding")


def counted(t: Tables, query: str):
    """The corpus with what its texts and vectors count for a query in their place: neither is shuffled."""
    near = vectors(t).select("id", S.nearness(query_vector(t)).alias("_near"))
    return texts(t).select("id", S.term_counts(F.col("content"), query).alias("_terms")).join(near, "id")


def query_vector(t):
    return t.embeddings.filter("vec_id = 3").first()["embedding"]


@query("vec1_cosine", f"SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {Q}), 6) AS score FROM embeddings")
def vec1(t):
    return t.embeddings.select("vec_id", F.round(S.cosine(F.col("embedding"), S.vector(query_vector(t))), 6).alias("score"))


@query("vec2_resize", "SELECT vec_id, len(v) AS dim, round(list_sum(v), 5) AS total FROM (SELECT vec_id, list_resize(CAST(embedding AS DOUBLE[]), 80, 0.0) AS v FROM embeddings)")
def vec2(t):
    v = F.slice(F.concat(F.col("embedding").cast("array<double>"), F.array_repeat(F.lit(0.0), 80)), 1, 80)
    return t.embeddings.select("vec_id", F.size(v).cast("bigint").alias("dim"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("q1a_dense_rank", f"SELECT id, row_number() OVER (ORDER BY round(list_cosine_similarity(e, {Q}), 9) DESC, id) AS rank FROM {ROWS} ORDER BY rank LIMIT 25")
def q1a(t):
    d = S.dense_scores(corpus(t), query_vector(t)).withColumn("dense_score", F.round("dense_score", 9))
    return S.ranked_top(d.select("id", "dense_score"), "dense_score", "id", 25).select("id", "rank")


TFIDF = r"""WITH tok AS (SELECT id, list_filter(regexp_split_to_array(lower(content), '[^\p{L}\p{N}]+'), lambda x: length(x) > 1) AS k FROM ROWS),
q(w, qv) AS (VALUES ('the', 2), ('thing', 1), ('and', 1), ('of', 1), ('world', 1)),
df AS (SELECT w, qv, ln(((SELECT count(*) FROM tok) + 1) / ((SELECT count(*) FROM tok WHERE list_contains(k, w)) + 1)) + 1 AS idf FROM q),
sp AS (SELECT id, sum(len(list_filter(k, lambda x: x = w)) / len(k) * idf * qv) AS score FROM tok, df WHERE len(k) > 0 GROUP BY id)""".replace("ROWS", ROWS)


@query("q1b_sparse_scores", TFIDF + " SELECT id, round(score, 9) AS sparse_score FROM sp")
def q1b(t):
    return S.counted_scores(counted(t, QUERY), QUERY).select("id", F.round("sparse_score", 9).alias("sparse_score"))


@query("mth2_idf", TFIDF + " SELECT w, round(idf, 9) AS idf FROM df")
def mth2(t):
    words = sorted(set(S.query_tokens(QUERY)))
    counts = counted(t, QUERY).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("_terms.hits")[i] > 0).alias(w) for i, w in enumerate(words)])
    return counts.select("n", F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.col(w).alias("df")) for w in words])).alias("x")).select("x.w", F.round(F.log((F.col("n") + 1) / (F.col("x.df") + 1)) + 1, 9).alias("idf"))


FUSED = TFIDF + f""", d AS (SELECT id, row_number() OVER (ORDER BY list_cosine_similarity(e, {Q}) DESC, id) AS r FROM {ROWS}),
s AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM sp),
f AS (SELECT coalesce(d.id, s.id) AS id, coalesce(1.0 / (60 + d.r), 0) + coalesce(1.0 / (60 + s.r), 0) AS score FROM d FULL JOIN s ON d.id = s.id ORDER BY score DESC, 1 LIMIT 32)"""


@query("q1c_fusion", FUSED + " SELECT id, round(score, 9) AS rrf_score FROM f")
def q1c(t):
    c = counted(t, QUERY)
    f = S.fuse(S.near_scores(c), S.counted_scores(c, QUERY), 32)
    return f.select("id", F.round("rrf_score", 9).alias("rrf_score"))


@query("win2_rebalance", "WITH r AS (SELECT doc_id, source, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents ORDER BY rank LIMIT 40), n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank) AS i FROM r) SELECT doc_id FROM n ORDER BY CASE WHEN i = 1 THEN 1 WHEN i <= 5 THEN 2 ELSE 3 END, rank LIMIT 8")
def win2(t):
    from pyspark.sql import Window

    top = R.top_k(t.documents.select("doc_id", "source", "n_chars"), "n_chars", "doc_id", 40)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")))  # 40 rows
    return S.rebalance(ranked, 8, "source").select("doc_id")


FILLER = r"""(len(list_filter(['copyright', 'all rights reserved', 'isbn', 'publisher'], lambda w: contains(substr(lower(content), 1, 200), w))) >= 2
 OR (length(regexp_replace(content, '^\s+|\s+$', '', 'g')) < 60 AND NOT regexp_matches(content, '(?i)(^|[^a-z])(example|exercise|problem) *[0-9]*')))"""
HYBRID = FUSED.replace("coalesce(1.0 / (60 + s.r), 0) AS score FROM d FULL JOIN s ON d.id = s.id", "coalesce(1.0 / (60 + s.r), 0) AS raw FROM d FULL JOIN s ON d.id = s.id").replace(
    "\nf AS (SELECT", "\ng AS (SELECT").replace(" ORDER BY score DESC, 1 LIMIT 32)", f"), f AS (SELECT g.id, document_id, raw * CASE WHEN {FILLER} THEN 0.4 ELSE 1.0 END AS score FROM g JOIN {ROWS} r ON g.id = r.id ORDER BY score DESC, g.id LIMIT 32)") + """,
k AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM f), n AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY rank) AS i FROM k)
SELECT id, document_id, round(score, 9) AS rrf_score, rank FROM n ORDER BY CASE WHEN i = 1 THEN 1 WHEN i <= 5 THEN 2 ELSE 3 END, rank LIMIT 8"""


@query("q1_hybrid_search", HYBRID)
def q1(t):
    return S.hybrid_search(texts(t), QUERY, query_vector(t), vectors=vectors(t)).withColumn("rrf_score", F.round("rrf_score", 9))


ROLE = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(text), {chr(39)}{w}{chr(39)})' for w in words)} THEN '{k}'" for k, words in X.QA_ROLES) + " ELSE CASE turn % 3 WHEN 0 THEN 'question' WHEN 1 THEN 'answer' ELSE 'other' END END"
FOCUS_QUERY = "what is the answer of the question"
FOCUS_WORDS = sorted(set(S.query_tokens(FOCUS_QUERY)))
DF = ", ".join(f"count(*) FILTER (len(w) > 0 AND list_contains(w, '{w}')) AS df_{w}" for w in FOCUS_WORDS)
TF = " + ".join(f"len(list_filter(w, lambda x: x = '{w}')) / len(w) * (ln((n_rows + 1) / (df_{w} + 1)) + 1) * {S.query_tokens(FOCUS_QUERY).count(w)}" for w in FOCUS_WORDS)
FOCUS = rf"""WITH t AS (SELECT conv_id, turn, text, conv_id * 1000 + turn AS id, {ROLE} AS qa_role, turn // 3 AS question, CAST(embedding AS DOUBLE[]) AS e FROM conversations JOIN embeddings ON vec_id = (conv_id * 8 + turn) % 400),
k AS (SELECT *, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: length(x) > 1) AS w FROM t), n AS (SELECT count(*) AS n_rows, {DF} FROM k),
s AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM (SELECT id, {TF} AS score FROM k, n WHERE len(w) > 0)),
d AS (SELECT id, row_number() OVER (ORDER BY round(list_cosine_similarity(e, {Q}), 9) DESC, id) AS r FROM t),
c AS (SELECT t.*, 1.0 / (60 + d.r) + coalesce(1.0 / (60 + s.r), 0) AS base FROM t JOIN d ON d.id = t.id LEFT JOIN s ON s.id = t.id ORDER BY base DESC, t.id LIMIT 120),
g AS (SELECT *, bool_or(qa_role = 'question') OVER q AND bool_or(qa_role IN ('answer', 'analysis')) OVER q AS pair FROM c WINDOW q AS (PARTITION BY conv_id, question)),
f AS (SELECT *, base + CASE qa_role WHEN 'answer' THEN 0.18 WHEN 'analysis' THEN 0.14 WHEN 'question' THEN 0.08 ELSE 0 END + CASE WHEN pair THEN 0.16 ELSE 0 END AS score FROM g),
best AS (SELECT * FROM f ORDER BY score DESC, base DESC, id LIMIT 40)"""


def focused(t):
    """Turns that match a question best by both rankings; their vectors are those of their number, three turns make a question's group."""
    other = F.when(F.col("turn") % 3 == 0, "question").when(F.col("turn") % 3 == 1, "answer").otherwise("other")
    named = X.first_class(F.lower("text"), X.QA_ROLES, "other")
    held = t.embeddings.select(F.col("vec_id").alias("_v"), "embedding").filter("_v BETWEEN -399 AND 399")  # no others are met
    rows = t.conversations.join(F.broadcast(held), (F.col("conv_id") * 8 + F.col("turn")) % 400 == F.col("_v"))
    rows = rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("document_id"), "turn", F.col("text").alias("content"), F.when(named == "other", other).otherwise(named).alias("qa_role"), F.expr("turn div 3").alias("question_id"), "embedding")
    dense = S.dense_scores(rows.select("id", "embedding"), query_vector(t)).withColumn("dense_score", F.round("dense_score", 9))
    fused = S.fuse(dense, S.sparse_scores(rows.select("id", "content"), FOCUS_QUERY), 120)
    return S.qa_focus(rows.drop("embedding").join(F.broadcast(fused), "id"), 40)  # 120 rows


@query("q2_qa_focus", FOCUS + " SELECT conv_id, turn, qa_role, pair, round(score, 9) AS score FROM best")
def q2(t):
    return focused(t).select(F.col("document_id").alias("conv_id"), "turn", "qa_role", "pair", F.round("score", 9).alias("score"))


CLIP = r"(CASE WHEN length(c) > 240 THEN substr(c, 1, 239) || '…' ELSE c END)"


@query("q2_qa_blocks", FOCUS + rf""", x AS (SELECT *, {CLIP} AS clip FROM (SELECT *, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS c FROM best)),
p AS (SELECT conv_id, question, max(score) AS score, list(clip ORDER BY score DESC, base DESC, id) FILTER (qa_role = 'question') AS q, list(clip ORDER BY score DESC, base DESC, id) FILTER (qa_role = 'answer') AS a, list(clip ORDER BY score DESC, base DESC, id) FILTER (qa_role = 'analysis') AS y FROM x GROUP BY 1, 2)
SELECT conv_id, question, round(score, 9) AS score, '[QA_FOCUS::Conversation ' || conv_id || '::exam/question]' || chr(10) || '题干：' || q[1] || chr(10) || '答案与解析：' || concat_ws(' ', a[1], y[1]) AS block FROM p WHERE q IS NOT NULL AND (a IS NOT NULL OR y IS NOT NULL) ORDER BY score DESC, conv_id, question LIMIT 3""")
def q2_blocks(t):
    rows = focused(t).withColumn("title", F.concat(F.lit("Conversation "), F.col("document_id").cast("string"))).withColumn("section_path", F.lit(""))
    return S.qa_blocks(rows, 3).select(F.col("document_id").alias("conv_id"), F.col("question_id").alias("question"), F.round("score", 9).alias("score"), "block")


@query("q3_agent_context")
def q3(t):
    hits = S.hybrid_search(texts(t), QUERY, query_vector(t), vectors=vectors(t))
    hits = t.documents.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(hits), "id")  # 8 rows
    return hits.agg(R.keep_in_order(F.col("rank"), X.snippet(F.col("text"), 200), "\n").alias("context"))


@query("q4_transfer")
def q4(t):
    """From the best rows of one source, concepts; for each of the best five the two best rows of another source."""
    c = texts(t)
    return S.transfer(c.filter("document_id = 'src0'"), c.filter("document_id = 'src1'"), QUERY, query_vector(t), vectors=vectors(t))


PAIRS = "FROM embeddings q JOIN embeddings s ON s.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0"
SIM = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(s.embedding AS DOUBLE[]))"


@query("jn14_threshold_join", f"SELECT q, vec_id, round(score, 6) AS score FROM (SELECT q.vec_id AS q, s.vec_id, {SIM} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {SIM} DESC, s.vec_id) AS n {PAIRS}) WHERE n <= 5 AND score >= 0.3")
def jn14(t):
    """Each vector whose id 20 divides against all: its five nearest of at least 0.3."""
    found = S.nearest(t.embeddings.filter("vec_id % 20 = 0"), t.embeddings, "vec_id", "embedding", 5, 0.3)
    return found.select("q", "vec_id", F.round("score", 6).alias("score"))


@query("q5_document_chunks", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 4")
def q5(t):
    return R.first_per(t.conversations, ["conv_id"], [F.col("turn")], 4).select("conv_id", "turn")


@query("q21_chat_context", "SELECT conv_id, string_agg(role || ': ' || substr(text, 1, 50), chr(10) ORDER BY turn) AS memory FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4 GROUP BY conv_id")
def q21(t):
    last = R.first_per(t.conversations, ["conv_id"], [F.desc("turn")], 4)
    return last.groupBy("conv_id").agg(R.keep_in_order(F.col("turn"), F.concat(F.col("role"), F.lit(": "), F.substring("text", 1, 50)), "\n").alias("memory"))


@query("vec3_hash_embedding")
def vec3(t):
    from folioflow.functions.embedding import hash_embedding

    return t.documents.select("doc_id", hash_embedding(F.col("text"), 64).alias("embedding"))


@query("vec4_separation")
def vec4(t):
    from folioflow.functions.embedding import separate

    return t.embeddings.select("vec_id", separate(F.col("embedding"), 128).alias("separated"))
