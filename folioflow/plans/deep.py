"""Deep reading of documents whose pages are stretches of 500 characters, each cut in rows of 250."""

from pyspark.sql import functions as F

from folioflow.operators import chunking as C
from folioflow.operators import deep as D
from folioflow.plans.registry import query

SIZE = 4


def rows(t):
    half = C.fixed_stride(t.documents, "doc_id", "text", 250, 250)
    return half.select("id", F.col("chunk").alias("seq"), (F.floor(F.col("chunk") / 2) + 1).cast("int").alias("page"), "content")


def title(sample):
    """A sample with a digit-free first line of capital start opens a chapter named by its first two words, where its length isn't divisible by 3."""
    words = F.split(sample, " ")
    return F.when(words[0].rlike("^[A-Z][a-z]+$") | (F.length(words[0]) % 3 == 1), F.array_join(F.slice(words, 1, 2), " "))


def candidate(content):
    return F.trim(F.left(F.regexp_replace(content, r"\s+", " "), F.lit(40)))


def read(t):
    """A row offers its candidate before the shuffle, so texts stay where they are."""
    r = rows(t)
    offers = r.withColumn("content", candidate(F.col("content")))
    return D.folded(D.batches(offers, D.outline(D.samples(r), title), SIZE), lambda offer: offer)


BATCHES = rf"""WITH RECURSIVE r AS (SELECT doc_id AS id, i AS seq, CAST(i // 2 + 1 AS INTEGER) AS page, substr(text, i * 250 + 1, 250) AS content FROM (SELECT *, unnest(range(0, (length(text) - 1) // 250 + 1)) AS i FROM documents)),
sampled AS (SELECT id, seq, page, string_split(substr(content, 1, 150), ' ') AS w FROM r QUALIFY row_number() OVER (PARTITION BY id, page ORDER BY seq) = 1),
named AS (SELECT id, seq, page, array_to_string(w[1:2], ' ') AS title FROM (FROM sampled QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) <= 120) WHERE regexp_matches(w[1], '^[A-Z][a-z]+$') OR length(w[1]) % 3 = 1),
chapters AS (SELECT id, row_number() OVER o AS at_, title, page AS s, coalesce(lead(page) OVER o, 2147483647) AS e FROM named WINDOW o AS (PARTITION BY id ORDER BY seq)),
few AS (FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) <= 500),
placed AS (SELECT few.*, at_ FROM few JOIN chapters c ON c.id = few.id AND page BETWEEN s AND e UNION ALL SELECT *, 0 FROM few WHERE id NOT IN (SELECT id FROM chapters)),
cut AS (SELECT *, (row_number() OVER (PARTITION BY id, at_ ORDER BY seq) - 1) // {SIZE} AS part FROM placed),
numbered AS (SELECT *, dense_rank() OVER (PARTITION BY id ORDER BY at_, part) - 1 AS batch FROM cut),
opened AS (SELECT id, batch, arg_min(page, seq) AS page FROM numbered GROUP BY 1, 2),
hints AS (SELECT o.id, batch, coalesce(arg_min(title, at_), 'Page ' || any_value(page)) AS hint FROM opened o LEFT JOIN chapters c ON c.id = o.id AND page BETWEEN s AND e GROUP BY 1, 2),
offers AS (SELECT id, batch, list(x ORDER BY seq) FILTER (x <> '') AS offered FROM (SELECT *, trim(substr(regexp_replace(content, '\s+', ' ', 'g'), 1, 40)) AS x FROM numbered) GROUP BY 1, 2),
step AS (SELECT o.id, o.batch, hint, coalesce(list_filter(offered, lambda x, i: list_position(offered, x) = i), []) AS offered FROM offers o JOIN hints h ON h.id = o.id AND h.batch = o.batch),
fold AS (SELECT id, batch, hint, '' AS context, list_filter(offered, lambda x: x <> '') AS points FROM step WHERE batch = 0
  UNION ALL SELECT id, batch, hint, context, list_filter(offered, lambda x: NOT list_contains(string_split(context, chr(10)), x)) FROM (
    SELECT s.*, substr(array_to_string(f.points[1:10], chr(10)), 1, 500) AS context FROM fold f JOIN step s ON s.id = f.id AND s.batch = f.batch + 1))"""
SLUG = "coalesce(nullif(substr(regexp_replace(regexp_replace(lower({}), '[^a-z0-9一-鿿]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40), ''), 'unknown')"
TREE = f"""{BATCHES},
placed_facts AS (SELECT id, hint AS section, batch, generate_subscripts(points, 1) AS pos, unnest(points) AS fact FROM fold),
summed AS (SELECT id, section, list(fact ORDER BY batch, pos)[1:50] AS facts FROM placed_facts GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT DISTINCT id, '/' AS path, NULL AS parent, 'root' AS type, '深度解析地图' AS title, NULL AS body, 0 AS round, 0 AS batch FROM fold
UNION ALL SELECT id, p, '/', 'chapter', arg_min(hint, batch), NULL, 2, min(batch)::INT FROM (SELECT *, '/chapter/' || {SLUG.format('hint')} AS p FROM fold) GROUP BY id, p
UNION ALL SELECT id, '/chapter/' || {SLUG.format('hint')} || '/detail_' || batch, '/chapter/' || {SLUG.format('hint')}, 'detail', '深度解析(Batch ' || (batch + 1) || ')', array_to_string(list_transform(points[1:50], lambda x: '- ' || x), chr(10)), 2, batch FROM fold
UNION ALL SELECT id, '/synthesis/' || {SLUG.format('section')}, '/', 'synthesis', '【全局复盘】' || section, array_to_string(facts, chr(10)), 3, 999 FROM summed"""


@query("q14_batches", f"{BATCHES} SELECT n.id, n.batch::INT AS batch, hint, seq::INT AS seq, page FROM numbered n JOIN hints h ON h.id = n.id AND h.batch = n.batch")
def q14_batches(t):
    r = rows(t)
    return D.batches(r, D.outline(D.samples(r), title), SIZE).select("id", "batch", "hint", "seq", "page")


@query("q14_fold", f"{BATCHES} SELECT id, batch::INT AS batch, hint, context, array_to_string(points, '|') AS points FROM fold")
def q14_fold(t):
    return read(t).withColumn("points", F.array_join("points", "|"))


@query("q14_deep_pipeline", TREE)
def q14(t):
    return D.tree(read(t))
