"""Queries of what is read out of texts by patterns; the SQL is made from the same fixed values."""

from pyspark.sql import functions as F

from folioflow.functions import extract as E
from folioflow.functions import text as X
from folioflow.operators import retrieval as S
from folioflow.plans.registry import query
from folioflow.plans.text import sql_any, sql_hits


def quoted(pattern):
    return "'" + pattern.replace("'", "''") + "'"


def sql_all(col, pattern):
    return f"regexp_extract_all({col}, {quoted(pattern)}, {E.group_of(pattern)})"


def sql_trim(col):
    return rf"regexp_replace({col}, '^\s+|\s+$', '', 'g')"


def sql_count(col, pattern):
    return f"len(regexp_extract_all({col}, {quoted(pattern)}))"


SLUG = "regexp_replace(regexp_replace(lower(text), '[^a-z0-9一-鿿]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query("str5_slug", f"SELECT doc_id, coalesce(nullif(substr({SLUG}, 1, 80), ''), 'section') AS slug FROM documents")
def str5(t):
    return t.documents.select("doc_id", X.slug(F.col("text")).alias("slug"))


def sql_category(name):
    a, b, c = (sql_all("text", p) for p in E.CATEGORIES[name])
    cut = rf"substr(regexp_replace({sql_trim('x')}, '\s+', ' ', 'g'), 1, 280)"
    return f"list_filter(list_transform(list_concat(list_concat({a}, {b}), {c}), lambda x: {cut}), lambda x: length(x) >= 10)"


def sql_firsts(col):
    starts = f"list_transform({col}, lambda y: substr(y, 1, 80))"
    return f"array_to_string(list_filter({col}, lambda x, i: list_position({starts}, substr(x, 1, 80)) = i)[1:8], '|') AS {col}"


FOUND = ", ".join(f"{sql_category(c)} AS {c}" for c in E.CATEGORIES)


@query("str8_categories", f"SELECT doc_id, {', '.join(map(sql_firsts, E.CATEGORIES))} FROM (SELECT doc_id, {FOUND} FROM documents)")
def str8(t):
    return t.documents.select("doc_id", *[F.array_join(E.category(F.col("text"), c), "|").alias(c) for c in E.CATEGORIES])


NAMED = r"list_distinct(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}_]+'), lambda x: regexp_matches(x, '^(?:[A-Z][A-Za-z0-9]{2,}|[一-龥]{2,5})$')))"
DENSE = "SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 3)), 6) AS dense FROM embeddings"
CONCEPT_ROWS = f"SELECT doc_id, dense, concept, (length(text) - length(replace(text, concept, ''))) // length(concept) AS frequency FROM (SELECT doc_id, text, dense, unnest({NAMED}) AS concept FROM documents LEFT JOIN ({DENSE}) ON doc_id = vec_id)"


@query("str9_relevance", f"SELECT doc_id, concept, frequency, round(least(1e0, frequency * 1e-1 + coalesce(dense, 0e0) * 5e-1), 3) AS relevance FROM ({CONCEPT_ROWS})")
def str9(t):
    wanted = t.embeddings.filter("vec_id = 3").select(F.col("embedding").alias("q"))
    dense = t.embeddings.join(F.broadcast(wanted), F.lit(True)).select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("q")), 6).alias("dense"))  # one row is sent
    found = t.documents.select("doc_id", E.term_frequencies(F.col("text")).alias("terms"))  # texts aren't joined
    rows = found.join(dense, F.col("doc_id") == F.col("vec_id"), "left").select("doc_id", "dense", F.explode("terms").alias("t"))
    return rows.select("doc_id", "t.concept", "t.frequency", E.relevance(F.col("t.frequency"), F.col("dense")).alias("relevance"))


ENDS = " OR ".join(f"ends_with(s, '{m}')" for m in E.SENTENCE_ENDS)
STARTS = " OR ".join(f"starts_with(s, '{w}')" for w in E.HEADING_STARTS)
VISUAL = rf"(length(s) BETWEEN 1 AND 50 AND NOT ({ENDS}) AND ((starts_with(s, '**') AND ends_with(s, '**')) OR (NOT regexp_matches(s, '^\d+$') AND NOT regexp_matches(s, '^\[\[PAGE:\d+\]\]') AND (coalesce(length(following) > 100, false) OR {STARTS}))))"
KEYWORD = {k: rf"regexp_matches(s, '(?i)^(?:{w})(?:[^\p{{L}}\p{{N}}_]|$)')" for k, w in E.HEADINGS.items()}
LINE = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents"
LINES = f"SELECT doc_id, n, s, lead(s) OVER (PARTITION BY doc_id ORDER BY n) AS following FROM (SELECT doc_id, {sql_trim('line')} AS s, n FROM ({LINE}))"
KINDS = ", ".join(f"{v} AS {k}" for k, v in KEYWORD.items())


@query("str12_headings", f"SELECT doc_id, CAST(n AS INTEGER) AS n, {VISUAL} AS visual, {KINDS} FROM ({LINES}) WHERE {VISUAL} OR {' OR '.join(KEYWORD.values())}")
def str12(t):
    found = lambda lines: F.transform(lines, lambda x, i: F.struct(i.alias("n"), E.visual_heading(x, F.get(lines, i + 1)).alias("visual"), *[E.keyword_heading(x, k).alias(k) for k in E.HEADINGS]))
    heads = F.filter(X.once(F.split("text", "\n"), found), lambda h: h["visual"] | h["academic"] | h["technical"] | h["project"])
    return t.documents.select("doc_id", F.explode(heads).alias("h")).select("doc_id", "h.*")


def keyword_headings(lines, kind):
    return F.transform(lines, lambda x: E.keyword_heading(x, kind))


FAMILY = " UNION ALL ".join(
    f"SELECT doc_id, '{k}' AS family, count(*) FILTER ({v}) + CAST(NOT bool_or(n = 0 AND {v}) AS INTEGER) AS sections FROM ({LINES}) GROUP BY doc_id" for k, v in {"visual": VISUAL, **KEYWORD}.items()
)


@query("chk5_sections", FAMILY)
def chk5(t):
    """How many sections each family of headings cuts a text into; lines before the first heading are one."""
    lines = F.split("text", "\n")
    heads = {"visual": X.once(lines, lambda ls: F.transform(ls, lambda x, i: E.visual_heading(x, F.get(ls, i + 1)))), **{k: keyword_headings(lines, k) for k in E.HEADINGS}}
    found = [F.struct(F.lit(k).alias("family"), h.alias("h")) for k, h in heads.items()]
    rows = t.documents.select("doc_id", F.explode(F.array(*found)).alias("f")).select("doc_id", "f.family", "f.h")
    return rows.select("doc_id", "family", (F.size(F.filter("h", lambda x: x)) + F.when(F.get("h", F.lit(0)), 0).otherwise(1)).cast("bigint").alias("sections"))


TRADITIONAL = """CASE WHEN CAST(contains(h, 'copyright') AS INTEGER) + CAST(contains(h, 'all rights reserved') AS INTEGER) + CAST(contains(h, 'isbn') AS INTEGER) + CAST(contains(h, 'publisher') AS INTEGER) >= 2
 OR (length(s) < 60 AND NOT e) THEN 'filler' WHEN e THEN 'example' ELSE 'knowledge' END"""
COUNTED = {k: sql_count("text", "(?i)" + p) for k, p in E.CONCEPT_MARKS}
WEIGHED = {k: f"10 * {n} + CASE WHEN {n} > 1 THEN 5 ELSE 0 END" for k, n in COUNTED.items()}
WEIGHED["definition"] += " + 15 * " + sql_count("text", E.DEFINED)
WEIGHED["example"] += " + 12 * " + sql_count("text", E.EXERCISE)
BEST = f"greatest({', '.join(f'm_{k}' for k in WEIGHED)})"
PICK = " ".join(f"WHEN m_{k} = {BEST} THEN '{k}'" for k in WEIGHED)
COLS = ", ".join(f"{v} AS m_{k}" for k, v in WEIGHED.items())
EXAMPLE = "regexp_matches(text, '(?i)(^|[^a-z])(example|exercise|problem) *[0-9]*')"


@query("str14_weighted_type", f"SELECT doc_id, CASE WHEN t = 'filler' OR {BEST} < 10 THEN t {PICK} END AS kind FROM (SELECT *, {TRADITIONAL} AS t FROM (SELECT doc_id, {COLS}, substr(lower(text), 1, 200) AS h, {sql_trim('text')} AS s, {EXAMPLE} AS e FROM documents))")
def str14(t):
    return t.documents.select("doc_id", E.concept_chunk(F.col("text"), X.chunk_class(F.col("text"), F.col("source"))).alias("kind"))


@query("str15_references", " UNION ALL ".join(f"SELECT doc_id, '{k}' AS target_type, unnest({sql_all('text', p)}) AS label FROM documents" for k, p in E.REFERENCES))
def str15(t):
    """References by pattern; a text that matches several gives a row for each."""
    found = t.documents.select("doc_id", F.explode(E.labelled(F.col("text"), E.REFERENCES)).alias("r"))
    return found.select("doc_id", F.col("r.kind").alias("target_type"), "r.label")


TERM_TYPE = "CASE " + " ".join(f"WHEN {sql_any('lower(term)', w)} THEN '{n}'" for n, w in E.TERM_TYPES) + " WHEN regexp_matches(term, '[A-Z][a-z]+') THEN 'entity' ELSE 'general' END"
MARKED = " UNION ALL ".join(f"SELECT page_id, unnest({sql_all('html', p)}) AS x FROM pages" for p in E.TERMS)


@query("str16_terms", f"SELECT page_id, term, {TERM_TYPE} AS term_type, count(*) AS frequency FROM (SELECT page_id, {sql_trim('x')} AS term FROM ({MARKED})) WHERE length(term) BETWEEN 2 AND 30 GROUP BY 1, 2")
def str16(t):
    e = t.pages.select("page_id", F.explode(E.terms(F.col("html"))).alias("term")).groupBy("page_id", "term").agg(F.count(F.lit(1)).alias("frequency"))
    return e.select("page_id", "term", E.term_type(F.col("term")).alias("term_type"), "frequency")


STATED = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest({sql_all('text', '(?i)' + p)}) AS x FROM documents" for k, p in E.CONCEPTS)


@query("str17_concepts", f"SELECT * FROM (SELECT doc_id, kind, {sql_trim('x')} AS concept FROM ({STATED})) WHERE length(concept) >= 2")
def str17(t):
    found = t.documents.select("doc_id", F.explode(E.labelled(F.col("text"), E.CONCEPTS, "(?i)")).alias("c"))
    return found.select("doc_id", "c.kind", X.strip_all(F.col("c.label")).alias("concept")).filter("length(concept) >= 2")


def sql_points(kind):
    items = f"list_concat({', '.join(sql_all('text', p) for p in E.POINTS[kind])})"
    split = rf"flatten(list_transform({items}, lambda x: regexp_split_to_array(x, '[，,;；、]\s*')))"
    return f"list_filter(list_transform({split}, lambda x: {sql_trim('x')}), lambda x: length(x) BETWEEN 2 AND 40)"


NAMED_POINTS = "CASE doc_id % 4 WHEN 0 THEN {} WHEN 1 THEN {} WHEN 2 THEN {} ELSE {} END".format(*map(sql_points, E.POINTS))
WORDS = "list_transform(regexp_extract_all(text, '[A-Za-z]{4,}|[一-鿿]{2,8}')[1:300], lambda w: CASE WHEN regexp_matches(w, '^[A-Za-z]+$') THEN lower(w) ELSE w END)"


@query("str20_knowledge_points", f"SELECT doc_id, array_to_string(list_sort(list_distinct(CASE WHEN len(named) > 0 THEN named ELSE plain END)), '|') AS points FROM (SELECT doc_id, {NAMED_POINTS} AS named, {WORDS} AS plain FROM documents)")
def str20(t):
    """A document's type follows its number here, so that each of the four is used."""
    kind = F.col("doc_id") % 4
    a, b, c, d = (F.array_join(E.points(F.col("text"), k), "|") for k in E.POINTS)
    return t.documents.select("doc_id", F.when(kind == 0, a).when(kind == 1, b).when(kind == 2, c).otherwise(d).alias("points"))


def sql_forms():
    """Scores in twentieths of a point, over columns text, head, tail and lines."""
    score = {k: f"{E.twentieths(w)} * {sql_hits('head', words)}" if words else "0" for k, w, words in E.FORMS}
    either = " + ".join(f"CAST(contains(head, '{w}') OR contains(tail, '{w}') AS INTEGER)" for w in E.FORMS[0][2])
    cited = r"CASE WHEN regexp_matches(text, '\[\d+\]|\([\p{L}\p{N}_]+,\s*\d{4}\)') THEN 40 ELSE 0 END"
    score["paper"] = f"(30 * ({either}) + {cited}) // CASE WHEN {score['thesis']} > 0 THEN 2 ELSE 1 END"
    score["textbook"] += " + CASE WHEN regexp_matches(head, '第.{1,3}章') THEN 30 ELSE 0 END"
    score["exam"] += r" + CASE WHEN regexp_matches(text, '(?m)(?:第\s*[一二三四五六七八九十\d]+\s*题|^\s*\d+[\.、。])') THEN 20 ELSE 0 END"
    score["slides"] = "CASE WHEN len(list_filter(lines, lambda x: length(x) < 30)) > 0.65 * len(lines) AND len(lines) > 10 THEN 40 ELSE 0 END + CASE WHEN regexp_matches(head, 'slide|ppt') THEN 40 ELSE 0 END"
    score["technical"] += " + CASE WHEN regexp_matches(text, '```|`[^`]+`') THEN 20 ELSE 0 END"
    return ", ".join(f"CAST({v} AS INTEGER) AS f_{k}" for k, v in score.items())


TOP = f"greatest({', '.join(f'f_{k}' for k, _, _ in E.FORMS)})"
FORM = " ".join(f"WHEN f_{k} = {TOP} THEN '{k}'" for k, _, _ in E.FORMS)
HEAD = "lower(source || ' ' || substr(text, 1, 4000))"
PARTS = f"SELECT *, {HEAD} AS head, CASE WHEN length(text) > 2000 THEN lower(right(text, 2000)) ELSE {HEAD} END AS tail, list_filter(list_transform(string_split(text, chr(10)), lambda x: {sql_trim('x')}), lambda x: x <> '') AS lines FROM documents"


@query("str22_form", f"SELECT doc_id, {TOP} AS score, CASE WHEN {TOP} <= 0 THEN 'general' {FORM} END AS form FROM (SELECT doc_id, {sql_forms()} FROM ({PARTS}))")
def str22(t):
    args = F.col("text"), F.col("source"), F.lit(0)
    return t.documents.select("doc_id", F.greatest(*E.form_scores(*args).values()).cast("int").alias("score"), E.form(*args).alias("form"))


BLOCK = "CASE WHEN turn % 2 = 1 THEN '一、选择题 共' || turn ELSE text END"
SQUEEZED = sql_trim(rf"regexp_replace({BLOCK}, '\s+', ' ', 'g')")
HEADER = f"length(s) BETWEEN 1 AND 50 AND NOT {sql_any('s', E.OPTION_MARKS)} AND NOT {sql_any('s', E.QUESTION_CUES)} AND ({sql_any('s', E.HEADER_WORDS)} OR {sql_any('s', E.HEADER_TOKENS)})"


@query("str28_section_header", f"SELECT conv_id, turn, turn % 3 = 1 AND {HEADER} AS is_header FROM (SELECT conv_id, turn, {SQUEEZED} AS s FROM conversations)")
def str28(t):
    """Every other turn is worded as a header here; its number gives the block's level."""
    block = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("一、选择题 共"), F.col("turn").cast("string"))).otherwise(F.col("text"))
    return t.conversations.select("conv_id", "turn", E.section_header(block, F.lit("number"), F.col("turn") % 3).alias("is_header"))


@query("js2_first_object", """SELECT event_id, '{"data": ' || props || ', "note": "a } in a string"}' AS object FROM events""")
def js2(t):
    """The first object of an answer with prose, a stray brace and a fence around it."""
    answer = F.concat(F.lit('Here { is it:\n```json\n{"data": '), "props", F.lit(', "note": "a } in a string"}\n``` {"not": "this"}'))
    return t.events.select("event_id", X.first_object(answer).alias("object"))


TITLE = "regexp_replace(lower({}), '[\\s\\-_.:/\\\\|()\\[\\]【】（）·*★#]+', '', 'g')"
CONTENTS = f"(SELECT c_nationkey * 7 + n_regionkey AS item, n_name AS title, {TITLE.format('n_name')} AS norm FROM nation JOIN (SELECT DISTINCT c_nationkey FROM customer) ON c_nationkey = n_nationkey)"


@query("jn12_longest_match", f"SELECT s_suppkey, arg_max(title, ROW(length(norm), -item)) AS title FROM (SELECT s_suppkey, {TITLE.format('n_name')} || CASE WHEN s_suppkey % 2 = 0 THEN 's' ELSE '' END AS t FROM supplier JOIN nation ON s_nationkey = n_nationkey) JOIN {CONTENTS} ON contains(norm, t) OR contains(t, norm) GROUP BY s_suppkey")
def jn12(t):
    """A title's item of the contents: the longest that holds it or is held by it, of equals the first.

    Contents are a bounded list for each document (some hundreds of items), so they are sent along
    and every title is matched where it lies, once for each distinct one.
    """
    held = t.customer.select("c_nationkey").distinct().join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    items = held.select((F.col("c_nationkey") * 7 + F.col("n_regionkey")).alias("item"), F.col("n_name").alias("title"), E.comparable(F.col("n_name")).alias("norm"))
    contents = items.agg(F.collect_list(F.struct("item", "title", "norm")).alias("contents"))  # the contents of one document
    named = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat(E.comparable(F.col("n_name")), F.when(F.col("s_suppkey") % 2 == 0, "s").otherwise("")).alias("t"))
    fits = F.filter("contents", lambda x: F.contains(x["norm"], F.col("t")) | F.contains(F.col("t"), x["norm"]))
    best = F.array_max(F.transform(fits, lambda x: F.struct(F.length(x["norm"]).alias("n"), (-x["item"]).alias("item"), x["title"].alias("title"))))
    found = named.select("t").distinct().join(F.broadcast(contents), F.lit(True)).select("t", best["title"].alias("title")).filter("title is not null")
    return named.join(found, "t").select("s_suppkey", "title")
