"""Titles, headings, key points and types of documents; files are named after their rows."""

from pyspark.sql import functions as F

from folioflow.functions import titles as N
from folioflow.plans.extracts import sql_trim
from folioflow.plans.registry import query
from folioflow.plans.text import sql_any

KINDS = ("paper", "exam", "technical", "book")
NAMES = ("基于模型的研究_v2.docx", "Department of {}_{}.pdf", "a-b.txt", "{} system design-{}.md", ".hidden")
ENDS = " _-|:：;；,，.。/\\"


def filename():
    """Five forms of names."""
    made = [F.lit(n) if "{}" not in n else F.concat(F.lit(n.split("{}")[0]), "source", F.lit(n.split("{}")[1]), F.col("doc_id").cast("string"), F.lit(n.split("{}")[2])) for n in NAMES]
    return F.element_at(F.array(*made), (F.col("doc_id") % 5 + 1).cast("int"))


def kind():
    return F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % 4 + 1).cast("int"))


FILENAME = "CASE doc_id % 5 " + " ".join(f"WHEN {i} THEN '" + n.replace("{}", "' || source || '", 1).replace("{}", "' || doc_id || '") + "'" for i, n in enumerate(NAMES)) + " END"


def sql_title(x):
    return rf"trim(regexp_replace(regexp_replace({x}, '\s+', ' ', 'g'), '^ | $', '', 'g'), '{ENDS}')"


def sql_score(x, by_name=0):
    some = lambda cond, n: f"CASE WHEN {cond} THEN {n} ELSE 0 END"
    han, latin = f"regexp_matches({x}, '[一-鿿]')", f"regexp_matches({x}, '[A-Za-z]')"
    parts = [some(f"length({x}) BETWEEN 6 AND 40", 4), some(f"length({x}) BETWEEN 41 AND 80", 2), some(han, 3), some(latin, 1), some(f"{han} AND {latin}", 1), some(sql_any(x, N.SUBJECTS_CJK), 4), some(sql_any(f"lower({x})", N.SUBJECTS), 2), some(sql_any(f"lower({x})", N.INSTITUTIONS), -6), some(sql_any(f"lower({x})", N.PERSONS), -3)]
    noisy = rf"length({x}) < 4 OR regexp_matches({x}, '^[^\p{{L}}\p{{Nl}}\p{{No}}]+$') OR {sql_any(f'lower({x})', N.NOISE)}"
    return f"CASE WHEN {noisy} THEN -100 ELSE {by_name} + {' + '.join(parts)} END"


TITLES = rf"""WITH d AS (SELECT doc_id, text, {FILENAME} AS f FROM documents),
stems AS (SELECT *, CASE WHEN starts_with(f, '.') THEN f ELSE regexp_replace(f, '\.[^.]*$', '') END AS stem FROM d),
parts AS (SELECT doc_id, {sql_title('p')} AS x, i FROM (SELECT doc_id, stem AS p, 0 AS i FROM stems UNION ALL SELECT doc_id, unnest(regexp_split_to_array(stem, '[_\-]+')), generate_subscripts(regexp_split_to_array(stem, '[_\-]+'), 1) FROM stems)),
names AS (SELECT stems.doc_id, coalesce(x, stem) AS name FROM stems LEFT JOIN (SELECT doc_id, x FROM parts WHERE x <> '' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY {sql_score('x', 2)} DESC, i) = 1) USING (doc_id)),
lines AS (SELECT doc_id, unnest(l[1:20]) AS line, generate_subscripts(l[1:20], 1) - 1 AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {sql_trim('x')}), lambda x: x <> '') AS l FROM documents)),
c AS (SELECT doc_id, x, i, {sql_score('x')} - i AS s FROM (SELECT doc_id, {sql_title('line')} AS x, i FROM lines) WHERE x <> '' UNION ALL SELECT doc_id, name, 20, {sql_score('x', 2)} + 2 FROM (SELECT doc_id, name, {sql_title('name')} AS x FROM names)),
b AS (FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, i) = 1)
SELECT doc_id, substr(CASE WHEN s < 0 OR (doc_id % 4 IN (0, 2) AND {sql_any('lower(x)', N.INSTITUTIONS)}) THEN name ELSE x END, 1, 180) AS title FROM b JOIN names USING (doc_id)"""


@query("str18_title", TITLES)
def str18(t):
    return N.with_title(t.documents, F.col("text"), kind(), filename()).select("doc_id", "title")


CLEAN = f"list_transform(string_split(text, chr(10)), lambda x: {sql_trim('x')})"


@query("str19_heading_list", rf"SELECT doc_id, array_to_string(list_filter({CLEAN}, lambda x: regexp_matches(x, '^\d+(\.\d+)*\s+.|[:：]$') OR (length(x) <= 35 AND regexp_matches(x, '\p{{Lu}}') AND NOT regexp_matches(x, '[\p{{Ll}}\p{{Lt}}]')))[1:30], '|') AS heads FROM (SELECT doc_id, replace(text, 'of ', '1.2 of:' || chr(10)) AS text FROM documents)")
def str19(t):
    """Every "of" ends a numbered line with a colon here."""
    text = F.regexp_replace("text", "of ", "1.2 of:\n")
    return t.documents.select("doc_id", F.array_join(N.heading_lines(text), "|").alias("heads"))


POINTS = rf"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ' || chr(9) || '-•*#')), lambda x: length(x) >= 20) AS lines,
 list_filter(list_transform(regexp_split_to_array(t, '[。！？.!?\n]+'), lambda x: {sql_trim('x')}), lambda x: length(x) >= 20) AS sentences FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(replace(text, ' ', chr(10)), chr(10) || chr(10), '. ') ELSE text END AS t FROM documents)),
q AS (SELECT doc_id, CASE WHEN len(lines) > 0 THEN lines ELSE sentences END AS x FROM p)
SELECT doc_id, array_to_string(list_transform(list_filter(x, lambda y, i: list_position(list_transform(x, lambda z: substr(z, 1, 120)), substr(y, 1, 120)) = i)[1:5], lambda y: substr(y, 1, 280)), chr(10)) AS points FROM q"""


@query("str7_key_points", POINTS)
def str7(t):
    """A third of the texts have a word a line, so that sentences are looked for."""
    text = F.when(F.col("doc_id") % 3 == 0, F.replace(F.replace("text", F.lit(" "), F.lit("\n")), F.lit("\n\n"), F.lit(". "))).otherwise(F.col("text"))
    return t.documents.select("doc_id", F.array_join(N.key_points(text), "\n").alias("points"))


@query("str25_language_probe", "SELECT doc_id, regexp_matches(t, '[一-鿿]') AS has_cjk, latin >= 40 AND latin > 3 * len(regexp_extract_all(t, '[一-鿿]')) AS mostly_english FROM (SELECT *, len(regexp_extract_all(t, '[A-Za-z]')) AS latin FROM (SELECT doc_id, substr(text, 1, doc_id % 90) || repeat('文本', doc_id % 7) AS t FROM documents))")
def str25(t):
    """Texts of up to 90 characters with some Chinese ones after them, so that both rules decide."""
    text = F.concat(F.left("text", F.col("doc_id") % 90), F.expr("repeat('文本', CAST(doc_id % 7 AS INT))"))
    return t.documents.select("doc_id", text.rlike(N.HAN_CHARACTER).alias("has_cjk"), N.mostly_english(text).alias("mostly_english"))


@query("str29_doc_type", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'exam' WHEN 1 THEN 'technical' WHEN 2 THEN 'project' ELSE CASE WHEN contains(lower(url), 'exam') THEN 'exam' WHEN contains(lower(url), 'api') OR contains(lower(url), 'tech') THEN 'technical' WHEN contains(lower(url), 'project') THEN 'project' ELSE 'academic' END END AS kind FROM pages WHERE NOT contains(lower(url), 'exam') OR page_id % 4 IN (0, 3)")
def str29(t):
    """Names that say what a document is, and the urls themselves."""
    n = F.col("page_id") % 4
    name = F.when(n == 0, "期末试卷.pdf").when(n == 1, F.concat(F.lit("API "), "url")).when(n == 2, "需求.docx").otherwise(F.col("url"))
    return t.pages.filter(~F.contains(F.lower("url"), F.lit("exam")) | n.isin(0, 3)).select("page_id", N.type_by_name(name).alias("kind"))


@query("str31_report_valid", rf"SELECT doc_id, size >= 80 AND NOT contains(lower(t), 'report unavailable') AS valid, size < 700 AS short, size < 320 AS short_compact FROM (SELECT *, length(regexp_replace(t, '\s+', '', 'g')) AS size FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'Report Unavailable ' || text ELSE substr(text, 1, (doc_id * 37) % 1500) END AS t FROM documents))")
def str31(t):
    """Every tenth report says that there is none; the others are of many lengths."""
    text = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("Report Unavailable "), "text")).otherwise(F.left("text", (F.col("doc_id") * 37) % 1500))
    return t.documents.select("doc_id", N.report_valid(text).alias("valid"), N.report_short(text).alias("short"), N.report_short(text, True).alias("short_compact"))
