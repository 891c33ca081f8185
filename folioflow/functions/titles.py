"""Titles, headings and key points of documents, and what their names and texts are taken for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text as X

# What is cut off a title's ends, words that no title holds, words of institutions, of subjects (in either script) and of persons.
TITLE_ENDS = " _-|:：;；,，.。/\\"
NOISE = (
    "abstract", "keywords", "keyword", "contents", "table of contents", "acknowledgements", "reference", "references", "bibliography", "student id", "supervisor", "department",
    "faculty", "school", "college", "university", "摘要", "关键词", "关键字", "目录", "致谢", "参考文献", "学号", "姓名", "专业", "学院", "学校", "大学", "指导教师", "指导老师",
)
INSTITUTIONS = ("university", "college", "faculty", "department", "school", "institute", "campus", "学院", "大学", "学校", "系", "研究院")
SUBJECTS_CJK = ("研究", "分析", "设计", "系统", "模型", "方法", "实现", "应用", "优化", "预测", "影响", "治理", "识别", "检测", "基于")
SUBJECTS = ("study", "analysis", "design", "system", "model", "method", "application", "optimization", "prediction")
PERSONS = ("class", "student", "grade", "学号", "班", "专业")
# Scores of a title.
NOISE_SCORE, BY_NAME, FITTING, LONG, HAN, LATIN, BOTH, SUBJECT_CJK, SUBJECT, INSTITUTION, PERSON, NAME_BONUS = -100, 2, 4, 2, 3, 1, 1, 4, 2, -6, -3, 2
TITLE_LINES, LONGEST_TITLE, HEADINGS_KEPT, UPPER_LENGTH = 20, 180, 30, 35
#: Types whose title is never an institution's line if the file's name gives one.
NAMED_TYPES = ("paper", "general", "technical")
# Key points.
POINT_ENDS, LEAST_POINT, SAME_POINT, MOST_POINTS, POINT_LENGTH = " \t-•*#", 20, 120, 5, 280
# Latin letters of a mostly English text, types by the words of a file's name, and reports that say nothing.
LEAST_LATIN, LATIN_SHARE = 40, 3
TYPES_BY_NAME = (("exam", ("exam", "题", "试卷")), ("technical", ("api", "tech", "技术", "接口")), ("project", ("project", "需求", "里程碑", "任务")))
EMPTY_REPORTS = ("当前未生成稳定报告内容", "建议补充更明确的问题边界后重试", "未生成稳定报告", "report unavailable", "no stable report")
LEAST_REPORT, SHORT_REPORT, SHORT_COMPACT = 80, 700, 320

HAN_CHARACTER, LATIN_LETTER = "[一-鿿]", "[A-Za-z]"


def title_of(c: Column) -> Column:
    return F.btrim(X.strip_all(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), F.lit(TITLE_ENDS))


def institution(title: Column) -> Column:
    return X.has_any(F.lower(title), INSTITUTIONS)


def title_score(title: Column, by_name: bool = False) -> Column:
    """How much a cleaned line, or part of a file's name, looks like a title."""
    some = lambda cond, n: F.when(cond, n).otherwise(0)

    def of(x: Column) -> Column:
        title, low, han, latin, size = (x[k] for k in ("title", "low", "han", "latin", "size"))
        score = F.when(size.between(6, 40), FITTING).when(size.between(41, 80), LONG).otherwise(0) + (BY_NAME if by_name else 0)
        score = score + some(han, HAN) + some(latin, LATIN) + some(han & latin, BOTH) + some(han & X.has_any(title, SUBJECTS_CJK), SUBJECT_CJK) + some(X.has_any(low, SUBJECTS), SUBJECT)
        noisy = (size < 4) | X.has_any(low, NOISE) | title.rlike(r"^[^\p{L}\p{Nl}\p{No}]+$")
        return F.when(noisy, NOISE_SCORE).otherwise(score + some(X.has_any(low, INSTITUTIONS), INSTITUTION) + some(X.has_any(low, PERSONS), PERSON))

    read = F.struct(title.alias("title"), F.lower(title).alias("low"), title.rlike(HAN_CHARACTER).alias("han"), title.rlike(LATIN_LETTER).alias("latin"), F.length(title).alias("size"))
    return X.once(read, of)


def best_of(candidates: Column) -> Column:
    """The title with the highest score of structs (score, order, title) with order falling; null if there are none."""
    return F.array_max(candidates)["title"]


def name_title(filename: Column) -> Column:
    """The best part of a file's name without folder and extension: the whole or what stands between _ and -."""
    base = F.regexp_extract(F.coalesce(filename, F.lit("")), r"([^/\\]*)$", 1)
    stem = F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")
    parts = F.transform(F.concat(F.array(stem), F.split(stem, r"[_\-]+")), title_of)
    scored = F.transform(parts, lambda p, i: F.struct(title_score(p, True).alias("score"), (-i).alias("order"), p.alias("title")))
    found = best_of(F.filter(scored, lambda x: x["title"] != ""))
    return F.coalesce(found, F.nullif(stem, F.lit("")), filename)


def with_title(rows: DataFrame, text: Column, kind: Column, filename: Column, out: str = "title") -> DataFrame:
    """rows with the best of the first TITLE_LINES lines, each a point less than the one before, and of the file's name.

    The name wins if the best scores below 0, or is an institution's line of a type in NAMED_TYPES. Each step is a column of its own,
    as the next ones use it several times.
    """
    lines = F.slice(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: X.strip_all(x)), lambda x: x != ""), 1, TITLE_LINES)
    d = rows.withColumn("_name", name_title(filename)).withColumn("_lines", F.transform(lines, title_of)).withColumn("_clean", title_of(F.col("_name")))
    scored = F.transform("_lines", lambda x, i: F.struct((title_score(x) - i).alias("score"), (-i).alias("order"), x.alias("title")))
    named = F.struct((title_score(F.col("_clean"), True) + NAME_BONUS).alias("score"), F.lit(-TITLE_LINES).alias("order"), F.col("_name").alias("title"))
    d = d.withColumn("_all", F.filter(F.concat(scored, F.array(named)), lambda x: F.coalesce(x["title"] != "", F.lit(False))))
    d = d.withColumn("_best", F.array_max("_all")).withColumn("_title", F.col("_best.title"))
    by_name = (F.col("_best.score") < 0) | (kind.isin(*NAMED_TYPES) & institution(title_of(F.col("_title"))))
    chosen = F.when(by_name & (F.col("_name") != ""), F.col("_name")).otherwise(F.coalesce("_title", "_name"))
    return d.withColumn(out, F.left(chosen, F.lit(LONGEST_TITLE))).drop("_name", "_lines", "_clean", "_all", "_best", "_title")


def heading_lines(text: Column) -> Column:
    """Numbered lines, lines that end in a colon, and short ones in capitals: the first HEADINGS_KEPT."""
    lines = F.transform(F.split(text, "\n"), lambda x: X.strip_all(x))
    capitals = lambda x: (F.length(x) <= UPPER_LENGTH) & x.rlike(r"\p{Lu}") & ~x.rlike(r"[\p{Ll}\p{Lt}]")
    return F.slice(F.filter(lines, lambda x: x.rlike(r"^\d+(\.\d+)*\s+.|[:：]$") | capitals(x)), 1, HEADINGS_KEPT)


def key_points(text: Column, limit: int = MOST_POINTS, longest: int = POINT_LENGTH) -> Column:
    """The first lines of LEAST_POINT characters, without marks at their ends; sentences if no line is so long. Those that begin alike count once."""
    long = lambda xs: F.filter(xs, lambda x: F.length(x) >= LEAST_POINT)

    def found(t: Column) -> Column:
        lines = F.split(F.replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "\n")
        sentences = long(F.transform(F.split(t, r"[。！？.!?\r\n]+"), lambda x: X.strip_all(x)))
        return X.once(long(F.transform(lines, lambda x: F.btrim(x, F.lit(POINT_ENDS)))), lambda p: F.when(F.size(p) > 0, p).otherwise(sentences))

    points = X.first_alike(X.once(F.coalesce(text, F.lit("")), found), SAME_POINT, limit)
    return F.transform(points, lambda x: F.left(x, F.lit(max(SAME_POINT, longest))))


def mostly_english(text: Column) -> Column:
    latin = F.regexp_count(text, F.lit(LATIN_LETTER))
    return (latin >= LEAST_LATIN) & (latin > LATIN_SHARE * F.regexp_count(text, F.lit(HAN_CHARACTER)))


def type_by_name(filename: Column) -> Column:
    return X.first_class(F.lower(filename), TYPES_BY_NAME, "academic")


def report_size(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""))


def report_valid(text: Column) -> Column:
    """Says something: no stand-in for a report, and LEAST_REPORT characters besides white space."""
    t = F.coalesce(text, F.lit(""))
    return ~X.has_any(t, EMPTY_REPORTS) & ~X.has_any(F.lower(t), EMPTY_REPORTS) & (report_size(t) >= LEAST_REPORT)


def report_short(text: Column, compact: bool = False) -> Column:
    return report_size(text) < (SHORT_COMPACT if compact else SHORT_REPORT)
