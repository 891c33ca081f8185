"""Text functions as Column expressions. Patterns that DuckDB's engine shares are written alike."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers of content types, in order of precedence.
CONTENT_TYPES = (
    ("definition", ("定义为", "是指", "称为", "定义", "definition")),
    ("example", ("例如", "比如", "举例", "example")),
    ("application", ("应用", "使用", "用于", "application")),
    ("question", ("问题", "疑问", "question")),
    ("answer", ("答案", "解答", "answer")),
)
# Terms that show a discipline, in order of precedence.
DISCIPLINES = {
    "computer-science": ("algorithm", "api", "database", "模型", "算法", "编程", "系统"),
    "mathematics": ("theorem", "proof", "matrix", "概率", "统计", "线性代数"),
    "physics": ("quantum", "mechanics", "entropy", "力学", "电磁", "热力学"),
    "economics": ("market", "finance", "gdp", "经济", "金融", "博弈"),
    "medicine": ("clinical", "patient", "treatment", "医学", "病理", "临床"),
}
# Question and answer roles.
QA_ROLES = (("answer", ("参考答案", "正确答案", "答案", "answer")), ("analysis", ("解析", "解答", "思路", "analysis", "explain")), ("question", ("题干", "question", "题目")))


def once(made: Column, use: Callable[[Column], Column]) -> Column:
    """use(made) with `made` computed once a row: what a lambda or several branches use is else computed anew for each use."""
    return F.get(F.transform(F.array(made), use), F.lit(0))


def first_alike(found: Column, start: int, most: int) -> Column:
    """The first `most` texts of an array that differ in their first `start` characters; of those that begin alike the first."""

    def pick(x: Column) -> Column:
        starts = F.slice(F.array_distinct(x["starts"]), 1, most)
        return F.transform(starts, lambda s: F.get(x["found"], (F.array_position(x["starts"], s) - 1).cast("int")))

    return once(once(found, lambda f: F.struct(f.alias("found"), F.transform(f, lambda y: F.left(y, F.lit(start))).alias("starts"))), pick)


def has_any(text: Column, words) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def hits(text: Column, words) -> Column:
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


def first_class(text: Column, classes, default: str) -> Column:
    """The first class any of whose markers occurs."""
    out = None
    for name, words in classes:
        cond = has_any(text, words)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(default)


def most_hits(text: Column, classes: dict, default: str) -> Column:
    """The class with the most markers; of equals the first; the default without any."""
    names = list(classes)
    counts = [hits(text, classes[n]) for n in names]
    best = F.greatest(*counts)
    out = F.when(best == 0, default)
    for name, n in zip(names, counts, strict=True):
        out = out.when(n == best, name)
    return out


def strip_all(c: Column) -> Column:
    """Without the white space (the patterns' \\s) at both ends."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def normalise(c: Column) -> Column:
    """Line ends to \\n, runs of blanks to one, at most one empty line between others."""
    lines = F.regexp_replace(F.regexp_replace(c, "\r\n|\r", "\n"), "[ \t]+", " ")
    return strip_all(F.regexp_replace(lines, "\n{3,}", "\n\n"))


def strip_layout_noise(c: Column) -> Column:
    """Drop image tokens and lines of punctuation only; squeeze empty lines."""
    unified = F.regexp_replace(c, "\r\n|\r", "\n")
    plain = F.regexp_replace(unified, r"!\[[^\]]*\]\([^)]*\)", "")
    lines = F.transform(F.split(plain, "\n"), strip_all)
    kept = F.filter(lines, lambda x: ~x.rlike(r"^\[OCR_WARN") & ~(x.rlike(r"^[!()\[\],=\-_.:;#/\\\s]+$") & (x != "")))
    return strip_all(F.regexp_replace(F.array_join(kept, "\n"), "\n{3,}", "\n\n"))


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits of two characters or more."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: F.length(x) > 1)


def snippet(c: Column, n: int) -> Column:
    clean = strip_all(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(clean) > n, F.concat(F.substring(clean, 1, n - 1), F.lit("…"))).otherwise(clean)


def slug(c: Column, n: int = 80, default: str = "section") -> Column:
    dashes = F.regexp_replace(F.lower(c), r"[^a-z0-9一-鿿]+", "-")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(dashes, "^-+|-+$", ""), 1, n), F.lit("")), F.lit(default))


def keywords(c: Column) -> Column:
    """Words to count; the pattern is a fixed value."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z]{4,}|[一-鿿]{2,8}"), F.lit(0))


def text_quality(c: Column) -> Column:
    """Share of letters less that of malformed characters."""
    signal = F.regexp_count(c, F.lit("[A-Za-z一-鿿]"))
    noise = F.regexp_count(c, F.lit("[�?\x01-\x08\x0b\x0c\x0e-\x1f]"))
    return F.when(F.length(c) > 0, (signal - noise) / F.length(c)).otherwise(0.0)


def encoding_issues(c: Column) -> Column:
    """Names of the encoding checks that fail; patterns and shares are fixed values."""
    n = F.length(c)
    share = lambda p: F.regexp_count(c, F.lit(p)) / n
    checks = F.array(
        F.when(share("�") > 0.02, "replacement"),
        F.when(share("[\x01-\x08\x0b\x0c\x0e-\x1f]") > 0.01, "control"),
        F.when(F.regexp_count(c, F.lit("[Ã-ÿ]{2,}|â€[’“”]")) > 5, "mojibake"),
        F.when((n > 200) & (share("[^\x01-\x7f一-鿿　-〿＀-￯]") > 0.15), "high_non_cjk"),
    )
    return F.when(n > 0, F.array_compact(checks)).otherwise(F.array().cast("array<string>"))


def first_object(c: Column) -> Column:
    """The first JSON object in each text, as it stands there, however deep its braces are; null without one."""

    @F.pandas_udf("string")
    def objects(texts: pd.Series) -> pd.Series:
        read = json.JSONDecoder()

        def found(text):
            at = text.find("{") if text else -1
            while at >= 0:
                try:
                    return text[at : read.raw_decode(text, at)[1]]
                except ValueError:
                    at = text.find("{", at + 1)
            return None

        return texts.map(found)

    return objects(c)


def natural_key(c: Column) -> Column:
    """Sort key: numbers compare as numbers, and before text."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), F.lit(1))
    number = lambda p: p.rlike(r"^\d+$")
    return F.transform(parts, lambda p: F.struct((~number(p)).alias("is_text"), F.coalesce(p.try_cast("bigint"), F.lit(0)).alias("num"), F.when(number(p), "").otherwise(p).alias("txt")))


def page_number(page: Column, chunk_id: Column) -> Column:
    found = F.regexp_extract(chunk_id, r"page(\d+)", 1).try_cast("int")
    return F.coalesce(F.nullif(page, F.lit(0)), found)


def page_span(first: Column, last: Column) -> Column:
    return F.when(first.isNull(), "").when((last.isNull()) | (first == last), F.concat(F.lit("p. "), first)).otherwise(F.concat(F.lit("p. "), first, F.lit("-"), last))


def chunk_class(content: Column, section: Column) -> Column:
    """filler, example or knowledge."""
    short = F.length(strip_all(content)) < 60

    def kind(x: Column) -> Column:
        filler_section = has_any(x["section"], ("copyright", "acknowledg", "preface", "index", "references"))
        filler_head = hits(F.substring(x["low"], 1, 200), ("copyright", "all rights reserved", "isbn", "publisher")) >= 2
        return F.when(filler_section | filler_head | (x["short"] & ~x["example"]), "filler").when(F.contains(x["section"], F.lit("exam/question")) | x["example"], "example").otherwise("knowledge")

    def marked(x: Column) -> Column:
        example = has_any(x["low"], ("example", "exercise", "problem")) & x["c"].rlike("(?i)(^|[^a-z])(example|exercise|problem) *[0-9]*")
        return F.struct(x["low"].alias("low"), x["section"].alias("section"), short.alias("short"), example.alias("example"))

    return once(once(F.struct(content.alias("c"), F.lower(content).alias("low"), F.lower(section).alias("section")), marked), kind)
