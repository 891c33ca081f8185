"""Exams: a text cut into numbered questions with levels, types, options, shared material and a difficulty.

Everything is columns and windows over the lines of one text, so a text's lines meet once, by its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import extract as E
from folioflow.functions import text as X

# Marks that open a question, with the order of equally frequent ones; question types by words of the
# section's title, then by patterns of the body; wording of shared material; difficulty by words and types.
MARKS = {
    "chapter": r"^第\s*([0-9一-鿿]{1,4})\s*[题章节]",
    "q_num": r"^(?i:Q)\s*(\d{1,3})",
    "paren_num": r"^[(（]\s*(\d{1,3})\s*[)）]",
    "num_dot": r"^(\d{1,3})\s*[.、．:：)）]",
    "circled": r"^([①-⑳])",
    "zh_big": r"^([一二三四五六七八九十百千零]{1,4})\s*[、.．]",
}
PRIORITY = {"zh_big": 1, "chapter": 1, "q_num": 1, "num_dot": 2, "paren_num": 3, "circled": 3}
INLINE = (
    r"(?i)(?<!\n)(?<=[\s　。！？；;:：])(?=第\s*[0-9一-鿿]{1,4}\s*[题章节]|Q\s*\d{1,3}\s*[.):：）]?"
    r"|(?:\d{1,3}|[①-⑳])\s*[.、．:：)）]|[一二三四五六七八九十百千零]{1,4}\s*[、.．])"
)
SECTION_WORDS = {
    "choice": ("选择", "单选", "多选", "不定项选择"),
    "fill_blank": ("填空",),
    "true_false": ("判断", "是非"),
    "short_answer": ("简答", "简述", "名词解释"),
    "essay": ("论述", "问答"),
    "calculation": ("计算", "运算"),
    "proof": ("证明",),
    "design": ("设计", "方案"),
    "material_analysis": ("材料分析", "案例分析", "综合分析", "阅读理解"),
}
CHOICE = r"(?:^|\n)\s*([A-Ha-h])\s*[.、．:：)）]\s*\S"
BODY = {
    "fill_blank": r"_{2,}|（\s*）|\(\s*\)|【\s*】",
    "true_false": r"(?m)[（(]\s*[)）]\s*$|[（(]\s*[对错√×TF]\s*[)）]",
    "proof": r"(?i)(?:^|\n)\s*(?:证明|证：|Prove|证明题)",
    "calculation": r"计算|求解|算出|求.{0,8}的值|解方程|列式",
    "essay": r"试论|论述|详细阐述|分析并评价|谈谈你的看法|结合实际|如何理解",
    "short_answer": r"(?:^|\n)\s*(?:简述|简要说明|简要分析|列举|说明.{0,6}的含义|什么是)",
}
DESIGN = ("题目设计", "设计题", "方案设计", "实验设计", "系统设计", "课程设计")
MATERIAL = (
    r"阅读[下以]?[面列]?(?:的)?材料|材料[一二三四五六七八九十\d]|根据[下以]?[面列]?(?:的)?(?:材料|资料|图表|数据)"
    r"|案例[：:]|背景(?:材料|资料|介绍)[：:]"
)
OPTION = r"(?:^|\n)\s*([A-Ha-h])\s*[.、．:：)）]\s*([\s\S]+?)(?=\n\s*[A-Ha-h]\s*[.、．:：)）]|\z)"
HARD = ("证明", "推导", "复杂度", "optimize", "derive", "证明题", "设计并实现")
ADJUST = {"proof": 0.08, "calculation": 0.08, "essay": 0.05, "design": 0.05, "choice": -0.08, "true_false": -0.10, "fill_blank": -0.05}

LEVELS = len(MARKS)


def number_of(raw: Column) -> Column:
    """Digits, circled numbers and Chinese numerals up to 99; null for others."""

    def digit(c: Column) -> Column:
        return F.when(F.length(c) == 1, F.position(c, F.lit("一二三四五六七八九"))).otherwise(0)

    left, right = F.substring_index(raw, "十", 1), F.regexp_replace(raw, "^[^十]*十", "")
    tens = F.when(left == "", 1).otherwise(digit(left)) * 10 + digit(right)
    chinese = F.when(raw.contains("十"), F.when(tens > 0, tens)).when(raw == "零", 0).when(digit(raw) > 0, digit(raw))
    return (
        F.when(raw.rlike(r"^\d+$"), raw.try_cast("int"))
        .when(raw.rlike("^[①-⑳]$"), F.position(raw, F.lit("①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳")))
        .when(raw.rlike("^[一二三四五六七八九十百千零]+$"), chinese)
    )


def question_type(text: Column, title: Column) -> Column:
    """By the section's title, else three labels of options, else the body's wording."""
    found = F.when(F.lit(False), "")
    for kind, words in SECTION_WORDS.items():
        found = found.when(X.has_any(title, words), kind)
    labels = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(CHOICE), F.lit(1)), F.upper))
    found = found.when(F.size(labels) >= 3, "choice")
    for kind, pattern in BODY.items():
        found = found.when(text.rlike(pattern), kind)
    return found.when(X.has_any(text, DESIGN), "design").otherwise("standard")


def options(text: Column) -> Column:
    """Options (label, text) by label, the first of each; none where there are fewer than two."""
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(OPTION), F.lit(1)).alias("label"), F.regexp_extract_all(text, F.lit(OPTION), F.lit(2)).alias("text"))
    clean = F.transform(both, lambda o: F.struct(F.upper(o["label"]).alias("label"), X.strip_all(F.split_part(X.strip_all(o["text"]), F.lit("\n"), F.lit(1))).alias("text")))
    full = F.filter(clean, lambda o: o["text"] != "")
    first = X.once(full, lambda f: F.filter(f, lambda o, i: F.array_position(f["label"], o["label"]) == i + 1))
    return X.once(first, lambda f: F.when(F.size(f) >= 2, F.array_sort(f)).otherwise(F.slice(f, 1, 0)))


def difficulty(text: Column, kind: Column) -> Column:
    adjust = F.lit(0.0)
    for name, by in ADJUST.items():
        adjust = F.when(kind == name, by).otherwise(adjust)
    listed = F.when(text.rlike(r"\b[ABCD][.)]"), 0.15).otherwise(0.0)
    score = 0.35 + 0.5 * F.least(F.length(text) / 220.0, F.lit(1.0)) + 0.13 * X.hits(F.lower(text), HARD) - listed + adjust
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3)


def difficulty_level(score: Column) -> Column:
    return F.when(score < 0.45, "easy").when(score < 0.72, "medium").otherwise("hard")


def blocks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, block, mark, raw, text): stretches of lines, a new one at each mark; what comes before the first is block 0."""
    clean = F.regexp_replace(F.regexp_replace(text_col, "\r\n?", "\n"), r"[ \t　]+", " ")
    lines = F.split(F.regexp_replace(clean, INLINE, "\n"), r"[\n\u000b\u000c\u0085  ]")
    d = df.select(F.col(id_col).alias("id"), F.posexplode(lines).alias("at", "line")).withColumn("line", X.strip_all(F.col("line"))).filter("line <> ''")
    mark = F.coalesce(*[F.when(F.col("line").rlike(p), F.struct(F.lit(kind).alias("mark"), F.regexp_extract("line", p, 1).alias("raw"))) for kind, p in MARKS.items()])
    so_far = Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("m", mark).withColumn("block", F.count("m").over(so_far))
    lines = F.array_sort(F.collect_list(F.struct("at", "line")))
    out = d.groupBy("id", "block").agg(F.first("m", ignorenulls=True).alias("m"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))
    return out.select("id", "block", "m.mark", "m.raw", "text")


def numbered(b: DataFrame) -> DataFrame:
    """Adds level, number and path to marked blocks.

    A block without a mark of these has level 0 and no path. Marks that a text uses less often stand above the others. A block without a number of its own counts on
    from the last at its level; a deeper level starts anew below each higher one, and levels left out count as 1.
    """
    whole = Window.partitionBy("id")
    order = F.array_sort(F.filter(F.array(*[F.struct(F.count_if(F.col("mark") == k).over(whole).alias("n"), F.lit(p).alias("p"), F.lit(k).alias("k")) for k, p in PRIORITY.items()]), lambda x: x["n"] > 0))
    b = b.withColumn("level", F.array_position(order["k"], F.col("mark")).cast("int")).withColumn("own", number_of(F.col("raw")))
    so_far = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    above = F.array(F.lit(0).cast("bigint"), *[F.count_if(F.col("level") <= k).over(so_far) for k in range(1, LEVELS)])
    b = b.withColumn("above", F.get(above, F.col("level") - 1))
    section = Window.partitionBy("id", "level", "above").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("given", F.count("own").over(section))
    run = Window.partitionBy("id", "level", "above", "given").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("number", F.coalesce(F.first("own").over(run), F.lit(0)) + F.count_if(F.col("own").isNull()).over(run))
    higher = [F.last(F.when(F.col("level") <= k, F.struct(F.when(F.col("level") == k, F.col("number")).alias("n"))), ignorenulls=True).over(so_far)["n"] for k in range(1, LEVELS + 1)]
    parts = F.filter(F.slice(F.array(*[F.coalesce(h, F.lit(1)) for h in higher]), F.lit(1), F.col("level")), lambda n: n > 0)
    return b.withColumn("path", F.array_join(F.transform(parts, lambda n: n.cast("string")), "."))


def questions(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, question, number_path, parent_path, level, marker, section_title, type, options, score, difficulty, material_id, material, text).

    Headers of sections are no questions but give their title and close what stands below them. A question of
    the first level that is worded as material is taken out and given to those below it; its number stays
    unused. A text without a question is one; a text without words, or null, has none. Texts are kept whole.
    Ids have to be unique: rows that repeat one count as one text with their lines mingled.
    """
    b = blocks(df, id_col, text_col)
    whole = Window.partitionBy("id")
    so_far = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    unmarked = F.col("mark").isNull() & (F.max("block").over(whole) == 0)  # a text without a question: its block 0 is all of it
    d = b.withColumn("mark", F.when(unmarked, "none").otherwise(F.col("mark"))).filter("mark is not null")
    d = numbered(d)
    level = F.col("level")
    d = d.withColumn("title", F.last(F.when(level == 1, F.left(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit(80))), ignorenulls=True).over(so_far))
    d = d.withColumn("header", E.section_header(F.col("text"), F.col("mark"), level))
    seen = [F.last(F.when(F.col("header") & (level <= k), F.struct(F.lit(None).cast("string").alias("p"))).when(~F.col("header") & (level == k), F.struct(F.col("path").alias("p"))), ignorenulls=True).over(so_far)["p"] for k in range(1, LEVELS)]
    parents = F.filter(F.slice(F.array(*seen), F.lit(1), F.greatest(level - 1, F.lit(0))), lambda p: p.isNotNull())
    d = d.withColumn("parent_path", F.when(F.size(parents) > 0, F.element_at(parents, -1))).filter(~F.col("header"))
    d = d.withColumn("question", F.row_number().over(whole.orderBy("block")))
    d = d.select("id", "question", F.coalesce(F.nullif("path", F.lit("")), F.col("question").cast("string")).alias("number_path"), "parent_path", F.greatest(level, F.lit(1)).alias("level"), F.col("mark").alias("marker"), F.when(level > 1, F.col("title")).alias("section_title"), F.coalesce("title", F.lit("")).alias("_title"), "text")
    by_question = whole.orderBy("question").rowsBetween(Window.unboundedPreceding, 0)
    is_material = (level == 1) & F.col("text").rlike(MATERIAL)
    group = F.last(F.when(level == 1, F.struct(F.when(is_material, F.count_if(is_material).over(by_question)).alias("n"), F.when(is_material, F.col("text")).alias("text"))), ignorenulls=True).over(by_question)
    d = d.withColumn("m", group).filter(~is_material)
    kind = question_type(F.col("text"), F.col("_title"))
    d = d.withColumn("kind", kind).withColumn("score", difficulty(F.col("text"), F.col("kind")))
    shown = F.when(F.col("m")["n"].isNotNull() & (F.col("kind") == "standard"), "material_analysis").otherwise(F.col("kind"))
    return d.select(
        "id", "question", "number_path", "parent_path", "level", "marker", "section_title", shown.alias("type"),
        F.when(F.col("kind") == "choice", options(F.col("text"))).otherwise(F.array().cast("array<struct<label:string,text:string>>")).alias("options"),
        "score", difficulty_level(F.col("score")).alias("difficulty"), F.concat(F.lit("mat_"), F.col("m")["n"].cast("string")).alias("material_id"), F.col("m")["text"].alias("material"), "text",
    )


def exam_statistics(q: DataFrame) -> DataFrame:
    """A row an exam: questions, depth, mean score, counts by difficulty, and its most frequent type (the first by name)."""
    by_type = q.groupBy("id", "type").agg(
        F.count(F.lit(1)).alias("n"), F.max("level").alias("depth"), F.sum(F.col("score").cast("decimal(9,3)")).alias("score"),
        *[F.count_if(F.col("difficulty") == k).alias(k) for k in ("easy", "medium", "hard")],
    )
    return by_type.groupBy("id").agg(
        F.sum("n").alias("questions"), F.max("depth").alias("depth"), F.round(F.sum("score").cast("double") / F.sum("n"), 6).alias("mean"),
        *[F.sum(k).alias(k) for k in ("easy", "medium", "hard")], F.min_by("type", F.struct(-F.col("n"), "type")).alias("main_type"),
    )


def roll_up(q: DataFrame) -> DataFrame:
    """Adds children, child_pass_rate and whether a question passes to (id, path, parent_path, passed).

    Bottom up, a level at a time: a question passes if its own checks do and at least half of the questions
    right below it pass; one without any has a rate of 1. Paths are numbers joined by dots, of at most as many
    levels as there are marks; rows that repeat a path each count, and each get the sums of what is below.
    """
    d = q.select("id", "path", "parent_path", F.coalesce("passed", F.lit(False)).alias("own"), F.size(F.split("path", r"\.")).alias("depth"))
    d = d.withColumn("children", F.lit(0).cast("bigint")).withColumn("good", F.lit(0).cast("bigint"))
    rate = F.when(F.col("children") > 0, F.round(F.col("good") / F.col("children"), 3)).otherwise(1.0)
    passes = F.col("own") & (rate >= 0.5)
    for depth in range(LEVELS, 1, -1):
        below = d.filter((F.col("depth") == depth) & F.col("parent_path").isNotNull())
        below = below.groupBy("id", F.col("parent_path").alias("path")).agg(F.count(F.lit(1)).alias("more"), F.count_if(passes).alias("passing"))
        d = d.join(below, ["id", "path"], "left").withColumn("children", F.col("children") + F.coalesce("more", F.lit(0))).withColumn("good", F.col("good") + F.coalesce("passing", F.lit(0))).drop("more", "passing")
    return d.select("id", "path", "parent_path", "children", rate.alias("child_pass_rate"), passes.alias("passed"))
