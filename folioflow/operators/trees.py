"""Trees of documents: contents or derived chapters, nested structs of any depth, answers rolled up from below."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import rows as R

# Entries of a tree, lines shown, deepest indent; what tells a paper and a book; their labels and outlines.
MOST_ENTRIES, MOST_LINES, MOST_INDENT = 24, 18, 3
PAPER_MARKERS = ("abstract", "introduction", "method", "results", "discussion", "conclusion", "references")
BOOK_CONTENTS, BOOK_ENTRIES = 3, 5
LABELS = {"paper": "论文/学术文章", "book": "书籍/长篇著作", "generic": "学术长文档"}
BLUEPRINTS = {
    "paper": ("研究问题与核心论点", "方法与数据", "主要发现", "局限性与可信度", "研究价值与延展"),
    "book": ("全书结构图", "核心主题", "章节递进关系", "关键证据与案例", "研究价值与局限"),
    "generic": ("研究问题", "结构脉络", "方法与证据", "主要发现", "局限性", "研究价值"),
}
# How much of the children's evidence, reasons, steps and titles a group of questions keeps, and from which rate of passed children it passes.
MOST_EVIDENCE, MOST_REASONS, MOST_STEPS, MOST_TITLES, LEAST_RATE = 4, 3, 8, 4, 0.5
GROUP_ANSWER, GROUP_TITLES, GROUP_REASONS = ("本题为题组，共 ", " 个子题，建议按顺序递归作答。"), "优先处理：", "共性抓手："
NO_REASON, INCONSISTENT = "本题需要先理解总题干，再逐层拆解到子题。", "subquestion_consistency"


def document_tree(rows: DataFrame, contents: DataFrame) -> DataFrame:
    """(id, at, title, page_start, page_end, level, source): the first MOST_ENTRIES entries of each document's tree.

    contents (id, at, title, page, level) if a document's first MOST_ENTRIES items name anything, else the chapters of its rows (id,
    seq, page, chapter_key, chapter_title) as they are met first. Pages and levels are never below 0 and 1.
    """
    title = X.strip_all(F.coalesce("title", F.lit("")))
    few = R.first_per(contents, ["id"], [F.col("at")], MOST_ENTRIES).withColumn("title", title).filter("title <> ''")
    page = F.greatest(F.coalesce("page", F.lit(0)), F.lit(0))
    toc = few.select("id", F.col("at").cast("int").alias("at"), "title", page.alias("page_start"), page.alias("page_end"), F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)).alias("level"), F.lit("toc").alias("source"))
    known = F.when(F.col("page") > 0, F.col("page"))
    chapters = rows.groupBy("id", "chapter_key").agg(F.min_by("chapter_title", F.struct("page", "seq")).alias("title"), F.min(F.struct("page", "seq")).alias("first"), F.min(known).alias("page_start"), F.max(known).alias("page_end"))
    derived = R.first_per(chapters.join(toc.select("id").distinct(), "id", "left_anti"), ["id"], [F.col("first"), F.col("chapter_key")], MOST_ENTRIES)
    number = F.row_number().over(Window.partitionBy("id").orderBy("first", "chapter_key"))  # MOST_ENTRIES rows at most
    return toc.unionByName(derived.select("id", number.alias("at"), "title", "page_start", "page_end", F.lit(1).alias("level"), F.lit("derived").alias("source")))


def profile(documents: DataFrame, tree: DataFrame) -> DataFrame:
    """(id, kind, label, blueprint) of documents (id, type, toc_items): a paper, a book or a long document, by its tree."""
    t = F.lower(F.col("title"))
    facts = tree.groupBy("id").agg(F.count_if(X.has_any(t, PAPER_MARKERS)).alias("hits"), F.max(F.contains(t, F.lit("abstract"))).alias("abstract"), F.count(F.lit(1)).alias("entries"))
    d = documents.join(facts, "id", "left").fillna(0, ["hits", "entries"])
    paper = (F.lower(F.trim(F.coalesce("type", F.lit("")))) == "academic") & ((F.col("hits") >= 2) | F.coalesce("abstract", F.lit(False)))
    kind = F.when(paper, "paper").when((F.col("toc_items") >= BOOK_CONTENTS) | (F.col("entries") >= BOOK_ENTRIES), "book").otherwise("generic")
    named = lambda values: F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])
    d = d.withColumn("kind", kind)
    return d.select("id", "kind", named({k: F.lit(v) for k, v in LABELS.items()})[F.col("kind")].alias("label"), named({k: F.array(*map(F.lit, v)) for k, v in BLUEPRINTS.items()})[F.col("kind")].alias("blueprint"))


def shown(tree: DataFrame) -> DataFrame:
    """(id, outline): the first MOST_LINES entries as lines, indented by level."""
    indent = F.repeat(F.lit("  "), F.least(F.col("level") - 1, F.lit(MOST_INDENT)))
    line = F.concat(indent, F.lit("- "), "title", F.when(F.col("page_start") > 0, F.concat(F.lit(" ("), X.page_span(F.col("page_start"), F.col("page_end")), F.lit(")"))).otherwise(""))
    few = R.first_per(tree, ["id"], [F.col("at")], MOST_LINES)
    return few.groupBy("id").agg(R.keep_in_order(F.col("at"), line, "\n").alias("outline"))


def nested(nodes: DataFrame, levels: int, fields: list[str]) -> DataFrame:
    """(doc, ord, tree) for each root: its fields, how many children it has, and they nested, as JSON.

    nodes: (doc, id, parent, level from 0, ord, fields). Children are on a deeper level than their parent, not always the next, and go by
    ord, then id. Nodes whose parent is no node are roots. Built from the deepest level up, a join a level: what has found no
    parent yet waits, grouped by the parent's id.
    """
    kid = "array<struct<ord:string,id:string,json:string>>"
    waiting = None
    for level in reversed(range(levels)):
        here = nodes.filter(F.col("level") == level).select("doc", F.col("id").cast("string").alias("id"), F.col("parent").cast("string").alias("parent"), F.format_string("%012d", F.col("ord").cast("bigint")).alias("ord"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("own"))
        if waiting is None:
            both = here.withColumn("kids", F.lit(None).cast(kid)).withColumn("of", F.lit(None).cast("string"))
        else:
            w = waiting.withColumnRenamed("doc", "_doc")
            both = here.join(w, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("id") == F.col("of")), "full").withColumn("doc", F.coalesce("doc", "_doc"))
        inner = F.coalesce(F.array_join(F.transform(F.array_sort("kids"), lambda x: x["json"]), ","), F.lit(""))
        json = F.concat(F.expr("substring(own, 1, length(own) - 1)"), F.lit(',"child_count":'), F.coalesce(F.size("kids"), F.lit(0)).cast("string"), F.lit(',"children":['), inner, F.lit("]}"))
        built = F.array(F.struct("ord", "id", json.alias("json"))).cast(kid)
        out = F.when(F.col("id").isNotNull(), built).otherwise(F.col("kids"))
        up = F.when(F.col("id").isNotNull(), F.col("parent")).otherwise(F.col("of"))
        waiting = both.select("doc", up.alias("of"), F.explode(out).alias("k")).groupBy("doc", "of").agg(F.collect_list("k").cast(kid).alias("kids"))
    return waiting.select("doc", F.explode("kids").alias("k")).select("doc", F.col("k.ord").cast("bigint").alias("ord"), F.col("k.json").alias("tree"))


def first_distinct(rows: DataFrame, group: list[str], keys: list[str], order: list[str], limit: int) -> DataFrame:
    """The first `limit` distinct keys of each group, by where they are met first: (group, keys, _at).

    Repeats go where they lie and again after the shuffle, and only a limit's worth of each group is sorted: no group is gathered.
    """
    firsts = rows.groupBy(*group, *keys).agg(F.min(F.struct(*order)).alias("_at"))
    return R.first_per(firsts, group, [F.col("_at"), *map(F.col, keys)], limit)


def listed(first: DataFrame, group: list[str], value: Column, out: str) -> DataFrame:
    """What first_distinct kept, as an array in order."""
    held = F.array_sort(F.collect_list(F.struct(F.col("_at"), value.alias("v"))))
    return first.groupBy(*group).agg(F.transform(held, lambda x: x["v"]).alias(out))


def preview(c: Column, n: int) -> Column:
    plain = X.strip_all(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(F.length(plain) <= n, plain).otherwise(F.concat(F.rtrim(F.left(plain, F.lit(n - 1))), F.lit("…")))


def roll_up_answers(questions: DataFrame, levels: int) -> DataFrame:
    """Questions with their answers; a group's are made of its children's, from the deepest level up.

    questions: (id, path, parent_path, level from 1, text, answer, reasons, evidence (title, section_path, discipline), steps, passed,
    failed); a child is one level below its parent. A group gets its children's first distinct evidence, reasons and steps, an
    answer that names the first children, the share of them that passed, and passes if it does itself and half of them do.
    """
    g, below, out = ["id", "_up"], None, None
    number = F.transform(F.split("path", r"\."), lambda p: F.try_to_number(p, F.lit("999999999")).cast("bigint"))
    cols = ["id", "path", "parent_path", "answer", "reasons", "evidence", "steps", "child_pass_rate", "passed", "failed"]
    for level in range(levels, 0, -1):
        here = questions.filter(F.col("level") == level)
        if below is None:
            done = here.withColumn("child_pass_rate", F.lit(1.0))
        else:
            kids = below.select("id", F.col("parent_path").alias("_up"), number.alias("_number"), "path", "text", "reasons", "evidence", "steps", "passed").filter("_up IS NOT NULL")
            spread = lambda c: kids.select(*g, "_number", "path", F.posexplode(c).alias("_i", "x"))
            s = spread("evidence").select(*g, "_number", "path", "_i", *[F.trim(F.coalesce(F.col(f"x.{c}"), F.lit(""))).alias(c) for c in ("title", "section_path", "discipline")]).filter("title <> ''")
            shown_as = F.struct("title", F.coalesce(F.nullif("section_path", F.lit("")), F.lit("N/A")).alias("section_path"), F.coalesce(F.nullif("discipline", F.lit("")), F.lit("all")).alias("discipline"))
            evidence = listed(first_distinct(s, g, ["title", "section_path", "discipline"], ["_number", "path", "_i"], MOST_EVIDENCE), g, shown_as, "_evidence")
            texts = lambda c, value, n, name: listed(first_distinct(spread(c).withColumn("v", value).filter("v <> ''"), g, ["v"], ["_number", "path", "_i"], n), g, F.col("v"), name)
            reasons, steps = texts("reasons", preview(F.col("x"), 120), MOST_REASONS, "_reasons"), texts("steps", F.trim("x"), MOST_STEPS, "_steps")
            titles = R.first_per(kids, g, [F.col("_number"), F.col("path")], MOST_TITLES).withColumn("_at", F.struct("_number", "path"))
            titles = listed(titles, g, F.concat(F.lit("Q"), "path", F.lit(" "), preview(F.col("text"), 96)), "_titles")
            stats = kids.groupBy(*g).agg(F.count(F.lit(1)).alias("_of"), F.round(F.count_if("passed") / F.count(F.lit(1)), 3).alias("_rate"))
            j = here
            for part in (stats, titles, evidence, reasons, steps):
                p = part.withColumnRenamed("id", "_id")
                j = j.join(p, (F.col("id") == F.col("_id")) & (F.col("path") == F.col("_up")), "left").drop("_id", "_up")
            group = F.col("_of").isNotNull()
            some = lambda c, own: F.when(group, F.coalesce(c, F.array().cast(questions.schema[own].dataType))).otherwise(F.col(own)).alias(own)
            first_two = F.array_join(F.slice("_reasons", 1, 2), "；")
            answer = F.concat_ws("\n", F.concat(F.lit(GROUP_ANSWER[0]), F.col("_of").cast("string"), F.lit(GROUP_ANSWER[1])), F.concat(F.lit(GROUP_TITLES), F.array_join("_titles", "；")), F.concat(F.lit(GROUP_REASONS), first_two))
            failed = F.when(F.col("_rate") < 1, F.array_union("failed", F.array(F.lit(INCONSISTENT)))).otherwise(F.col("failed"))
            done = j.select(
                "id", "path", "parent_path", "text", F.when(group, answer).otherwise(F.col("answer")).alias("answer"),
                F.when(group, F.coalesce("_reasons", F.array(F.lit(NO_REASON)))).otherwise(F.col("reasons")).alias("reasons"), some(F.col("_evidence"), "evidence"), some(F.col("_steps"), "steps"),
                F.coalesce("_rate", F.lit(1.0)).alias("child_pass_rate"), F.when(group, F.col("passed") & (F.col("_rate") >= LEAST_RATE)).otherwise(F.col("passed")).alias("passed"), F.when(group, failed).otherwise(F.col("failed")).alias("failed"),
            )
        below = done
        out = done.select(*cols) if out is None else out.unionByName(done.select(*cols))
    return out
