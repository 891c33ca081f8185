"""Chapters of a report: headings of rows, rows grouped by chapter and cut in segments, mapped parts grouped again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import extract as E
from folioflow.functions import text as X

# Parts of a path that name no section, headings in order of trust, openings of heading lines, and
# titles that are generic or always stand for a chapter.
PATH_NOISE = ("section", "chunk", "academic", "technical", "project", "exam", "intro", "overall")
INLINE_HEADINGS = (
    r"##\s*(摘\s*要|Abstract)\b",
    r"##\s*([0-9]+(?:\.[0-9]+){0,4}\s*[^\n#]{1,80})",
    r"##\s*(第[一二三四五六七八九十百0-9]+[章节篇部]\s*[^\n#]{0,60})",
    r"(?:^|[\n。！？；;]\s*)(摘\s*要|Abstract)\b",
    r"(?:^|[\n。！？；;]\s*)([0-9]+(?:\.[0-9]+){0,4}\s*[^\n。！？；;#]{1,80})",
    r"(?:^|[\n。！？；;]\s*)(第[一二三四五六七八九十百0-9]+[章节篇部]\s*[^\n。！？；;#]{0,60})",
)
HEADING_LINE = r"^(?i:摘\s*要|abstract|目录|前言|引言|参考文献|总结)(?U:\b)|^[A-Z]\.\s+\S|^[IVXLC]+\.\s+\S|^\d+(?:\.\d+){0,4}\s+\S|^第[一二三四五六七八九十百0-9]+[章节篇部]"
PLAIN_LINE = r"^[一-鿿A-Za-z][^\n]{1,40}$"
HEADING_LINES, LONGEST = 16, 90
GENERIC = ("解题思路", "典型试题", "答案", "工作目标", "职权和职责", "示例", "案例", "例题", "练习题", "相关知识")
GENERIC_OPENINGS = ("答案", "解题思路", "典型试题", "示例", "案例", "附录")
ANCHORS = ("目录", "前言", "编者的话", "考试大纲内容")
ANCHOR = r"^[IVXLC]+\.\s*$|^[A-Z]\.|^\d|^第.*[章节]"
PAGES_IN_BIN = 12


def path_title(path: Column) -> Column:
    """The first part of a section path that names something; empty if none does."""
    parts = F.split(path, "/")
    named = F.filter(parts, lambda p: (p != "") & ~F.lower(p).rlike(r"^(page)?\d+$") & ~F.lower(p).isin(*PATH_NOISE))
    title = X.strip_all(F.regexp_replace(F.coalesce(F.get(named, F.lit(0)), F.lit("")), "[-_]+", " "))
    return F.when(F.length(title) > 1, F.left(title, F.lit(80))).otherwise("")


def clean_heading(line: Column) -> Column:
    """A line without tags, list marks and leaders to a page number."""
    bare = F.regexp_replace(F.regexp_replace(X.strip_all(line), "<[^>]+>", " "), r"^[#>\-*\s]+", "")
    squeezed = X.strip_all(F.regexp_replace(bare, r"\s+", " "))
    return F.left(X.strip_all(F.regexp_replace(squeezed, r"[.·•]{3,}\s*\d+\s*$", "")), F.lit(100))


def content_heading(content: Column) -> Column:
    """A numbered or named heading anywhere, else the first of the opening lines that looks like one; empty if none does."""
    text = F.regexp_replace(F.coalesce(content, F.lit("")), "\r\n?", "\n")
    usable = lambda line: (line != "") & (F.length(line) <= LONGEST)
    inline = F.filter(F.array(*[clean_heading(F.regexp_extract(text, f"(?i){p}", 1)) for p in INLINE_HEADINGS]), usable)
    lines = F.filter(F.transform(F.slice(F.split(text, "\n"), 1, HEADING_LINES), clean_heading), usable)
    strong, plain = F.filter(lines, lambda x: x.rlike(HEADING_LINE)), F.filter(lines, lambda x: x.rlike(PLAIN_LINE))
    return F.coalesce(F.get(inline, F.lit(0)), F.get(strong, F.lit(0)), F.get(plain, F.lit(0)), F.lit(""))


def heading(path: Column, content: Column, title: Column) -> Column:
    """By the section path, else the content, else the row's own title; empty if all fail."""
    found = [F.nullif(path_title(path), F.lit("")), F.nullif(content_heading(content), F.lit("")), clean_heading(title), F.lit("")]
    return F.coalesce(*found)


def generic_title(title: Column) -> Column:
    plain = F.regexp_replace(F.lower(X.strip_all(title)), "[:：]+$", "")
    return (plain == "") | plain.isin(*GENERIC) | plain.rlike("^(" + "|".join(GENERIC_OPENINGS) + ")")


def anchor_title(title: Column) -> Column:
    t = X.strip_all(title)
    return (t != "") & (t.isin(*ANCHORS) | t.rlike(ANCHOR) | ~generic_title(t))


def chapters(rows: DataFrame, contents: DataFrame) -> DataFrame:
    """Adds chapter_key and chapter_title to rows (id, seq, page, section_path, content, title).

    contents: (id, at, title), an item of the table of contents each; a document's items are few. A row
    belongs to the last item at or before its page; else to the longest item that holds its heading or is
    held by it (of equals the first); else to its own heading. A generic heading stays in the chapter
    before, if there is one. Without a heading, pages go to bins of 12, rows without a page to their document.
    """
    item = F.struct(F.col("at"), F.col("title"))
    toc = contents.filter("at > 0 AND title IS NOT NULL").groupBy(F.col("id").alias("_id")).agg(F.array_sort(F.collect_list(item)).alias("toc"))
    d = rows.join(toc, rows["id"] == toc["_id"], "left").withColumn("toc", F.coalesce("toc", F.array().cast("array<struct<at:int,title:string>>")))
    d = d.withColumn("page", F.coalesce("page", F.lit(0))).withColumn("_head", heading(F.col("section_path"), F.col("content"), F.col("title")))
    before = F.filter("toc", lambda x: x["at"] <= F.col("page"))
    plain = E.comparable(F.col("_head"))
    alike = F.filter("toc", lambda x: (plain != "") & (E.comparable(x["title"]) != "") & (F.contains(plain, E.comparable(x["title"])) | F.contains(E.comparable(x["title"]), plain)))
    longest = F.array_max(F.transform(alike, lambda x: F.length(E.comparable(x["title"]))))
    by_text = F.get(F.filter(alike, lambda x: F.length(E.comparable(x["title"])) == longest), F.lit(0))
    hit = F.coalesce(F.when((F.col("page") > 0) & (F.size(before) > 0), F.element_at(before, -1)), by_text)
    titled = F.col("_head") != ""
    strong = titled & ~generic_title(F.col("_head")) & anchor_title(F.col("_head"))
    d = d.withColumn("_hit", hit)
    kind = F.when(F.col("_hit").isNotNull(), "toc").when(strong, "own").when(titled, "weak").when(F.col("page") > 0, "bin").otherwise("document")
    d = d.withColumn("_kind", kind)
    start = F.expr(f"(page - 1) div {PAGES_IN_BIN} * {PAGES_IN_BIN} + 1")
    end = start + PAGES_IN_BIN - 1
    name = F.coalesce(F.nullif(X.strip_all(F.col("title")), F.lit("")), F.lit("文档内容"))
    span = F.concat(start.cast("string"), F.lit("-"), end.cast("string"))
    key = (
        F.when(F.col("_kind") == "toc", F.concat(F.lit("toc:"), F.col("_hit")["at"].cast("string"), F.lit(":"), X.slug(F.col("_hit")["title"], 100)))
        .when(titled, F.concat(F.lit("section:"), X.slug(F.col("_head"), 100)))
        .when(F.col("_kind") == "bin", F.concat(F.lit("pages:"), span))
        .otherwise(F.concat(F.lit("document:"), X.slug(name, 100)))
    )
    shown = F.when(F.col("_kind") == "toc", F.col("_hit")["title"]).when(titled, F.col("_head")).when(F.col("_kind") == "bin", F.concat(F.lit("页 "), span)).otherwise(name)
    order = Window.partitionBy("id").orderBy("page", "seq")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    # what a weak heading carries on: the last chapter that is no bin; the first weak one opens its own
    d = d.withColumn("_c", F.struct(key.alias("key"), shown.alias("title")))
    opens = (F.col("_kind") != "bin") & ((F.col("_kind") != "weak") | (F.count_if(F.col("_kind") != "bin").over(so_far) == 1))
    d = d.withColumn("_opens", opens)
    active = F.last(F.when(F.col("_opens"), F.col("_c")), ignorenulls=True).over(so_far)
    d = d.withColumn("_chapter", F.when(F.col("_kind") == "weak", active).otherwise(F.col("_c")))
    return d.select(*rows.columns, F.col("_chapter")["key"].alias("chapter_key"), F.col("_chapter")["title"].alias("chapter_title"))


def in_segments(rows: DataFrame, size: int) -> DataFrame:
    """Rows with their chapter's segment and how many there are.

    Chapters of up to `size` rows, or twice that within 24 pages, stay whole; others go into 2 to 4 segments
    by their span of pages (48, 90), or by their rows (3 and 5 times `size`) where no page is known.
    """
    w = Window.partitionBy("id", "chapter_key")
    page = F.when(F.col("page") > 0, F.col("page"))
    d = rows.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("span", F.coalesce(F.max(page).over(w) - F.min(page).over(w) + 1, F.lit(0)))
    whole = f"n <= {size} OR (span <= 24 AND n <= {2 * size})"
    wanted = f"CASE WHEN span = 0 THEN CASE WHEN n <= {3 * size} THEN 2 WHEN n <= {5 * size} THEN 3 ELSE 4 END WHEN span <= 48 THEN 2 WHEN span <= 90 THEN 3 ELSE 4 END"
    each = F.expr(f"CASE WHEN {whole} THEN n ELSE greatest({size}, (n + ({wanted}) - 1) div ({wanted})) END")
    d = d.withColumn("each", each).withColumn("r", F.row_number().over(w.orderBy("page", "seq")) - 1)
    d = d.withColumn("segment", F.expr("CAST(r div each + 1 AS INT)")).withColumn("of", F.expr("CAST((n + each - 1) div each AS INT)"))
    return d.drop("n", "span", "each", "r")


def segments(rows: DataFrame, size: int) -> DataFrame:
    """A row (id, chapter_key, chapter_title, segment, label, first, last, rows) for each segment of rows."""
    page = F.when(F.col("page") > 0, F.col("page"))
    out = in_segments(rows, size).groupBy("id", "chapter_key", "segment", "of").agg(F.first("chapter_title").alias("chapter_title"), F.min(page).alias("first"), F.max(page).alias("last"), F.count(F.lit(1)).alias("rows"))
    part = F.concat(F.lit(" 第"), F.col("segment").cast("string"), F.lit("/"), F.col("of").cast("string"), F.lit("段"))
    return out.select("id", "chapter_key", "chapter_title", "segment", F.concat("chapter_title", F.when(F.col("of") > 1, part).otherwise("")).alias("label"), "first", "last", "rows")


def regroup(parts: DataFrame, content: str) -> DataFrame:
    """Mapped parts (id, chapter_key, chapter_title, label, first, last, content) by chapter: (id, key, title, first, last, parts).

    The key is the part's chapter, else its label, else its pages, else a digest of its content; equal
    parts without any of these share a group. The title is that of the part with the least page.
    """
    given = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    first, last = F.col("first"), F.col("last")
    pages = F.when((first > 0) & (last >= first), F.concat_ws("", F.lit("pages:"), first.cast("string"), F.lit("-"), last.cast("string"))).when(first > 0, F.concat(F.lit("page:"), first.cast("string")))
    digest = F.concat(F.lit("auto:"), F.left(F.md5(F.coalesce(F.col(content), F.lit("")).cast("binary")), F.lit(8)))
    own = F.when(~given("chapter_key").rlike("^pages?:"), given("chapter_key"))
    d = parts.select("id", F.coalesce(given("chapter_key"), given("label"), pages, digest).alias("key"), F.coalesce(given("chapter_title"), given("label"), own, F.lit("章节")).alias("title"), "first", "last")
    return d.groupBy("id", "key").agg(F.min_by("title", F.struct(F.col("first").isNull(), "first", "title")).alias("title"), F.min(F.when(first > 0, first)).alias("first"), F.max(F.when(last > 0, last)).alias("last"), F.count(F.lit(1)).alias("parts"))


# What titles are compared without, and the number that opens one.
UNCOMPARED, NUMBER = r"[\s\-_.:/()\[\]【】（）·*★]+", r"^(\d+(?:\.\d+)*)"


def navigation(tree: DataFrame, summaries: DataFrame) -> DataFrame:
    """Nodes (id, node, title, page_start, page_end, matched, score): each with its best summary.

    tree: (id, node, title, page_start, page_end), nodes in order; summaries: (id, seq, title, page_start,
    page_end). A node's pages reach to the next known start. A summary scores by an equal title, an equal
    number before it, pages that overlap and an equal start; of equals the first wins, none without a
    score. A document without a tree has its summaries as nodes. A document's summaries are a bounded list.
    """
    following = Window.partitionBy("id").orderBy("node").rowsBetween(1, Window.unboundedFollowing)
    upto = F.first("page_start", ignorenulls=True).over(following) - 1
    start, end = F.col("page_start"), F.col("page_end")
    longer = (upto >= start) & (end.isNull() | (end < upto))
    d = tree.withColumn("page_end", F.coalesce(F.when(longer, upto).otherwise(end), start))
    held = summaries.groupBy(F.col("id").alias("_id")).agg(F.array_sort(F.collect_set(F.struct("seq", "title", "page_start", "page_end"))).alias("s"))
    plain = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), UNCOMPARED, "")
    number = lambda c: F.regexp_extract(X.strip_all(F.coalesce(c, F.lit(""))), NUMBER, 1)
    usable = lambda a, b: (a > 0) & (b >= a)

    def score(x: Column) -> Column:
        same = F.when(plain(F.col("title")) == plain(x["title"]), 1000).otherwise(0)
        own = number(F.col("title"))
        numbered = F.when((own != "") & (own == number(x["title"])), 900 + F.least(F.length(own), F.lit(20))).otherwise(0)
        meet = usable(start, end) & usable(x["page_start"], x["page_end"]) & (start <= x["page_end"]) & (x["page_start"] <= end)
        return same + numbered + F.when(meet, 100 + F.when(start == x["page_start"], 20).otherwise(0)).otherwise(0)

    d = d.join(held, d["id"] == held["_id"], "left")
    scored = F.transform("s", lambda x: F.struct(score(x).alias("score"), (-x["seq"]).alias("first"), x["title"].alias("title")))
    best = F.array_max(F.filter(scored, lambda x: x["score"] > 0))
    nodes = d.withColumn("b", best).select("id", "node", "title", "page_start", "page_end", F.col("b")["title"].alias("matched"), F.coalesce(F.col("b")["score"], F.lit(0)).alias("score"))
    bare = summaries.distinct().join(tree.select(F.col("id")).distinct(), "id", "left_anti")
    return nodes.unionByName(bare.select("id", F.col("seq").alias("node"), "title", "page_start", "page_end", F.col("title").alias("matched"), F.lit(0).alias("score")))
