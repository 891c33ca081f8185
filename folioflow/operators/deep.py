"""Deep reading of documents: an outline from the first row of each page, batches by chapters, a fold that carries context, a tree.

What a model would do is a plug-in: the outline (titles of samples), a step (points of a batch, given the summary of
the batch before) and the synthesis of a section's facts. The defaults are deterministic columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import rows as R

# Rows read and pages sampled of a document, rows of a batch, points and characters that are carried, shown and summed up.
MOST_ROWS, MOST_SAMPLES, SAMPLE_LENGTH, BATCH = 500, 120, 150, 30
CARRIED_POINTS, CARRIED_LENGTH, SHOWN_POINTS = 10, 500, 50
LEAST_FACTS, MOST_FACTS, SYNTHESIS_ORDER = 3, 50, 999
ROOT_TITLE, DETAIL_TITLE, SYNTHESIS_TITLE = "深度解析地图", "深度解析(Batch {})", "【全局复盘】"
BEFORE = "前文解析摘要："
STATE = "struct<summary:string,done:array<struct<batch:int,hint:string,context:string,points:array<string>>>>"


def samples(rows: DataFrame) -> DataFrame:
    """The first row (by seq) of each page of rows (id, seq, page, content), the first MOST_SAMPLES pages of a document as they come: id, seq, page, sample."""
    short = rows.select("id", "seq", "page", F.left("content", F.lit(SAMPLE_LENGTH)).alias("sample")).repartition("id")  # serves both windows
    first = R.first_per(short, ["id", "page"], [F.col("seq")])
    return R.first_per(first, ["id"], [F.col("seq")], MOST_SAMPLES)


def outline(sampled: DataFrame, title: Callable[[Column], Column]) -> DataFrame:
    """Chapters (id, at, title, start, end): one begins at each sample with a title and ends on the page where the next begins.

    That page belongs to both. The last one is open. at numbers a document's chapters from 1.
    """
    named = sampled.withColumn("title", title(F.col("sample"))).filter("title IS NOT NULL")
    order = Window.partitionBy("id").orderBy("seq")  # MOST_SAMPLES rows at most
    return named.select("id", F.row_number().over(order).alias("at"), "title", F.col("page").alias("start"), F.coalesce(F.lead("page").over(order), F.lit(2**31 - 1)).alias("end"))


def batches(rows: DataFrame, chapters: DataFrame, size: int = BATCH) -> DataFrame:
    """(id, batch, hint, seq, page, content): a document's rows by chapter, at most `size` to a batch, numbered from 0.

    A row whose page lies in several chapters is in a batch of each, one in none is left out; documents without chapters are cut
    as they are. The hint is the title of the first chapter that holds the page of the batch's first row, else `Page n`.
    """
    read = R.first_per(rows.filter("id IS NOT NULL"), ["id"], [F.col("seq")], MOST_ROWS)
    known = chapters.groupBy(F.col("id").alias("_id")).agg(F.array_sort(F.collect_list(F.struct("at", "title", "start", "end"))).alias("chapters"))
    held = F.filter("chapters", lambda c: F.col("page").between(c["start"], c["end"]))
    found = read.join(known, F.col("id") == F.col("_id"), "left").select("id", "seq", "page", "content", "_id", held.alias("held"))
    ats = F.when(F.col("_id").isNull(), F.array(F.lit(0))).otherwise(F.transform("held", lambda c: c["at"]))
    hint = F.coalesce(F.get("held", F.lit(0))["title"], F.concat(F.lit("Page "), F.col("page").cast("string")))
    placed = found.select("id", "seq", "page", "content", hint.alias("hint"), F.explode(ats).alias("at"))
    # Both windows need the same order, so rows are sorted once; all is done where the shuffle by id has put a document.
    opens = (F.row_number().over(Window.partitionBy("id", "at").orderBy("seq")) - 1) % size == 0
    so_far = Window.partitionBy("id").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, 0)
    cut = placed.withColumn("opens", opens)
    numbered = cut.withColumn("batch", (F.count_if("opens").over(so_far) - 1).cast("int")).withColumn("first", F.last(F.when(F.col("opens"), F.struct("hint")), ignorenulls=True).over(so_far))
    return numbered.select("id", "batch", "seq", "page", "content", F.col("first.hint").alias("hint"))


def new_points(candidates: Column, summary: Column) -> Column:
    """The default step: candidates once each, without those of the summary carried on."""
    return F.array_except(F.array_distinct(candidates), F.split(summary, "\n"))


def carried(points: Column) -> Column:
    return F.left(F.array_join(F.slice(points, 1, CARRIED_POINTS), "\n"), F.lit(CARRIED_LENGTH))


def gathered(batched: DataFrame, candidate: Callable[[Column], Column]) -> DataFrame:
    """(id, batches): a document's batches in order, with what each row offers as a point; MOST_ROWS rows to a document and chapter."""
    offers = F.nullif(candidate(F.col("content")), F.lit(""))
    one = batched.groupBy("id", "batch", "hint").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", offers.alias("x")))), lambda r: r["x"]).alias("offered"))
    return one.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("batch", "hint", F.array_compact("offered").alias("offered")))).alias("batches"))


def folded(batched: DataFrame, candidate: Callable[[Column], Column], step: Callable[[Column, Column], Column] = new_points) -> DataFrame:
    """(id, batch, hint, context, points): the batches of each document in turn, each with the summary of the one before as context.

    The fold runs within a document's row, documents in parallel; nothing leaves the JVM.
    """

    def merge(state: Column, b: Column) -> Column:
        points = step(b["offered"], state["summary"])
        done = F.struct(b["batch"].alias("batch"), b["hint"].alias("hint"), state["summary"].alias("context"), points.alias("points"))
        return F.struct(carried(points).alias("summary"), F.concat(state["done"], F.array(done)).alias("done"))

    start = F.struct(F.lit("").alias("summary"), F.array().alias("done")).cast(STATE)
    out = gathered(batched, candidate).select("id", F.explode_outer(F.aggregate("batches", start, merge)["done"]).alias("d"))  # never empty: without `outer` it would be folded once more to see that
    return out.select("id", "d.*")


def folded_by(batched: DataFrame, candidate: Callable[[Column], Column], step: Callable[[list[str], str], list[str]]) -> DataFrame:
    """As folded, with a Python step (a model's call): a document's batches are read one after the other in a task."""

    def run(tables):
        import pyarrow as pa

        for table in tables:
            rows = []
            for doc, parts in zip(table.column("id").to_pylist(), table.column("batches").to_pylist(), strict=True):
                summary = ""
                for b in parts:
                    points = step(b["offered"], summary)
                    rows.append({"id": doc, "batch": b["batch"], "hint": b["hint"], "context": summary, "points": points})
                    summary = "\n".join(points[:CARRIED_POINTS])[:CARRIED_LENGTH]
            yield pa.RecordBatch.from_pylist(rows, schema)

    import pyarrow as pa

    schema = pa.schema([("id", pa.int64()), ("batch", pa.int32()), ("hint", pa.string()), ("context", pa.string()), ("points", pa.list_(pa.string()))])
    held = gathered(batched, candidate).select(F.col("id").cast("bigint").alias("id"), "batches")
    return held.mapInArrow(run, "id bigint, batch int, hint string, context string, points array<string>")


def tree(read: DataFrame, write: Callable[[Column], Column] = lambda texts: F.array_join(texts, "\n")) -> DataFrame:
    """(id, path, parent, type, title, body, round, batch): the rows of each document's tree.

    A root, a chapter for each hint (as its first batch has it), a detail for each batch below it with its first SHOWN_POINTS
    points, and a synthesis for each section with at least LEAST_FACTS points, written from the first MOST_FACTS of them.
    The fold is read once: a section's row makes its details and synthesis, its chapter if it is the first of that path, the
    root if it is the document's first.
    """
    none = F.lit(None).cast("string")
    path = F.concat(F.lit("/chapter/"), F.col("slug"))

    def node(path: Column, parent: Column, kind: str, title: Column, body: Column, depth: int, batch: Column) -> Column:
        return F.struct(path.alias("path"), parent.alias("parent"), F.lit(kind).alias("type"), title.alias("title"), body.alias("body"), F.lit(depth).alias("round"), batch.cast("int").alias("batch"))

    def detail(b: Column) -> Column:
        shown = F.array_join(F.transform(F.slice(b["points"], 1, SHOWN_POINTS), lambda x: F.concat(F.lit("- "), x)), "\n")
        title = F.concat(F.lit(opening), (b["batch"] + 1).cast("string"), F.lit(closing))
        return node(F.concat(path, F.lit("/detail_"), b["batch"].cast("string")), path, "detail", title, shown, 2, b["batch"])

    opening, closing = DETAIL_TITLE.split("{}")
    sections = read.groupBy("id", "hint").agg(F.min("batch").alias("first"), F.array_sort(F.collect_list(F.struct("batch", "points"))).alias("batches"))
    facts = F.slice(F.flatten(F.filter(F.transform("batches", lambda b: b["points"]), lambda p: p.isNotNull())), 1, MOST_FACTS)
    s = sections.select("id", "hint", "first", "batches", facts.alias("facts"), X.slug(F.col("hint"), 40, "unknown").alias("slug"))
    nth = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("first"))
    s = s.withColumn("of_path", nth("id", "slug")).withColumn("of_document", nth("id"))
    root = node(F.lit("/"), none, "root", F.lit(ROOT_TITLE), none, 0, F.lit(0))
    chapter = node(path, F.lit("/"), "chapter", F.col("hint"), none, 2, F.col("first"))
    whole = node(F.concat(F.lit("/synthesis/"), F.col("slug")), F.lit("/"), "synthesis", F.concat(F.lit(SYNTHESIS_TITLE), "hint"), write(F.col("facts")), 3, F.lit(SYNTHESIS_ORDER))
    some = lambda made, when: F.when(when, F.array(made)).otherwise(F.array())
    nodes = F.concat(some(root, F.col("of_document") == 1), some(chapter, F.col("of_path") == 1), F.transform("batches", detail), some(whole, F.size("facts") >= LEAST_FACTS))
    return s.select("id", F.inline_outer(nodes))
