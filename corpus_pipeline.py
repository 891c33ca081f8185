"""The corpus pipeline: quality classifier, exact dedup, near-dedup, mixing, packing.

Every stage takes what the one before kept, written as Parquet and read again. A document leaves if the
classifier rejects it (its score is under 0.7), if an equal text with a larger doc_id stays, or if it is
linked to a document with a smaller doc_id. Columns of any other name come through as they are. An
empty table gives an empty one. Mixing writes the rest in the order of the mix; packing takes all
in the order of the files' rows, so that sequences follow the mix.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.common import Scratch, text_or_empty
from folioflow.llm.exact_dedup import exact_dedup
from folioflow.llm.mixing import mix
from folioflow.llm.near_dedup import near_dedup
from folioflow.llm.packing import digest, pack_in_order
from folioflow.llm.quality import learn, score_of


#: A row for each file (about 150 bytes) is broadcast up to so many files.
MOST_FILES = 500_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = 0.7) -> DataFrame:
    """Rows whose text scores at least the threshold; a null text is scored as an empty one. Rows and columns are as they were."""
    with Scratch(spark, "pipeline-quality") as scratch:
        model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), scratch)
    return docs.filter(score_of(model, text_or_empty()) >= threshold)


def in_file_order(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (doc, row): docs' columns as a struct, and a number of its own for each row, by the files' names, then their rows.

    What doesn't come straight from files is written first.
    """
    try:
        docs.select("_metadata.file_path").schema  # noqa: B018
    except AnalysisException:
        docs = scratch.save(docs, "rows", keep=True)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    sizes = rows.groupBy("file").agg((F.max("at") + 1).alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    first = sizes.select(F.col("file").alias("f"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    few = len(docs.inputFiles()) <= MOST_FILES
    return rows.join(F.broadcast(first) if few else first, F.col("file") == F.col("f")).select("doc", (F.col("first") + F.col("at")).alias("row"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: that with the largest doc_id, of several such the last one; null texts are empty ones, null ids lowest."""
    with Scratch(spark, "pipeline-exact") as scratch:
        rows = in_file_order(docs, scratch).select("doc", F.struct(F.col("doc.doc_id").alias("id"), "row").alias("doc_id"), F.col("doc.text").alias("text"))
        return exact_dedup(rows).filter("kept").select("doc.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose doc_id is the least of its near copies; rows with one id go or stay together, null ids and empty texts stay."""
    with Scratch(spark, "pipeline-near") as scratch, Scratch(spark, "pipeline-links") as links:
        gone = scratch.save(near_dedup(docs, links).filter("not kept").select(F.col("doc_id").alias("_id")).distinct(), "gone", keep=True)
        links.drop(links.path)
        return docs.join(gone, docs["doc_id"] == gone["_id"], "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order of the mix; joined by their number, as ids may repeat or be null. A null source is the source ""."""
    with Scratch(spark, "pipeline-mixed") as scratch:
        rows = in_file_order(docs, scratch)
        order = mix(rows.select("doc.doc_id", "doc.source", "row")).select(F.col("row").alias("of"), "position")
        return rows.join(order, F.col("row") == F.col("of")).repartitionByRange("position").sortWithinPartitions("position").select("doc.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows' tokens, in sequences that follow the rows' order; a null text is the one id 0."""
    import public_tokenizers

    with Scratch(spark, "pipeline-packed") as scratch:
        rows = in_file_order(docs, scratch).select("doc.doc_id", "doc.text", "row")
        return digest(pack_in_order(rows, "row", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixing", mixed), ("packing", packed)]
#: Learned scores and tokenization have no SQL; a test holds the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark, "pipeline") as scratch:
        for name, stage in STAGES[:-1]:
            docs = scratch.save(stage(spark, docs, sf_dir), name, keep=True)
        return STAGES[-1][1](spark, docs, sf_dir)
