"""Exams made of conversations: each turn is a question with its number, every other one with three options."""

from pyspark.sql import functions as F

from folioflow.operators import exam
from folioflow.operators import rows as R
from folioflow.plans.registry import Tables, query

# Letters, commas and spaces only, so that no word of a turn opens a question: the oracle then knows each block.
BLOCKS = """(SELECT conv_id AS id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS question, turn, turn % 2 = 0 AS listed,
 rtrim(turn || '. ' || trim(regexp_replace(text, '[^A-Za-z,]+', ' ', 'g'))) || CASE WHEN turn % 2 = 0 THEN chr(10) || 'A. yes' || chr(10) || 'B. no' || chr(10) || 'C. maybe' ELSE '' END AS text FROM conversations)"""
SCORED = f"""(SELECT *, CASE WHEN turn = 0 THEN CAST(question AS VARCHAR) ELSE CAST(turn AS VARCHAR) END AS number_path, CASE WHEN listed THEN 'choice' ELSE 'standard' END AS type,
 round(greatest(0.0, least(1.0, 0.35 + 0.5 * least(length(text) / 220.0, 1.0) + 0.13 * (CAST(contains(lower(text), 'optimize') AS INTEGER) + CAST(contains(lower(text), 'derive') AS INTEGER)) - CASE WHEN listed THEN 0.15 + 0.08 ELSE 0 END)), 3) AS score FROM {BLOCKS})"""


def exams(t: Tables):
    words = F.trim(F.regexp_replace("text", "[^A-Za-z,]+", " "))
    text = F.concat(F.rtrim(F.concat(F.col("turn").cast("string"), F.lit(". "), words)), F.when(F.col("turn") % 2 == 0, "\nA. yes\nB. no\nC. maybe").otherwise(""))
    return t.conversations.groupBy("conv_id").agg(R.keep_in_order(F.col("turn"), text, "\n").alias("text"))


@query("str27_question_blocks", f"SELECT id, question, number_path, type, CAST(CASE WHEN listed THEN 3 ELSE 0 END AS INTEGER) AS options, text FROM {SCORED}")
def str27(t):
    q = exam.questions(exams(t), "conv_id", "text")
    return q.select("id", "question", "number_path", "type", F.size("options").alias("options"), "text")


@query("q15_exam_stats", f"""SELECT id, count(*) AS questions, 1 AS depth, round(sum(CAST(score AS DECIMAL(9,3)))::DOUBLE / count(*), 6) AS mean, count(*) FILTER (score < 0.45) AS easy,
 count(*) FILTER (score >= 0.45 AND score < 0.72) AS medium, count(*) FILTER (score >= 0.72) AS hard, CASE WHEN count(*) FILTER (listed) * 2 >= count(*) THEN 'choice' ELSE 'standard' END AS main_type FROM {SCORED} GROUP BY id""")
def q15(t):
    return exam.exam_statistics(exam.questions(exams(t), "conv_id", "text"))
