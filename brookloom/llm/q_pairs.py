"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import functions as F

from brookloom.llm import pairs


def _rows(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/chat_history.parquet")


def p3_found(spark, sf_dir):
    return pairs.judged(_rows(spark, sf_dir))


def p3_counts(spark, sf_dir):
    """Defects by kind."""
    return pairs.judged(_rows(spark, sf_dir)).groupBy("defect").agg(F.count(F.lit(1)).alias("n"))


def p3_pairs(spark, sf_dir):
    """The pairs themselves: every question with the answer directly after it."""
    return pairs.question_answers(_rows(spark, sf_dir))


QUERIES = {"p3_found": p3_found, "p3_counts": p3_counts, "p3_pairs": p3_pairs}
SQL = {
    "p3_pairs": """
WITH once AS (
  SELECT session_id, id, min(created_at) AS sent, arg_min({'role': role, 'content': content}, created_at) AS m FROM chat_history WHERE session_id IS NOT NULL GROUP BY session_id, id
), o AS (
  SELECT id, m.role AS role, m.content AS answer, lag(m.role) OVER w AS before, lag(m.content) OVER w AS question FROM once WHERE m.role IN ('user', 'assistant')
  WINDOW w AS (PARTITION BY session_id ORDER BY sent, CASE m.role WHEN 'user' THEN 1 ELSE 2 END, id)
)
SELECT id, question, answer FROM o WHERE role = 'assistant' AND before = 'user' AND regexp_matches(question, '[\\p{L}\\p{N}]')""",
}
