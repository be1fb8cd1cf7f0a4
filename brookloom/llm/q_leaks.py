"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import functions as F

from brookloom.llm.leaks import leaks


def _found(spark, sf_dir, paraphrases=True):
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/eval_items.parquet"), paraphrases=paraphrases)


def p7_found(spark, sf_dir):
    return _found(spark, sf_dir, paraphrases=False).filter("kind = 'verbatim'").select("doc_id", "item_id").distinct()


def p7_items(spark, sf_dir):
    """How often each item leaked, verbatim or as a paraphrase."""
    return _found(spark, sf_dir).groupBy("item_id", "kind").agg(F.count_distinct("doc_id").alias("documents"))


_WORDS = "regexp_extract_all(lower(coalesce({}, '')), '[\\p{{L}}\\p{{N}}]+')"
QUERIES = {"p7_found": p7_found, "p7_items": p7_items}
SQL = {
    "p7_found": f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
e AS (SELECT item_id, {_WORDS.format("question")} AS w FROM eval_items UNION ALL SELECT item_id, {_WORDS.format("answer")} FROM eval_items),
dg AS (SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d WHERE len(w) >= 12)),
eg AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)""",
}
