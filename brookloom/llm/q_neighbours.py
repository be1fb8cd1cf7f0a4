"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import functions as F

from brookloom.llm.neighbours import neighbours


def _near(spark, sf_dir):
    return neighbours(spark.read.parquet(f"{sf_dir}/knowledge_sections.parquet").select("id", "embedding"))


def p6_found(spark, sf_dir):
    """Pairs with a similarity of 0.9 or more of which one is among the other's five most similar."""
    near = _near(spark, sf_dir).filter("similarity >= 0.9")
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def p6_nearest(spark, sf_dir):
    """The five most similar sections of every section."""
    return _near(spark, sf_dir).select("id", "other", F.round(F.col("similarity").cast("double"), 6).alias("similarity"), "place")


QUERIES = {"p6_found": p6_found, "p6_nearest": p6_nearest}
SQL = {
    # by comparison of all with all
    "p6_found": """WITH s AS (SELECT DISTINCT ON (id) id, embedding::DOUBLE[] AS e FROM knowledge_sections WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
u AS (SELECT id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM s),
p AS (SELECT a.id, b.id AS other, list_dot_product(a.e, b.e) AS sim FROM u a, u b WHERE a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) AS n FROM p)
SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM r WHERE n <= 5 AND sim >= 0.9""",
}
