"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import functions as F

from brookloom.llm import duplicates
from brookloom.llm.texts import records


def p2_found(spark, sf_dir):
    return duplicates.record_pairs(records(spark, sf_dir))


def p2_groups(spark, sf_dir):
    """One row for each record: its group and the number of other texts it is alike to."""
    return duplicates.groups(records(spark, sf_dir))


def p2_strict(spark, sf_dir):
    """Pairs of different texts on five-word shingles with a resemblance of 0.8 or more, by class representatives."""
    members, pairs = duplicates.class_pairs(records(spark, sf_dir), duplicates.Likeness())
    names = members.groupBy("class").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    a = names.select(F.col("class").alias("a"), F.col("id").alias("id_a"), F.col("n").alias("copies_a"))
    b = names.select(F.col("class").alias("b"), F.col("id").alias("id_b"), F.col("n").alias("copies_b"))
    return pairs.join(a, "a").join(b, "b").select("id_a", "id_b", "copies_a", "copies_b", "common", "total")


_SETS = """
WITH r AS (
  SELECT 'section' AS kind, id, max(markdown_content) AS text FROM knowledge_sections WHERE markdown_content IS NOT NULL GROUP BY id
  UNION ALL SELECT 'document', id, max(raw_content) FROM knowledge_documents WHERE raw_content IS NOT NULL GROUP BY id
), w AS (SELECT kind, id, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda x: lower(x)) AS w FROM r),
s AS (
  SELECT DISTINCT kind, id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT kind, id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 20)
), n AS (SELECT kind, id, count(*) AS n FROM s GROUP BY kind, id),
c AS (SELECT a.kind, a.id AS id_a, b.id AS id_b, count(*) AS c FROM s a JOIN s b ON a.kind = b.kind AND a.g = b.g AND a.id < b.id GROUP BY 1, 2, 3)
SELECT c.kind, id_a, id_b FROM c JOIN n x ON x.kind = c.kind AND x.id = id_a JOIN n y ON y.kind = c.kind AND y.id = id_b
WHERE 5 * c >= 3 * (x.n + y.n - c)"""

QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups, "p2_strict": p2_strict}
SQL = {"p2_found": _SETS}
