"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import functions as F

from brookloom.llm.splitting import oversized, pieces
from brookloom.llm.texts import SOLID_JAVA, records


def p5_found(spark, sf_dir):
    """Records that the splitter cuts because they exceed a limit."""
    return oversized(records(spark, sf_dir))


def p5_pieces(spark, sf_dir):
    """The pieces of the oversized records by offsets."""
    return pieces(records(spark, sf_dir), oversized_only=True)


def p5_boundaries(spark, sf_dir):
    """How the cuts fell."""
    return p5_pieces(spark, sf_dir).groupBy("kind", "boundary").agg(F.count(F.lit(1)).alias("n"), F.max("words").alias("most_words"))


_TEXTS = """WITH t AS (
  SELECT 'section' AS kind, id, markdown_content AS text, 300 AS w, 2400 AS c FROM knowledge_sections
  UNION ALL SELECT 'document', id, raw_content, 1500, 12000 FROM knowledge_documents)"""

QUERIES = {"p5_found": p5_found, "p5_pieces": p5_pieces, "p5_boundaries": p5_boundaries}
SQL = {
    "p5_found": _TEXTS + f" SELECT DISTINCT kind, id FROM t WHERE length(text) > c OR len(regexp_extract_all(text, '{SOLID_JAVA}')) > w",
}
