"""Queries of the sentence gate and of the source check. Sequential rules on text: no SQL; tests hold them against written cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from brookloom.functions import checks, cuts, gate
from brookloom.session import table


def _sections(spark, sf_dir):
    """Section texts with the whole text of their document."""
    s = table(spark, sf_dir, "knowledge_sections").dropDuplicates(["id"]).select("id", "document_id", "markdown_content")
    d = table(spark, sf_dir, "knowledge_documents").groupBy(F.col("id").alias("document_id")).agg(F.max_by("raw_content", "updated_at").alias("raw_content"))
    return s.join(d, "document_id", "left")


def _gated(spark, sf_dir):
    return gate.gated(_sections(spark, sf_dir), "id", "markdown_content", "raw_content")


def gate_released(spark, sf_dir):
    """Sentences of each section that pass the gate with the document as their source, and those withheld."""
    return _gated(spark, sf_dir).groupBy("id").agg(F.count_if(F.col("reason") == "").alias("released"), F.count_if(F.col("reason") != "").alias("withheld"))


def gate_reasons(spark, sf_dir):
    return _gated(spark, sf_dir).filter("reason <> ''").groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("token").alias("tokens"))


def number_words(spark, sf_dir):
    """Number words in documents, by value."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = cuts.exploded(d, "doc_id", "text", gate.number_words, "start int, end int, value double, claim boolean")
    return found.groupBy(F.round("value", 6).alias("value"), "claim").agg(F.count(F.lit(1)).alias("n"))


def _grounded(spark, sf_dir):
    return checks.grounded_sentences(_sections(spark, sf_dir).sortWithinPartitions("document_id"), "id", "markdown_content", "raw_content")


def ground_verdicts(spark, sf_dir):
    """Section sentences against their document, by verdict."""
    return _grounded(spark, sf_dir).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("overlap"), 3).alias("overlap"))


def ground_reasons(spark, sf_dir):
    return _grounded(spark, sf_dir).select("verdict", F.explode("reasons").alias("reason")).groupBy("verdict", "reason").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (gate_released, gate_reasons, number_words, ground_verdicts, ground_reasons)}
SQL: dict = {}
