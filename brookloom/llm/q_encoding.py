"""Queries of problem 9."""

from __future__ import annotations

from pyspark.sql import functions as F

from brookloom.llm.encoding import garbled


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def p9_found(spark, sf_dir):
    return garbled(_documents(spark, sf_dir)).select("doc_id").distinct()


def p9_restored(spark, sf_dir):
    """The affected documents with the restored text; ``whole`` says that nothing was lost."""
    return garbled(_documents(spark, sf_dir)).withColumn("whole", F.col("lost") == 0)


QUERIES = {"p9_found": p9_found, "p9_restored": p9_restored}
SQL: dict = {}
