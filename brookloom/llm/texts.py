"""Shared pieces: word rules and the two knowledge-base text columns as one table of records."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Unicode white space (the White_Space property), as a character class body.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A run that is not white space: the words of the size rules.
SOLID = re.compile(f"[^{SPACE}]+")
#: A run of letters and digits of any script: the words of the likeness rules.
ALNUM = re.compile(r"[^\W_]+")

SOLID_JAVA = r"[^\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, id, text) of knowledge_sections.markdown_content and knowledge_documents.raw_content. Repeated rows are kept here."""
    s = spark.read.parquet(f"{sf_dir}/knowledge_sections.parquet").select(F.lit("section").alias("kind"), "id", F.col("markdown_content").alias("text"))
    d = spark.read.parquet(f"{sf_dir}/knowledge_documents.parquet").select(F.lit("document").alias("kind"), "id", F.col("raw_content").alias("text"))
    return s.unionAll(d)


def spread(df: DataFrame) -> DataFrame:
    """Few input files mean few tasks; a heavy Python step then runs on the cluster's default parallelism instead. A no-op when the scan is wide already."""
    sc = df.sparkSession.sparkContext
    want = sc.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)
