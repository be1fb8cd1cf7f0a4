"""Receipts of answers: what was cited, with hashes, under one root; and checking them against files later.

A receipt commits to the citations of an answer: each is a leaf made of its number, label, the hashes of its excerpt and its file and
the span; neither the text nor the proof is part of it. The root over an answer's leaves changes if any of them does.

Defined cases: null excerpts count as empty; an answer without citations has no receipt; a file that no longer exists, a text that no
longer stands at its span, and a root that doesn't match are told apart, the first of these that applies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookloom.operators.ledger import leaf_hash, merkle_roots


def sha(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def citation_leaf(n: Column, label: Column, excerpt_sha: Column, file_sha: Column, start: Column, end: Column) -> Column:
    """The leaf of a citation: canonical JSON (keys in order, no blanks) under the leaf hash."""
    return leaf_hash(F.to_json(F.struct(end.alias("end"), excerpt_sha.alias("excerpt"), file_sha.alias("file"), label.alias("label"), n.alias("n"), start.alias("start"))))


def receipts(citations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(receipts (id, leaves, root), lines (id, n, label, excerpt_sha, file_sha, start, end)) of citations (id, n, label, excerpt, file, start, end),
    where file is the whole text of the cited file."""
    lines = citations.select("id", "n", "label", sha(F.col("excerpt")).alias("excerpt_sha"), sha(F.col("file")).alias("file_sha"), "start", "end")
    return merkle_roots(_leaves(lines), "id", "n", "leaf"), lines


def _leaves(lines: DataFrame) -> DataFrame:
    return lines.select("id", "n", citation_leaf(F.col("n"), F.col("label"), F.col("excerpt_sha"), F.col("file_sha"), F.col("start"), F.col("end")).alias("leaf"))


def verified(heads: DataFrame, lines: DataFrame, files: DataFrame) -> DataFrame:
    """(id, n, status) of every line against the files there are now (text): ok, file_changed (no file has its hash), text_changed (the excerpt isn't
    at its span) or root_mismatch. Files are found by hash in an equi-join."""
    now = files.select(sha(F.col("text")).alias("file_sha"), "text").dropDuplicates(["file_sha"])
    there = lines.join(now, "file_sha", "left")
    span = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    again = merkle_roots(_leaves(lines), "id", "n", "leaf").select("id", F.col("root").alias("_again"))
    roots = heads.select("id", "root").join(again, "id", "left")
    out = there.withColumn("_same", sha(span) == F.col("excerpt_sha")).select("id", "n", F.col("text").isNotNull().alias("_file"), "_same").join(roots, "id", "left")
    status = F.when(~F.col("root").eqNullSafe(F.col("_again")), "root_mismatch").when(~F.col("_file"), "file_changed").when(~F.coalesce("_same", F.lit(False)), "text_changed").otherwise("ok")
    return out.select("id", "n", status.alias("status"))
