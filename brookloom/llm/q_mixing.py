"""Queries of problem 8."""

from __future__ import annotations

from pyspark.sql import functions as F

from brookloom.llm import mixing


def _in(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"), spark.read.parquet(f"{sf_dir}/mix_targets.parquet")


def p8_found(spark, sf_dir):
    """Sources whose slots the schedule can't fill: their words, used as often as allowed, stay below their share of the total."""
    return mixing.shortage(*_in(spark, sf_dir))


def p8_shares(spark, sf_dir):
    """The shares really reached."""
    return mixing.shares(*_in(spark, sf_dir))


def p8_mix(spark, sf_dir):
    """The mix itself, by slot."""
    return mixing.mix(*_in(spark, sf_dir))


def p8_reached(spark, sf_dir):
    """The shares counted again from the rows of the mix."""
    return mixing.mix(*_in(spark, sf_dir)).groupBy("source").agg(F.sum(F.col("to_token") - F.col("from_token")).alias("placed"), F.max("pass").alias("last_pass"))


#: A public vocabulary file; any other path does as well.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def p8_token_shares(spark, sf_dir):
    """The shares by tokens of a public tokenizer instead of words."""
    return mixing.shares(*_in(spark, sf_dir), vocabulary=VOCABULARY)


_SLOTS = f"""
WITH w AS (SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '{mixing.SOLID_JAVA}'))) AS own, count(*) AS docs FROM documents
           WHERE source IN (SELECT source FROM mix_targets) GROUP BY source),
m AS (SELECT source, weight, max_repeats::BIGINT AS max_repeats, coalesce(own, 0)::BIGINT AS own, coalesce(docs, 0) AS docs, sum(weight) OVER (ORDER BY source) / sum(weight) OVER () AS upto FROM mix_targets LEFT JOIN w USING (source)),
t AS (SELECT *, (sum(own) OVER ())::BIGINT AS total, (own + 511) // 512 AS blocks FROM m),
p AS (SELECT i, ((i + 1)::HUGEINT * 11400714819323198485 % 18446744073709551616)::DOUBLE / 18446744073709551616.0 AS point FROM (SELECT unnest(range((max(total) + 511) // 512)) AS i FROM t)),
s AS (SELECT i, (SELECT min(source) FROM t WHERE upto > point AND weight > 0) AS source FROM p),
c AS (SELECT t.*, count(s.i) AS slots FROM t LEFT JOIN s USING (source) GROUP BY ALL),
f AS (SELECT *, least(slots, blocks * max_repeats) AS filled FROM c),
r AS (SELECT *, CASE WHEN blocks > 0 THEN filled // blocks ELSE 0 END AS passes, CASE WHEN blocks > 0 THEN filled % blocks ELSE 0 END AS rest FROM f),
g AS (SELECT *, passes * own + rest * 512 - CASE WHEN blocks > 0 AND ((blocks - 1 - passes) % blocks + blocks) % blocks < rest THEN blocks * 512 - own ELSE 0 END AS placed FROM r)
"""

QUERIES = {"p8_found": p8_found, "p8_shares": p8_shares, "p8_mix": p8_mix, "p8_reached": p8_reached, "p8_token_shares": p8_token_shares}
SQL = {
    "p8_shares": _SLOTS + """SELECT source, weight, max_repeats, docs, own, own * max_repeats AS capacity, weight * total AS wanted, slots, filled, placed,
 placed / (sum(placed) OVER ())::DOUBLE AS share, own * max_repeats < weight * total AS short FROM g""",
    "p8_reached": _SLOTS + "SELECT source, placed, CASE WHEN rest > 0 THEN passes ELSE passes - 1 END AS last_pass FROM g WHERE placed > 0",
    "p8_found": f"""
WITH w AS (SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '{mixing.SOLID_JAVA}'))) AS own FROM documents
           WHERE source IN (SELECT source FROM mix_targets) GROUP BY source),
t AS (SELECT sum(own) AS total FROM w)
SELECT m.source FROM mix_targets m LEFT JOIN w USING (source), t WHERE coalesce(own, 0) * max_repeats < weight * total""",
}
