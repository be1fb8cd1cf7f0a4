"""Mixing sources to target weights.

Method: the documents of a source, shuffled by a hash, lie end to end on a tape of tokens that is cut into blocks of equal length.
The mix is a row of slots, one block long each. Slot i takes the point frac(i x golden ratio), computed exactly in 64-bit integers;
the cumulative weights map the point to a source, so that every stretch of slots holds the sources in their shares. The slots of a
source are ranked; rank r takes block r mod n in pass r div n, and stays empty once the passes exceed the source's limit.

Scale: slot ranks and tape positions are two-level prefix sums (in chunks, then over chunk totals), so no source is ever gathered
in one task, however large; slots meet blocks in an equi-join on (source, block). The targets are configuration and are checked
against MOST_TARGETS; everything else stays distributed.

Defined cases: documents with null source, or one without target, take no part; null or blank texts have no tokens and are never
placed; a source without documents has capacity 0; a null weight or limit is 0; weights are used in proportion to their sum for
the schedule and as they are for ``short``; repeated rows of a doc_id are documents of their own unless ``distinct`` is set.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brookloom.llm.texts import SOLID_JAVA
from brookloom.session import staged

MOST_TARGETS = 100_000
CHUNK = 1 << 16
#: Slots by which a source's number may miss its share, for each doubling of the row of slots.
DISCREPANCY = 2
GOLDEN = np.uint64(0x9E3779B97F4A7C15)  # 2**64 / golden ratio


@lru_cache(maxsize=4)
def _encoder(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("tokens", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_count(text: str, vocabulary: str | None = None) -> Column:
    """Tokens of a text column: words (runs without white space) on the JVM, or those of a public byte-BPE vocabulary file."""
    if vocabulary is None:
        return F.coalesce(F.regexp_count(F.col(text), F.lit(SOLID_JAVA)), F.lit(0)).cast("bigint")

    @F.pandas_udf("bigint")
    def count(s: pd.Series) -> pd.Series:
        e = _encoder(vocabulary)
        return pd.Series([len(x) for x in e.encode_ordinary_batch([t or "" for t in s], num_threads=1)], index=s.index)

    return count(F.col(text))


def sized(docs: DataFrame, targets: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, source, tokens) of the documents whose source has a target."""
    rows = docs.select("doc_id", "source", token_count("text", vocabulary).alias("tokens"))
    return rows.join(F.broadcast(_checked(targets).select("source")), "source", "left_semi")


def _checked(targets: DataFrame) -> DataFrame:
    """The targets, once their number is known to be small enough to broadcast."""
    n = targets.limit(MOST_TARGETS + 1).count()
    if n > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    return targets


def totals(sizes: DataFrame, targets: DataFrame, block: int) -> DataFrame:
    """One row for each target: own tokens, capacity, wanted tokens and blocks."""
    own = sizes.groupBy("source").agg(F.sum("tokens").alias("own"), F.count(F.lit(1)).alias("docs"))
    rows = targets.select("source", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("max_repeats", F.lit(0)).cast("bigint").alias("max_repeats"))
    rows = rows.join(own, "source", "left").fillna(0, ["own", "docs"])
    rows = rows.collect()  # a row for each target, whose number is checked
    total = sum(r["own"] for r in rows)
    report = [(*r, total) for r in map(tuple, rows)]
    return targets.sparkSession.createDataFrame(report, "source string, weight double, max_repeats bigint, own bigint, docs bigint, total bigint").select(
        "*",
        (F.col("own") * F.col("max_repeats")).alias("capacity"),
        (F.col("weight") * F.col("total")).alias("wanted"),
        F.ceil(F.col("own") / F.lit(block)).cast("bigint").alias("blocks"),
    )


def _sources_of(first: int, n: int, bounds: np.ndarray) -> np.ndarray:
    """Indexes of the sources of slots first .. first + n - 1."""
    points = (np.arange(first + 1, first + n + 1, dtype=np.uint64) * GOLDEN).astype(np.float64) / 2.0**64
    return np.minimum(np.searchsorted(bounds, points, side="right"), len(bounds) - 1)


def schedule(report: DataFrame, block: int) -> DataFrame:
    """(slot, source, rank): the source of every slot and the slot's rank among those of its source."""
    spark = report.sparkSession
    rows = report.select("source", "weight", "total").filter("weight > 0").orderBy("source").collect()  # configuration, checked above
    if not rows or not rows[0]["total"]:
        return spark.createDataFrame([], "slot bigint, source string, rank bigint")
    names = [r["source"] for r in rows]
    bounds = np.cumsum([r["weight"] for r in rows])
    bounds /= bounds[-1]
    slots = -(-rows[0]["total"] // block)
    chunks = spark.range(0, -(-slots // CHUNK), 1, min(spark.sparkContext.defaultParallelism * 4, -(-slots // CHUNK)))

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c in b["id"]:
                n = np.bincount(_sources_of(c * CHUNK, min(CHUNK, slots - c * CHUNK), bounds), minlength=len(names))
                yield pd.DataFrame({"chunk": c, "source": names, "n": n})

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c in b["id"]:
                s = _sources_of(c * CHUNK, min(CHUNK, slots - c * CHUNK), bounds)
                local = pd.Series(s).groupby(s).cumcount()
                yield pd.DataFrame({"chunk": c, "slot": np.arange(len(s)) + c * CHUNK, "source": np.array(names, dtype=object)[s], "local": local})

    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunks.mapInPandas(counts, "chunk bigint, source string, n bigint").select("chunk", "source", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return chunks.mapInPandas(placed, "chunk bigint, slot bigint, source string, local bigint").join(offsets, ["chunk", "source"]).select("slot", "source", (F.col("offset") + F.col("local")).alias("rank"))


def tape(sizes: DataFrame, bucket_docs: int = 50_000, seed: int = 7) -> DataFrame:
    """(doc_id, source, tokens, start): where each document lies on its source's tape. Order: by hash, then doc_id."""
    buckets = max(1, -(-sizes.count() // bucket_docs))
    rows = sizes.filter("tokens > 0").withColumn("h", F.xxhash64("doc_id", F.lit(seed)).bitwiseAND(F.lit((1 << 63) - 1)))
    rows = rows.withColumn("bucket", F.expr(f"h div {((1 << 63) - 1) // buckets + 1}"))
    below = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("source", "bucket").agg(F.sum("tokens").alias("n")).select("source", "bucket", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("inner", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
        .join(base, ["source", "bucket"])
        .select("doc_id", "source", "tokens", (F.col("base") + F.col("inner")).alias("start"))
    )


def mix(docs: DataFrame, targets: DataFrame, block: int = 512, vocabulary: str | None = None) -> DataFrame:
    """The mix: (slot, source, pass, doc_id, from_token, to_token), in the order of slot and place in the block."""
    sizes = staged(sized(docs, targets, vocabulary), "mix-sizes")
    report = totals(sizes, targets, block)
    slots = schedule(report, block).join(F.broadcast(report.select("source", "blocks", "max_repeats")), "source").filter("blocks > 0")
    slots = slots.withColumn("pass", F.expr("rank div blocks")).filter("pass < max_repeats").select("slot", "source", "pass", F.expr("(rank + pass) % blocks").alias("block"))
    b = F.lit(block)
    laid = tape(sizes).withColumn("end", F.col("start") + F.col("tokens"))
    laid = laid.withColumn("block", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(end - 1) div {block}"))))
    part = laid.select(
        "source",
        "block",
        "doc_id",
        F.greatest(F.lit(0), F.col("block") * b - F.col("start")).alias("from_token"),
        (F.least(F.col("end"), (F.col("block") + 1) * b) - F.col("start")).alias("to_token"),
    )
    return slots.join(part, ["source", "block"]).select("slot", "source", "pass", "doc_id", "from_token", "to_token")


def filled(report: DataFrame, block: int) -> DataFrame:
    """Adds to the targets: slots that the schedule gives a source, those that its blocks fill, and whether it runs short.

    A source may run short if slots stay empty, or nearly: the points of the schedule miss a source's share by a few slots (DISCREPANCY for
    each doubling of the row). For those sources the exact sizes decide.
    """
    slots = schedule(report, block).groupBy("source").agg(F.count(F.lit(1)).alias("slots"))
    out = report.join(slots, "source", "left").withColumn("slots", F.coalesce("slots", F.lit(0)))
    near = F.lit(DISCREPANCY) * (2 + F.log2(2 + F.col("total") / block))
    weights = Window.partitionBy()  # a row for each target
    likely = (F.col("slots") * F.sum("weight").over(weights) + near) * block >= F.col("capacity")
    return out.withColumn("filled", F.least(F.col("slots"), F.col("blocks") * F.col("max_repeats"))).withColumn("short", likely & (F.col("capacity") < F.col("wanted")))


def shortage(docs: DataFrame, targets: DataFrame, block: int = 512, vocabulary: str | None = None) -> DataFrame:
    """(source): the sources whose documents, used as often as allowed, can't fill their slots."""
    return filled(totals(sized(docs, targets, vocabulary), targets, block), block).filter("short").select("source")


def shares(docs: DataFrame, targets: DataFrame, block: int = 512, vocabulary: str | None = None) -> DataFrame:
    """Target and actual share of every source, and whether its documents suffice."""
    out = filled(totals(sized(docs, targets, vocabulary), targets, block), block)
    # full passes hold all tokens of the source; pass p, the last, begins at block p, and the tail block may be among its own
    some = F.col("blocks") > 0
    out = out.withColumn("passes", F.when(some, F.expr("filled div blocks")).otherwise(0)).withColumn("rest", F.when(some, F.expr("filled % blocks")).otherwise(0))
    tail = some & (F.expr("pmod(blocks - 1 - passes, blocks)") < F.col("rest"))
    placed = F.col("passes") * F.col("own") + F.col("rest") * block - F.when(tail, F.col("blocks") * block - F.col("own")).otherwise(0)
    out = out.withColumn("placed", placed)
    whole = out.agg(F.sum("placed").alias("all_placed"))
    return out.crossJoin(whole).select(  # one row
        "source", "weight", "max_repeats", "docs", "own", "capacity", "wanted", "slots", "filled", "placed",
        F.when(F.col("all_placed") > 0, F.col("placed") / F.col("all_placed")).otherwise(0.0).alias("share"), "short",
    )
