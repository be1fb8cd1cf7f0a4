"""The event log: idempotent append, latest-per-key view, staleness, throttling, breaker, rate limits. Batch forms and streams.

The stream of a view and its batch form give the same rows; tests hold them against each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brookloom.operators.sequences import folded


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def deduplicated(log: DataFrame) -> DataFrame:
    """The first delivery (least seq) of each (source, dedupe)."""
    rest = [c for c in log.columns if c not in ("source", "dedupe")]
    return log.groupBy("source", "dedupe").agg(F.min_by(F.struct(*rest), "seq").alias("r")).select("source", "dedupe", "r.*")


def append(log: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to append, duplicates): new events whose (source, dedupe) the log doesn't hold yet, each once; the others."""
    first = deduplicated(new)
    fresh = first.join(log.select("source", "dedupe"), ["source", "dedupe"], "left_anti")
    dup = new.join(fresh.select("seq"), "seq", "left_anti")
    return fresh, dup


def latest(samples: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The newest row of each key by event time; later arrivals win ties, late rows never win. Aggregated map-side, no window."""
    rest = [c for c in samples.columns if c not in keys]
    return samples.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("r")).select(*keys, "r.*")


def feed_samples(log: DataFrame) -> DataFrame:
    """Samples from the bodies of public feed.sample events; broken JSON and missing values are left out."""
    body = F.from_json("body", "series string, value double, unit string, quality string")
    s = log.filter((F.col("type") == "feed.sample") & (F.col("class") == "public")).withColumn("b", body)
    return s.filter(F.col("b.series").isNotNull() & F.col("b.value").isNotNull()).select("seq", "source", "b.series", "b.value", "b.unit", F.coalesce("b.quality", F.lit("good")).alias("quality"), "happened", "recorded")


def sample_problems(log: DataFrame) -> DataFrame:
    """The side output of feed_samples: why a body gives no sample."""
    body = F.from_json("body", "series string, value double, unit string, quality string, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    s = log.filter((F.col("type") == "feed.sample") & (F.col("class") == "public")).withColumn("b", body)
    why = F.when(F.col("body").isNull(), "no body").when(F.col("b._corrupt_record").isNotNull(), "broken json").when(F.col("b.series").isNull(), "no series").when(F.col("b.value").isNull(), "no value")
    return s.select("seq", why.alias("problem")).filter("problem is not null")


def state_changes(rows: DataFrame, keys: list[str], order: list[str], state: str) -> DataFrame:
    """Rows whose state differs from the one before within the key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("before", F.lag(state).over(w)).filter(F.col("before").isNull() | (F.col("before") != F.col(state)))


def silences(rows: DataFrame, keys: list[str], at: str, longer_s: int) -> DataFrame:
    """Gaps after a row in which nothing was heard for longer than the limit: from when to when the key counts as stale."""
    w = Window.partitionBy(*keys).orderBy(at)
    out = rows.select(*keys, micros(at).alias(at)).withColumn("next", F.lead(at).over(w))
    return out.filter(F.col("next") - F.col(at) > longer_s * 1_000_000).select(*keys, (F.col(at) + longer_s * 1_000_000).alias("stale_from"), F.col("next").alias("stale_to"))


def error_rates(rows: DataFrame, at: str, bad: Column, window_s: int = 60, least: int = 20, bucket: str = "bucket") -> DataFrame:
    """Share of bad rows in the ``window_s`` before each row, null below ``least`` rows. Rows are taken in buckets of four windows, each with
    the tail of the bucket before, so no single task sees the whole log. A row enters at its time and leaves after the window; running
    sums over both make the work linear, where a sliding frame would go through each window again for every row."""
    size = window_s * 1_000_000
    own = rows.withColumn("_us", micros(at)).withColumn("_bad", bad.cast("int")).withColumn(bucket, F.expr(f"_us div {4 * size}")).withColumn("_tail", F.lit(False))
    tail = own.filter(F.pmod("_us", F.lit(4 * size)) >= 3 * size).withColumn(bucket, F.col(bucket) + 1).withColumn("_tail", F.lit(True))
    moves = F.array(F.struct(F.col("_us").alias("t"), F.lit(1).alias("d")), F.struct((F.col("_us") + size + 1).alias("t"), F.lit(-1).alias("d")))
    both = own.unionByName(tail).withColumn("_m", F.explode(moves))
    w = Window.partitionBy(bucket).orderBy("_m.t").rangeBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("events", F.sum("_m.d").over(w)).withColumn("failures", F.sum(F.col("_bad") * F.col("_m.d")).over(w)).filter("_m.d = 1 and not _tail")
    return out.withColumn("rate", F.when(F.col("events") >= least, F.col("failures") / F.col("events"))).drop("_us", "_bad", "_tail", "_m", bucket)


def breaker_levels(rates: DataFrame, order: str, thresholds: tuple[float, ...] = (0.3, 0.5, 0.8)) -> DataFrame:
    """The level of each row by its rate, and the hours' levels that only rise. Levels per hour first, so the running maximum is over hours."""
    level = F.lit(0)
    for i, t in enumerate(thresholds):
        level = F.when(F.col("rate") >= t, i + 1).otherwise(level)
    hours = rates.withColumn("level", level).groupBy(F.date_trunc("hour", F.col(order)).alias("hour")).agg(F.max("level").alias("level"))
    return hours.withColumn("held", F.max("level").over(Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)))  # a row for each hour


def throttled(rows: DataFrame, key: str, at_us: str, min_gap_us: int) -> DataFrame:
    """(key, at): rows kept when each must come at least ``min_gap_us`` after the last one kept. Greedy, by key, in the order of time."""
    return folded(rows, key, at_us, lambda: None, lambda last, r: (r[0], r) if last is None or r[0] - last >= min_gap_us else (last, None), [], f"{at_us} bigint")


def rate_limited(rows: DataFrame, key: str, at_us: str, limit: int, window_us: int) -> DataFrame:
    """(key, at, place, allowed): fixed windows that begin at a key's first hit, each allowing ``limit`` hits."""

    def judge(state: tuple, r: tuple) -> tuple:
        start, n = state
        start, n = (r[0], 1) if start is None or r[0] - start >= window_us else (start, n + 1)
        return (start, n), (r[0], n, n <= limit)

    return folded(rows, key, at_us, lambda: (None, 0), judge, [], f"{at_us} bigint, place int, allowed boolean")


def seq_gaps(log: DataFrame, size: int = 100_000) -> DataFrame:
    """(after, missing): holes in seq. Buckets of seq find inner holes in parallel; the joints between buckets are checked on their ends."""
    b = log.select("seq", F.expr(f"seq div {size}").alias("b"))
    inner = b.withColumn("prev", F.lag("seq").over(Window.partitionBy("b").orderBy("seq"))).filter(F.col("seq") > F.col("prev") + 1).select(F.col("prev").alias("after"), (F.col("seq") - F.col("prev") - 1).alias("missing"))
    ends = b.groupBy("b").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    joints = ends.withColumn("prev", F.lag("hi").over(Window.orderBy("b"))).filter(F.col("lo") > F.col("prev") + 1).select(F.col("prev").alias("after"), (F.col("lo") - F.col("prev") - 1).alias("missing"))
    return inner.unionByName(joints)


# --- streams ----------------------------------------------------------------------------------------------------------------------


def stream_deduplicated(stream: DataFrame, delay: str = "12 hours") -> DataFrame:
    """The same as ``deduplicated`` on a stream in the order of arrival, for repeats that come within ``delay``, after which state is dropped;
    ``append_to`` knows no such limit."""
    return stream.withColumn("recorded", F.col("recorded").cast("timestamp")).withWatermark("recorded", delay).dropDuplicatesWithinWatermark(["source", "dedupe"])


def append_to(path: str):
    """A foreachBatch function that appends to the log under ``path`` the events of a micro-batch whose (source, dedupe) it doesn't hold yet,
    however long ago they came. A replayed batch writes the same again."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = deduplicated(batch)
        if number > 0:
            before = spark.read.schema(fresh.schema).parquet(*[f"{path}/b{n}" for n in range(number)])
            fresh = fresh.join(before.select("source", "dedupe"), ["source", "dedupe"], "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/b{number}")

    return merge


def upsert_latest(path: str, keys: list[str], at: str, tie: str):
    """A foreachBatch function that merges a micro-batch into the latest-per-key table under ``path``; versions are kept, a replayed batch changes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = latest(batch, keys, at, tie)
        if number > 0:
            new = latest(new.unionByName(spark.read.parquet(f"{path}/v{number - 1}").select(new.columns)), keys, at, tie)
        new.write.mode("overwrite").parquet(f"{path}/v{number}")

    return merge


def topic_matches(filter_text: str, topic: Column) -> Column:
    """Subscription filters: + stands for one level, a final # for the rest; topics that begin with $ need a filter that does."""
    import re

    parts = filter_text.split("/")
    rx = []
    for i, p in enumerate(parts):
        if p == "#" and i == len(parts) - 1:
            rx.append(".*" if i == 0 else "(/.*)?")
        else:
            rx.append(("/" if i else "") + ("[^/]*" if p == "+" else re.escape(p)))
    hit = topic.rlike("^" + "".join(rx) + "$")
    return hit & ~topic.startswith("$") if filter_text[:1] in "+#" else hit
