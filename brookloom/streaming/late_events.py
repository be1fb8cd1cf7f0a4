"""Late and out-of-order events: per-period counts by event time, closed by per-source low watermarks, corrected until a cut-off.

Time of arrival (``recorded``) is the clock of the log. A source's low watermark is its latest arrival less its bound. For a period
that ends at *e*, a source passes when its watermark first exceeds *e*: that arrival is its punctuation, from which on nothing of
the source is on time. A source that stays silent for ``idle_timeout`` beyond its bound is idle and no longer holds the period open. The
period closes when every source has passed or is idle. Its first figure is what each source had sent before its own
punctuation. What comes with or after it is diverted: it corrects the figure until ``e + cutoff`` and is only reported after that.

``source_figures`` settles each source by its own punctuation, and ``source_diverted`` is its side output; ``period_figures`` counts for the
first figure whatever came before the period as a whole closed, and ``diverted`` is its side output.

Defined cases: a row without ``happened``, ``recorded`` or ``type`` belongs to no period and is left out (``rejected``); a row
without ``source`` or ``dedupe`` is an event of its own, named by ``seq``; repeated deliveries count once, at the earliest
``recorded`` (ties: lowest ``seq``); an empty log gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MICROS = 1_000_000


def _micros(col: str) -> Column:
    return F.unix_micros(F.col(col).cast("timestamp"))


def usable(log: DataFrame) -> Column:
    return F.col("happened").isNotNull() & F.col("recorded").isNotNull() & F.col("type").isNotNull()


def rejected(log: DataFrame) -> DataFrame:
    return log.filter(~usable(log))


def distinct_events(log: DataFrame) -> DataFrame:
    """(source, type, happened_us, recorded_us): one row for each event. One shuffle, with map-side combine, on a key without skew."""
    lone = F.col("source").isNull() | F.col("dedupe").isNull()
    first = F.min_by(F.struct("type", "happened_us"), F.struct("recorded_us", "seq"))
    return (
        log.filter(usable(log))
        .select(
            "source",
            F.when(~lone, F.col("dedupe")).alias("mark"),
            F.when(lone, F.col("seq")).alias("alone"),
            "type",
            "seq",
            _micros("happened").alias("happened_us"),
            _micros("recorded").alias("recorded_us"),
        )
        .groupBy("source", "mark", "alone")
        .agg(first.alias("e"), F.min("recorded_us").alias("recorded_us"))
        .select("source", "e.type", "e.happened_us", "recorded_us")
    )


def with_period(events: DataFrame, period_s: int) -> DataFrame:
    size = period_s * MICROS
    start = F.col("happened_us") - F.pmod(F.col("happened_us"), F.lit(size))
    return events.withColumn("start_us", start).withColumn("end_us", start + F.lit(size))


def source_bound(bound_s: int, bounds: dict[str, int] | None) -> Column:
    """Microseconds a source may lag behind; ``bounds`` holds exceptions by source."""
    default = F.lit(bound_s * MICROS).cast("bigint")
    if not bounds:
        return default
    pairs = [x for source, s in bounds.items() for x in (F.lit(source), F.lit(s * MICROS).cast("bigint"))]
    return F.coalesce(F.create_map(*pairs)[F.col("source")], default)


def passes(log: DataFrame, period_s: int, bound_s: int, idle_timeout_s: int, bounds: dict[str, int] | None = None) -> DataFrame:
    """(end_us, source, passed_us): the punctuation by which a source passed its bound for a period before the idle time-out.

    Each arrival names the few period ends whose waiting time it falls into, so the work is rows x (idle_timeout / period + 1).
    """
    size, idle = period_s * MICROS, idle_timeout_s * MICROS
    arrived = log.filter(F.col("recorded").isNotNull() & F.col("source").isNotNull()).select("source", _micros("recorded").alias("recorded_us"))
    at = F.col("recorded_us") - source_bound(bound_s, bounds)
    last = at - F.pmod(at, F.lit(size))
    first = F.ceil((at - F.lit(idle)) / F.lit(size)).cast("bigint") * F.lit(size)
    ends = F.when(first <= last, F.sequence(first, last, F.lit(size)))
    return arrived.select("source", "recorded_us", F.explode(ends).alias("end_us")).groupBy("end_us", "source").agg(F.min("recorded_us").alias("passed_us"))


def with_closing(events: DataFrame, log: DataFrame, period_s: int, bound_s: int, idle_timeout_s: int, bounds: dict[str, int] | None = None) -> DataFrame:
    """Adds closed_us, when the event's period closes. The joined side has a row for each period, not for each event."""
    widest = max([bound_s, *(bounds or {}).values()]) * MICROS
    latest = F.col("end_us") + F.lit(widest + idle_timeout_s * MICROS)
    spoken = (
        passes(log, period_s, bound_s, idle_timeout_s, bounds)
        .groupBy("end_us")
        .agg(F.count(F.lit(1)).alias("spoke"), F.max("passed_us").alias("passed_us"))
    )
    known = log.select("source").na.drop().distinct().agg(F.count(F.lit(1)).alias("known"))  # one row
    closed = F.when(F.col("spoke") >= F.col("known"), F.col("passed_us")).otherwise(latest)
    return events.join(spoken.crossJoin(known), "end_us", "left").withColumn("closed_us", closed).drop("spoke", "known", "passed_us")


def punctuations(log: DataFrame, period_s: int, bound_s: int, cutoff_s: int, bounds: dict[str, int] | None = None) -> DataFrame:
    """(source, end_us, passed_us): for every period end that a source's watermark passes with an arrival up to the cut-off, in whole
    periods, beyond it, that arrival.

    Arrivals are reduced to the first one of a source in each stretch of a period's length before anything is ordered. In a longer silence
    the ends further back are left out: what came for them before it is on time, and what comes after it is beyond the cut-off.
    """
    size = period_s * MICROS
    back = -(-cutoff_s // period_s) * size
    arrived = log.filter(F.col("recorded").isNotNull()).select("source", _micros("recorded").alias("recorded_us"))
    above = F.col("recorded_us") - source_bound(bound_s, bounds)  # the watermark after this arrival; it passes the ends below it
    end = above - 1 - F.pmod(above - 1, F.lit(size))
    firsts = arrived.withColumn("end_us", end).groupBy("source", "end_us").agg(F.min("recorded_us").alias("passed_us"))
    before = F.lag("end_us").over(Window.partitionBy("source").orderBy("end_us"))
    since = firsts.withColumn("since_us", F.greatest(before + size, F.col("end_us") - back))
    return since.select("source", "passed_us", F.explode(F.sequence("since_us", "end_us", F.lit(size))).alias("end_us"))


def closings(log: DataFrame, passed: DataFrame, period_s: int, bound_s: int, idle_timeout_s: int, bounds: dict[str, int] | None = None) -> DataFrame:
    """(end_us, closed_us): when the last source passed or, if some had not within the time-out, when that was over."""
    widest = max([bound_s, *(bounds or {}).values()]) * MICROS
    latest = F.col("end_us") + F.lit(widest + idle_timeout_s * MICROS)
    known = log.select("source").distinct().agg(F.count(F.lit(1)).alias("known"))  # one row
    spoken = passed.filter(F.col("passed_us") <= latest).groupBy("end_us").agg(F.count(F.lit(1)).alias("spoke"), F.max("passed_us").alias("last_us"))
    return spoken.crossJoin(known).select("end_us", F.when(F.col("spoke") >= F.col("known"), F.col("last_us")).alias("closed_us"))


def settled(log: DataFrame, passed: DataFrame, period_s: int, cutoff_s: int) -> DataFrame:
    """The events with their period, final (came before the cut-off) and on_time (came, besides, before the punctuation of its source)."""
    events = with_period(distinct_events(log), period_s)
    own = passed.select(F.col("source").alias("by"), F.col("end_us").alias("by_end_us"), "passed_us")
    final = F.col("recorded_us") <= F.col("end_us") + F.lit(cutoff_s * MICROS)
    on_time = F.col("passed_us").isNull() | (F.col("recorded_us") < F.col("passed_us"))
    joined = events.join(own, F.col("source").eqNullSafe(F.col("by")) & (F.col("end_us") == F.col("by_end_us")), "left")
    return joined.withColumn("final", final).withColumn("on_time", final & on_time).drop("by", "by_end_us", "passed_us")


def source_figures(
    log: DataFrame,
    period_s: int = 600,
    bound_s: int = 300,
    idle_timeout_s: int = 1800,
    cutoff_s: int = 12 * 3600,
    bounds: dict[str, int] | None = None,
) -> DataFrame:
    """(type, start_us, end_us, closed_us, first, corrections, final, too_late), one row for each type and period with any event."""
    widest = max([bound_s, *(bounds or {}).values()])
    passed = punctuations(log, period_s, bound_s, max(cutoff_s, widest + idle_timeout_s), bounds)  # closings looks back by the time-out
    final, on_time = F.col("final"), F.col("on_time")
    counted = (
        settled(log, passed, period_s, cutoff_s)
        .groupBy("type", "start_us", "end_us")
        .agg(
            F.count_if(on_time).alias("first"),
            F.count_if(final & ~on_time).alias("corrections"),
            F.count_if(final).alias("final"),
            F.count_if(~final).alias("too_late"),
        )
    )
    closed = closings(log, passed, period_s, bound_s, idle_timeout_s, bounds)
    timed_out = F.col("end_us") + F.lit((widest + idle_timeout_s) * MICROS)
    return counted.join(closed, "end_us", "left").select("type", "start_us", "end_us", F.coalesce("closed_us", timed_out).alias("closed_us"), "first", "corrections", "final", "too_late")


def source_diverted(log: DataFrame, period_s: int = 600, bound_s: int = 300, cutoff_s: int = 12 * 3600, bounds: dict[str, int] | None = None) -> DataFrame:
    """The side output of ``source_figures``: every event that isn't in a first figure, with its lateness and whether it still counts."""
    passed = punctuations(log, period_s, bound_s, cutoff_s, bounds)
    late_us = (F.col("recorded_us") - F.col("end_us")).alias("late_us")
    return settled(log, passed, period_s, cutoff_s).filter(~F.col("on_time")).select("source", "type", "start_us", "happened_us", "recorded_us", late_us, F.col("final").alias("counts"))


def period_figures(
    log: DataFrame,
    period_s: int = 600,
    bound_s: int = 300,
    idle_timeout_s: int = 0,
    cutoff_s: int = 12 * 3600,
    bounds: dict[str, int] | None = None,
) -> DataFrame:
    """The same columns; the first figure is all that came before the period closed."""
    events = with_period(distinct_events(log), period_s)
    final = F.col("recorded_us") <= F.col("end_us") + F.lit(cutoff_s * MICROS)
    first = final & (F.col("recorded_us") <= F.col("closed_us"))
    return (
        with_closing(events, log, period_s, bound_s, idle_timeout_s, bounds)
        .groupBy("type", "start_us", "end_us", "closed_us")
        .agg(
            F.count_if(first).alias("first"),
            F.count_if(final & ~first).alias("corrections"),
            F.count_if(final).alias("final"),
            F.count_if(~final).alias("too_late"),
        )
    )


def diverted(log: DataFrame, period_s: int = 600, bound_s: int = 300, idle_timeout_s: int = 0, cutoff_s: int = 12 * 3600, bounds: dict[str, int] | None = None) -> DataFrame:
    """The side output: every event that came after its period closed, with its lateness and whether it still counts."""
    events = with_period(distinct_events(log), period_s)
    return (
        with_closing(events, log, period_s, bound_s, idle_timeout_s, bounds)
        .filter(F.col("recorded_us") > F.col("closed_us"))
        .select(
            "source",
            "type",
            "start_us",
            "happened_us",
            "recorded_us",
            (F.col("recorded_us") - F.col("end_us")).alias("late_us"),
            (F.col("recorded_us") <= F.col("end_us") + F.lit(cutoff_s * MICROS)).alias("counts"),
        )
    )


_REVISED = "type string, start_us bigint, kind string, figure bigint"


def _revise(size_us: int, bound_us: int, idle_us: int, cutoff_us: int, sources: frozenset[str]):
    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, passed, shown = pickle.loads(state.get[0]) if state.exists else ({}, {}, {})
        end = int(key[0]) + size_us
        for b in () if state.hasTimedOut else batches:
            for mark, kind, source, at in zip(b["mark"].tolist(), b["type"].tolist(), b["source"].tolist(), b["recorded_us"].tolist()):
                if mark is None:  # a punctuation: the source's watermark has passed the end
                    passed[source] = min(at, passed.get(source, at))
                elif mark not in held or at < held[mark][2]:
                    held[mark] = (kind, source, at)
        now = state.getCurrentWatermarkMs() * 1000
        timed_out = end + bound_us + idle_us
        closed = now >= timed_out or bool(sources) and sources <= passed.keys() and now >= max(passed.values())
        out = []
        if closed:
            first, final = Counter(), Counter()
            for kind, source, at in held.values():
                first[kind] += at < passed.get(source, timed_out + 1)
                final[kind] += at <= end + cutoff_us
            for kind in final:
                if kind not in shown:
                    shown[kind] = first[kind]
                    out.append((kind, "first", first[kind]))
                if final[kind] != shown[kind]:
                    shown[kind] = final[kind]
                    out.append((kind, "correction", final[kind]))
            if now >= end + cutoff_us:
                out += [(kind, "final", n) for kind, n in final.items()]
        if now >= end + cutoff_us and closed:
            if state.exists:
                state.remove()
        else:
            state.update((pickle.dumps((held, passed, shown), protocol=5),))
            state.setTimeoutTimestamp(max(now, end + cutoff_us if closed else timed_out) // 1000 + 1)
        yield pd.DataFrame([(k, key[0], *x) for k, *x in out], columns=["type", "start_us", "kind", "figure"])

    return fold


def stream_figures(
    stream: DataFrame, period_s: int = 600, bound_s: int = 300, cutoff_s: int = 12 * 3600, disorder: str = "1 minute", idle_timeout_s: int = 1800, sources: list[str] | None = None
) -> DataFrame:
    """The stream of figures of a log that is read in the order of arrival: first, each correction, final.

    Every arrival is an event of its period and a punctuation for the periods whose waiting time it falls into: those that its source's
    watermark has passed with it. State is held by period until the cut-off: the punctuation of each source and a mark for each event, so
    repeats count once. A period closes when all ``sources`` have passed, or when the arrival clock says that the others are idle; a
    source's events count in the first figure if they came before its own punctuation.
    """
    size, bound, idle = period_s * MICROS, bound_s * MICROS, idle_timeout_s * MICROS
    lone = F.col("source").isNull() | F.col("dedupe").isNull()
    rows = stream.filter(usable(stream)).select(
        "type",
        F.coalesce("source", F.lit("\0")).alias("source"),
        _micros("happened").alias("happened_us"),
        F.col("recorded").cast("timestamp").alias("recorded"),
        _micros("recorded").alias("recorded_us"),
        F.when(lone, F.concat(F.lit("seq "), F.col("seq").cast("string"))).otherwise(F.to_json(F.array("source", "dedupe"))).alias("mark"),
    )
    placed = with_period(rows, period_s).withWatermark("recorded", disorder)
    above = F.col("recorded_us") - bound
    last = above - 1 - F.pmod(above - 1, F.lit(size))  # the latest end that the watermark has passed
    ends = F.sequence(last - (idle // size + 1) * size, last, F.lit(size))
    each = F.concat(F.array(F.struct(F.col("start_us"), F.col("mark"))), F.transform(ends, lambda e: F.struct((e - size).alias("start_us"), F.lit(None).cast("string").alias("mark"))))
    sent = placed.select("type", "source", "recorded_us", "recorded", F.explode(each).alias("x")).select("type", "source", "recorded_us", "recorded", "x.start_us", "x.mark")
    return sent.groupBy("start_us").applyInPandasWithState(_revise(size, bound, idle, cutoff_s * MICROS, frozenset(sources or ())), _REVISED, "held binary", "append", GroupStateTimeout.EventTimeTimeout)


def period_text(start_us: str = "start_us") -> Column:
    return F.date_format(F.timestamp_micros(F.col(start_us)), "yyyy-MM-dd HH:mm")
