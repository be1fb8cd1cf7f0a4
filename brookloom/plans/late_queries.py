"""Queries of problem 1 and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from brookloom.session import table
from brookloom.streaming import late_events as late


def p1_found(spark, sf_dir):
    """Types and periods whose first figure (each source up to its punctuation, 5 minutes after the end) and final figure (12 hours) differ."""
    return late.source_figures(table(spark, sf_dir, "event_log")).filter("first <> final").select("type", late.period_text().alias("period_start"))


def p1_figures(spark, sf_dir):
    figures = late.source_figures(table(spark, sf_dir, "event_log"))
    return figures.select("type", late.period_text().alias("period_start"), "first", "final", "too_late")


def p1_closings(spark, sf_dir):
    """Periods that wait up to 30 minutes for silent sources: when they close and how the first figure changes."""
    figures = late.period_figures(table(spark, sf_dir, "event_log"), idle_timeout_s=1800)
    return figures.groupBy(late.period_text().alias("period_start")).agg(
        F.max(F.col("closed_us") - F.col("end_us")).alias("wait_us"), F.sum("first").alias("first"), F.sum("final").alias("final")
    )


def p1_diverted(spark, sf_dir):
    """Events that came with or after the punctuation of their source, by type and whether they still count."""
    rows = late.source_diverted(table(spark, sf_dir, "event_log"))
    return rows.groupBy("type", "counts").agg(F.count(F.lit(1)).alias("n"), F.max("late_us").alias("most_us"))


_EVENTS = """
WITH e AS (
  SELECT source, dedupe, arg_min(type, (recorded, seq)) AS type, arg_min(happened, (recorded, seq)) AS happened, min(recorded) AS recorded
  FROM event_log WHERE happened IS NOT NULL AND recorded IS NOT NULL AND type IS NOT NULL GROUP BY source, dedupe
), p AS (
  SELECT *, epoch_us(happened) - ((epoch_us(happened) % 600000000) + 600000000) % 600000000 AS start_us, epoch_us(recorded) AS rec_us FROM e
), f AS (
  SELECT type, start_us, count(*) FILTER (WHERE rec_us <= start_us + 900000000) AS first,
         count(*) FILTER (WHERE rec_us <= start_us + 600000000 + 43200000000) AS final,
         count(*) FILTER (WHERE rec_us > start_us + 600000000 + 43200000000) AS too_late
  FROM p GROUP BY type, start_us
)
"""

QUERIES = {"p1_found": p1_found, "p1_figures": p1_figures, "p1_closings": p1_closings, "p1_diverted": p1_diverted}
SQL = {
    "p1_found": _EVENTS + "SELECT type, strftime(make_timestamp(start_us), '%Y-%m-%d %H:%M') AS period_start FROM f WHERE first <> final",
    "p1_figures": _EVENTS + "SELECT type, strftime(make_timestamp(start_us), '%Y-%m-%d %H:%M') AS period_start, first, final, too_late FROM f",
    "p1_diverted": _EVENTS
    + """SELECT type, rec_us <= start_us + 43800000000 AS counts, count(*) AS n, max(rec_us - start_us - 600000000) AS most_us
    FROM p WHERE rec_us > start_us + 900000000 GROUP BY 1, 2""",
    "p1_closings": """
WITH e AS (
  SELECT source, dedupe, arg_min(type, (recorded, seq)) AS type, arg_min(happened, (recorded, seq)) AS happened, min(recorded) AS recorded
  FROM event_log WHERE happened IS NOT NULL AND recorded IS NOT NULL AND type IS NOT NULL GROUP BY source, dedupe
), p AS (
  SELECT *, epoch_us(happened) - epoch_us(happened) % 600000000 + 600000000 AS end_us, epoch_us(recorded) AS rec_us FROM e
), s AS (SELECT DISTINCT source FROM event_log), ends AS (SELECT DISTINCT end_us FROM p),
w AS (
  SELECT end_us, s.source, (SELECT min(epoch_us(recorded)) FROM event_log l WHERE l.source = s.source
     AND epoch_us(l.recorded) BETWEEN end_us + 300000000 AND end_us + 2100000000) AS passed FROM ends, s
), c AS (SELECT end_us, max(coalesce(passed, end_us + 2100000000)) AS closed FROM w GROUP BY end_us)
SELECT strftime(make_timestamp(end_us - 600000000), '%Y-%m-%d %H:%M') AS period_start, max(closed - end_us) AS wait_us,
  count(*) FILTER (WHERE rec_us <= least(closed, end_us + 43200000000)) AS first, count(*) FILTER (WHERE rec_us <= end_us + 43200000000) AS final
FROM p JOIN c USING (end_us) GROUP BY end_us
""",
}
