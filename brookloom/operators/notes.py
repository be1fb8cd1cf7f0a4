"""Notes, names, merges and small expressions: ranking by use, unique names, three-way merge, compare-and-set, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brookloom.operators.sequences import folded


def freshness(last: Column, now: Column, half_life_days: float) -> Column:
    """Halves with every half-life since the last touch; the future counts as now."""
    return F.pow(F.lit(0.5), F.greatest(F.lit(0), F.datediff(now, last)) / half_life_days)


def usage(recalls: Column) -> Column:
    return 1 - F.exp(-recalls / 5.0)


def spread(days: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), days / 7.0))


def use_weight(weight: Column) -> Column:
    return 1 + F.least(F.lit(1.0), F.when(weight > 1, F.ln(weight) / F.ln(F.lit(50.0))).otherwise(0.0))


def note_score(match: Column, best: Column, fresh: Column, use: Column, wide: Column) -> Column:
    """Shares of match, freshness, use and spread: .60 .20 .15 .05. The match counts relative to the best one."""
    return 0.60 * F.when(best > 0, match / best).otherwise(0.0) + 0.20 * fresh + 0.15 * use + 0.05 * wide


def unique_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    """A clashing name gets " (n)" before its extension, in the given order."""
    w = Window.partitionBy(F.lower(name)).orderBy(order)
    n = F.row_number().over(w)
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[A-Za-z0-9]{1,5})?$", 1), F.regexp_extract(name, r"^(.*?)(\.[A-Za-z0-9]{1,5})?$", 2)
    return rows.withColumn("unique", F.when(n == 1, F.col(name)).otherwise(F.concat(stem, F.lit(" ("), n.cast("string"), F.lit(")"), ext)))


def put(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Upsert: rows of ``new`` replace those with the same key."""
    return table.join(new.select(key), key, "left_anti").unionByName(new)


def compare_and_set(table: DataFrame, new: DataFrame, key: str, rev: str) -> DataFrame:
    """(key, outcome): a new row counts only if its revision is greater than the stored one."""
    j = new.select(key, F.col(rev).alias("_new")).join(table.select(key, F.col(rev).alias("_old")), key, "left")
    return j.select(key, F.when(F.col("_old").isNull(), "insert").when(F.col("_new") > F.col("_old"), "update").otherwise("refused").alias("outcome"))


def merged(base: DataFrame, local: DataFrame, remote: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, how): a three-way merge. The side that changed wins; if both did, the lesser value; what one side deleted and the
    other left alone is gone."""
    b, a, r = (x.select(key, F.col(value).alias(n), F.lit(True).alias("has_" + n)) for x, n in ((base, "b"), (local, "l"), (remote, "r")))
    j = b.join(a, key, "full").join(r, key, "full")
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y)) & F.col("has_" + x).eqNullSafe(F.col("has_" + y))
    how = F.when(same("l", "r"), "same").when(same("l", "b"), "remote").when(same("r", "b"), "local").otherwise("both")
    j = j.withColumn("how", how)
    gone = F.when(F.col("how") == "same", F.col("has_l").isNull()).when(F.col("how") == "remote", F.col("has_r").isNull()).when(F.col("how") == "local", F.col("has_l").isNull()).otherwise(False)
    out = F.when(F.col("how") == "remote", F.col("r")).when(F.col("how").isin("local", "same"), F.col("l")).otherwise(F.least("l", "r"))
    return j.filter(~gone).select(key, out.alias(value), "how")


def within_budget(rows: DataFrame, group: str, rank: str, size: str, most: int, budget: int) -> DataFrame:
    """(group, rank): items taken in rank order while they fit; one that doesn't fit is skipped, later ones may still. At most ``most``."""

    def take(state: tuple, r: tuple) -> tuple:
        left, n = state
        return ((left - r[1], n + 1), r[:1]) if n < most and r[1] <= left else (state, None)

    return folded(rows, group, rank, lambda: (budget, 0), take, [size], f"{rank} {rows.schema[rank].dataType.simpleString()}")


def column_index(name: Column) -> Column:
    """Spreadsheet column letters to numbers: A is 1."""
    return F.aggregate(F.split(F.upper(name), ""), F.lit(0).cast("bigint"), lambda s, c: F.when(F.length(c) == 1, s * 26 + F.ascii(c) - 64).otherwise(s))


def serial_date(serial: Column, from_1904: bool = False) -> Column:
    """Spreadsheet day numbers to dates; in the older system day 60 is the leap day 1900 never had and gives null."""
    if from_1904:
        return F.date_add(F.lit("1904-01-01").cast("date"), serial)
    return F.when(serial == 60, F.lit(None)).otherwise(F.date_add(F.lit("1899-12-31").cast("date"), F.when(serial > 60, serial - 1).otherwise(serial)))


def stripped_pii(text: Column) -> Column:
    """Mail addresses, bank accounts, IP addresses and phone numbers become marks."""
    for mark, rx in (
        ("[mail]", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+"),
        ("[iban]", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}\b"),
        ("[ip]", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
        ("[phone]", r"\+\d{1,3}[ /-]?\d{2,5}[ /-]?\d{4,10}"),
    ):
        text = F.regexp_replace(text, rx, mark.replace("[", "\\[").replace("]", "\\]"))
    return text


def without_reasoning(text: Column) -> Column:
    """Paired reasoning tags with their content go, then a lone closing tag with all before it, then an open one with all after it."""
    t = F.regexp_replace(text, r"(?is)<think(?:ing)?>.*?</think(?:ing)?>", "")
    t = F.regexp_replace(t, r"(?is)^.*</think(?:ing)?>", "")
    return F.trim(F.regexp_replace(t, r"(?is)<think(?:ing)?>.*$", ""))


def citations(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Labels [Doc: name, Chunk: n], numbered within each name."""
    safe = F.trim(F.regexp_replace(F.col(name), r"[\[\]\n]+", " "))
    n = F.row_number().over(Window.partitionBy(safe).orderBy(order))
    return rows.withColumn("label", F.concat(F.lit("[Doc: "), safe, F.lit(", Chunk: "), n.cast("string"), F.lit("]")))
