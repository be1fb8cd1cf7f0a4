"""Operators of a document store: range scans, pages, offsets, cascades, retention, scopes, vectors by model, exports.

A scan with an order and a limit is a distributed top-k. Every order ends in the primary key.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- scans ------------------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class KeyRange:
    """Bounds of a key: ``only`` one value, ``lower`` and ``upper`` (open or closed), a text ``prefix``, or the ``head`` of an array key."""

    only: Any = None
    lower: Any = None
    upper: Any = None
    lower_open: bool = False
    upper_open: bool = False
    prefix: str | None = None
    head: tuple | None = None

    def holds(self, key: Column) -> Column:
        tests = []
        if self.only is not None:
            tests.append(key == self.only)
        if self.lower is not None:
            tests.append(key > self.lower if self.lower_open else key >= self.lower)
        if self.upper is not None:
            tests.append(key < self.upper if self.upper_open else key <= self.upper)
        if self.prefix is not None:
            tests.append(key.startswith(self.prefix))
        if self.head is not None:
            tests.append(F.slice(key, 1, len(self.head)) == F.array(*[F.lit(x) for x in self.head]))
        out = F.lit(True)
        for t in tests:
            out = out & t
        return out


def scan(rows: DataFrame, key: str, within: KeyRange | None = None, by: str | None = None, descending: bool = False, limit: int | None = None) -> DataFrame:
    """Rows in the order of an index column ``by`` (else the key), then of the key; ``within`` bounds that column."""
    column = F.col(by or key)
    out = rows if within is None else rows.filter(within.holds(column))
    order = [F.desc(by or key), F.desc(key)] if descending else [F.asc(by or key), F.asc(key)]
    out = out.orderBy(*order)
    return out if limit is None else out.limit(limit)


def offset_page(rows: DataFrame, key: str, number: int, size: int) -> DataFrame:
    """The page with this number, from 0; a page with fewer rows is the last."""
    return rows.orderBy(key).offset(number * size).limit(size)


# --- writes -----------------------------------------------------------------------------------------------------------------------


def committed_positions(old: DataFrame, batch: DataFrame, source: str, position: str) -> DataFrame:
    """(source, position): offsets after a batch; they never go back."""
    new = batch.groupBy(source).agg(F.max(position).alias(position))
    return old.select(source, position).unionByName(new).groupBy(source).agg(F.max(position).alias(position))


def deleted(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows that belong to the ids of ``gone`` (id): the rows themselves and all that hang on them."""
    return {name: rows.join(gone.select(F.col("id").alias(key)), key, "left_anti") for name, (rows, key) in tables.items()}


def without_range(rows: DataFrame, key: str, within: KeyRange) -> DataFrame:
    return rows.filter(~F.coalesce(within.holds(F.col(key)), F.lit(False)))


def retained(rows: DataFrame, at: Column, now: Column, keep_days: int, most: int, read: str, group: str, order: str) -> DataFrame:
    """Rows younger than ``keep_days``; of a group with more than ``most`` of them the oldest read ones go first, then the oldest others."""
    young = rows.filter(F.datediff(now, at) <= keep_days)
    w = Window.partitionBy(group).orderBy(F.asc(read), F.desc(order))
    return young.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


# --- predicates -------------------------------------------------------------------------------------------------------------------


def may_reach(data_class: Column, place: Column, personal_to_cloud: bool = True) -> Column:
    """Whether data of a class may go to a place (none, local, cloud): public anywhere, sensitive stays local, what is unknown goes nowhere."""
    return (
        F.when(place == "none", True)
        .when(data_class == "public", True)
        .when(data_class == "personal", (place == "local") | F.lit(personal_to_cloud))
        .when(data_class == "sensitive", place == "local")
        .otherwise(False)
    )


def live(derived: DataFrame, docs: DataFrame, key: str, sha: str) -> DataFrame:
    """Derived rows with ``live``: whether the hash they were made from is that of the document now."""
    now = docs.select(key, F.col(sha).alias("_now"))
    return derived.join(now, key, "left").withColumn("live", F.coalesce(F.col(sha) == F.col("_now"), F.lit(False))).drop("_now")


def syncable(nodes: DataFrame) -> DataFrame:
    """(id): rows (id, parent, role, local_only) that may leave the device: a question only if an answer below it may."""
    may = nodes.filter(~F.coalesce("local_only", F.lit(False)))
    answered = may.filter(~F.coalesce("role", F.lit("")).isin("user", "system") & F.col("parent").isNotNull()).select(F.col("parent").alias("id")).distinct()
    return may.filter(F.coalesce(F.col("role") != "user", F.lit(True))).select("id").unionByName(may.filter("role = 'user'").select("id").join(answered, "id", "left_semi"))


def in_scope(scope: Column, project: Column, mode: Column) -> Column:
    """Whether a memory of a scope counts in a project by its mode: off, project (its own only), else also the global ones."""
    scopes = F.when(project.isNull(), F.array(F.lit("global"))).when(mode == "off", F.array().cast("array<string>")).when(mode == "project", F.array(project)).otherwise(F.array(F.lit("global"), project))
    return F.array_contains(scopes, scope)


def valid_entry(rows: DataFrame, numbers: list[str], texts: list[str]) -> Column:
    """Whether a row has finite numbers and texts that aren't empty where it must."""
    out = F.lit(True)
    for c in numbers:
        out = out & F.coalesce(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")), F.lit(False))
    for c in texts:
        out = out & (F.coalesce(F.length(c), F.lit(0)) > 0)
    return out


def distinct_sources(hits: DataFrame, key: str, position: str) -> DataFrame:
    """The first hit of each document, with ``place`` from 1 in the order of first appearance. Hits are those of one answer, a bounded list."""
    first = hits.groupBy(key).agg(F.min(position).alias(position))
    return first.withColumn("place", F.row_number().over(Window.orderBy(position, key)))


# --- vectors by model -------------------------------------------------------------------------------------------------------------


def prefixed(kind: Column, text: Column) -> Column:
    """What the embedder reads: queries and passages carry their prefix."""
    return F.concat(F.when(kind == "query", "query: ").otherwise("passage: "), text)


def pending_vectors(chunks: DataFrame, vectors: DataFrame, model: str, limit: int) -> DataFrame:
    """Chunks (doc, idx) without a vector of the model, in document order."""
    have = vectors.filter(F.col("model") == model).select("doc", "idx")
    return chunks.join(have, ["doc", "idx"], "left_anti").orderBy("doc", "idx").limit(limit)


def accepted_vectors(new: DataFrame, chunks: DataFrame, dim: int) -> DataFrame:
    """New vectors of the right length whose chunk exists."""
    return new.filter(F.size("embedding") == dim).join(chunks.select("doc", "idx"), ["doc", "idx"], "left_semi")


def switched(vectors: DataFrame, model: str) -> DataFrame:
    """Vectors of other models are dropped."""
    return vectors.filter(F.col("model") == model)


def pooled(vectors: DataFrame, key: str, dim: int) -> DataFrame:
    """(key, embedding): the mean of a group's vectors at length one. Numbers are added by place, so no group is gathered."""
    each = vectors.select(key, *[F.col("embedding")[i].cast("double").alias(f"_{i}") for i in range(dim)])
    mean = each.groupBy(key).agg(F.array(*[F.avg(f"_{i}") for i in range(dim)]).alias("m"))
    length = F.sqrt(F.aggregate("m", F.lit(0.0), lambda s, x: s + x * x))
    return mean.select(key, F.transform("m", lambda x: x / F.greatest(length, F.lit(1e-12))).alias("embedding"))


# --- exports ----------------------------------------------------------------------------------------------------------------------


def exported(messages: DataFrame, key: str, order: list[str], fields: list[str], version: int = 2) -> DataFrame:
    """(key, json): a versioned JSON text of each conversation, its messages in order. A conversation is one text by nature."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))), lambda m: F.struct(*[m[f].alias(f) for f in fields]))
    return messages.groupBy(key).agg(rows.alias("messages")).select(key, F.to_json(F.struct(F.lit(version).alias("version"), F.col(key), F.col("messages"))).alias("json"))


def imported(texts: DataFrame, key: str, fields: dict[str, str], version: int = 2) -> DataFrame:
    """The messages of exported conversations with their place; texts of another version or that are no such JSON give none."""
    message = ",".join(f"{f}:{t}" for f, t in fields.items())
    parsed = texts.select(F.from_json("json", f"version int, {key} string, messages array<struct<{message}>>").alias("c"))
    each = parsed.filter(F.col("c.version") == version).select(F.col(f"c.{key}").alias(key), F.posexplode("c.messages").alias("place", "m"))
    return each.select(key, "place", "m.*")


def sarif_result(rule: Column, level: Column, text: Column, uri: Column, line: Column, column: Column) -> Column:
    """One result of a static-analysis report as JSON: rule, level, message, place, and a fingerprint that survives moves."""
    where = F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), F.struct(line.alias("startLine"), column.alias("startColumn")).alias("region"))
    finger = F.struct(F.sha2(F.concat_ws("\n", rule, text), 256).alias("statement/v1"))
    return F.to_json(F.struct(rule.alias("ruleId"), level.alias("level"), F.struct(text.alias("text")).alias("message"), F.array(F.struct(where.alias("physicalLocation"))).alias("locations"), finger.alias("partialFingerprints")))


# --- marks ------------------------------------------------------------------------------------------------------------------------


def inbox(items: DataFrame, after: int) -> DataFrame:
    """One row: items after a position, those unread, and the highest position ever handed out."""
    new = F.col("seq") > after
    return items.agg(F.count_if(new).alias("new"), F.count_if(new & ~F.col("read")).alias("unread"), F.coalesce(F.max("seq"), F.lit(after)).alias("mark"))


def stale_jobs(jobs: DataFrame, now_ms: Column, limit_ms: int = 30_000) -> DataFrame:
    """Running jobs whose last sign of life is older than the limit."""
    return jobs.filter((F.col("state") == "running") & (now_ms - F.col("beat_ms") > limit_ms))
