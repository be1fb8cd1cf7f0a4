"""Answers as text: canonical form, blocks, labels blanked in place, personal data removed by kind, spoken form, places by line and column,
publishing, incremental runs, replay of projections, and the state of a service by its calls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brookloom.functions import cuts
from brookloom.functions.readings import card_number, passage_text
from brookloom.operators.answers import LOOSE
from brookloom.operators.sequences import folded

# --- columns ----------------------------------------------------------------------------------------------------------------------


#: Pattern and replacement, in order: invisible characters, line ends, marks at line starts, emphasis, blanks, quotation marks, dashes, blanks
#: at line ends.
CANONICAL = (
    (r"[\x{200B}-\x{200F}\x{2060}\x{FEFF}\x{00AD}]", ""),
    (r"\r\n?", "\n"),
    (r"(?m)^[ \t]{0,3}(?:#{1,6}|>|[-*+]|\d{1,3}[.)])[ \t]+", ""),
    (r"\*\*([^*\n]+)\*\*", "$1"),
    (r"__([^_\n]+)__", "$1"),
    (r"\*([^*\n]+)\*", "$1"),
    (r"\b_([^_\n]+)_\b", "$1"),
    (r"`([^`\n]+)`", "$1"),
    (r"[\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}\t ]+", " "),
    ("[‘’‚‛]", "'"),
    ("[“”„‟«»]", '"'),
    ("[‐‑‒–—]", "-"),
    (r" *\n *", "\n"),
)


def canonical_text(text: Column) -> Column:
    """Marks of Markdown and invisible characters off, quotation marks and dashes unified, white space single; lines stay."""
    for rx, to in CANONICAL:
        text = F.regexp_replace(text, rx, to)
    return F.trim(text)


def blanked(text: Column, pattern: str = LOOSE) -> Column:
    """Labels become blanks of their length, so that offsets stay."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return F.aggregate(found, text, lambda t, x: F.replace(t, x, F.repeat(F.lit(" "), F.length(x))))


def line_of(text: Column, offset: Column) -> Column:
    """(line, column) from 1 of an offset from 0."""
    head = F.substring(text, F.lit(1), offset)
    return F.struct((F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).alias("line"), (F.length(F.substring_index(head, "\n", -1)) + 1).alias("column"))


# What personal data looks like, in the order in which it is removed.
PERSONAL = {
    "mail": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}\b",
    "card": r"\b\d(?:[ -]?\d){12,18}\b",
    "ip": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "phone": r"\+\d{1,3}[ /-]?\d{2,5}[ /-]?\d{4,10}",
}


def _marked(text: Column, found: Column, mark: str) -> Column:
    return F.aggregate(found, text, lambda t, x: F.replace(t, x, F.lit(mark)))


def without_personal(text: Column) -> Column:
    """(text, kinds): personal data replaced by its kind, and which kinds were there. A row of digits is a card only if its check sum holds."""
    out, kinds = text, []
    for kind, rx in PERSONAL.items():
        found = F.regexp_extract_all(out, F.lit(rx), F.lit(0))
        if kind == "card":
            found = F.filter(found, card_number)
        kinds.append(F.when(F.size(found) > 0, F.lit(kind)))
        out = _marked(out, F.array_distinct(found), f"[{kind}]")
    return F.struct(out.alias("text"), F.array_compact(F.array(*kinds)).alias("kinds"))


# Abbreviations and how they are read out.
SPOKEN = {"z. B.": "zum Beispiel", "e.g.": "for example", "i.e.": "that is", "approx.": "approximately", "ca.": "circa", "Nr.": "Nummer", "No.": "number", "Dr.": "Doktor", "usw.": "und so weiter", "%": " percent", "&": " and "}


def spoken(text: Column) -> Column:
    """Abbreviations written out, as long as the text's digits stay the same; else the text as it was."""
    out = text
    for short, long in SPOKEN.items():
        out = F.replace(out, F.lit(short), F.lit(long))
    digits = lambda c: F.regexp_replace(c, r"\D", "")
    out = F.regexp_replace(out, " {2,}", " ")
    return F.when(digits(out) == digits(text), out).otherwise(text)


# --- frames -----------------------------------------------------------------------------------------------------------------------


def blocks(rows: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, line, kind, depth, text) of the lines of Markdown texts that aren't blank: heading, li, row, quote or p; lines that end in a colon lead
    in what follows (``leads``)."""
    each = rows.select(id_col, F.posexplode(F.split(text, r"\r\n|\n|\r")).alias("line", "t")).filter("trim(t) <> ''")
    kind = (
        F.when(F.col("t").rlike(r"^#{1,6}\s"), "heading").when(F.col("t").rlike(r"^\s*(?:[-*+]|\d{1,3}[.)])\s"), "li").when(F.col("t").rlike(r"^\s*\|.*\|\s*$"), "row").when(F.col("t").rlike(r"^\s*>"), "quote").otherwise("p")
    )
    bare = F.trim(F.regexp_replace("t", r"^\s*(?:#{1,6}|>|[-*+]|\d{1,3}[.)])\s+", ""))
    return each.select(id_col, (F.col("line") + 1).alias("line"), kind.alias("kind"), F.length(F.regexp_extract("t", r"^\s*", 0)).alias("depth"), bare.alias("text"), bare.endswith(":").alias("leads"))


def published(docs: DataFrame, embed: Callable[[list[str]], list[list[float]]] | None = None, most: int = 1500) -> DataFrame:
    """(id, idx, heading, content, words, passage, embedding) of documents (id, title, markdown): cut into sections, each with the text that is
    embedded. ``embed`` gets batches of passages; without it there are no vectors."""

    def cut(text: str) -> list[tuple]:
        return cuts.markdown_sections(text, most)

    sections = cuts.exploded(docs, "id", "markdown", cut, "idx int, heading string, content string, words int")
    out = sections.join(docs.select("id", "title"), "id").withColumn("passage", passage_text(F.col("title"), F.col("heading"), F.col("content")))
    if embed is None:
        return out.drop("title").withColumn("embedding", F.lit(None).cast("array<float>"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(embedding=pd.Series([list(map(float, v)) for v in embed(b["passage"].tolist())], dtype=object, index=b.index))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.drop("title").schema)
    return out.drop("title").mapInPandas(run, f"{fields}, embedding array<float>")


def next_run(chunks: DataFrame, done: DataFrame, most: int = 60) -> DataFrame:
    """(doc, idx): the chunks (doc, idx) that an incremental run takes next: those without a result, documents with the fewest left first."""
    left = chunks.select("doc", "idx").join(done.select("doc", "idx"), ["doc", "idx"], "left_anti")
    fewest = left.groupBy("doc").agg(F.count(F.lit(1)).alias("left"))
    return left.join(fewest, "doc").orderBy("left", "doc", "idx").limit(most).select("doc", "idx")


def replayed(view: DataFrame, log: DataFrame, project: Callable[[DataFrame], DataFrame], stored: int, version: int, position: int) -> DataFrame:
    """What a projection adds to its view: all of the log again after its version changed (the view is then empty), else what came after a position."""
    if stored != version:
        return project(log)
    return view.unionByName(project(log.filter(F.col("seq") > position)))


def service_states(calls: DataFrame, key: str, at_ms: str, failed: str, limit: int = 3, open_ms: int = 60_000) -> DataFrame:
    """(key, at, state) of the calls of a service in order. After ``limit`` failures in a row it is open and calls are refused for ``open_ms``; the
    first call after that is a trial (half-open): it closes the service or opens it again."""

    def step(state: tuple, r: tuple) -> tuple:
        fails, until = state
        at, bad = r
        if until is not None and at < until:
            return state, (at, "refused")
        if until is not None:
            return ((fails, at + open_ms) if bad else (0, None)), (at, "trial failed" if bad else "trial passed")
        fails = fails + 1 if bad else 0
        return (fails, at + open_ms if fails >= limit else None), (at, "failed" if bad else "passed")

    return folded(calls, key, at_ms, lambda: (0, None), step, [failed], f"{at_ms} bigint, state string")


def carried_values(statements: DataFrame, block: list[str], order: str, values: str) -> DataFrame:
    """Adds ``carried``: the one value of the statement before, for a statement that has none itself (values: array)."""
    before = F.lag(values).over(Window.partitionBy(*block).orderBy(order))
    return statements.withColumn("carried", F.when((F.size(values) == 0) & (F.size(before) == 1), before[0]))
