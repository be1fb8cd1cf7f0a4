"""Splitting oversized items at natural boundaries.

Method: the words' start and end offsets of a text are arrays (the prefix sums of its token lengths); the ends of paragraphs,
lines and sentences are sorted arrays of word positions. From a piece's first word, binary search gives the last word that fits
both limits, and then the last boundary of the best kind before it; the next piece starts ``overlap`` words earlier. A word longer
than the limit is cut hard.

Offsets and lengths are code points. Pieces are slices of the text from a word's start to a word's end: only white space between
pieces is left out, so the text can be put together again from the offsets.

Defined cases: a null or blank text has no piece; a text within the limits is one piece, the text without outer white space;
repeated rows of an id are one record (for equal texts either; else the longest text that is cut, of equal length the one with the
greatest hash); extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brookloom.llm.texts import SOLID

PIECES = "kind string, id string, piece int, start int, end int, words int, repeated int, boundary string"


@dataclass(frozen=True)
class Limits:
    words: int
    chars: int
    overlap: int = 30


#: The limits of TESTDATA.md.
LIMITS = {"section": Limits(300, 2400), "document": Limits(1500, 12000)}

KINDS = ("paragraph", "line", "sentence")
_CLOSERS = "\"'”’»)]*_`"


def _boundaries(text: str, starts: list[int], ends: list[int]) -> list[list[int]]:
    """Word counts after which a paragraph, line or sentence ends, each sorted. A paragraph end is no line end: the better kind wins."""
    found: list[list[int]] = [[], [], []]
    for k in range(len(starts) - 1):
        gap = text[ends[k] : starts[k + 1]]
        if gap != " ":
            breaks = gap.count("\n") or gap.count("\r") or sum(gap.count(c) for c in "\u2028\u2029\x85\x0b\x0c")
            if breaks:
                found[0 if breaks > 1 or "\u2029" in gap else 1].append(k + 1)
                continue
        at = ends[k] - 1
        while at > starts[k] and text[at] in _CLOSERS:
            at -= 1
        if text[at] in ".!?…。！？":
            found[2].append(k + 1)
    return found


def _spans(text: str, limits: Limits) -> tuple[list[int], list[int]]:
    """Starts and ends of the words; a word beyond the character limit becomes hard pieces of at most that length."""
    starts, ends = [], []
    for m in SOLID.finditer(text):
        a, b = m.span()
        while b - a > limits.chars:
            starts.append(a)
            ends.append(a + limits.chars)
            a += limits.chars
        starts.append(a)
        ends.append(b)
    return starts, ends


def split(text: str | None, limits: Limits) -> list[tuple[int, int, int, int, str]]:
    """(start, end, words, repeated words, kind of boundary at the end) of each piece."""
    if text is None:
        return []
    starts, ends = _spans(text, limits)
    n = len(starts)
    if not n:
        return []
    if n <= limits.words and len(text) <= limits.chars:
        return [(starts[0], ends[-1], n, 0, "end")]
    bounds = _boundaries(text, starts, ends)
    out = []
    first = repeated = 0
    while True:
        fit = min(first + limits.words, bisect_right(ends, starts[first] + limits.chars))  # words before this one fit
        fresh = first + repeated  # the first word that no piece holds yet
        if fit <= fresh:  # the overlap leaves no room for the next word: take less of it
            repeated -= 1
            first += 1
            continue
        if fit >= n:
            out.append((starts[first], ends[n - 1], n - first, repeated, "end"))
            break
        least = max(fresh, first + (fit - first) // 2)
        cut, kind = fit, "word"
        for name, places in zip(KINDS, bounds):
            k = bisect_right(places, fit) - 1
            if k >= 0 and places[k] > least:
                cut, kind = places[k], name
                break
        if kind == "word" and ends[cut - 1] == starts[cut]:
            kind = "hard"
        out.append((starts[first], ends[cut - 1], cut - first, repeated, kind))
        repeated = min(limits.overlap, cut - first - 1)
        first = cut - repeated
    if len(out) == 1:  # over the limit only by outer white space
        return [(starts[0], ends[-1], n, 0, "end")]
    return out


def _cut(rows: DataFrame, limits: dict[str, Limits], oversized_only: bool) -> DataFrame:
    """The pieces of every row, with the length and hash of its text.

    ``oversized_only`` keeps the records that exceed a limit; the scan then drops texts that are too short to exceed either
    before they reach Python (w words need at least 2w - 1 characters).
    """
    base = rows.select("kind", "id", "text").filter(F.col("kind").isin(list(limits)) & F.col("id").isNotNull() & F.col("text").isNotNull())
    if oversized_only:
        long = F.lit(False)
        for kind, x in limits.items():
            long = long | ((F.col("kind") == kind) & (F.char_length("text") > min(x.chars, 2 * x.words - 2)))
        base = base.filter(long)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for kind, i, text, mark in zip(b["kind"], b["id"], b["text"], b["mark"]):
                x = limits[kind]
                if oversized_only and len(text) <= x.chars and sum(1 for _ in SOLID.finditer(text)) <= x.words:
                    continue
                out += [(kind, i, k, *p, len(text), mark) for k, p in enumerate(split(text, x))]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in f"{PIECES}, size int, mark bigint".split(", ")])

    return base.withColumn("mark", F.xxhash64("text")).mapInPandas(run, f"{PIECES}, size int, mark bigint")


def pieces(rows: DataFrame, limits: dict[str, Limits] | None = None, oversized_only: bool = False) -> DataFrame:
    """One row for each piece of each record of rows (kind, id, text). Repeated records are settled by their pieces, texts aren't moved."""
    cut = _cut(rows, limits or LIMITS, oversized_only)
    longest = F.max(F.struct("size", "mark")).over(Window.partitionBy("kind", "id"))
    own = cut.withColumn("longest", longest).filter((F.col("size") == F.col("longest.size")) & (F.col("mark") == F.col("longest.mark")))
    return own.dropDuplicates(["kind", "id", "piece"]).drop("size", "mark", "longest")


def oversized(rows: DataFrame, limits: dict[str, Limits] | None = None) -> DataFrame:
    """(kind, id) of the records that are cut because a text of theirs exceeds a limit."""
    return _cut(rows, limits or LIMITS, True).select("kind", "id").distinct()


def piece_texts(rows: DataFrame, limits: dict[str, Limits] | None = None) -> DataFrame:
    """The pieces of every record with their text; repeated rows count once."""
    once = rows.groupBy("kind", "id").agg(F.max_by("text", F.struct(F.char_length("text"), F.xxhash64("text"))).alias("text"))
    cut = pieces(once, limits)
    return cut.join(once, ["kind", "id"]).withColumn("text", F.expr("substring(text, start + 1, end - start)"))
