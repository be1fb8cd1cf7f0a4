"""Small readings and forms as column expressions: numbers, times, titles, series names, greetings, labels of machines.

Null in, null out, unless a docstring says otherwise.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from brookloom.functions import words

# --- numbers ----------------------------------------------------------------------------------------------------------------------


def significant(x: Column, digits: int) -> Column:
    """Rounded half up to so many significant digits; 0 stays 0."""
    factor = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - digits + 1)
    return F.when(x == 0, F.lit(0.0)).otherwise(F.floor(F.floor(x / factor + 0.5) * factor * 1e6 + 0.5) / 1e6)


def approximately(a: Column, b: Column, share: float) -> Column:
    """Whether two numbers lie within a share of the greater one; a zero is near nothing."""
    return (a != 0) & (b != 0) & (F.abs(a - b) <= share * F.greatest(F.abs(a), F.abs(b)))


def number_of(text: Column) -> Column:
    """A plain number, with a decimal point or one decimal comma; anything else is null."""
    t = F.regexp_replace(F.trim(text), r"^(-?\d+),(\d+)$", "$1.$2")
    return F.when(t.rlike(r"^[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?$"), t.try_cast("double"))


# The steps that an axis may end at.
NICE = (1, 1.5, 2, 2.5, 3, 4, 5, 6, 8, 10)


def axis_end(x: Column) -> Column:
    """The least nice number that is not below x; 1 for nothing above zero."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(x)))
    steps = F.filter(F.array(*[F.lit(float(s)) for s in NICE]), lambda s: s * power >= x)
    return F.when(x > 0, F.round(F.coalesce(F.try_element_at(steps, F.lit(1)), F.lit(10.0)) * power, 9)).otherwise(1.0)


def card_number(text: Column) -> Column:
    """Whether the digits of a text pass the check sum of card numbers."""
    return F.coalesce(F.call_function("luhn_check", F.regexp_replace(text, r"[ -]", "")), F.lit(False))


def stepped(x: Column, step: int, least: int, most: int) -> Column:
    """x down to a whole number of steps, within bounds; the least for nothing above zero."""
    return F.when(x > 0, F.greatest(F.lit(least), F.least(F.lit(most), F.floor(x / step).cast("int") * step))).otherwise(least)


def column_name(n: Column) -> Column:
    """Spreadsheet letters of a column number, 1 is A."""
    rest = n.cast("bigint")
    out = F.lit("")
    for _ in range(7):  # 26^7 columns
        out = F.when(rest > 0, F.concat(F.chr(65 + (rest - 1) % 26), out)).otherwise(out)
        rest = F.when(rest > 0, F.floor((rest - 1) / 26)).otherwise(0)
    return out


def size_text(n: Column) -> Column:
    """Bytes in the largest unit of 1 to 1023, with one decimal from kilobytes on."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024**k, F.concat(F.format_string("%.1f", F.floor(n / 1024.0**k * 10 + 0.5) / 10), F.lit(f" {unit}"))).otherwise(out)
    return out


def speed(started: Column, first: Column, ended: Column, tokens: Column) -> Column:
    """(first_ms, per_s, total_ms) of a run by its instants in milliseconds: the tokens after the first count against the time after it."""
    rest, decode = F.greatest(F.lit(0), tokens - 1), F.greatest(F.lit(0), ended - first)
    rate = F.when((decode > 0) & (rest > 0), rest / (decode / 1000.0)).otherwise(0.0)
    return F.struct(F.greatest(F.lit(0), first - started).alias("first_ms"), rate.alias("per_s"), F.greatest(F.lit(0), ended - started).alias("total_ms"))


# --- times ------------------------------------------------------------------------------------------------------------------------


def time_of(text: Column, zone: str) -> Column:
    """An instant from ISO text; without a zone of its own it is local time in ``zone``. Anything else is null."""
    t = F.trim(text)
    zoned = t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?:Z|[+-]\d{2}:?\d{2})$")
    local = t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,3})?)?$")
    iso = F.regexp_replace(F.regexp_replace(t, " ", "T"), r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(zoned, iso.try_cast("timestamp")).when(local, F.to_utc_timestamp(iso.try_cast("timestamp_ntz").cast("timestamp"), zone))


def local_text(at: Column, zone: str) -> Column:
    """Calendar text of an instant in a zone (the session reads instants as UTC)."""
    return F.date_format(F.from_utc_timestamp(at, zone), "yyyy-MM-dd HH:mm")


def written_forms(at: Column, zone: str) -> Column:
    """(times, dates): the ways in which people write an instant's local time and day."""
    t = F.from_utc_timestamp(at, zone)
    full, short = F.date_format(t, "HH:mm:ss"), F.date_format(t, "HH:mm")
    times = F.array_compact(F.array(F.when(~full.endswith(":00"), full), short, F.when(short.startswith("0"), F.substring(short, 2, 4))))
    dates = F.array_distinct(F.array(F.date_format(t, "yyyy-MM-dd"), F.date_format(t, "dd.MM.yyyy"), F.date_format(t, "d.M.yyyy")))
    return F.struct(times.alias("times"), dates.alias("dates"))


def retry_after_ms(text: Column, now: Column) -> Column:
    """Milliseconds to wait: whole seconds, or the time to an HTTP date (never below 0); else null."""
    t = F.trim(F.coalesce(text, F.lit("")))
    at = F.try_to_timestamp(F.regexp_extract(t, r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), (\d{2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.when(t.rlike("^[0-9]+$"), t.cast("bigint") * 1000).when(at.isNotNull(), F.greatest(F.lit(0).cast("bigint"), F.unix_millis(at) - F.unix_millis(now)))


def day_wave(at_ms: Column, base: float, swing: float) -> Column:
    """A test signal with the period of a day, to one decimal."""
    return F.floor((base + swing * F.sin(at_ms % 86_400_000 / 86_400_000.0 * 2 * F.pi())) * 10 + 0.5) / 10


# --- texts ------------------------------------------------------------------------------------------------------------------------


def _lines(text: Column) -> Column:
    return F.split(text, r"\r\n|\n|\r")


def title_of(markdown: Column, fallback: Column, most: int = 300) -> Column:
    """The first heading of level one, else the first line that isn't blank without its marks, else the fallback."""
    heads = F.filter(_lines(markdown), lambda x: x.rlike(r"^#\s+\S"))
    lines = F.filter(_lines(markdown), lambda x: F.trim(x) != "")
    first = F.trim(F.regexp_replace(F.trim(F.try_element_at(lines, F.lit(1))), "^#+", ""))
    head = F.trim(F.regexp_replace(F.try_element_at(heads, F.lit(1)), r"^#\s+", ""))
    return F.left(F.coalesce(head, F.when(first != "", first), fallback), F.lit(most))


def first_line(text: Column, most: int = 60) -> Column:
    """The first line as a title, with an ellipsis if it is cut."""
    line = F.trim(F.split(F.trim(text), "\n")[0])
    return F.when(F.length(line) > most, F.concat(F.left(line, F.lit(most - 1)), F.lit("…"))).otherwise(line)


def summary_of(markdown: Column, limit: int = 300) -> Column:
    """The first paragraph that isn't a heading, list, quote, table or fence, cut at a word."""
    marked = r"^\s*(?:#|[-*+>|]|\d+[.)]\s|```|~~~)"
    # each line with what it is: 0 blank, 1 marked, 2 plain; the paragraph is the first run of plain ones
    kinds = F.transform(_lines(markdown), lambda x: F.struct(F.when(F.trim(x) == "", 0).when(x.rlike(marked), 1).otherwise(2).alias("k"), F.trim(x).alias("t")))
    start = F.array_position(F.transform(kinds, lambda x: x["k"]), F.lit(2)).cast("int")
    rest = F.slice(kinds, F.greatest(start, F.lit(1)), F.greatest(F.size(kinds), F.lit(1)))
    stop = F.array_position(F.transform(rest, lambda x: x["k"] < 2), True).cast("int")
    run = F.when(stop > 0, F.slice(rest, F.lit(1), F.greatest(stop - 1, F.lit(0)))).otherwise(rest)
    text = F.when(start > 0, F.array_join(F.transform(run, lambda x: x["t"]), " ")).otherwise("")
    head = F.left(text, F.lit(limit))
    cut = F.regexp_extract(head, r"(?s)^(.+) [^ ]*$", 1)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(F.when(cut != "", cut).otherwise(head), "[ ,;:]+$", ""), F.lit(" …")))


def passage_text(title: Column, heading: Column, content: Column) -> Column:
    """What is embedded for a section: title, the heading unless the text begins with it, text."""
    c, h = F.coalesce(content, F.lit("")), F.coalesce(heading, F.lit(""))
    begins = F.trim(F.regexp_replace(F.split(c, "\n")[0], "^#+", ""))
    return F.concat_ws("\n", F.when(title != "", title), F.when((h != "") & (h != begins), h), c)


def ingest_markdown(title: Column, kind: Column, content: Column, facts: str = "Facts", meta: str = "Metadata", source: str = "Source") -> Column:
    return F.concat(F.lit("# "), title, F.lit(f"\n\n## {facts}\n"), content, F.lit(f"\n\n## {meta}\n- **{source}:** "), kind)


def squashed(text: Column) -> Column:
    """Lower case with single blanks, for comparisons."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def quoted_in(quote: Column, text: Column) -> Column:
    """Whether a quotation stands in a text, case and white space aside; an empty one doesn't."""
    q = squashed(quote)
    return (q != "") & squashed(text).contains(q)


def series_name(template: str, topic: Column) -> Column:
    """A series name from a topic: {n} is its n-th level; null if what comes out is no name."""
    levels = F.split(topic, "/")
    parts: list[Column] = []
    for literal, n in re.findall(r"([^{]*)(?:\{(\d+)\})?", template):
        parts.append(F.lit(literal))
        if n:
            parts.append(F.coalesce(F.try_element_at(levels, F.lit(int(n))), F.lit("")))
    t = F.lower(F.concat(*parts))
    for rx, to in ((r"[^a-z0-9_.]+", "_"), (r"\.{2,}", "."), (r"^[._]+|[._]+$", "")):
        t = F.regexp_replace(t, rx, to)
    return F.when(t.rlike(r"^[a-z0-9][a-z0-9_.]*$"), t)


# How a greeting begins, and words that add nothing to one.
GREETS = r"^(?:hey|hallo|hi|hello|moin|servus|grüß gott|guten (?:tag|morgen|abend)|good (?:morning|afternoon|evening)|was geht|wer bist du|who are you|what can you do)\b"
FILLER = "there everyone everybody all team folks friend friends again you are doing today zusammen leute allerseits alle geht gehts dir euch ihnen nochmal heute can kannst bist".split()


def is_greeting(text: Column) -> Column:
    t = F.lower(F.trim(text))
    rest = F.regexp_replace(t, GREETS, "")
    own = F.filter(F.regexp_extract_all(rest, F.lit(words.WORD), F.lit(0)), lambda w: (F.length(w) > 2) & ~w.isin(words.STOP_LOCAL))
    return t.rlike(GREETS) & F.forall(own, lambda w: w.isin(FILLER))


def content_tokens(text: Column, boilerplate: list[str]) -> Column:
    """Search tokens, folded, without labels, numbers and the words of source notes."""
    bare = F.regexp_replace(text, r"(?i)\[(?:doc|dok|dokument|document|source|quelle)\s*:[^\]\n]{1,300}\]", " ")
    return F.filter(F.transform(words.tokens(bare), words.fold), lambda w: ~w.isin(boilerplate) & ~w.rlike(r"\p{N}"))


# Signs that a released sentence may hold besides letters, digits and blanks.
SIGNS = """ .,;:!?'"()[]-/%&+=<>#@$~_°±²³µ§€£¥¢©®×÷«»–—‘’‚“”„‹›…•™Ω"""


def disallowed(signs: str = SIGNS) -> str:
    """The pattern of one character outside the allowed set."""
    return "[^\\p{L}\\p{M}\\p{N}\\s" + re.sub(r"([\[\]\\^&\-])", r"\\\1", signs) + "]"


def first_disallowed(text: Column, signs: str = SIGNS) -> Column:
    """The first character outside the allowed set, or null."""
    found = F.regexp_extract(text, disallowed(signs), 0)
    return F.when(found != "", found)


def browser_of(agent: Column) -> Column:
    """Name and main version of a browser by its agent text."""
    out = F.lit("unknown")
    for rx, name in reversed(((r"Edg(?:e|A|iOS)?/(\d+)", "Edge"), (r"OPR/(\d+)", "Opera"), (r"Firefox/(\d+)", "Firefox"), (r"FxiOS/(\d+)", "Firefox"), (r"CriOS/(\d+)", "Chrome"), (r"Chrome/(\d+)", "Chrome"), (r"Version/(\d+)[\d.]* (?:Mobile/\S+ )?Safari/", "Safari"))):
        m = F.regexp_extract(agent, rx, 1)
        out = F.when(m != "", F.concat(F.lit(name + " "), m)).otherwise(out)
    return out
