"""The sentence gate: a sentence of an answer passes only if its numbers, identifiers and labels stand in the sources it cites.

``scanned`` finds numbers in digits, number words (English and German), identifiers and runs of digits that might be joined into
another number. ``judged`` withholds a sentence for the first of these reasons: unknown_source, chars, link, joined, identifier,
unsupported_number, number_word (in web mode web_ungrounded). ``units`` cuts a stream of text pieces into sentences that don't
depend on where the pieces were cut.

Defined cases: a text without sentences gives no unit; a unit of labels alone is not shown; without a cited source every claim is
unsupported; null sources hold nothing. All scans are linear in the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookloom.functions import cuts
from brookloom.functions.facts import readings
from brookloom.functions.readings import disallowed

# --- number words -----------------------------------------------------------------------------------------------------------------

_EN = {w: n for n, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
_EN |= {w: 10 * n for n, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
_EN_SCALE = {"hundred": 100, "thousand": 1_000, "million": 1_000_000, "billion": 1_000_000_000}
_DE = {w: n for n, w in enumerate("null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn".split())}
_DE_PART = _DE | {"ein": 1, "eine": 1} | {w: 10 * n for n, w in enumerate("zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig".split(), 2)}
_DE_SCALE = {"million": 1_000_000, "millionen": 1_000_000, "milliarde": 1_000_000_000, "milliarden": 1_000_000_000}
#: Words that multiply or divide, with their value.
FACTORS = {"half": 0.5, "third": 1 / 3, "quarter": 0.25, "double": 2, "twice": 2, "triple": 3, "dozen": 12, "hälfte": 0.5, "drittel": 1 / 3, "viertel": 0.25, "doppelt": 2, "dreifach": 3, "dutzend": 12}
#: Words after which a small number claims something.
UNITS = set("percent per cent euros euro dollars francs hours days weeks months years people times prozent franken stunden tage wochen monate jahre personen mal".split())


@lru_cache(maxsize=1 << 14)
def german_number(word: str) -> int | None:
    """The value of a German compound such as zweihundertfünfunddreißigtausend; None if the word is none."""

    def below_hundred(w: str) -> int | None:
        if w in _DE_PART:
            return _DE_PART[w]
        at = w.find("und", 2)  # dreiundzwanzig
        if at > 0 and w[:at] in _DE_PART and _DE_PART[w[:at]] < 10:
            tens = _DE_PART.get(w[at + 3 :])
            return tens + _DE_PART[w[:at]] if tens is not None and tens >= 20 else None
        return None

    def below_thousand(w: str) -> int | None:
        head, mark, tail = w.partition("hundert")
        if not mark:
            return below_hundred(w)
        n = 1 if not head else _DE_PART.get(head)
        rest = 0 if not tail else below_hundred(tail.removeprefix("und") if tail.startswith("und") else tail)
        return None if n is None or n > 9 or rest is None else n * 100 + rest

    w = word.lower()
    if len(w) < 3 or len(w) > 80:
        return None
    head, mark, tail = w.partition("tausend")
    if not mark:
        return below_thousand(w) if w not in ("ein", "eine") else None
    n = 1 if not head else below_thousand(head)
    rest = 0 if not tail else below_thousand(tail.removeprefix("und") if tail.startswith("und") else tail)
    return None if n is None or rest is None else n * 1000 + rest


_WORD = re.compile(r"[^\W\d_]+")


def number_words(text: str, german: bool | None = None) -> list[tuple[int, int, float, bool]]:
    """(start, end, value, claim) of the number words of a text. One below ten claims something only with a unit or a scale behind it."""
    found: list[tuple[int, int, float, bool]] = []
    tokens = [(m.start(), m.end(), m.group().lower()) for m in _WORD.finditer(text)]
    i = 0
    while i < len(tokens):
        a, b, w = tokens[i]
        j, value, scaled = i, None, False
        if german is not True and (w in _EN or (w in ("a", "an") and i + 1 < len(tokens) and tokens[i + 1][2] in _EN_SCALE)):
            total = run = scale = 0
            open_tens = False
            while j < len(tokens):
                x = tokens[j][2]
                gap = text[tokens[j - 1][1] : tokens[j][0]] if j > i else ""
                if j > i and not re.fullmatch(r"[ \-]{1,2}", gap):
                    break
                if x in _EN and (j == i or (_EN[x] < 10 and open_tens) or (run and run % 100 == 0) or (not run and total)):
                    run += _EN[x]
                    open_tens = _EN[x] >= 20
                elif x in ("a", "an") and j == i:
                    run = 1
                elif x == "hundred" and 0 < run < 100:
                    scaled, run = True, run * 100
                elif x in _EN_SCALE and x != "hundred" and run and not (total and _EN_SCALE[x] >= scale):
                    scaled, scale = True, _EN_SCALE[x]
                    total, run = total + run * scale, 0
                    open_tens = False
                elif x == "and" and scaled and j + 1 < len(tokens) and tokens[j + 1][2] in _EN:
                    pass
                else:
                    break
                j += 1
            value = float(total + run)
        elif german is not False and (n := german_number(w)) is not None:
            value, j = float(n), i + 1
            if j < len(tokens) and tokens[j][2] in _DE_SCALE and text[tokens[j - 1][1] : tokens[j][0]] == " ":
                value, scaled, j = value * _DE_SCALE[tokens[j][2]], True, j + 1
        elif german is not False and w in ("ein", "eine") and i + 1 < len(tokens) and tokens[i + 1][2] in _DE_SCALE:
            value, scaled, j = float(_DE_SCALE[tokens[i + 1][2]]), True, i + 2
        elif w in FACTORS:
            value, scaled, j = FACTORS[w], True, i + 1
        if value is None:
            i += 1
            continue
        unit = j < len(tokens) and tokens[j][2] in UNITS
        found.append((a, tokens[j - 1][1], value, scaled or unit or value >= 10))
        i = j
    return found


# --- scanning ---------------------------------------------------------------------------------------------------------------------

_IDENTIFIER = re.compile(r"(?<![\w])(?=[\w\-]*\d)(?=[\w\-]*[^\W\d_])[^\W_]+(?:-[^\W_]+)*(?![\w])")
_DIGITS = re.compile(r"(?<![\w.,])\d+(?:[.,'’]\d+)*(?:[  ]\d{3}(?!\d))*(?:[.,]\d+)?(?![\w])")
_NEXT = re.compile(r"[  ]\d")


@dataclass(frozen=True)
class Item:
    kind: str  # number, word, identifier, joined
    start: int
    end: int
    raw: str
    values: tuple[float, ...] = ()
    claim: bool = True


def scanned(text: str, german: bool | None = None) -> list[Item]:
    """Numbers, number words, identifiers and doubtful joins, in the order of the text; none overlaps another."""
    out, taken = [], bytearray(len(text))

    def put(item: Item) -> None:
        if not any(taken[item.start : item.end]):
            taken[item.start : item.end] = b"\x01" * (item.end - item.start)
            out.append(item)

    for m in _IDENTIFIER.finditer(text):
        put(Item("identifier", *m.span(), m.group()))
    for m in _DIGITS.finditer(text):
        raw = m.group().rstrip(".,")
        end = m.start() + len(raw)
        if _NEXT.match(text, end) and "." not in raw and "," not in raw:  # "4 80": digits that a reader might join
            tail = re.match(r"[  ]\d+", text[end:])
            put(Item("joined", m.start(), end + tail.end(), text[m.start() : end + tail.end()]))
            continue
        clean = raw.replace("'", "").replace("’", "")
        try:
            put(Item("number", m.start(), end, raw, tuple(dict.fromkeys(abs(x) for x in readings(clean)))))
        except ValueError:
            put(Item("number", m.start(), end, raw, ()))
    for a, b, value, claim in number_words(text, german):
        put(Item("word", a, b, text[a:b], (value,), claim))
    return sorted(out, key=lambda x: x.start)


@dataclass
class Source:
    """What a source holds: values in digits or words, numbers as written, identifiers."""

    values: set[float] = field(default_factory=set)
    written: set[str] = field(default_factory=set)
    tokens: set[str] = field(default_factory=set)


def indexed(text: str | None) -> Source:
    s = Source()
    for item in scanned(text or ""):
        s.values.update(round(v, 6) for v in item.values)
        if item.kind == "number":
            s.written.add(item.raw)
        elif item.kind == "identifier":
            s.tokens.add(item.raw.lower())
        elif item.kind == "joined":
            s.written.update(item.raw.split())
            s.values.update(float(x) for x in item.raw.split() if x.isdigit())
    return s


# --- judging ----------------------------------------------------------------------------------------------------------------------

_LABEL = re.compile(r"\[(?:[SF]\d{1,3}(?:\s*[,;]\s*[SF]\d{1,3})*|(?:Doc|Source|Quelle)\s*:[^\]\n]{1,300})\]", re.I)
_MARKS = re.compile(r"^\s*(?:#{1,6}|>|[-+*])(?=\s)|[*`|]", re.M)  # of Markdown; they become blanks, so that offsets stay
_LINK = re.compile(r"(?:https?://|www\.)\S+", re.I)
_BAD = re.compile(disallowed().replace(r"\p{L}\p{M}\p{N}", r"\w").replace("[^\\w", "[^\\w_"))


def judged(unit: str, sources: dict[str, Source], verbatim: bool = True, segments: list[tuple[int, int]] | None = None) -> tuple[str, str] | None:
    """(reason, token) why a unit is withheld, ("", "") if it passes, None if it holds labels alone.

    ``sources``: indexed sources by label, lower case. With ``segments`` (web mode) a claim must lie inside one of these spans instead.
    """
    cited: list[Source] = []
    bare = unit
    for m in _LABEL.finditer(unit):
        bare = bare[: m.start()] + " " * (m.end() - m.start()) + bare[m.end() :]
        names = [f"[{p.strip().lower()}]" for p in re.split("[,;]", m.group()[1:-1])] if re.match(r"\[[SF]\d", m.group(), re.I) else [m.group().lower()]
        for name in names:
            if segments is None and name not in sources:
                return "unknown_source", m.group()
            if name in sources:
                cited.append(sources[name])
    bare = _MARKS.sub(lambda m: " " * len(m.group()), bare)
    if not bare.strip():
        return None
    if m := _BAD.search(bare):
        return "chars", m.group()
    if m := _LINK.search(bare):
        return "link", m.group()
    items = scanned(bare)
    inside = lambda x: any(a <= x.start and x.end <= b for a, b in segments or ())
    for x in items:
        if x.kind == "joined":
            return "joined", x.raw
    for x in items:
        if x.kind == "identifier":
            if verbatim and not (inside(x) if segments is not None else any(x.raw.lower() in s.tokens for s in cited)):
                return "identifier", x.raw
        elif x.claim:
            if segments is not None:
                if not inside(x):
                    return ("number_word" if x.kind == "word" else "web_ungrounded"), x.raw
            elif not any((x.kind == "number" and x.raw in s.written) or any(round(v, 6) in s.values for v in x.values) for s in cited):
                return ("number_word" if x.kind == "word" else "unsupported_number"), x.raw
    return "", ""


def checked(text: str, sources: dict[str, str], **options: bool) -> list[tuple[int, int, str, str]]:
    """(start, end, reason, token) of the sentences of an answer; an empty reason is a released one."""
    index = {k.lower(): indexed(v) for k, v in sources.items()}
    out = []
    for a, b in cuts.sentences(text):
        j = judged(text[a:b], index, **options)
        if j is not None:
            out.append((a, b, *j))
    return out


def units(pieces: Iterable[str]) -> Iterator[str]:
    """Sentences of a stream of text pieces as soon as they are certain: a sentence is held until the next one has begun. Where the pieces are cut
    makes no difference; the last one comes at the end."""
    held = ""
    for p in pieces:
        held += p
        if not re.search(r"[.!?…\n]", p):
            continue
        spans = cuts.sentences(held)
        if len(spans) > 1:
            for a, b in spans[:-1]:
                yield held[a:b]
            held = held[spans[-1][0] :]
    for a, b in cuts.sentences(held):
        yield held[a:b]


# --- frames -----------------------------------------------------------------------------------------------------------------------


def gated(answers: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, start, end, reason, token) of the sentences of answers against one source text each, which every sentence cites."""
    kind = answers.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t, s in zip(b["_i"], b["_t"], b["_s"]):
                index = {"[s1]": indexed(s)}
                for a, e in cuts.sentences(t):
                    j = judged(t[a:e] + " [S1]", index)
                    if j is not None:
                        out.append((i, a, e, *j))
            yield pd.DataFrame(out, columns=[id_col, "start", "end", "reason", "token"])

    base = answers.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t"), F.col(source_col).alias("_s"))
    return base.mapInPandas(run, f"`{id_col}` {kind}, start int, end int, reason string, token string")
