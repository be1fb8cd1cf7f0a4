"""Garbled text from wrong character encoding.

Method: for every pair (UTF-8 bytes, wrong decoder), once and twice over, the garbled sequence of every character of a repertoire
is computed from Python's codecs, not listed. One multi-pattern automaton finds all of them in a single pass over a text; of
overlapping matches the first and longest counts. Only matched spans are replaced, correct text beside them stays as it is.

What keeps correct text safe:
* a span with Cyrillic, Greek or box-drawing characters counts only when no neighbour outside any span is of that same script
  (a Ukrainian or Greek word, a drawn table); one of box-drawing characters alone needs a letter beside it or another match;
* sequences of rare characters (``weak``: Latin Extended, Vietnamese, Greek, Cyrillic, small figures, currencies, arrows, pictographs) count when they have three
  characters, hold a sign amid the letters of a word, or a second match of the same decoder stands in the text;
* control characters U+0080-U+009F never occur in correct text, except U+0085 (next line); they are Windows-1252 bytes read as
  Latin-1. U+FFFD marks lost characters: the record is reported, the character stays.

A sequence that two decoders share goes to the decoder with more matches in the text.

Defined cases: null or empty text gives no row; a byte order mark (U+FEFF) is correct text, its garbled forms are not; texts of any
length are read whole; repeated rows give one row each; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Wrong decoders, the likelier first.
DECODERS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "iso8859-15", "cp1250", "koi8-r", "cp866")
#: Decoders that are also applied twice.
TWICE = ("cp1252", "latin-1", "mac_roman", "cp850")
LOST = "�"
FLAT = re.compile(r"(?<![^\W_])Ã (?=\W|\w)")


def _range(*spans: tuple[int, int]) -> list[str]:
    return [chr(c) for a, b in spans for c in range(a, b + 1)]


def strong_characters() -> list[str]:
    """Letters, signs and punctuation of Western European text."""
    return _range((0xA0, 0xFF), (0x152, 0x153), (0x160, 0x161), (0x178, 0x178), (0x17D, 0x17E), (0x2010, 0x2030), (0x2039, 0x203A), (0x20AC, 0x20AC), (0x2122, 0x2122), (0xFEFF, 0xFEFF))


def weak_characters() -> list[str]:
    return [c for c in _range((0x100, 0x24F), (0x391, 0x3C9), (0x401, 0x45F), (0x1E00, 0x1EFF), (0x2031, 0x205E), (0x2070, 0x209C), (0x20A0, 0x20BF), (0x2100, 0x21FF), (0x2200, 0x22FF), (0x25A0, 0x27BF), (0x1F300, 0x1F6FF), (0x1F900, 0x1F9FF)) if c not in set(strong_characters())]


@lru_cache(maxsize=None)
def _byte_table(decoder: str) -> tuple[str, ...]:
    """What each byte becomes; bytes the decoder has no character for stay as control characters, as lenient readers do."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(decoder))
        except UnicodeDecodeError:
            out.append(chr(b))
    return tuple(out)


def garble(text: str, decoder: str) -> str:
    return "".join(_byte_table(decoder)[b] for b in text.encode("utf-8"))


def _script(c: str) -> str:
    o = ord(c)
    return "cyrillic" if 0x400 <= o <= 0x52F else "greek" if 0x370 <= o <= 0x3FF and c.isalpha() else "box" if 0x2500 <= o <= 0x259F else ""


@lru_cache(maxsize=1)
def patterns() -> dict[str, tuple[dict[str, str], bool]]:
    """Garbled sequence -> ({decoder: original}, strong)."""
    found: dict[str, tuple[dict[str, str], bool]] = {}

    def put(seq: str, decoder: str, original: str, strong: bool) -> None:
        if len(seq) > 1 or ord(seq) in range(0x80, 0xA0):
            choices, before = found.get(seq, ({}, False))
            choices.setdefault(decoder, original)
            found[seq] = (choices, before or strong or any(0x80 <= ord(c) < 0xA0 for c in seq))

    for strong, chars in ((True, strong_characters()), (False, weak_characters())):
        for c in chars:
            for d in DECODERS:
                once = garble(c, d)
                put(once, d, c, strong)
                if d in TWICE:
                    put(garble(once, d), d, c, strong)
    for b in range(0x80, 0xA0):
        if b != 0x85 and (c := _byte_table("cp1252")[b]) != chr(b):
            put(chr(b), "cp1252", c, True)
    return found


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for seq in patterns():
        a.add_word(seq, seq)
    a.make_automaton()
    return a


def suspicious(text: str) -> Column:
    """A necessary condition on the JVM side: some pattern's first character, or U+FFFD, is there."""
    first = sorted({p[0] for p in patterns()} | {LOST})
    return F.col(text).rlike("[" + "".join(f"\\x{{{ord(c):X}}}" for c in first) + "]")


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, original) of the garbled places that can be restored, in order, without overlap."""
    table = patterns()
    hits = [(end + 1 - len(seq), end + 1, seq) for end, seq in automaton().iter(text)]
    if not hits:
        return []
    hits.sort(key=lambda h: (h[0], -h[1]))
    kept, reach = [], 0
    for h in hits:
        if h[0] >= reach:
            kept.append(h)
            reach = h[1]
    inside = {i for a, b, _ in kept for i in range(a, b)}

    def beside(a: int, b: int) -> list[str]:
        return [text[i] for i in (a - 1, b) if 0 <= i < len(text) and i not in inside]

    def native(a: int, b: int, seq: str) -> bool:
        return bool(({_script(c) for c in seq} - {""}) & {_script(c) for c in beside(a, b)})

    def drawn(a: int, b: int, seq: str) -> bool:
        return all(_script(c) == "box" for c in seq) and not any(c.isalpha() for c in beside(a, b)) and not inside & {a - 1, b}

    def inner(a: int, b: int, seq: str) -> bool:
        return any(not c.isalnum() for c in seq) and a > 0 and b < len(text) and text[a - 1].isalpha() and text[b].islower()

    kept = [h for h in kept if not native(*h)]
    votes = Counter(d for h in kept if not drawn(*h) for d in table[h[2]][0])
    kept = [h for h in kept if not drawn(*h) or any(votes[d] for d in table[h[2]][0])]
    # a no-break space that was flattened later: "Ã " alone is "à" when the text is garbled the same way elsewhere
    if votes["cp1252"]:
        kept += [(m.start(), m.end(), m.group()) for m in FLAT.finditer(text) if m.start() not in inside]
        kept.sort()
    out = []
    for a, b, seq in kept:
        choices, strong = table.get(seq, ({"cp1252": "à"}, True))
        best = max(choices, key=lambda d: (votes[d], -DECODERS.index(d)))
        if strong or len(seq) >= 3 or votes[best] > 1 or inner(a, b, seq):
            out.append((a, b, choices[best]))
    return out


def restore(text: str) -> tuple[str, int, int]:
    """(restored text, places restored, characters lost for good)."""
    out, at, found = [], 0, spans(text)
    for a, b, c in found:
        out += [text[at:a], c]
        at = b
    out.append(text[at:])
    return "".join(out), len(found), text.count(LOST)


def garbled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, restored, lost, text): the affected records with the text as far as it can be restored. No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, restored int, lost int, text string"
    rows = docs.filter(F.col(text_col).isNotNull()).filter(suspicious(text_col)).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [(i, *restore(t)) for i, t in zip(b["_id"], b["_text"])]
            yield pd.DataFrame([(i, n, lost, t) for i, t, n, lost in done if n or lost], columns=[id_col, "restored", "lost", "text"])

    return rows.mapInPandas(run, schema)
