"""Word lists and tokenisers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words that carry no retrieval signal.
STOP_EN = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can could did do "
    "does doing down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me "
    "more most my no nor not now of off on once only or other our ours out over own same she should so some such than that the their theirs "
    "them then there these they this those through to too under until up very was we were what when where which while who whom why will with would "
    "you your yours"
).split()
STOP_DE = (
    "aber alle allem allen aller alles als also an andere anderen auch auf aus bei beim bin bis bist da damit dann das dass dein deine dem den "
    "denn der des dessen dich die dies diese diesem diesen dieser dieses dir doch dort du durch ein eine einem einen einer eines er es etwas euch "
    "euer eure für gegen gibt hab habe haben hat hatte hatten hier hin ich ihm ihn ihr ihre ihrem ihren ihrer im in ins ist ja jede jedem "
    "jeden jeder jedes jetzt kann kein keine können man mein meine mich mir mit muss nach nicht nichts noch nun nur ob oder ohne sehr sein seine "
    "sich sie sind so soll sollte sondern um und uns unser unsere unter vom von vor wann war waren warum was weil welche welchem welchen welcher "
    "welches wenn wer werde werden wie wieder will wir wird wo wurde wurden zu zum zur über"
).split()
# The shorter list of the local ranking.
STOP_LOCAL = (
    "der die das und oder aber ein eine einen einem einer ist sind war wer wie was wann wo warum welche welcher welches mit von für auf aus bei zu "
    "im in am an den dem des es ich du sie wir ihr mir mich uns nicht the and for what who how with about bitte mal gibt hat haben kann können"
).split()
# Words that do not count in the knowledge-base search.
STOP_SEARCH = (
    "a about an and are as at be by can did do does for from has have how in is it its of on or that the there this to was what when where which who why will with"
).split()

TOKEN = r"[\p{L}\p{N}][\p{L}\p{M}\p{N}]*"
WORD = r"[\p{L}\p{N}]+"


def lowered(text: Column) -> Column:
    """Lower case in which both Turkish forms of i read as i."""
    return F.regexp_replace(F.lower(F.regexp_replace(text, "İ", "i")), "ı", "i")


def tokens(text: Column, stop: list[str] | None = None) -> Column:
    """Search tokens in order: letters and digits with their marks, at least two characters, no function words. Null text has none."""
    drop = stop if stop is not None else [*STOP_EN, *STOP_DE]  # a hash set in the plan
    found = F.regexp_extract_all(lowered(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) >= 2) & ~w.isin(drop))


def local_tokens(text: Column) -> Column:
    """Tokens of the local ranking: longer than two characters, its own list of function words."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: (F.length(w) > 2) & ~w.isin(STOP_LOCAL))


def query_tokens(query: str) -> list[str]:
    """The distinct tokens of a query, in order, on the driver."""
    import re
    import unicodedata

    text = unicodedata.normalize("NFKC", query).replace("İ", "i").lower().replace("ı", "i")
    stop = {*STOP_EN, *STOP_DE}
    return list(dict.fromkeys(w for w in re.findall(r"[^\W_]+", text) if len(w) >= 2 and w not in stop))


def fold(text: Column) -> Column:
    """Case, umlauts, soft hyphens, line-break hyphens, quotes and dashes unified. Compatibility forms (NFKC) are left to ``nfkc``."""
    t = F.regexp_replace(text, "­", "")
    t = F.regexp_replace(t, r"(\p{L})-\n(\p{L})", "$1$2")
    t = lowered(t)
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(t, "[‘’‚‛′]", "'")
    t = F.regexp_replace(t, "[“”„‟«»″]", '"')
    return F.regexp_replace(t, "[‐‑‒–—―]", "-")


def name_key(text: Column) -> Column:
    """A name's key: folded, everything but letters and digits one blank."""
    return F.trim(F.regexp_replace(fold(text), r"[^\p{L}\p{N}]+", " "))


def fence_safe(text: Column) -> Column:
    """Runs of angle brackets can't open or close a fence any more."""
    return F.regexp_replace(F.regexp_replace(text, "<{2,}", "<"), ">{2,}", ">")


def _members(words: Column, of: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(of)))


def guess_language(text: Column, only: dict[str, list[str]], letters: dict[str, str]) -> Column:
    """The language with clearly the most function words that no other language has, or null."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))
    scores = []
    for lang in sorted(only):
        n = _members(words, only[lang])
        if lang in letters:
            n = n + F.when(F.lower(text).rlike(f"[{letters[lang]}]"), 1).otherwise(0)
        scores.append(F.struct(n.alias("n"), F.lit(lang).alias("lang")))
    ranked = F.sort_array(F.array(*scores), asc=False)
    top, second = ranked[0], ranked[1]
    return F.when((top["n"] > 0) & (second["n"] == 0), top["lang"]).when((top["n"] >= 2) & (top["n"] >= 2 * second["n"]), top["lang"])
