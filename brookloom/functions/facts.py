"""Facts in statements: quotations, versions, dates, times, codes and numbers with canonical keys, so that a claim and a source
meet by an equi-join on keys.

Keys: ``q:words`` ``v:4.2.1`` ``d:2026-08-28`` ``d:--08-28`` ``m:2026-08`` ``m:--08`` ``w:1`` (Monday) ``t:14:30`` ``c:qx12`` ``n:480000``. Earlier kinds mask
their span for later ones. A number whose separator precedes exactly three digits has two readings; a claim takes the likelier one
(thousands), a source offers both.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MONTHS = {
    "en": "january february march april may june july august september october november december",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
}
_MONTH = {w: i + 1 for names in MONTHS.values() for i, w in enumerate(names.split())}
_M = "|".join(sorted(_MONTH, key=len, reverse=True))

_QUOTE = re.compile(r"[“„«\"]\s?([^“”„«»\"\n]{3,200}?)\s?[”“»\"]")
_VERSION = re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,4}){2,3}(?![\d.])(?!\d)")
_DATES = (
    (re.compile(r"\b(\d{4})-(\d{2})-(\d{2})\b"), "ymd"),
    (re.compile(r"\b(\d{1,2})\.(\d{1,2})\.(\d{4})\b"), "dmy"),
    (re.compile(rf"\b(\d{{1,2}})(?:\.|st|nd|rd|th|er)?\s+(?:de\s+)?({_M})\s+(?:de\s+)?(\d{{4}})\b", re.I), "dMy"),
    (re.compile(rf"\b({_M})\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})\b", re.I), "Mdy"),
    (re.compile(rf"\b({_M})\s+(?:de\s+)?(\d{{4}})\b", re.I), "My"),
    (re.compile(rf"\b(\d{{1,2}})\.?\s+(?:de\s+)?({_M})\b", re.I), "dM"),
    (re.compile(rf"\b({_M})\s+(\d{{1,2}})(?:st|nd|rd|th)?\b(?!\s*[:.]\d)", re.I), "Md"),
    (re.compile(r"(?<![\d/])(\d{1,2})/(\d{1,2})/(\d{4})(?![\d/])"), "xx"),
    (re.compile(r"(?<![\d/])(\d{1,2})/(\d{4})(?![\d/])"), "mY"),
    (re.compile(r"(?<![\d.,])(\d{1,2})\.(\d{1,2})\.(?!\d)"), "dm"),
)
_HOUR = re.compile(r"\b([01]?\d|2[0-4])\s+(?:Uhr|o'clock)\b", re.I)
WEEKDAYS = (
    "monday tuesday wednesday thursday friday saturday sunday", "montag dienstag mittwoch donnerstag freitag samstag sonntag",
    "lundi mardi mercredi jeudi vendredi samedi dimanche", "lunes martes miércoles jueves viernes sábado domingo",
)
_DAY = {w: i + 1 for names in WEEKDAYS for i, w in enumerate(names.split())}
_DAYS = re.compile(r"\b(" + "|".join(sorted(_DAY, key=len, reverse=True)) + r")s?\b", re.I)
_ANY_MONTH = re.compile(rf"\b({_M})\b", re.I)
#: A month by itself claims something after such a word only: "may" is mostly no month.
_IN_MONTH = re.compile(rf"\b(?:in|since|until|by|from|early|late|im|seit|bis|ab|anfang|ende|en|depuis|desde|hasta)\s+({_M})\b", re.I)
_TIME = re.compile(r"\b([01]?\d|2[0-3])[:h]([0-5]\d)\b(?:\s*(am|pm))?|\b(1[0-2]|0?[1-9])(?:\.([0-5]\d))?\s*(am|pm)\b", re.I)
_CODE = re.compile(r"\b[A-Z]{1,4}-?\d{1,6}\b")
_NUMBER = re.compile(r"(?<![\w.,])[-−]?\d+(?:[.,  ]\d{3})*(?:[.,]\d+)?(?![\w])")
_SCALE = {"thousand": 1e3, "tausend": 1e3, "mille": 1e3, "mil": 1e3, "million": 1e6, "millions": 1e6, "millionen": 1e6, "mio": 1e6, "millones": 1e6, "millón": 1e6, "billion": 1e9, "milliarde": 1e9, "milliarden": 1e9, "mrd": 1e9, "milliards": 1e9}
_UNIT = re.compile(r"\s?(%|€|\$|£|°C?|EUR|CHF|USD|[^\W\d_]+)")


def number_key(x: float) -> str:
    """Six decimals at most, no trailing zeros, no sign."""
    return "n:" + (f"{abs(x):.6f}".rstrip("0").rstrip("."))


def readings(text: str) -> list[float]:
    """All readings of a run of digits, the likelier first."""
    t = text.replace("−", "-").replace(" ", " ").replace(" ", "")
    marks = [c for c in t if c in ".,"]
    if not marks:
        return [float(t)]
    last = max(t.rfind("."), t.rfind(","))
    head, tail = t[:last].replace(".", "").replace(",", ""), t[last + 1 :]
    whole, parted = float(head + tail), float(f"{head}.{tail}")
    if len(set(marks)) == 2:
        return [parted]
    if len(marks) > 1:
        return [whole]
    if len(tail) == 3 and head not in ("0", "-0", "", "-"):
        return [whole, parted]
    return [parted]


def _valid(y: int, m: int, d: int) -> bool:
    return 1 <= m <= 12 and 1 <= d <= (29 if m == 2 and (y == 0 or y % 4 == 0 and (y % 100 or y % 400 == 0)) else [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][m - 1])


def _date_keys(kind: str, g: tuple[str, ...]) -> list[str | None]:
    """The readings of a date: two where day and month could be either."""
    if kind == "xx":
        return list(dict.fromkeys([_date_key("dmy", g), _date_key("dmy", (g[1], g[0], g[2]))]))
    if kind == "mY":
        return [f"m:{int(g[1]):04}-{int(g[0]):02}" if 1 <= int(g[0]) <= 12 else None]
    return [_date_key(kind, g)]


def _date_key(kind: str, g: tuple[str, ...]) -> str | None:
    name = lambda w: _MONTH[w.lower()]
    y, m, d = {
        "ymd": lambda: (int(g[0]), int(g[1]), int(g[2])),
        "dmy": lambda: (int(g[2]), int(g[1]), int(g[0])),
        "dMy": lambda: (int(g[2]), name(g[1]), int(g[0])),
        "Mdy": lambda: (int(g[2]), name(g[0]), int(g[1])),
        "My": lambda: (int(g[1]), name(g[0]), 0),
        "dM": lambda: (0, name(g[1]), int(g[0])),
        "Md": lambda: (0, name(g[0]), int(g[1])),
        "dm": lambda: (0, int(g[1]), int(g[0])),
    }[kind]()
    if kind == "My":
        return f"m:{y:04}-{m:02}"
    if not _valid(y, m, d):
        return None
    return f"d:{y:04}-{m:02}-{d:02}" if y else f"d:--{m:02}-{d:02}"


def facts(text: str, source: bool = False) -> list[tuple[str, str, int, int, list[str]]]:
    """(kind, surface, start, end, keys) in the order of the text. ``source`` reads leniently: all readings, years of dates as numbers."""
    hidden = list(text)
    out: list[tuple[str, str, int, int, list[str]]] = []

    def put(kind: str, a: int, b: int, keys: list[str]) -> None:
        out.append((kind, text[a:b], a, b, keys))
        hidden[a:b] = "\x00" * (b - a)

    for m in _QUOTE.finditer(text):
        ws = re.findall(r"[^\W_]+", m.group(1).lower())
        if len(ws) >= 2:
            if source:
                out.append(("quote", m.group(), *m.span(), ["q:" + " ".join(ws)]))
            else:
                put("quote", *m.span(), ["q:" + " ".join(ws)])
    # what a later kind sees no longer holds what an earlier one took
    for kind_of, rx in (("version", _VERSION),):
        for m in rx.finditer("".join(hidden)):
            if not re.fullmatch(r"\d{1,2}\.\d{1,2}\.\d{4}", m.group()):
                put(kind_of, *m.span(), ["v:" + m.group()])
    for rx, kind in _DATES:
        for m in rx.finditer("".join(hidden)):
            found = [k for k in _date_keys(kind, m.groups()) if k]
            if found:
                key, keys = found[0], found if source else found[:2]
                year = re.match(r"[dm]:(\d{4})", key)
                if source and year:
                    keys = keys + ["n:" + str(int(year.group(1)))] + ([f"d:--{key[7:]}", f"m:{key[2:9]}"] if key[0] == "d" else [])
                if source:
                    month = re.match(r"(?:d|m):(?:\d{4}|-)-(\d\d)", key)
                    keys = keys + ([f"m:--{month.group(1)}"] if month else [])
                put("date", *m.span(), keys)
    for m in _TIME.finditer("".join(hidden)):
        h, mi, half = (m.group(1), m.group(2), m.group(3)) if m.group(1) else (m.group(4), m.group(5) or "00", m.group(6))
        hour = int(h) % 12 + (12 if half.lower() == "pm" else 0) if half else int(h)
        put("time", *m.span(), [f"t:{hour:02}:{mi}"] + ([number_key(float(hour))] if source else []))
    for m in _HOUR.finditer("".join(hidden)):
        put("time", *m.span(), [f"t:{int(m.group(1)) % 24:02}:00"] + ([number_key(float(m.group(1)))] if source else []))
    for m in _DAYS.finditer("".join(hidden)):
        put("weekday", *m.span(), [f"w:{_DAY[m.group(1).lower()]}"])
    for m in (_ANY_MONTH if source else _IN_MONTH).finditer("".join(hidden)):
        put("month", *m.span(1), [f"m:--{_MONTH[m.group(1).lower()]:02}"])
    for m in _CODE.finditer("".join(hidden)):
        put("code", *m.span(), ["c:" + m.group().lower().replace("-", "")])
    plain = "".join(hidden)
    for m in _NUMBER.finditer(plain):
        values = readings(m.group())
        unit = _UNIT.match(plain, m.end())
        scale = _SCALE.get(unit.group(1).lower().rstrip("."), 1.0) if unit else 1.0
        keys = [number_key(v * scale) for v in values]
        if source:
            keys += [number_key(v) for v in values if scale != 1.0]
        else:
            measured = bool(unit) and (scale != 1.0 or not unit.group(1).isalpha() or unit.group(1) in ("EUR", "CHF", "USD"))
            if values[0] < 10 and values[0] == int(values[0]) and not measured:
                continue  # small bare integers claim nothing
            keys = keys[:1]
        put("number", *m.span(), list(dict.fromkeys(keys)))
    return sorted(out, key=lambda f: (f[2], f[3]))


FACTS = "kind string, surface string, start int, end int, keys array<string>"


def extracted(rows: DataFrame, id_col: str, text_col: str, source: bool = False) -> DataFrame:
    """A row for each fact of each text; null texts have none."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(i, *f) for i, t in zip(b["_i"], b["_t"]) for f in facts(t, source)]
            yield pd.DataFrame(out, columns=[id_col, "kind", "surface", "start", "end", "keys"])

    return rows.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t")).mapInPandas(run, f"`{id_col}` {kind}, {FACTS}")


def looked_up(claims: DataFrame, sources: DataFrame, claim: list[str], source: str) -> DataFrame:
    """claims (*claim, source, kind, surface, keys) with ``found``: exact when a key of the source equals one of the claim's, else
    missing. An equi-join on (source, key)."""
    c = claims.select(*claim, source, "kind", "surface", F.monotonically_increasing_id().alias("_n"), F.explode("keys").alias("key"))
    s = sources.select(source, F.explode("keys").alias("key")).distinct().withColumn("hit", F.lit(True))
    exact = c.join(s, [source, "key"], "left").groupBy("_n", *claim, source, "kind", "surface").agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("exact"), F.min("key").alias("key"))
    return exact.withColumn("found", F.when(F.col("exact"), "exact").otherwise("missing")).drop("_n", "exact")
