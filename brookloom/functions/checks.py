"""Checking a statement against its sources: facts, words, names, negation, direction of change, comparisons, order in time.

``ground`` gives a verdict: ``unsupported`` if a fact or a name stands in no source, ``weak`` if the sources share too few of the
statement's words or say the opposite (negation, direction, comparison, order), ``supported`` otherwise, ``unchecked`` for a statement
without words to check. Reasons name what was found, the deciding one first. Relations are judged only between clauses that
speak of the same: those that share most words.

Defined cases: a question, a heading or an empty text is unchecked; without sources every fact is missing; null sources hold nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookloom.functions import words
from brookloom.functions.cuts import sentences
from brookloom.functions.facts import facts

NEGATIONS = set("not no never none neither nor without cannot nobody nothing nicht kein keine keinen keinem keiner nie niemals ohne weder niemand nichts pas jamais aucun aucune sans ni rien personne nunca jamás sin ningún ninguna tampoco nadie nada".split())
RESTRICTS = set("only nur lediglich bloß seulement uniquement solo sólo solamente únicamente unless".split())
RISES = set("rose rise rises risen increased increase increases grew grow grown gained climbed doubled up higher stieg steigt stiegen gestiegen erhöht erhöhte wuchs gewachsen zunahm verdoppelte höher augmenté augmente augmentation hausse monté doublé subió sube aumentó aumenta creció duplicó".split())
FALLS = set("fell fall falls fallen decreased decrease decreases dropped drop drops shrank shrunk declined halved down lower sank sinkt gesunken fiel gefallen verringert reduzierte halbierte niedriger baissé baisse diminué chute réduit bajó baja cayó disminuyó redujo".split())
MORE = set("more above over exceeds exceeded larger greater longer mehr über größer länger plus dépasse más supera mayor".split())
LESS = set("less fewer below under smaller shorter weniger unter kleiner kürzer moins menos menor inferior".split())
BEFORE = set("before earlier prior vor vorher bevor avant antes".split())
AFTER = set("after later since following nach nachher nachdem après depuis después desde".split())
OVERLAP = 0.5
SHARED, FORWARD, BACK = 2, 0.6, 0.5
_STOP = {*words.STOP_EN, *words.STOP_DE}
_SPOKEN = NEGATIONS | RESTRICTS | RISES | FALLS | MORE | LESS | BEFORE | AFTER
_WORD = re.compile(r"[^\W_]+")
_CUT = re.compile(r"[;:,–—]|\b(?:but|because|although|while|whereas|aber|weil|obwohl|während|sondern|mais|car|bien que|tandis|pero|porque|aunque|mientras)\b", re.I)
_LABEL = re.compile(r"\[(?:[SF]\d{1,3}|(?:Doc|Source|Quelle)\s*:[^\]\n]*)\]", re.I)
_NAME = re.compile(r"(?<![.!?]\s)(?<!^)\b[A-ZÀ-ÖØ-Þ][^\W\d_]+(?:\s+[A-ZÀ-ÖØ-Þ][^\W\d_]+)*")


def bare(text: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[*_`>#]+", " ", _LABEL.sub(" ", text))).strip()


def folded(w: str) -> str:
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        w = w.replace(a, b)
    return w


def content(text: str) -> list[str]:
    """The distinct words that carry a statement: no function words, numbers or words of relation; inflection cut off after six letters."""
    ws = (folded(w.lower()) for w in _WORD.findall(text))
    return list(dict.fromkeys(w[:6] for w in ws if len(w) >= 3 and w not in _STOP and w not in _SPOKEN and not any(c.isdigit() for c in w)))


@dataclass
class Clause:
    text: str
    words: set[str]
    negated: bool
    restricted: bool
    rise: int
    more: int
    time: int
    keys: list[str]


def clause(text: str) -> Clause:
    low = [w.lower() for w in _WORD.findall(text.replace("n't", " not").replace("n’t", " not"))]
    have = set(low)
    sign = lambda up, down: bool(have & up) - bool(have & down)
    found = facts(text, source=True)
    return Clause(text, set(content(text)), sum(w in NEGATIONS for w in low) % 2 == 1, bool(have & RESTRICTS), sign(RISES, FALLS), sign(MORE, LESS), sign(BEFORE, AFTER), [k for f in found for k in f[4]])


def clauses(text: str) -> list[Clause]:
    """The clauses of a text. Parts without two words of their own belong to the one before."""
    parts: list[str] = []
    for piece in _CUT.split(text):
        if parts and len(content(piece)) < 2:
            parts[-1] += " " + piece
        elif piece.strip():
            parts.append(piece)
    return [clause(p) for p in parts]


@dataclass
class Evidence:
    """What the sources of a statement hold."""

    keys: set[str]
    words: set[str]
    text: str
    clauses: list[Clause]


def evidence(sources: list[str | None]) -> Evidence:
    text = "\n".join(s for s in sources if s)
    parts = [c for a, b in sentences(text) for c in clauses(bare(text[a:b]))]
    return Evidence({k for f in facts(text, source=True) for k in f[4]}, set(content(text)), text.lower(), parts)


def _alike(own: Clause, e: Evidence) -> list[Clause]:
    """The source clauses that speak of the same, the best covered only."""
    best: list[tuple[int, Clause]] = []
    for c in e.clauses:
        n = len(own.words & c.words)
        if n >= SHARED and n >= FORWARD * len(own.words) and n >= BACK * len(c.words):
            best.append((n, c))
    top = max((n for n, _ in best), default=0)
    return [c for n, c in best if n == top]


def relations(statement: str, e: Evidence) -> list[str]:
    """negation, direction, comparison, order: where all source clauses that speak of the same say the opposite; misplaced_value: where they have another
    value and the statement's belongs to something else."""
    out = []
    for own in clauses(statement):
        others = _alike(own, e)
        if not others:
            continue
        if all(c.negated != own.negated and c.restricted == own.restricted for c in others):
            out.append("negation")
        for kind in ("rise", "more", "time"):
            mine = getattr(own, kind)
            if mine and all(getattr(c, kind) == -mine and c.negated == own.negated for c in others):
                out.append({"rise": "direction", "more": "comparison", "time": "order"}[kind])
        # a value that the sources give to something else, while what the clause speaks of has another one of its kind
        for key in own.keys:
            holders = [c for c in e.clauses if key in c.keys]
            if holders and not any(key in c.keys for c in others) and any(k[:2] == key[:2] for c in others for k in c.keys) and max(len(own.words & c.words) for c in holders) < FORWARD * len(own.words):
                out.append("misplaced_value")
    return list(dict.fromkeys(out))


def ground(statement: str, e: Evidence) -> tuple[str, list[str], float | None]:
    """(verdict, reasons, overlap)."""
    text = bare(statement)
    own = content(text)
    claims = facts(text)
    if not text or text.endswith("?") or (not claims and len(own) < 2):
        return "unchecked", [], None
    reasons = [f"{f[0]}_missing" for f in claims if not set(f[4]) & e.keys]
    reasons += ["name_missing" for m in _NAME.finditer(text) if not all(w in e.text for w in m.group().lower().split())]
    share = round(sum(w in e.words for w in own) / len(own), 3) if len(own) >= 3 else None
    hard = bool(reasons)
    if share is not None and share < OVERLAP:
        reasons.append("few_words")
    reasons += relations(text, e)
    return "unsupported" if hard else "weak" if reasons else "supported", list(dict.fromkeys(reasons)), share


def grounded(statements: DataFrame, id_col: str, text_col: str, sources_col: str) -> DataFrame:
    """(id, verdict, reasons, overlap) of statements, each with an array of the texts it cites."""
    kind = statements.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, None
        for b in batches:
            out = []
            for i, t, s in zip(b["_i"], b["_t"], b["_s"]):
                key = tuple(s) if s is not None else ()
                if key != last:  # neighbouring statements mostly cite the same
                    last, held = key, evidence(list(key))
                out.append((i, *ground(t, held)))
            yield pd.DataFrame(out, columns=[id_col, "verdict", "reasons", "overlap"]).astype({"overlap": "float64"})

    base = statements.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t"), F.col(sources_col).alias("_s"))
    return base.mapInPandas(run, f"`{id_col}` {kind}, verdict string, reasons array<string>, overlap double")


def grounded_sentences(answers: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, start, verdict, reasons, overlap) of the sentences of answers against one source text each. The source travels once for each answer;
    answers of the same source that follow each other share its reading."""
    kind = answers.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, evidence([])
        for b in batches:
            out = []
            for i, t, s in zip(b["_i"], b["_t"], b["_s"]):
                if s != last:
                    last, held = s, evidence([s])
                out += [(i, a, *ground(t[a:e], held)) for a, e in sentences(t)]
            yield pd.DataFrame(out, columns=[id_col, "start", "verdict", "reasons", "overlap"]).astype({"overlap": "float64"})

    base = answers.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t"), F.col(source_col).alias("_s"))
    return base.mapInPandas(run, f"`{id_col}` {kind}, start int, verdict string, reasons array<string>, overlap double")
