"""Cutting text: overlapping windows, sentences, Markdown sections; reading CSV, JSON and HTML text. Offsets are code points.

All functions take one text; ``exploded`` runs them over a column in Arrow batches.
"""

from __future__ import annotations

import csv
import html
import io
import json
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

_PARAGRAPH = re.compile(r"\n\n")
_SENTENCE_END = re.compile(r"[.!?…。](?=\s)")
_BLANK = re.compile(r"\s")
_HEADING = re.compile(r"^(#{1,4})\s+(.*\S)\s*$")
#: Words that end in a full stop without ending a sentence.
ABBREVIATIONS = set("z b u a d h bzw ca nr dr st usw vgl inkl ggf evtl etc mio mrd tsd prof abs tel inc corp ltd vs e g i mr mrs ms jr sr fig approx".split())


def windows(text: str, size: int = 500, overlap: int = 50) -> list[tuple[int, int, int]]:
    """(index, start, end) of windows of at most ``size`` characters that share ``overlap``.

    A window that doesn't reach the end of the text is cut in its last quarter: after the last blank line there, else after the last
    sentence, else after the last white space, else hard. Windows are trimmed; blank ones are dropped.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    cuts = [[m.end() for m in p.finditer(text)] for p in (_PARAGRAPH, _SENTENCE_END, _BLANK)]
    n, start, out = len(text), 0, []
    while start < n:
        end = min(start + size, n)
        if end < n:
            low = max(start + 1, end - size // 4)
            for kind, places in enumerate(cuts):
                # the cut's first character must lie in the last quarter, and what follows a sentence end inside the window
                k = bisect_left(places, end if kind == 1 else end + 1) - 1
                width = 2 if kind == 0 else 1
                if k >= 0 and places[k] - width >= low:
                    end = places[k]
                    break
        piece = text[start:end]
        left, right = len(piece) - len(piece.lstrip()), len(piece.rstrip())
        if right > left:
            out.append((len(out), start + left, start + right))
        if end >= n:
            break
        start = max(end - overlap, start + 1)
    return out


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of sentences. A line break ends one; so do . ! ? before white space, unless the stop belongs to an ordinal, a
    date or an abbreviation."""
    out: list[tuple[int, int]] = []

    def put(a: int, b: int) -> None:
        piece = text[a:b]
        s = piece.strip()
        if s:
            out.append((a + len(piece) - len(piece.lstrip()), a + len(piece.rstrip())))

    at = 0
    for line in text.split("\n"):
        end, a = at + len(line), at
        for m in re.finditer(r"[.!?]+[\"'”’»)\]]*(?=\s+\S)", line):
            w = m.start()  # back to where the word begins, so that long lines cost no more than their length
            while w and not line[w - 1].isspace():
                w -= 1
            word = line[w : m.start()].lstrip("(\"'„“«")
            stop = m.group()[0] == "." and len(m.group().rstrip("\"'”’»)]")) == 1
            if stop and (re.fullmatch(r"\d{1,2}(\.\d{1,2})?", word) or word.lower().split(".")[-1] in ABBREVIATIONS):
                continue
            put(a, at + m.end())
            a = at + m.end()
        put(a, end)
        at = end + 1
    return out


def markdown_sections(text: str, most: int = 1500) -> list[tuple[int, str, str, int]]:
    """(index, heading, content, words): sections at headings of level 1 to 4 outside code fences, cut at blank lines to ``most`` characters."""
    parts: list[tuple[str, list[str]]] = [("", [])]
    fenced = False
    for line in text.split("\n"):
        if line.lstrip().startswith("```"):
            fenced = not fenced
        m = None if fenced else _HEADING.match(line)
        if m:
            parts.append((m.group(2), []))
        else:
            parts[-1][1].append(line)
    out: list[tuple[int, str, str, int]] = []
    for heading, lines in parts:
        block = ""
        for para in re.split(r"\n\s*\n", "\n".join(lines)):
            para = para.strip("\n")
            while len(para) > most:
                cut = para.rfind(" ", 0, most)
                cut = cut if cut > 0 else most
                if block:
                    out.append((len(out), heading, block, len(block.split())))
                    block = ""
                out.append((len(out), heading, para[:cut], len(para[:cut].split())))
                para = para[cut:].lstrip()
            if block and len(block) + 2 + len(para) > most:
                out.append((len(out), heading, block, len(block.split())))
                block = ""
            if para.strip():
                block = f"{block}\n\n{para}" if block else para
        if block:
            out.append((len(out), heading, block, len(block.split())))
    return out


def csv_statements(text: str) -> list[str]:
    """Rows as "column: value; column: value". The delimiter is the most frequent of comma, semicolon and tab in the first line; a
    header counts if its names are there, distinct and not numbers; without one the rows come as they are."""
    first = text.split("\n", 1)[0]
    delimiter = max(",;\t", key=lambda d: (first.count(d), -",;\t".index(d)))
    rows = [r for r in csv.reader(io.StringIO(text), delimiter=delimiter) if any(c.strip() for c in r)]
    if not rows:
        return []
    head = [c.strip() for c in rows[0]]
    usable = len(rows) > 1 and all(head) and len({h.lower() for h in head}) == len(head) and not any(re.fullmatch(r"[-+]?[\d.,]+", h) for h in head)
    if not usable:
        return [delimiter.join(r) for r in rows]
    return ["; ".join(f"{h}: {v.strip()}" for h, v in zip(head, r) if v.strip()) for r in rows[1:]]


def json_paths(text: str) -> list[tuple[str, str]]:
    """(path, value) of every scalar that isn't empty, in the order of the document; broken JSON gives none."""
    try:
        root = json.loads(text.lstrip("﻿"))
    except ValueError:
        return []
    out, stack = [], [("", root)]
    while stack:
        path, v = stack.pop()
        if isinstance(v, dict):
            stack += [(f"{path}.{k}" if path else k, x) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            stack += [(f"{path}[{i}]", x) for i, x in reversed(list(enumerate(v)))]
        elif v is not None and v != "":
            out.append((path, "true" if v is True else "false" if v is False else str(v)))
    return out


class _Text(HTMLParser):
    """Headings become #, list items - or numbers, tables lines of cells; scripts, styles and page frames are left out."""

    DROP = {"script", "style", "template", "noscript", "head", "nav", "footer", "aside", "svg", "form"}
    BLOCK = {"p", "div", "section", "article", "table", "tr", "ul", "ol", "blockquote", "pre", "main", "figure", "header"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.dropped: list[str] = []
        self.lists: list[int | None] = []
        self.cells = 0
        self.pre = 0
        self.title = ""
        self.in_title = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "title":
            self.in_title = True
        if tag in self.DROP:
            self.dropped.append(tag)
        if self.dropped:
            return
        if re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("ul", "ol"):
            self.lists.append(None if tag == "ul" else 0)
            self.out.append("\n")
        elif tag == "li":
            depth = "  " * (len(self.lists) - 1)
            if self.lists and self.lists[-1] is not None:
                self.lists[-1] += 1
                self.out.append(f"\n{depth}{self.lists[-1]}. ")
            else:
                self.out.append(f"\n{depth}- ")
        elif tag == "br":
            self.out.append("\n")
        elif tag in ("td", "th"):
            self.out.append(" | " if self.cells else "")
            self.cells += 1
        elif tag in self.BLOCK:
            self.out.append("\n" if tag == "tr" else "\n\n")
            self.cells = 0
            self.pre += tag == "pre"

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        if self.dropped:
            if tag in self.dropped:
                while self.dropped.pop() != tag:
                    pass
            return
        if tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        if tag == "pre":
            self.pre = max(0, self.pre - 1)
        if re.fullmatch("h[1-6]", tag) or tag in self.BLOCK - {"tr"}:
            self.out.append("\n\n")

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        if not self.dropped:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def html_text(source: str) -> str:
    p = _Text()
    p.feed(source)
    p.close()
    text = re.sub(r"[ \t]+\n", "\n", "".join(p.out))
    text = re.sub(r"\n[ \t]+(?![-\d])", "\n", re.sub(r"\n{3,}", "\n\n", text)).strip()
    title = html.unescape(p.title).strip()
    return f"# {title}\n\n{text}" if title and not re.search(r"^# ", text, re.M) else text


def normalised(text: str) -> str:
    """No byte order mark, line feeds only, no control characters but tab and line feed."""
    return re.sub(r"[\x00-\x08\x0b-\x1f\x7f]", "", text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n"))


def exploded(rows: DataFrame, id_col: str, text_col: str, cut: Callable[[str], list[tuple]], fields: str) -> DataFrame:
    """(id, *fields), a row for each piece that ``cut`` gives; null texts give none."""
    kind = rows.schema[id_col].dataType.simpleString()
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(i, *(p if isinstance(p, tuple) else (p,))) for i, t in zip(b["_i"], b["_t"]) for p in cut(t)]
            yield pd.DataFrame(out, columns=[id_col, *names])

    base = rows.filter(rows[text_col].isNotNull()).select(rows[id_col].alias("_i"), rows[text_col].alias("_t"))
    return base.mapInPandas(run, f"`{id_col}` {kind}, {fields}")
