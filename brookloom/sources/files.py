"""Files to text: plain text, Markdown, CSV, JSON, HTML, DOCX, XLSX and PPTX, read with ``binaryFile`` in parallel.

Defined cases: files beyond MOST_BYTES, of an unknown kind, broken or without text give a row with an error code and no text. Text is
normalised (no byte order mark, line feeds, no control characters). PDF needs a library that isn't at hand: code ``unsupported``.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from brookloom.functions import cuts

MOST_BYTES = 25 * 1024 * 1024
MOST_CHARS = 5_000_000
#: Limits of an archive: entries, unpacked bytes, ratio of unpacked to packed bytes.
MOST_ENTRIES, MOST_UNPACKED, MOST_RATIO = 10_000, 200 * 1024 * 1024, 200
MOST_DEPTH = 200


class Refused(ValueError):
    """A file that can't be read; the message is the code."""


def decoded(data: bytes, kind: str) -> str:
    """By byte order mark, else for HTML by the charset it names, else UTF-8."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace")
    if kind == "html":
        m = re.search(rb"<meta[^>]+charset=[\"']?\s*([A-Za-z0-9_-]+)", data[:1024], re.I)
        if m:
            try:
                return data.decode(m.group(1).decode(), "replace")
            except LookupError:
                pass
    return data.decode("utf-8", "replace")


def opened(data: bytes) -> zipfile.ZipFile:
    """An archive within the limits; every entry that is read is checked by its CRC-32."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, struct.error) as e:
        raise Refused("broken_zip") from e
    infos = z.infolist()
    if len(infos) > MOST_ENTRIES or sum(i.file_size for i in infos) > MOST_UNPACKED:
        raise Refused("zip_too_large")
    if any(i.file_size > 1 << 20 and i.file_size > MOST_RATIO * max(i.compress_size, 1) for i in infos):
        raise Refused("zip_ratio")
    if any(i.filename.startswith("/") or ".." in i.filename.split("/") for i in infos):
        raise Refused("zip_name")
    last = 0
    for i in sorted(infos, key=lambda i: i.header_offset):  # entries that share bytes unpack to more than the archive holds
        if i.header_offset < last:
            raise Refused("zip_overlap")
        last = i.header_offset + 30 + len(i.orig_filename) + i.compress_size
    return z


class _Strict(ElementTree.TreeBuilder):
    """A tree without document types, in any encoding and wherever they stand, and no deeper than MOST_DEPTH."""

    depth = 0

    def doctype(self, name: str, public: str | None, system: str | None) -> None:
        raise Refused("xml_entities")

    def start(self, tag: str, attrs: dict) -> ElementTree.Element:
        self.depth += 1
        if self.depth > MOST_DEPTH:
            raise Refused("xml_depth")
        return super().start(tag, attrs)

    def end(self, tag: str) -> ElementTree.Element:
        self.depth -= 1
        return super().end(tag)


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    try:
        data = z.read(name)
    except KeyError:
        return None
    except (zipfile.BadZipFile, zlib.error, RuntimeError) as e:
        raise Refused("broken_zip") from e
    try:
        return ElementTree.fromstring(data, ElementTree.XMLParser(target=_Strict()))
    except ElementTree.ParseError as e:
        raise Refused("broken_xml") from e


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _att(e: ElementTree.Element | None, name: str) -> str | None:
    return None if e is None else next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


def _kids(e: ElementTree.Element, *path: str) -> list[ElementTree.Element]:
    level = [e]
    for p in path:
        level = [c for x in level for c in x if _tag(c) == p]
    return level


def table_lines(rows: list[list[str]]) -> list[str]:
    """With a usable header "column: value; ...", else cells joined by bars."""
    rows = [[c.strip() for c in r] for r in rows if any(c.strip() for c in r)]
    if not rows:
        return []
    head = rows[0]
    numeric = any(re.fullmatch(r"[-+]?[\d.,]+%?", c) for c in head)
    if len(rows) > 1 and all(head) and not numeric and len({h.lower() for h in head}) == len(head) and all(len(r) == len(head) for r in rows):
        return ["; ".join(f"{h}: {v}" for h, v in zip(head, r) if v) for r in rows[1:]]
    return [" | ".join(r) for r in rows]


def docx_text(data: bytes) -> str:
    """Paragraphs in reading order; heading styles become #, list paragraphs get a dash; deleted text and field codes stay out."""
    z = opened(data)
    root = _xml(z, "word/document.xml")
    if root is None:
        raise Refused("not_docx")
    level = {}
    styles = _xml(z, "word/styles.xml")
    for s in _kids(styles, "style") if styles is not None else []:
        name = (_att(next(iter(_kids(s, "name")), None), "val") or "").lower()
        m = re.fullmatch(r"heading (\d)", name)
        outline = _att(next(iter(_kids(s, "pPr", "outlineLvl")), None), "val")
        if m or outline is not None:
            level[_att(s, "styleId")] = min(6, int(m.group(1)) if m else int(outline) + 1)

    def words(e: ElementTree.Element) -> str:
        out = []
        for c in e:
            t = _tag(c)
            if t in ("del", "moveFrom", "instrText", "pPr", "rPr"):
                continue
            out.append({"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}.get(t, c.text or "" if t == "t" else words(c)))
        return "".join(out)

    lines: list[str] = []

    def walk(e: ElementTree.Element) -> None:
        for c in e:
            t = _tag(c)
            if t == "p":
                text = words(c).strip()
                style = _att(next(iter(_kids(c, "pPr", "pStyle")), None), "val")
                if not text:
                    continue
                if style in level:
                    lines.extend(["", "#" * level[style] + " " + text, ""])
                else:
                    lines.append(("- " if _kids(c, "pPr", "numPr") else "") + text)
            elif t == "tbl":
                lines.extend(table_lines([[" ".join(words(p).strip() for p in _kids(cell, "p")) for cell in _kids(r, "tc")] for r in _kids(c, "tr")]))
            elif t in ("body", "sdt", "sdtContent"):
                walk(c)

    walk(root)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def serial_text(n: float, time_only: bool = False, from_1904: bool = False) -> str:
    """A spreadsheet date as ISO text; the leap day of 1900 exists there."""
    if time_only or n < 1:
        return (datetime(2000, 1, 1) + timedelta(seconds=round(n % 1 * 86400))).strftime("%H:%M")
    base = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 31) if n < 60 else datetime(1899, 12, 30)
    t = base + timedelta(seconds=round(n * 86400))
    return t.strftime("%Y-%m-%d") if t.time() == datetime.min.time() else t.strftime("%Y-%m-%d %H:%M")


def _general(text: str) -> str:
    try:
        return f"{float(text):.15g}"
    except ValueError:
        return text


def xlsx_text(data: bytes) -> str:
    """Each sheet as "Sheet: name" with its rows; cached values, dates by their number format."""
    z = opened(data)
    book = _xml(z, "xl/workbook.xml")
    if book is None:
        raise Refused("not_xlsx")
    from_1904 = _att(next(iter(_kids(book, "workbookPr")), None), "date1904") in ("1", "true")
    rels = _xml(z, "xl/_rels/workbook.xml.rels")
    target = {_att(r, "Id"): _att(r, "Target") for r in (rels if rels is not None else [])}
    shared_root = _xml(z, "xl/sharedStrings.xml")
    shared = ["".join(t.text or "" for t in si.iter() if _tag(t) == "t") for si in (shared_root if shared_root is not None else [])]
    styles = _xml(z, "xl/styles.xml")
    kinds: list[str] = []
    if styles is not None:
        custom = {_att(f, "numFmtId"): _att(f, "formatCode") or "" for f in _kids(styles, "numFmts", "numFmt")}
        for xf in _kids(styles, "cellXfs", "xf"):
            i = _att(xf, "numFmtId") or "0"
            code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", custom.get(i, "")).lower()
            date = i in {str(x) for x in (14, 15, 16, 17, 22)} or bool(re.search(r"[yd]", code))
            clock = i in {str(x) for x in (18, 19, 20, 21, 45, 46, 47)} or bool(re.search(r"[hs]", code))
            kinds.append("date" if date else "time" if clock else "percent" if i in ("9", "10") or "%" in code else "")

    def value(c: ElementTree.Element) -> str:
        kind, v = _att(c, "t"), next(iter(_kids(c, "v")), None)
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter() if _tag(t) == "t")
        if v is None or v.text is None:
            return ""
        if kind == "s":
            return shared[int(v.text)] if v.text.isdigit() and int(v.text) < len(shared) else ""
        if kind == "b":
            return "TRUE" if v.text == "1" else "FALSE"
        if kind in ("str", "e"):
            return v.text
        style = int(_att(c, "s") or 0)
        form = kinds[style] if style < len(kinds) else ""
        try:
            if form in ("date", "time"):
                return serial_text(float(v.text), form == "time", from_1904)
            return _general(str(float(v.text) * 100)) + "%" if form == "percent" else _general(v.text)
        except (ValueError, OverflowError):
            return v.text

    out = []
    for sheet in _kids(book, "sheets", "sheet"):
        path = target.get(_att(sheet, "id")) or ""
        root = _xml(z, path.lstrip("/") if path.startswith("/") else f"xl/{path}")
        if root is None:
            continue
        rows = []
        for r in _kids(root, "sheetData", "row"):
            cells: dict[int, str] = {}
            for n, c in enumerate(_kids(r, "c")):
                letters = re.match(r"[A-Z]+", _att(c, "r") or "")
                col = 0
                for x in letters.group() if letters else "":
                    col = col * 26 + ord(x) - 64
                cells[col or n + 1] = value(c)
            rows.append([cells.get(k, "") for k in range(1, max(cells, default=0) + 1)])
        width = max((len(r) for r in rows), default=0)
        lines = table_lines([r + [""] * (width - len(r)) for r in rows])
        if lines:
            out.append(f"Sheet: {_att(sheet, 'name')}\n" + "\n".join(lines))
    return "\n\n".join(out)


def pptx_text(data: bytes) -> str:
    """"Slide n: title", then paragraphs in drawing order, tables, and the notes; dates, footers and numbers of the frame stay out."""
    z = opened(data)
    numbers = sorted(int(m.group(1)) for m in (re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n) for n in z.namelist()) if m)
    if not numbers:
        raise Refused("not_pptx")

    def paragraphs(root: ElementTree.Element) -> tuple[str, list[str]]:
        title, lines = "", []
        for shape in root.iter():
            if _tag(shape) == "sp":
                ph = next((e for e in shape.iter() if _tag(e) == "ph"), None)
                kind = _att(ph, "type") if ph is not None else None
                if kind in ("dt", "ftr", "sldNum", "sldImg"):
                    continue
                paras = ["".join(t.text or "" for t in p.iter() if _tag(t) == "t").strip() for p in shape.iter() if _tag(p) == "p"]
                paras = [p for p in paras if p]
                if kind in ("title", "ctrTitle") and not title:
                    title = " ".join(paras)
                else:
                    lines += paras
            elif _tag(shape) == "tbl":
                lines += table_lines([["".join(t.text or "" for t in c.iter() if _tag(t) == "t") for c in _kids(r, "tc")] for r in _kids(shape, "tr")])
        return title, lines

    out = []
    for k, n in enumerate(numbers, 1):
        root = _xml(z, f"ppt/slides/slide{n}.xml")
        title, lines = paragraphs(root) if root is not None else ("", [])
        notes = _xml(z, f"ppt/notesSlides/notesSlide{n}.xml")
        if notes is not None:
            lines += [f"Notes: {x}" for x in paragraphs(notes)[1]]
        out.append("\n".join([f"Slide {k}: {title}".rstrip(": "), *lines]))
    return "\n\n".join(out)


def image_facts(data: bytes) -> tuple[str, int, int] | None:
    """(type, width, height) by magic bytes; None if it is no PNG, GIF, BMP, WebP or JPEG."""
    if data.startswith(b"\x89PNG\r\n\x1a\n") and len(data) >= 24:
        return ("image/png", *struct.unpack(">II", data[16:24]))
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return ("image/gif", *struct.unpack("<HH", data[6:10]))
    if data.startswith(b"BM") and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return ("image/bmp", w, abs(h))
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        if data[12:16] == b"VP8X":
            return ("image/webp", 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little"))
        if data[12:16] == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return ("image/webp", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF))
        w, h = struct.unpack("<HH", data[26:30])
        return ("image/webp", w & 0x3FFF, h & 0x3FFF)
    at = 2
    while data.startswith(b"\xff\xd8") and at + 9 < len(data):
        if data[at] != 0xFF:
            return None
        mark = data[at + 1]
        if mark in (0xC0, 0xC1, 0xC2, 0xC3):
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return ("image/jpeg", w, h)
        at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


KINDS = {"txt": "text", "md": "text", "markdown": "text", "log": "text", "csv": "csv", "tsv": "csv", "json": "json", "html": "html", "htm": "html", "docx": "docx", "xlsx": "xlsx", "pptx": "pptx"}
_READ = {
    "text": lambda b: decoded(b, "text"),
    "csv": lambda b: "\n".join(cuts.csv_statements(cuts.normalised(decoded(b, "csv")))),
    "json": lambda b: "\n".join(f"{p}: {v}" for p, v in cuts.json_paths(decoded(b, "json"))),
    "html": lambda b: cuts.html_text(decoded(b, "html")),
    "docx": docx_text,
    "xlsx": xlsx_text,
    "pptx": pptx_text,
}


def text_of(name: str, data: bytes) -> tuple[str | None, str | None, str | None]:
    """(kind, text, error code)."""
    kind = KINDS.get(name.rsplit(".", 1)[-1].lower()) if "." in name else None
    if kind is None:
        return None, None, "unsupported"
    if len(data) > MOST_BYTES:
        return kind, None, "too_large"
    try:
        text = cuts.normalised(_READ[kind](data))
    except Refused as e:
        return kind, None, str(e)
    if kind == "json" and not text and data.strip():
        return kind, None, "invalid_json"
    if len(text) > MOST_CHARS:
        return kind, None, "too_long"
    return (kind, text, None) if text.strip() else (kind, None, "empty")


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, kind, text, error, sha256) of the files under a path."""
    import hashlib

    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *text_of(p, bytes(c)), hashlib.sha256(c).hexdigest()) for p, c in zip(b["path"], b["content"])]
            yield pd.DataFrame(rows, columns=["path", "kind", "text", "error", "sha256"])

    return raw.mapInPandas(run, "path string, kind string, text string, error string, sha256 string")
