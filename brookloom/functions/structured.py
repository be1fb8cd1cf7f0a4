"""Structured text: arithmetic, canonical JSON, JSON inside answers, schema checks, server-sent events, fenced context."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKENS = re.compile(r"\s*(?:(\d+(?:\.\d+)?(?:[eE][-+]?\d+)?|\.\d+)|([A-Za-z]+)|(.))")
# What the calculator knows.
FUNCTIONS = {"sqrt": math.sqrt, "abs": abs, "ln": math.log, "log": math.log10, "exp": math.exp, "sin": math.sin, "cos": math.cos, "tan": math.tan, "round": lambda x: math.floor(x + 0.5), "floor": math.floor, "ceil": math.ceil, "min": min, "max": max}
CONSTANTS = {"pi": math.pi, "e": math.e}
_BINDS = {"+": 1, "-": 1, "*": 2, "/": 2, "%": 2, "^": 4}
MOST_DEPTH = 100


def calculated(text: str) -> float | None:
    """The value of an expression with + - * / % ^, signs, brackets, functions and constants, to twelve significant digits; None if
    it is no expression or has no finite value. Precedence climbing; nothing is ever evaluated as code."""
    found = [next((k, m) for k, m in zip("nwo", t) if m) for t in _TOKENS.findall(text.strip())]
    at = 0

    def peek() -> tuple[str, str]:
        return found[at] if at < len(found) else ("", "")

    def take(want: str | None = None) -> tuple[str, str]:
        nonlocal at
        t = peek()
        if want is not None and t[1] != want:
            raise ValueError(want)
        at += 1
        return t

    def atom(depth: int) -> float:
        if depth > MOST_DEPTH:
            raise ValueError("depth")
        kind, t = take()
        if kind == "n":
            return float(t)
        if t in ("-", "+"):
            v = climb(3, depth + 1)
            return -v if t == "-" else v
        if t == "(":
            v = climb(0, depth + 1)
            take(")")
            return v
        name = t.lower()
        if kind == "w" and name in FUNCTIONS and peek()[1] == "(":
            take("(")
            args = [climb(0, depth + 1)]
            while peek()[1] == ",":
                take(",")
                args.append(climb(0, depth + 1))
            take(")")
            return float(FUNCTIONS[name](*args))
        if kind == "w" and name in CONSTANTS:
            return CONSTANTS[name]
        raise ValueError(t)

    def climb(least: int, depth: int) -> float:
        left = atom(depth)
        while (op := peek()[1]) in _BINDS and _BINDS[op] >= least:
            take()
            right = climb(_BINDS[op] if op == "^" else _BINDS[op] + 1, depth + 1)
            left = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b, "%": math.fmod, "^": lambda a, b: a**b}[op](left, right)
        return left

    try:
        v = climb(0, 0)
        return float(f"{v:.12g}") if at == len(found) and not isinstance(v, complex) and math.isfinite(v) else None
    except (ValueError, ArithmeticError, TypeError):
        return None


def canonical(text: str) -> str | None:
    """JSON with sorted keys and no white space; None for broken JSON and numbers that aren't finite."""
    try:
        return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    except ValueError:
        return None


def inner_json(text: str) -> str | None:
    """The JSON in an answer: the whole of it, else a fenced block, else the first balanced object or array."""
    body = re.sub(r"(?is)<think(?:ing)?>.*?</think(?:ing)?>", "", text).strip()
    for part in [body, *re.findall(r"```(?:json)?\s*\n(.*?)```", body, re.S)]:
        if (c := canonical(part)) is not None:
            return c
    decoder = json.JSONDecoder()
    for m in re.finditer(r"[{\[]", body):
        try:
            value, _ = decoder.raw_decode(body, m.start())
            return canonical(json.dumps(value))
        except ValueError:
            continue
    return None


_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(v: Any, kind: str) -> bool:
    if kind in ("number", "integer"):
        return isinstance(v, (int, float)) and not isinstance(v, bool) and (kind == "number" or float(v).is_integer())
    return isinstance(v, _KINDS[kind])


def schema_problems(value: Any, schema: dict, path: str = "$", most: int | None = None) -> list[str]:
    """"path:rule" of every rule that a value breaks, or the first ``most`` of them."""
    out: list[str] = []

    def check(v: Any, s: dict, p: str) -> None:
        if most is not None and len(out) >= most:
            return
        kinds = s.get("type")
        if kinds is not None and not any(_is(v, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
            out.append(f"{p}:type")
            return
        if "enum" in s and v not in s["enum"]:
            out.append(f"{p}:enum")
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            out.extend(f"{p}:{r}" for r, bad in (("minimum", v < s.get("minimum", v)), ("maximum", v > s.get("maximum", v))) if bad)
        if isinstance(v, str):
            out.extend(f"{p}:{r}" for r, bad in (("minLength", len(v) < s.get("minLength", 0)), ("maxLength", len(v) > s.get("maxLength", len(v))), ("pattern", "pattern" in s and not re.search(s["pattern"], v))) if bad)
        if isinstance(v, list):
            out.extend(f"{p}:{r}" for r, bad in (("minItems", len(v) < s.get("minItems", 0)), ("maxItems", len(v) > s.get("maxItems", len(v))), ("uniqueItems", bool(s.get("uniqueItems")) and len({json.dumps(x, sort_keys=True) for x in v}) < len(v))) if bad)
            for i, x in enumerate(v) if "items" in s else ():
                check(x, s["items"], f"{p}[{i}]")
        if isinstance(v, dict):
            own = s.get("properties", {})
            out.extend(f"{p}.{k}:required" for k in s.get("required", ()) if k not in v)
            for k, x in v.items():
                if k in own:
                    check(x, own[k], f"{p}.{k}")
                elif s.get("additionalProperties") is False:
                    out.append(f"{p}.{k}:additional")

    check(value, schema, path)
    return out[:most]


def schema_findings(rows: DataFrame, id_col: str, text_col: str, schema: dict) -> DataFrame:
    """(id, problem) of JSON texts; broken JSON is one problem, null texts have none."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t in zip(b["_i"], b["_t"]):
                try:
                    found = schema_problems(json.loads(t), schema)
                except ValueError:
                    found = ["$:json"]
                out += [(i, p) for p in found]
            yield pd.DataFrame(out, columns=[id_col, "problem"])

    return rows.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t")).mapInPandas(run, f"`{id_col}` {kind}, problem string")


def events(stream: str) -> list[tuple[str, str, str | None]]:
    """(event, data, id) of server-sent events: fields by line, a blank line ends an event, comments and events without data are dropped."""
    out, name, data, last = [], "message", [], None
    for line in re.split(r"\r\n|\n|\r", stream.removeprefix("﻿") + "\n\n"):
        if not line:
            if data:
                out.append((name, "\n".join(data), last))
            name, data = "message", []
            continue
        field, _, value = line.partition(":")
        value = value.removeprefix(" ")
        if field == "data":
            data.append(value)
        elif field == "event":
            name = value
        elif field == "id" and "\0" not in value:
            last = value
    return out


def fenced(sources: list[tuple[str, str]], budget: int, least: int = 120) -> tuple[str, list[int]]:
    """(text, delivered) of labelled sources in fences, in order, within a budget of characters. A source is cut to what is left if at
    least ``least`` characters of it fit, else it and all after it are left out; runs of angle brackets inside can't end a fence."""
    out, delivered, left = [], [], budget
    for k, (label, text) in enumerate(sources):
        safe = re.sub(r"<{2,}", lambda m: "<" + " " * (len(m.group()) - 1), re.sub(r">{2,}", lambda m: ">" + " " * (len(m.group()) - 1), text))
        head, tail = f"<<source {label}>>\n", "\n<<end>>\n"
        room = left - len(head) - len(tail)
        if room < min(least, len(safe)):
            break
        block = head + safe[:room] + tail
        out.append(block)
        delivered.append(k)
        left -= len(block)
    return "".join(out), delivered
