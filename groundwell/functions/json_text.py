"""JSON as models return it (fenced, wrapped in prose, or cut off), and JSON payloads of a bounded size."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

FENCE = re.compile(r"```(?:json)?\s*(.*?)(?:```|$)", re.S)
#: A whole string, a quote that opens one and has no end, or a bracket.
MARK = re.compile(r'"(?:[^"\\]|\\.)*"|"|[{}\[\]]', re.S)
# What a trace keeps of a payload.
MOST_CHARS, MOST_ITEMS, MOST_DEPTH = 2000, 25, 6


def balance(text: str) -> tuple[int | None, str, bool]:
    """Where the first bracket's value ends (None if it doesn't), what is missing to end it, and whether a string is open."""
    missing = ""
    for m in MARK.finditer(text):
        c = m.group()
        if c == '"':
            return None, missing, True
        if c in "{[":
            missing = ("}" if c == "{" else "]") + missing
        elif c in "}]" and missing:
            missing = missing[1:]
            if not missing:
                return m.end(), "", False
    return None, missing, False


def closed(text: str) -> str:
    """A text that was cut off, with its string and brackets closed; a last member without a value goes."""
    _, missing, quoted = balance(text)
    out = text.rstrip() + ('"' if quoted else "")
    if missing[:1] == "}":
        out = re.sub(r'([,{])\s*"[^"]*"\s*:?\s*$', lambda m: "{" if m.group(1) == "{" else "", out)
    return re.sub(r",\s*$", "", out) + missing


def repaired(text: str | None) -> str | None:
    """The JSON object or array in a text in compact form, or null: the whole text, what a fence holds, or the first value that a bracket opens;
    each as it is, without commas before brackets, and closed."""
    tries = [text or ""]
    if m := FENCE.search(tries[0]):
        tries.append(m.group(1))
    if m := re.search(r"[{\[]", tries[0]):
        rest = tries[0][m.start() :]
        tries.append(rest[: balance(rest)[0]])
    for mend in (str.strip, lambda t: re.sub(r",\s*([}\]])", r"\1", t), lambda t: closed(re.sub(r",\s*([}\]])", r"\1", t))):
        for t in tries:
            try:
                value = json.loads(mend(t))
            except ValueError:
                continue
            if isinstance(value, dict | list):
                return json.dumps(value, separators=(",", ":"), ensure_ascii=False)
    return None


def bounded(value: object, depth: int = 0) -> object:
    """A payload with long strings and lists cut, which say by how much, and nothing below a depth."""
    if depth > MOST_DEPTH:
        return "<max depth>"
    if isinstance(value, str) and len(value) > MOST_CHARS:
        return f"{value[:MOST_CHARS]}... <+{len(value) - MOST_CHARS} chars>"
    if isinstance(value, dict):
        return {k: bounded(v, depth + 1) for k, v in value.items()}
    if isinstance(value, list):
        over = len(value) - MOST_ITEMS
        return [bounded(v, depth + 1) for v in value[:MOST_ITEMS]] + ([f"<+{over} more>"] if over > 0 else [])
    return value


def _of_texts(make) -> Column:
    @F.arrow_udf(StringType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([make(t.as_py()) for t in texts], pa.string())

    return run


def repair(text: Column) -> Column:
    return _of_texts(repaired)(text)


def bounded_text(text: str | None) -> str | None:
    """A JSON text with its payload bounded; what isn't JSON is bounded as a string."""
    if text is None:
        return None
    try:
        value = json.loads(text)
    except ValueError:
        value = text
    return json.dumps(bounded(value), separators=(",", ":"), ensure_ascii=False)


def bound(payload: Column) -> Column:
    """Of a payload's text."""
    return _of_texts(bounded_text)(payload)
