"""JSON out of a model's free text: fences off, the first balanced span that parses, else the keys and values that can be told."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed value: a key and a value (array, object, string or bare) in broken JSON
PAIR = re.compile(r'(?P<key>"?\w+"?)\s*:\s*(?P<value>\[.*?\]|\{[^}]*\}|"(?:[^"\\]|\\.)*"|[^,}\]\n]+)', re.DOTALL)
_MARK = re.compile(r'\\.|["{}\[\]]', re.DOTALL)
_FENCE_OPEN, _FENCE_CLOSE = re.compile(r"\A\s*```(?:[^\n]*\n|(?:json)?)"), re.compile(r"```\s*\Z")
_CLOSES = {"}": "{", "]": "["}


def _loads(text: str):
    """The object or array that ``text`` is, else None."""
    try:
        found = json.loads(text)
    except ValueError:
        return None
    return found if isinstance(found, (dict, list)) else None


def balanced(text: str):
    """Spans from a bracket to the one that closes it, outermost ones only, in order; brackets in strings don't count.

    A bracket that closes nothing, or the wrong one, drops what is open.
    """
    opened: list[str] = []
    start, quoted = 0, False
    for m in _MARK.finditer(text):
        mark = m[0]
        if mark[0] == "\\":
            if not quoted and mark[1:] in ('"', "{", "}", "[", "]"):  # an escape only means something within a string
                mark = mark[1:]
            else:
                continue
        if mark == '"':
            quoted = not quoted
        elif quoted:
            continue
        elif mark in "{[":
            if not opened:
                start = m.end() - 1
            opened.append(mark)
        elif opened and opened[-1] == _CLOSES[mark]:
            opened.pop()
            if not opened:
                yield text[start : m.end()]
        else:
            opened.clear()


def value_of(text: str):
    """A bare value: true, false, digits, a number with a point, else the text without outer quotes."""
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if text.isdecimal():
        return int(text)
    if "." in text:
        try:
            return float(text)
        except ValueError:
            return text
    return text.strip('"')


def recover(text: str | None):
    """What a model's answer holds: an object or array, or an object of the pairs that can be told from broken JSON (maybe none)."""
    if text is None:
        return None
    body = _FENCE_CLOSE.sub("", _FENCE_OPEN.sub("", text, count=1), count=1).strip()
    for span in (body, *balanced(body)):
        if (found := _loads(span)) is not None:
            return found
    out = {}
    for m in PAIR.finditer(text):
        value = m["value"].strip()
        if value[:1] == "{" and value[-1:] == "}":
            # an object within the text is smaller than it, so this ends
            out[m["key"].strip('"')] = recover(value) if value != text else {}
        elif value[:1] == "[" and value[-1:] == "]":
            inner = _loads(value)
            out[m["key"].strip('"')] = value_of(value) if inner is None else inner
        else:
            out[m["key"].strip('"')] = value_of(value)
    return out


def recovered(c: Column) -> Column:
    """:func:`recover` of a text column, as JSON text with sorted keys; null stays null, text without any pair is ``{}``."""

    @F.pandas_udf("string")
    def run(texts):
        return texts.map(lambda t: None if t is None else json.dumps(recover(t), sort_keys=True, ensure_ascii=False))

    return run(c)
