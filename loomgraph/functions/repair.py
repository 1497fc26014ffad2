"""Getting JSON out of noisy text, and mending it; plain functions and Arrow UDFs over columns."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _end_of_value(text: str, start: int) -> int | None:
    """Where the bracket at `start` is closed, brackets in strings left aside."""
    opening = text[start]
    closing = {"{": "}", "[": "]"}[opening]
    depth = 0
    for token in re.finditer(r'"(?:[^"\\]|\\.)*"|[{}\[\]]', text[start:], re.S):
        depth += (token[0] == opening) - (token[0] == closing)
        if depth == 0:
            return start + token.end()
    return None


def extract_json(raw: str) -> str:
    """The first balanced object or list of a text without code fences; all from its bracket on if it is never closed."""
    bare = re.sub(r"```(?:json)?\s*", "", raw).strip()
    first = re.search(r"[{\[]", bare)
    if first is None:
        return bare
    return bare[first.start() : _end_of_value(bare, first.start())]


def close_lists(text: str, limit: int = 20) -> str:
    """A missing ] put in where parsing stops at a } or at the end, up to `limit` times; the text as it was if that is no help."""
    mended = text
    for _ in range(limit):
        try:
            json.loads(mended)
            return mended
        except json.JSONDecodeError as problem:
            stack = [t for t in _open_brackets(mended[: problem.pos])]
            if not stack or stack[-1] != "[":
                break
            at = len(mended[: problem.pos].rstrip().rstrip(","))
            mended = mended[:at] + "]" + mended[at:]
    return text


def _open_brackets(text: str) -> list[str]:
    stack: list[str] = []
    for token in re.finditer(r'"(?:[^"\\]|\\.)*"|[{}\[\]]', text, re.S):
        if token[0] in "{[":
            stack.append(token[0])
        elif token[0] in "}]" and stack:
            stack.pop()
    return stack


def parse_output(raw: str, sanitise: Callable[[object], object] | None = None) -> object:
    """The value in an answer, with lists closed where that is what was missing."""
    value = json.loads(close_lists(extract_json(raw)))
    return sanitise(value) if sanitise else value


def numbers_as_text(value: object) -> object:
    """Numbers and booleans inside attribute values and possible values turned to text."""
    if isinstance(value, list):
        return [numbers_as_text(v) for v in value]
    if isinstance(value, dict):
        text = lambda v: str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else v
        out = {}
        for key, inner in value.items():
            if key == "attribute_values" and isinstance(inner, dict):
                out[key] = {k: text(v) for k, v in inner.items()}
            elif key == "possible_values" and isinstance(inner, list):
                out[key] = [text(v) for v in inner]
            elif key == "class_value":
                out[key] = text(inner)
            else:
                out[key] = numbers_as_text(inner)
        return out
    return value


def _try(raw: str) -> str | None:
    try:
        return json.dumps(numbers_as_text(parse_output(raw)), sort_keys=True)
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def mended_json(raw: pd.Series) -> pd.Series:
    """The mended JSON of each answer, or null where none can be read."""
    return raw.map(lambda r: None if r is None else _try(r))
