"""JSON as models write it: fenced, cut short or with words around it."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S)


def _parsed(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def _open_at(text: str) -> tuple[list[str], bool, int]:
    """Closers still due at the end of a text, whether it ends within a string, and where its last whole element ends."""
    due: list[str] = []
    inside = skip = False
    whole = 0
    for i, c in enumerate(text):
        if skip:
            skip = False
        elif inside:
            skip = c == "\\"
            inside = c != '"'
        elif c == '"':
            inside = True
        elif c in "[{":
            due.append("]" if c == "[" else "}")
        elif c in "]}":
            if due and due[-1] == c:
                due.pop()
            if due:
                whole = i + 1
        elif c == "," and due:
            whole = i
    return due, inside, whole


def repaired(text: str | None):
    """The value of a JSON text: as it is, without a fence, closed, cut after its last whole element, or the first value within; else None."""
    if not text:
        return None
    text = text.strip()
    fence = _FENCE.search(text)
    for candidate in dict.fromkeys([text, fence[1].strip() if fence else text]):
        value = _parsed(candidate)
        if value is not None:
            return value
    body = fence[1].strip() if fence else text
    start = min((i for i in (body.find("{"), body.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None
    body = body[start:]
    due, inside, whole = _open_at(body)
    closed = _parsed(body + '"' * inside + "".join(reversed(due)))
    if closed is not None:
        return closed
    if whole:
        cut = body[:whole]
        value = _parsed(cut + "".join(reversed(_open_at(cut)[0])))
        if value is not None:
            return value
    try:
        return json.JSONDecoder().raw_decode(body)[0]
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def _repair(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if (v := repaired(t)) is None else json.dumps(v, ensure_ascii=False))


def json_value(text: Column, schema: str) -> Column:
    """A text as ``schema``: parsed in the JVM where it is JSON, else repaired first; null where neither works."""
    plain = F.try_parse_json(text).isNotNull()
    return F.from_json(F.when(plain, text).otherwise(_repair(F.when(~plain, text))), schema)
