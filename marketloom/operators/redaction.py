"""Masking of secrets in JSON records: by the names of keys, at any depth, whatever the value."""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Parts of names under which secrets stand in records, and what replaces them.
SECRET_NAMES = ("account_number", "authorization", "token", "secret", "password", "api_key", "access_token", "refresh_token", "apikey", "cookie")
MASK = "[redacted]"
MALFORMED = '{"redacted":"malformed"}'

_TOKEN = re.compile(r'"(?:[^"\\]++|\\.)*+"|[{}\[\],:]|[^\s"{}\[\],:]++', re.S)


def secret(name: str) -> bool:
    """A key of this name holds a secret."""
    low = name.lower()
    return any(part in low for part in SECRET_NAMES)


def _no_constant(word: str) -> None:
    raise ValueError(f"{word} is no JSON")


def mask_json(text: str | None) -> str:
    """``text`` with the whole value of every secret-named key replaced by a string.

    A machine over tokens with a stack of open brackets: what is kept is kept as it was
    written (numbers, order, repeated keys, white space); depth costs no recursion. Whatever
    isn't one JSON value, null included, becomes ``MALFORMED``.
    """
    if text is None:
        return MALFORMED
    try:
        json.loads(text, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return MALFORMED
    out: list[str] = []
    copied = depth = 0
    hide: int | None = None  # the depth of the key whose value is being dropped
    objects: list[bool] = []  # for every open bracket: it is an object's
    at_key = False
    for m in _TOKEN.finditer(text):
        t = m[0]
        if t in "{[":
            if hide is None and at_key == "value":
                hide = depth
                out += [text[copied : m.start()], json.dumps(MASK)]
            objects.append(t == "{")
            depth += 1
            at_key = t == "{"
        elif t in "}]":
            objects.pop()
            depth -= 1
            at_key = False
            if hide == depth:
                hide, copied = None, m.end()
        elif t == ",":
            at_key = objects[-1]
        elif t == ":":
            at_key = "value" if hide is None and secret(json.loads(key)) else False
        elif at_key is True:
            key = t
        elif at_key == "value":
            out += [text[copied : m.start()], json.dumps(MASK)]
            copied, at_key = m.end(), False
    return "".join(out) + text[copied:]


def mask_value(value: Any) -> Any:
    """The same for a value of lists and dicts."""
    if isinstance(value, dict):
        return {k: MASK if secret(str(k)) else mask_value(v) for k, v in value.items()}
    return [mask_value(v) for v in value] if isinstance(value, (list, tuple)) else value


@F.pandas_udf(StringType())
def _mask(body: pd.Series) -> pd.Series:
    return body.map(mask_json, na_action=None)


def redact_json(body: Column) -> Column:
    """JSON text with secrets masked; anything else becomes ``MALFORMED``. See ``mask_json``."""
    return _mask(body.cast("string"))
