"""Objects inside JSON payloads, found by a scan without recursion.

Built-in JSON functions need the path to a value; a page's data script holds its offers at
any depth, in an order that matters. This scan reads the tokens once, with the open
objects and lists on a stack of its own, and gives the text of each object that has a value
at a path. A payload may nest as deep as it likes.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r'[ \t\n\r]*("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|[{}\[\],:]|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity)')
_END = re.compile(r"[ \t\n\r]*\Z")


class _Open:
    """An open object or list: where it starts, what may come next, its key at hand, and the parts of the path that it has."""

    def __init__(self, start: int, is_object: bool):
        self.start, self.is_object, self.has = start, is_object, set()
        self.key: str | None = None
        self.wants = "first"  # first, key, colon, value or comma


def objects_with(text: str | None, path: str) -> list[str]:
    """The text of every object, at any depth, whose value at ``path`` (dotted) is there and not null, in document order; none if the text is no JSON.

    Of repeated keys the last one holds.
    """
    keys, text = path.split("."), text or ""
    found: list[tuple[int, int]] = []
    stack, at, done = [], 0, False

    def closed(kind: str, has: set[int]) -> bool:
        """Puts down a value in what is open around it."""
        if not stack:
            return True
        top = stack[-1]
        if top.is_object:
            for k, name in enumerate(keys):
                if name == top.key:
                    there = kind != "null" if k + 1 == len(keys) else k + 1 in has
                    (top.has.add if there else top.has.discard)(k)
        top.wants = "comma"
        return False

    while not done:
        m = _TOKEN.match(text, at)
        if m is None:
            return []
        at, token = m.end(), m[1]
        top = stack[-1] if stack else None
        if token in "}]":
            if top is None or top.is_object != (token == "}") or top.wants not in ("first", "comma"):
                return []
            stack.pop()
            if 0 in top.has:
                found.append((top.start, at))
            done = closed(token, top.has)
        elif token == ",":
            if top is None or top.wants != "comma":
                return []
            top.wants = "key" if top.is_object else "value"
        elif token == ":":
            if top is None or top.wants != "colon":
                return []
            top.wants = "value"
        elif top is not None and top.is_object and top.wants in ("first", "key"):
            if token[0] != '"':
                return []
            top.key, top.wants = _plain(token), "colon"
        elif top is not None and top.wants not in ("first", "value"):
            return []
        elif token in "{[":
            stack.append(_Open(at - 1, token == "{"))
        else:
            done = closed(token, set())
    return [text[a:b] for a, b in sorted(found)] if _END.match(text, at) else []


def _plain(token: str) -> str:
    """A key without its quotes; names that paths use need no escapes, but may be written with them."""
    return re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), token[1:-1]) if "\\" in token else token[1:-1]


def json_nodes(payload: Column, path: str) -> Column:
    """:func:`objects_with` of a column of payloads."""

    @F.pandas_udf("array<string>")
    def nodes(payloads: pd.Series) -> pd.Series:
        return payloads.map(lambda text: objects_with(text, path))

    return nodes(payload)
