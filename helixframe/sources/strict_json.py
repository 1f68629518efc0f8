"""Strict JSON: what a text breaks, as a column."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sequence import col


def fault(text: str | None, depth: int, size: int) -> str | None:
    """Why a text is no strict JSON, or None: more bytes or levels than allowed,
    a key twice in an object, numbers that aren't finite, surrogates alone, or
    no JSON at all."""
    if text is None:
        return "no text"
    if len(text.encode("utf-8", "surrogatepass")) > size:
        return "too large"

    def pairs(items: list[tuple]) -> dict:
        names = [k for k, _ in items]
        if len(set(names)) < len(names):
            raise ValueError("a key twice")
        return dict(items)

    def refused(name: str) -> None:
        raise ValueError("not finite")

    def number(x: str) -> float:
        value = float(x)
        if value in (float("inf"), float("-inf")):
            raise ValueError("not finite")
        return value

    try:
        value = json.loads(text, object_pairs_hook=pairs, parse_constant=refused, parse_float=number)
    except RecursionError:
        return "too deep"
    except json.JSONDecodeError:
        return "no JSON"
    except ValueError as e:
        return str(e) if str(e) in ("a key twice", "not finite") else "no JSON"
    todo = [(value, 1)]
    while todo:
        x, level = todo.pop()
        if level > depth and isinstance(x, (dict, list)):
            return "too deep"
        if isinstance(x, str) and any(0xD800 <= ord(c) <= 0xDFFF for c in x):
            return "a surrogate alone"
        if isinstance(x, dict):
            todo += [(k, level) for k in x] + [(v, level + 1) for v in x.values()]
        elif isinstance(x, list):
            todo += [(v, level + 1) for v in x]
    return None


def json_fault(text, depth: int = 64, size: int = 1 << 20) -> Column:
    """The fault of each text, null if it is strict JSON."""

    @F.pandas_udf(T.StringType())
    def faults(s: pd.Series) -> pd.Series:
        return s.map(lambda x: fault(x, depth, size), na_action=None)

    return faults(col(text))


def get_path(text, path: list[str]) -> Column:
    """The text of a member deep in objects, null where a step is missing."""
    return F.get_json_object(col(text), "$" + "".join(f"['{p}']" for p in path))


def put_path(value: dict, path: list[str], item) -> dict:
    """A copy of nested objects with one member set; missing objects are made."""
    if not path:
        return item
    head = value.get(path[0], {}) if isinstance(value, dict) else {}
    return {**(value if isinstance(value, dict) else {}), path[0]: put_path(head, path[1:], item)}
