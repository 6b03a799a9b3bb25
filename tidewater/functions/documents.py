"""Canonical JSON text: sorted keys, the last of repeated keys, ints and floats apart."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidewater.plans.nodes import LanguageError

MOST_DEPTH = 128


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON number")


def _depth(value) -> int:
    deepest, stack = 0, [(value, 1)]
    while stack:
        v, d = stack.pop()
        deepest = max(deepest, d)
        if isinstance(v, (dict, list)):
            stack += [(x, d + 1) for x in (v.values() if isinstance(v, dict) else v)]
    return deepest


def canonical(text: str) -> str:
    """The canonical text of a document; LanguageError if it isn't one."""
    try:
        value = json.loads(text, parse_constant=_refuse)
        if _depth(value) > MOST_DEPTH + 1:
            raise ValueError(f"nesting is deeper than {MOST_DEPTH}")
        return json.dumps(_sorted(value), separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    except (ValueError, RecursionError) as e:
        raise LanguageError(f"invalid JSON: {e}") from e


def _sorted(value):
    if isinstance(value, dict):
        return {k: _sorted(value[k]) for k in sorted(value, key=lambda k: k.encode("utf-8", "surrogatepass"))}
    return [_sorted(v) for v in value] if isinstance(value, list) else value


@F.pandas_udf(StringType())
def canonical_text(texts: pd.Series) -> pd.Series:
    """Canonical texts of a column; null stays null, and a text that is no document fails."""
    return texts.map(lambda t: None if t is None else canonical(t))
