"""Canonical decimals and JSON, content addresses. Spark's to_json drops nulls and keeps field order, so
canonical text is a vectorised function; hashes are native."""

from __future__ import annotations

import json
import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A decimal literal, and bounds of digits, exponent, nesting and integers.
DECIMAL = re.compile(r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?")
MOST_DIGITS, MOST_EXPONENT, MOST_INPUT, MOST_DEPTH = 1000, 1000, 1100, 500


def _decimal(text: str) -> str | None:
    if len(text) > MOST_INPUT or not DECIMAL.fullmatch(text):
        return None
    value = Decimal(text)
    if len(value.as_tuple().digits) > MOST_DIGITS or abs(value.adjusted()) > MOST_EXPONENT:
        return None
    return str(value)


@F.pandas_udf(T.StringType())
def canonical_decimal(text: pd.Series) -> pd.Series:
    """The decimal's one spelling, trailing zeros kept; null if it is no bounded decimal literal."""
    return text.map(_decimal, na_action="ignore")


def _checked(value, depth: int = 0):
    if depth > MOST_DEPTH:
        raise ValueError("too deep")
    if isinstance(value, float):
        raise ValueError("floats have no identity")
    if isinstance(value, int) and not isinstance(value, bool) and len(str(abs(value))) > MOST_DIGITS:
        raise ValueError("integer too long")
    for item in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        _checked(item, depth + 1)
    return value


def _json(text: str) -> str | None:
    try:
        return json.dumps(_checked(json.loads(text)), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False) + "\n"
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON with sorted keys, no spaces, nulls kept and a line end; null for floats, bad JSON and what is out of bounds."""
    return text.map(_json, na_action="ignore")


def address(canonical: Column) -> Column:
    """The SHA-256 of canonical text, which is the content's address."""
    return F.sha2(canonical, 256)


def derivation_binding(extractor: Column, raw_sha: Column, text_sha: Column) -> Column:
    """The address that binds an extracted text to its extractor and bytes."""
    return F.sha2(F.concat_ws("|", extractor, raw_sha, text_sha), 256)
