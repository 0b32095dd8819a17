"""Declared types, and literals checked on the driver before they become typed columns.

Every literal is text and takes its column's type, so filters stay on the bare column and reach
the scan. A literal that isn't wholly of the type is a mismatch; there are no prefixes, no nulls.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.errors import Outcome, StatementError

_SIMPLE = {"int": T.IntegerType(), "float": T.FloatType(), "bool": T.BooleanType(), "char": T.StringType(), "long": T.LongType()}
_RANGES = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}


def spark_type(declared: str) -> T.DataType:
    if declared in _SIMPLE:
        return _SIMPLE[declared]
    if declared == "string":
        raise StatementError(Outcome.NO_SIZE)
    m = re.fullmatch(r"string\(\s*(\d+)\s*\)", declared)
    if m is None or not int(m[1]):
        raise StatementError(Outcome.INVALID_TYPE, f"no type {declared}")
    return T.StringType()


def size_of(declared: str | None) -> int | None:
    """Characters that the type admits; nothing where it sets no limit."""
    m = re.fullmatch(r"string\(\s*(\d+)\s*\)", declared or "")
    return int(m[1]) if m else None


def value_of(text: str, kind: T.DataType, declared: str | None = None, in_condition: bool = False) -> object:
    """The literal as a Python value of the column's type."""

    def mismatch():
        return StatementError(Outcome.TYPE_MISMATCH, f"{text!r} is no {declared or kind.simpleString()}")

    if type(kind) in _RANGES:
        if not re.fullmatch(r"[+-]?[0-9]+", text) or not -(1 << _RANGES[type(kind)]) <= int(text) < 1 << _RANGES[type(kind)]:
            raise mismatch()
        return int(text)
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        if not re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", text) or not math.isfinite(float(text)):
            raise mismatch()
        if isinstance(kind, T.FloatType) and abs(float(text)) > 3.4028235677973366e38:
            raise mismatch()
        return text if isinstance(kind, T.DecimalType) else float(text)
    if isinstance(kind, T.BooleanType):
        if text not in ("true", "false"):
            raise mismatch()
        return text == "true"
    if isinstance(kind, T.StringType):
        if declared == "char" and len(text) != 1:
            raise mismatch()
        size = size_of(declared)
        if size is not None and len(text) > size and not in_condition:
            raise StatementError(Outcome.STRING_TOO_LARGE, f"{len(text)} characters, of at most {size}")
        return text
    return text  # types that only registered tables have: Spark casts, or fails


def literal(text: str, kind: T.DataType, declared: str | None = None, in_condition: bool = False) -> Column:
    value = value_of(text, kind, declared, in_condition)
    return F.lit(text if isinstance(kind, T.FloatType) else value).cast(kind)
