"""Guarded casts: only what is meant as the kind is converted, all else stays NULL or as it is."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions import dates
from gristmill.rules import RuleError

NUMERIC = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_KINDS = ("Int", "BigInt", "Float", "Decimal")


def number_text(column: Column, dtype: T.DataType) -> Column:
    """A number as text without a trailing .0 or exponent form for whole numbers."""
    if not isinstance(dtype, (T.DoubleType, T.FloatType)):
        return column.cast("string")
    whole = (column == F.floor(column)) & (F.abs(column) < 1e18)
    return F.when(whole, column.cast("long").cast("string")).otherwise(column.cast("string"))


def coerce(column: Column, dtype: T.DataType, kind: str) -> Column:
    text = isinstance(dtype, T.StringType)
    if isinstance(dtype, T.ArrayType):
        return F.transform(column, lambda x: coerce(x, dtype.elementType, kind))
    if kind in _KINDS:
        if text:
            trimmed = F.trim(column)
            return F.when(trimmed.rlike(NUMERIC), trimmed.try_cast("double"))
        return column.cast("double") if isinstance(dtype, T.NumericType) else F.lit(None).cast("double")
    if kind == "DateTime":
        if isinstance(dtype, T.NumericType):
            return column.cast("long")
        if text:
            trimmed = F.trim(column)
            zoned = trimmed.rlike(r"([zZ]|T.*[+-]\d{2}:?\d{2})$")
            naive = F.convert_timezone(F.lit("UTC"), F.current_timezone(), trimmed.try_cast("timestamp_ntz")).cast("timestamp")
            return F.when(trimmed.rlike(r"^-?\d+$"), trimmed.try_cast("long")).when(zoned, F.unix_millis(trimmed.try_cast("timestamp"))).otherwise(F.unix_millis(naive))
        if isinstance(dtype, (T.TimestampNTZType, T.DateType)):
            return F.unix_millis(F.convert_timezone(F.lit("UTC"), F.current_timezone(), column.cast("timestamp_ntz")).cast("timestamp"))
        return F.unix_millis(column) if isinstance(dtype, T.TimestampType) else F.lit(None).cast("long")
    if kind == "Boolean":
        if text:
            return F.when(column == "true", F.lit(True)).when(column == "false", F.lit(False))
        return column if isinstance(dtype, T.BooleanType) else F.lit(None).cast("boolean")
    if kind == "String":
        return number_text(column, dtype) if isinstance(dtype, T.NumericType) else column.cast("string")
    return column


def coerce_literal(value: Any, kind: str) -> Any:
    if isinstance(value, (list, tuple)):
        return [coerce_literal(v, kind) for v in value]
    if value is None:
        return None
    if kind in _KINDS:
        return float(value.strip()) if isinstance(value, str) and re.match(NUMERIC, value.strip()) else value
    if kind == "DateTime":
        if isinstance(value, str) and re.fullmatch(r"-?[0-9]+", value.strip()):
            return int(value.strip())
        try:
            moment = dates.instant(value, "UTC")
        except RuleError:
            return value
        return round(moment.timestamp() * 1000)
    if kind == "Boolean":
        return {"true": True, "false": False}.get(value, value) if isinstance(value, str) else value
    if kind == "String" and not isinstance(value, str):
        if isinstance(value, bool):
            return "true" if value else "false"
        return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)
    return value
