"""Field and date rules as columns."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill import catalog
from gristmill.functions import dates
from gristmill.functions.coercion import coerce, coerce_literal
from gristmill.functions.fuzzy import fuzzy_contains
from gristmill.options import EngineOptions
from gristmill.rules import MISSING, DateRule, FieldRule, RuleError

#: The phrases of error texts.
PHRASES = {
    "equals": "must equal", "notEquals": "must not equal", "lessThan": "must be less than", "lessThanEquals": "must be less than or equal to", "greaterThan": "must be greater than",
    "greaterThanEquals": "must be greater than or equal to", "in": "must be one of", "notIn": "must not be one of", "contains": "must contain", "notContains": "must not contain",
    "startsWith": "must start with", "endsWith": "must end with", "matches": "must match pattern", "notMatches": "must not match pattern", "between": "must be between",
    "notBetween": "must not be between", "isEmpty": "must be empty", "notEmpty": "must not be empty", "exists": "must exist", "notExists": "must not exist",
}
DATE_PHRASES = {"before": "must be before", "after": "must be after", "onOrBefore": "must be on or before", "onOrAfter": "must be on or after", "within": "must be within", "between": "must be between", "notBetween": "must not be between", "dayIn": "must be on", "dayNotIn": "must not be on"}


@dataclass
class Verdict:
    """ok is NULL or false where the rule fails; `sure` says that it is never NULL. error is a text for failing rows."""

    ok: Column
    error: Column
    sure: bool = False

    def strict(self) -> Column:
        return self.ok if self.sure else F.coalesce(self.ok, F.lit(False))


@dataclass
class Value:
    """A column and its type; type None: absent. literal: its plain value, if it is one."""

    column: Column
    type: T.DataType | None
    literal: Any = MISSING

    @property
    def family(self) -> str:
        return family(self.type)


def family(dtype: T.DataType | None) -> str:
    if dtype is None or isinstance(dtype, T.NullType):
        return "null"
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "date"
    return "array" if isinstance(dtype, T.ArrayType) else "other"


def literal(value: Any) -> Value:
    if value is None:
        return Value(F.lit(None), None, None)
    if isinstance(value, bool):
        return Value(F.lit(value), T.BooleanType(), value)
    if isinstance(value, int):
        return Value(F.lit(value), T.LongType(), value)
    if isinstance(value, float):
        return Value(F.lit(value), T.DoubleType(), value)
    if isinstance(value, Decimal):
        return Value(F.lit(value), T.DecimalType(38, 18), value)
    if isinstance(value, str):
        return Value(F.lit(value), T.StringType(), value)
    if isinstance(value, (datetime, date)):
        moment = dates.instant(value, "UTC")
        return Value(ntz(moment), T.TimestampNTZType(), moment)
    return Value(F.lit(None), T.ArrayType(T.NullType()) if isinstance(value, (list, tuple)) else T.NullType(), value)


def ntz(moment: datetime) -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{moment.strftime('%Y-%m-%d %H:%M:%S.%f')}'")


def shown(value: Any) -> str:
    """A literal as JSON text, with whole floats as integers."""
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        value = int(value)
    if isinstance(value, (datetime, date)):
        value = iso(dates.instant(value, "UTC"))
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(shown, value)) + "]"
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), default=str)


def iso(moment: datetime) -> str:
    return moment.strftime("%Y-%m-%dT%H:%M:%S.") + f"{moment.microsecond // 1000:03d}Z"


def shown_column(v: Value) -> Column:
    if v.literal is not MISSING:
        return F.lit(shown(v.literal))
    if v.type is None:
        return F.lit("null")
    text = F.to_json(F.struct(v.column.alias("v")))  # an absent value leaves {}
    return F.coalesce(F.nullif(F.regexp_extract(text, r'(?s)^\{"v":(.*)\}$', 1), F.lit("")), F.lit("null"))


def to_number(v: Value) -> Column:
    return coerce(v.column, v.type, "Float") if v.family == "text" else v.column


def comparable(a: Value, b: Value, zone: str) -> tuple[Column, Column] | None:
    """Both sides in one orderable type, or None if their families don't compare."""
    fa, fb = a.family, b.family
    if fa == "date" or fb == "date":
        try:
            x, y = (moment(v, zone) if v.family in ("date", "text", "number") else None for v in (a, b))
        except RuleError:
            return None
        return (x, y) if x is not None and y is not None else None
    if fa == fb and fa in ("number", "text"):
        return a.column, b.column
    if {fa, fb} == {"number", "text"}:
        return to_number(a), to_number(b)
    return None


def not_nan(v: Value, column: Column) -> list[Column]:
    return [~F.isnan(column)] if isinstance(v.type, (T.DoubleType, T.FloatType)) and v.literal is MISSING else []


def equal(a: Value, b: Value, zone: str, null_safe: bool) -> Column:
    """Equality without coercion across families."""
    if b.type is None:
        return a.column.isNull() if a.type is not None else F.lit(True)
    if a.type is None:
        return b.column.isNull() if null_safe else F.lit(False)
    if a.family == b.family == "boolean" or a.family == b.family and a.family in ("number", "text"):
        x, y = a.column, b.column
    elif "date" in (a.family, b.family) and (both := comparable(a, b, zone)) is not None and "number" not in (a.family, b.family):
        x, y = both
    else:
        return F.lit(False)
    same = x.eqNullSafe(y) if null_safe and b.literal is MISSING else x == y
    return reduce(Column.__and__, not_nan(a, x) if b.literal is MISSING else [], same)


def ordered(op: str, a: Value, b: Value, zone: str) -> Column:
    both = comparable(a, b, zone)
    if both is None:
        return F.lit(False)
    x, y = both
    out = {"lessThan": x < y, "lessThanEquals": x <= y, "greaterThan": x > y, "greaterThanEquals": x >= y}[op]
    return reduce(Column.__and__, [*not_nan(a, x), *not_nan(b, y)], out)


def _range(rule_value: Any) -> tuple[Any, Any]:
    if not isinstance(rule_value, (list, tuple)) or len(rule_value) != 2:
        raise RuleError("a range takes two bounds")
    return rule_value[0], rule_value[1]


def field_rule(rule: FieldRule, c: Value, rhs: Value | None, options: EngineOptions) -> Verdict:
    op, zone, sql = rule.operator, options.time_zone, options.profile == "sql"
    ci = (options.case_insensitive if rule.ci is None else rule.ci) and op in catalog.CASE_AWARE
    if rule.coerce:
        c = Value(coerce(c.column, c.type, rule.coerce), _coerced_type(rule.coerce, c.type)) if c.type is not None else c
        if rhs is not None and rhs.literal is not MISSING:
            rhs = literal(coerce_literal(rhs.literal, rule.coerce))
        elif rhs is not None and rhs.type is not None:
            rhs = Value(coerce(rhs.column, rhs.type, rule.coerce), _coerced_type(rule.coerce, rhs.type))
    text = F.lit(rule.error) if rule.error is not None else F.concat(F.lit(f"{rule.path} {PHRASES[op]}"), *([F.lit(" "), shown_column(rhs)] if rhs is not None else []))
    if ci:
        c, rhs = _lower(c), _lower(rhs)
    negative = op.startswith("not") and op not in ("notEmpty", "notExists")
    if op in catalog.PRESENCE:
        gone = c.column.isNull() if c.type is not None else F.lit(True)
        empty = gone | (c.column == F.lit("")) if c.family == "text" else gone
        out = {"isEmpty": empty, "notEmpty": ~empty, "exists": ~gone, "notExists": gone}[op]
        return Verdict(F.coalesce(out, F.lit(False)) if op == "notEmpty" and c.family == "text" else out, text, sure=c.family != "text" or op != "isEmpty")
    base = _positive(op, rule, c, rhs, options)
    if not negative:
        return Verdict(base, text)
    if sql:
        return Verdict(~base if c.type is not None else F.lit(None).cast("boolean"), text)
    return Verdict(~F.coalesce(base, F.lit(False)), text, sure=True)


def _coerced_type(kind: str, own: T.DataType) -> T.DataType:
    if isinstance(own, T.ArrayType):
        return own
    return {"Int": T.DoubleType(), "BigInt": T.DoubleType(), "Float": T.DoubleType(), "Decimal": T.DoubleType(), "DateTime": T.LongType(), "Boolean": T.BooleanType(), "String": T.StringType()}.get(kind, own)


def _lower(v: Value | None) -> Value | None:
    if v is None or v.family != "text":
        return v
    return Value(F.lower(v.column), v.type, v.literal.lower() if isinstance(v.literal, str) else MISSING) if v.literal is MISSING else literal(v.literal.lower())


def _positive(op: str, rule: FieldRule, c: Value, rhs: Value, options: EngineOptions) -> Column:
    """The rule or, for a negative operator, what it denies."""
    zone, sql = options.time_zone, options.profile == "sql"
    match op:
        case "equals" | "notEquals":
            return equal(c, rhs, zone, null_safe=not sql)
        case "lessThan" | "lessThanEquals" | "greaterThan" | "greaterThanEquals":
            return ordered(op, c, rhs, zone)
        case "in" | "notIn":
            if rhs.literal is MISSING:
                return F.array_contains(rhs.column, c.column) if rhs.family == "array" and c.type is not None else F.lit(False)
            if not isinstance(rhs.literal, (list, tuple)):
                return F.lit(False)
            if c.type is None:
                return F.lit(None in rhs.literal)
            known = [x for x in map(literal, rhs.literal) if x.family == c.family or c.family == "date" and x.family == "text"]
            if c.family == "date":
                out = reduce(Column.__or__, [equal(c, x, zone, False) for x in known], F.lit(False))
            else:
                out = c.column.isin([x.literal for x in known]) if known else (c.column.isNotNull() & F.lit(False) if not sql or rhs.literal else F.lit(False))
            return F.coalesce(out, c.column.isNull()) if None in rhs.literal and not sql else out
        case "contains" | "notContains":
            if c.family == "array":
                element = Value(c.column, c.type.elementType)
                return F.array_contains(c.column, rhs.column) if rhs.family == element.family else F.lit(False)
            if c.family != "text" or rhs.family != "text":
                return F.lit(False)
            fuzzy = options.fuzzy if rule.fuzzy is None else rule.fuzzy
            return fuzzy_contains(c.column, rhs.literal, fuzzy) if fuzzy and isinstance(rhs.literal, str) else F.contains(c.column, rhs.column)
        case "startsWith" | "endsWith":
            if c.family != "text" or rhs.family != "text":
                return F.lit(False)
            return (F.startswith if op == "startsWith" else F.endswith)(c.column, rhs.column)
        case "matches" | "notMatches":
            if c.family != "text" or not isinstance(rhs.literal, (str, dict)):
                return F.lit(False)
            return c.column.rlike(java_pattern(rhs.literal))
    if rhs.literal is not MISSING:
        low, high = map(literal, _range(rhs.literal))
    else:
        low, high = (Value(F.get(rhs.column, F.lit(i)), rhs.type.elementType) for i in (0, 1)) if rhs.family == "array" else (rhs, rhs)
    a, b = comparable(c, low, zone), comparable(c, high, zone)
    if a is None or b is None:
        return F.lit(False)
    if low.literal is not MISSING and low.family == high.family:
        (x, low_c), (_, high_c) = (a, b) if low.literal <= high.literal else (b, a)
    else:
        x, low_c, high_c = a[0], F.least(a[1], b[1]), F.greatest(a[1], b[1])
    inside = (x >= low_c) & (x <= high_c)
    return reduce(Column.__and__, not_nan(c, x), inside)


#: The evaluator's line ends and white space, and what its escapes mean where the JVM's mean something else.
_ENDS = r"\n\r\u2028\u2029"
_BLANKS = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
_ESCAPES = {"v": r"\x0B", "0": r"\x00", "b": r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))", "B": r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))", "s": f"[{_BLANKS}]", "S": f"[^{_BLANKS}]"}
_SAME = "dDwWfnrtxuk123456789"


def java_pattern(pattern: str | dict) -> str:
    """A pattern, a text or {source, flags}, as the JVM has to read it to match what the evaluator does."""
    source, flags = (pattern, "") if isinstance(pattern, str) else (pattern["source"], pattern.get("flags", ""))
    out, i, inside = [], 0, False
    while i < len(source):
        c = source[i]
        i += 1
        if c == "\\" and i < len(source):
            e = source[i]
            i += 1
            if e == "c":
                raise RuleError("control escapes have no counterpart")
            if inside and e == "b":
                out.append(r"\x08")
            elif e in "sS" or e in _ESCAPES and not (inside and e in "B"):
                out.append(_BLANKS if inside and e == "s" else _ESCAPES[e])
            elif e in _SAME or e in "pP" and "u" in flags or not e.isalnum():
                out.append("\\" + e)
            else:
                out.append(e)
        elif inside:
            inside = c != "]"
            out.append("\\" + c if c in "[&" else c)
        elif c == "[":
            if source.startswith(("]", "^]"), i):  # nothing, anything
                out.append("(?!)" if source[i] == "]" else "(?s:.)")
                i += 1 + (source[i] == "^")
                continue
            inside = True
            out.append(c)
            if source.startswith("^", i):
                out.append("^")
                i += 1
        elif c == "$":
            out.append(rf"(?=[{_ENDS}]|\z)" if "m" in flags else r"\z")
        elif c == "^":
            out.append(f"(?:^|(?<=[{_ENDS}]))" if "m" in flags else c)
        elif c == ".":
            out.append("(?s:.)" if "s" in flags else f"[^{_ENDS}]")
        elif c == "{" and not re.match(r"\d+(,\d*)?\}", source[i:]):
            out.append(r"\{")
        else:
            out.append(c)
    return ("(?iu)" if "i" in flags else "") + "".join(out)


def moment(v: Value, zone: str) -> Column:
    """A value as a UTC wall clock without zone. Naive values are anchored in `zone`."""
    if v.literal is not MISSING and v.literal is not None:
        return ntz(dates.instant(v.literal, zone))
    naive = lambda col: col if zone == "UTC" else F.convert_timezone(F.lit(zone), F.lit("UTC"), col)
    absolute = lambda col: F.convert_timezone(F.current_timezone(), F.lit("UTC"), col.cast("timestamp_ntz"))
    if isinstance(v.type, T.TimestampNTZType):
        return naive(v.column)
    if isinstance(v.type, T.DateType):
        return naive(v.column.cast("timestamp_ntz"))
    if isinstance(v.type, T.TimestampType):
        return absolute(v.column)
    if v.family == "number":
        return absolute(F.timestamp_millis(v.column.cast("long")))
    if v.family == "text":
        zoned = v.column.rlike(r"([zZ]|T.*[+-]\d{2}:?\d{2})$")
        return F.when(zoned, absolute(v.column.try_cast("timestamp"))).otherwise(naive(v.column.try_cast("timestamp_ntz")))
    raise RuleError("not a date")


def date_rule(rule: DateRule, c: Value, rhs: Value, options: EngineOptions) -> Verdict:
    """Bounds are milliseconds, columns may be finer: `<= x` is `< x + 1 ms`, which leaves the column bare for pushdown."""
    op, zone = rule.operator, options.time_zone
    if c.type is None or c.family in ("boolean", "array", "other"):
        return Verdict(F.lit(False), F.lit(rule.error or f"{rule.path} {DATE_PHRASES[op]}"), sure=True)
    x = moment(c, zone)
    say = lambda *parts: F.lit(rule.error) if rule.error is not None else F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in (f"{rule.path} {DATE_PHRASES[op]} ", *parts)])
    after = lambda m: ntz(m + dates.MS)
    if op in ("dayIn", "dayNotIn"):
        days = dates.weekdays(rhs.literal)
        local = x if zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(zone), x)
        hit = F.dayofweek(local).isin(days) if days else local.isNotNull() & F.lit(False)
        return Verdict(hit if op == "dayIn" else ~hit, say(" or ".join(map(str, rhs.literal))))
    if op in ("between", "notBetween", "within"):
        if op == "within":
            low, high = dates.span(rhs.literal, options)
        else:
            a, b = _range(rhs.literal if rhs.literal is not MISSING else None)
            low, high = sorted((dates.resolve(a, options, "start"), dates.resolve(b, options, "end")))
        inside, text = (x >= ntz(low)) & (x < after(high)), say(iso(low), " and ", iso(high))
        return Verdict((x < ntz(low)) | (x >= after(high)) if op == "notBetween" else inside, text)
    if rhs.literal is MISSING:
        y = moment(rhs, zone)
        x, y = (F.date_trunc("millisecond", v).cast("timestamp_ntz") for v in (x, y))
        return Verdict({"before": x < y, "after": x > y, "onOrBefore": x <= y, "onOrAfter": x >= y}[op], say(F.coalesce(y.cast("string"), F.lit("null"))))
    at = dates.resolve(rhs.literal, options, "end" if op in ("after", "onOrAfter") else "start")
    return Verdict({"before": x < ntz(at), "after": x >= after(at), "onOrBefore": x < after(at), "onOrAfter": x >= ntz(at)}[op], say(iso(at)))
