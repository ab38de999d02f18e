"""The operators, the field kinds they take, and the shapes of their values. The validator and the compilers read this table."""

from __future__ import annotations

KINDS = ("String", "Boolean", "Int", "BigInt", "Float", "Decimal", "DateTime", "Json", "Bytes", "Enum")
NUMERIC = ("Int", "BigInt", "Float", "Decimal")
ORDERABLE = (*NUMERIC, "String", "DateTime")
TEXT = ("String",)
EQUATABLE = ("String", "Boolean", *NUMERIC, "DateTime", "Enum")
TARGETS = ("check", "sql", "prisma", "spark")
_NO_RELATIONAL = ("check", "sql", "spark")

#: name: (kinds, value shape, targets)
FIELD_OPERATORS: dict[str, tuple[tuple[str, ...], str, tuple[str, ...]]] = {
    **{op: (EQUATABLE, "scalar", TARGETS) for op in ("equals", "notEquals")},
    **{op: (ORDERABLE, "ordered", TARGETS) for op in ("lessThan", "lessThanEquals", "greaterThan", "greaterThanEquals")},
    **{op: (EQUATABLE, "array", TARGETS) for op in ("in", "notIn")},
    **{op: (TEXT, "string", TARGETS) for op in ("contains", "notContains", "startsWith", "endsWith")},
    **{op: (TEXT, "pattern", _NO_RELATIONAL) for op in ("matches", "notMatches")},
    **{op: (ORDERABLE, "range", TARGETS) for op in ("between", "notBetween")},
    **{op: (KINDS, "none", TARGETS) for op in ("isEmpty", "notEmpty", "exists", "notExists")},
}
DATE_OPERATORS: dict[str, tuple[str, tuple[str, ...]]] = {
    **{op: ("dateOrPath", TARGETS) for op in ("before", "after", "onOrBefore", "onOrAfter")},
    "within": ("dateExpression", TARGETS),
    **{op: ("dateRange", TARGETS) for op in ("between", "notBetween")},
    **{op: ("dayList", _NO_RELATIONAL) for op in ("dayIn", "dayNotIn")},
}
#: name: (needs a condition, needs a count, targets)
ARRAY_OPERATORS: dict[str, tuple[bool, bool, tuple[str, ...]]] = {
    **{op: (True, False, ("check", "prisma", "spark")) for op in ("all", "any", "none")},
    **{op: (True, True, ("check", "prisma", "spark")) for op in ("atLeast", "atMost", "exactly")},
    **{op: (False, False, TARGETS) for op in ("empty", "notEmpty")},
}
AGGREGATE_MODES = ("sum", "avg")
AGGREGATE_SINGLE = ("equals", "notEquals", "lessThan", "lessThanEquals", "greaterThan", "greaterThanEquals")
AGGREGATE_RANGE = ("between", "notBetween")
PRESENCE = ("isEmpty", "notEmpty", "exists", "notExists")
CASE_AWARE = ("equals", "notEquals", "contains", "notContains", "startsWith", "endsWith")
UNITS = ("years", "quarters", "months", "weeks", "days", "hours", "minutes", "seconds")
PERIODS = ("year", "quarter", "month", "week", "isoWeek", "day", "hour", "minute", "second")
DAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")
COERCIBLE = (*NUMERIC, "DateTime", "Boolean", "String")
#: Windows by target: all forms, the rewritable extremal ones on arrays, or none.
WINDOW_SUPPORT = {"check": "full", "spark": "full", "prisma": "extremal", "sql": "none"}


def value_shape(operator: str) -> str | None:
    if operator in FIELD_OPERATORS:
        return FIELD_OPERATORS[operator][1]
    return None


def supports(operator: str, target: str, family: str = "field") -> bool:
    table = {"field": FIELD_OPERATORS, "date": DATE_OPERATORS, "array": ARRAY_OPERATORS}[family]
    return operator in table and target in table[operator][-1]


def operators_for(kind: str) -> list[str]:
    out = [op for op, (kinds, _, _) in FIELD_OPERATORS.items() if kind in kinds]
    return out + list(DATE_OPERATORS) if kind == "DateTime" else out


def array_operators(target: str = "spark") -> list[str]:
    return [op for op, (_, _, targets) in ARRAY_OPERATORS.items() if target in targets]
