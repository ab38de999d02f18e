"""All findings about a rule, with the place and a code for each. `gristmill.rules.parse` stops at the first instead."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime
from typing import Any

from gristmill import catalog
from gristmill.functions import dates
from gristmill.rules import RuleError


@dataclass(frozen=True)
class Issue:
    path: str
    code: str
    message: str


class RuleInvalid(RuleError):
    def __init__(self, issues: list[Issue]):
        super().__init__("; ".join(f"{i.path or 'rule'}: {i.message}" for i in issues))
        self.issues = issues


def assert_valid_rule(rule: Any, target: str = "spark") -> None:
    if issues := validate_rule(rule, target):
        raise RuleInvalid(issues)


def validate_rule(rule: Any, target: str = "spark") -> list[Issue]:
    own = _Validator(target)
    own.rule(rule, "")
    return own.found


def _number(v: Any) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def _ordered(v: Any) -> bool:
    return isinstance(v, (str, datetime, date)) or _number(v)


class _Validator:
    def __init__(self, target: str):
        self.target, self.found = target, []

    def say(self, path: str, code: str, message: str) -> None:
        self.found.append(Issue(path, code, message))

    def rule(self, rule: Any, at: str) -> None:
        if isinstance(rule, bool):
            if rule is False and self.target == "prisma" and not at:
                self.say(at, "boolean_false_not_supported", "false has no form there")
            return
        if not isinstance(rule, dict):
            return self.say(at, "invalid_condition", "a rule is true, false or an object")
        kinds = [k for k in ("all", "any", "if", "arrayOperator", "dateOperator", "aggregate") if k in rule]
        if len(kinds) > 1 or kinds and "operator" in rule and kinds != ["aggregate"]:
            return self.say(at, "ambiguous_condition", "more than one kind of rule")
        kind = kinds[0] if kinds else ""
        if kind in ("all", "any"):
            if not isinstance(rule[kind], list):
                return self.say(f"{at}.{kind}".lstrip("."), "logical_array_required", f"{kind} takes a list")
            for i, part in enumerate(rule[kind]):
                self.rule(part, f"{at}.{kind}[{i}]".lstrip("."))
            return None
        if kind == "if":
            if "then" not in rule:
                self.say(at, "invalid_condition", "if without then")
            for key in ("if", "then", "else"):
                if key in rule:
                    self.rule(rule[key], f"{at}.{key}".lstrip("."))
            return None
        if kind == "arrayOperator":
            return self.array(rule, at)
        if not kind and "operator" not in rule:
            return self.say(at, "invalid_condition", "no kind of rule")
        if not isinstance(rule.get("field"), str) or not rule["field"]:
            self.say(at, "field_required", "a field is needed")
        {"dateOperator": self.date, "aggregate": self.aggregate}.get(kind, self.field)(rule, at)
        return None

    def source(self, rule: dict, at: str, needed: bool = True) -> bool:
        given = [k for k in ("value", "path", "bind") if k in rule]
        if len(given) > 1:
            self.say(at, "ambiguous_value_source", "more than one of value, path and bind")
        elif not given and needed:
            self.say(at, "missing_value_source", "one of value, path and bind is needed")
        if self.target == "prisma" and str(rule.get("path", "")).startswith("$."):
            self.say(at, "unsupported_prisma_path", "no paths to the own row there")
        return given == ["value"] and not (isinstance(rule["value"], dict) and set(rule["value"]) == {"bind"})

    def support(self, op: str, at: str, family: str, label: str) -> None:
        if not catalog.supports(op, self.target, family):
            self.say(at, f"unsupported_{self.target}_{label}", f"{op} has no form for {self.target}")

    def field(self, rule: dict, at: str) -> None:
        op = rule["operator"]
        if op not in catalog.FIELD_OPERATORS:
            return self.say(at, "invalid_operator", f"unknown operator {op}")
        self.support(op, at, "field", "operator")
        if "coerceType" in rule and rule["coerceType"] not in catalog.KINDS:
            self.say(at, "invalid_coerce_type", f"unknown kind {rule['coerceType']}")
        shape = catalog.value_shape(op)
        if shape == "none":
            for key, code in (("value", "unexpected_value"), ("path", "unexpected_path")):
                if key in rule:
                    self.say(at, code, f"{op} takes no {key}")
            return None
        if not self.source(rule, at):
            return None
        v = rule["value"]
        bad = {
            "string": not isinstance(v, str), "ordered": not _ordered(v), "array": not isinstance(v, list),
            "pattern": not isinstance(v, str) and not (isinstance(v, dict) and isinstance(v.get("source"), str)), "range": not (isinstance(v, list) and len(v) == 2 and all(map(_ordered, v))),
        }.get(shape, False)
        if bad:
            name = {"array": "membership"}.get(shape, shape)
            self.say(at, f"invalid_{name}_value", f"{op} takes another kind of value")
        return None

    def date(self, rule: dict, at: str) -> None:
        op = rule["dateOperator"]
        if op not in catalog.DATE_OPERATORS:
            return self.say(at, "invalid_date_operator", f"unknown date operator {op}")
        self.support(op, at, "date", "date_operator")
        shape = catalog.DATE_OPERATORS[op][0]
        if shape != "dateOrPath" and "path" in rule:
            return self.say(at, "unexpected_path", f"{op} takes no path")
        if not self.source(rule, at):
            return None
        v = rule["value"]
        if shape == "dayList":
            if not (isinstance(v, list) and all(isinstance(d, str) and d.lower() in catalog.DAYS for d in v)):
                self.say(at, "invalid_day_list", "day names are needed")
        elif shape == "dateRange":
            if not (isinstance(v, list) and len(v) == 2):
                self.say(at, "invalid_date_range", "two dates are needed")
            else:
                for x in v:
                    self.moment(x, at)
        elif op == "within":
            if not dates.is_expression(v) or next(iter(v)) in ("start", "end"):
                self.say(at, "invalid_date_range", "a period or a rolling date is needed")
            else:
                self.expression(v, at)
        else:
            self.moment(v, at)
        return None

    def moment(self, v: Any, at: str) -> None:
        if isinstance(v, dict):
            return self.expression(v, at)
        try:
            dates.instant(v, "UTC")
        except (RuleError, TypeError, OverflowError):
            self.say(at, "invalid_date_value", f"not a date: {v!r}")
        return None

    def expression(self, v: dict, at: str) -> None:
        if not dates.is_expression(v):
            return self.say(at, "invalid_date_expression", "no date expression")
        key, inner = next(iter(v.items()))
        if key in ("this", "last", "next"):
            if inner not in catalog.PERIODS:
                self.say(at, "invalid_period_unit", f"unknown period {inner}")
        elif key in ("start", "end"):
            if not dates.is_expression(inner) or next(iter(inner)) not in ("this", "last", "next"):
                self.say(at, "invalid_date_range", f"{key} takes a period")
            else:
                self.expression(inner, at)
        elif not isinstance(inner, dict) or not inner:
            self.say(at, "invalid_relative_units", "units are needed")
        else:
            for unit, n in inner.items():
                if unit not in catalog.UNITS:
                    self.say(at, "invalid_relative_unit", f"unknown unit {unit}")
                if not _number(n) or n < 0:
                    self.say(at, "invalid_relative_magnitude", f"{unit} takes a count")
        return None

    def array(self, rule: dict, at: str) -> None:
        op = rule["arrayOperator"]
        if op not in catalog.ARRAY_OPERATORS:
            return self.say(at, "invalid_array_operator", f"unknown array operator {op}")
        self.support(op, at, "array", "array_operator")
        if "field" in rule and (not isinstance(rule["field"], str) or not rule["field"]):
            self.say(at, "field_required", "a field is needed")
        needs, counts, _ = catalog.ARRAY_OPERATORS[op]
        if needs and "condition" not in rule:
            self.say(at, "missing_condition", f"{op} needs a condition")
        if not needs and "condition" in rule:
            self.say(at, "unexpected_condition", f"{op} takes no condition")
        if counts and "count" not in rule:
            self.say(at, "missing_count", f"{op} needs a count")
        elif not counts and "count" in rule:
            self.say(at, "unexpected_count", f"{op} takes no count")
        elif counts and not (isinstance(rule["count"], int) and not isinstance(rule["count"], bool) and rule["count"] >= 0):
            self.say(at, "invalid_count", "a count is a whole number from 0")
        if needs and "condition" in rule:
            self.rule(rule["condition"], f"{at}.condition".lstrip("."))
        self.window(rule, at)
        return None

    def aggregate(self, rule: dict, at: str) -> None:
        own, op = rule["aggregate"], rule.get("operator")
        if not isinstance(own, dict):
            return self.say(at, "invalid_aggregate", "an aggregate is {mode, field}")
        if own.get("mode") not in catalog.AGGREGATE_MODES:
            self.say(at, "invalid_aggregate_mode", f"unknown mode {own.get('mode')}")
        if "field" in own and (not isinstance(own["field"], str) or not own["field"]):
            self.say(at, "invalid_aggregate_field", "the aggregate's field is a path")
        if op not in (*catalog.AGGREGATE_SINGLE, *catalog.AGGREGATE_RANGE):
            self.say(at, "invalid_aggregate_operator", f"{op} doesn't compare aggregates")
        elif self.target == "prisma" and op == "notBetween":
            self.say(at, "unsupported_prisma_aggregate_operator", f"{op} has no form there")
        if self.target == "prisma" and "path" in rule:
            self.say(at, "unsupported_prisma_aggregate_path", "no paths there")
        if self.target == "sql" and "condition" in rule:
            self.say(at, "unsupported_sql_aggregate_condition", "no condition there")
        if self.source(rule, at):
            v = rule["value"]
            if op in catalog.AGGREGATE_RANGE and not (isinstance(v, list) and len(v) == 2 and all(map(_number, v))):
                self.say(at, "invalid_range_value", "two numbers are needed")
            elif op in catalog.AGGREGATE_SINGLE and not _number(v):
                self.say(at, "invalid_aggregate_value", "a number is needed")
        if "condition" in rule:
            self.rule(rule["condition"], f"{at}.condition".lstrip("."))
        self.window(rule, at)
        return None

    def window(self, rule: dict, at: str) -> None:
        used = [k for k in ("filter", "orderBy", "take", "skip") if k in rule and rule[k] != []]
        if used and catalog.WINDOW_SUPPORT[self.target] == "none":
            self.say(at, f"unsupported_{self.target}_window", "no windows there")
        elif used and catalog.WINDOW_SUPPORT[self.target] == "extremal":
            from gristmill.rules import ArrayRule, extremal, parse

            try:
                own = parse(rule)
                if not isinstance(own, ArrayRule) or extremal(own) is own:
                    raise RuleError("window")
            except RuleError:
                self.say(at, f"unsupported_{self.target}_window", "only an extreme row's window has a form there")
        if "filter" in rule:
            self.rule(rule["filter"], f"{at}.filter".lstrip("."))
        order = rule.get("orderBy", [])
        if not isinstance(order, list):
            self.say(at, "invalid_order_by", "orderBy is a list")
        else:
            for o in order:
                if not isinstance(o, dict) or not isinstance(o.get("field"), str) or o.get("dir", "asc") not in ("asc", "desc"):
                    self.say(at, "invalid_order_by", "a key is {field, dir}")
        for key in ("take", "skip"):
            if key in rule and not (isinstance(rule[key], int) and not isinstance(rule[key], bool) and rule[key] >= 0):
                self.say(at, f"invalid_window_{key}", f"{key} is a whole number from 0")
