"""Rules as Spark SQL text with named parameters: (condition, parameters, joins). Values never stand in the text."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from gristmill import bindings
from gristmill.functions import dates
from gristmill.functions.fuzzy import words
from gristmill.operators.compiler import json_path
from gristmill.options import EngineOptions, get_options
from gristmill.rules import MISSING, AggregateRule, All, Any_, ArrayRule, DateRule, FieldRule, If, Literal, Node, RuleError
from gristmill.sources.schema import SchemaSet

_SIGNS = {"equals": "=", "notEquals": "<>", "lessThan": "<", "lessThanEquals": "<=", "greaterThan": ">", "greaterThanEquals": ">="}
_CALLS = {"contains": "contains", "startsWith": "startswith", "endsWith": "endswith"}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class _Text:
    def __init__(self, options: EngineOptions, schema: SchemaSet | None, model: str | None, alias: str, context: dict | None):
        self.options, self.schema, self.model, self.alias, self.context = options, schema, model, alias, context
        self.params: dict[str, Any] = {}
        self.joins: dict[str, tuple[str, str, str]] = {}  # relation path: alias, model, text

    def param(self, value: Any) -> str:
        name = f"p{len(self.params)}"
        self.params[name] = value
        return f":{name}"

    def path(self, path: str) -> str:
        """A column, joined where relations lead to it."""
        names, alias, model, key = path.split("."), self.alias, self.model, ""
        while self.schema is not None and model is not None and names and names[0] in self.schema.model(model).relations:
            name = names.pop(0)
            relation = self.schema.model(model).relations[name]
            if relation.many and not self.options.fanout:
                raise RuleError(f"{path} leads to many rows")
            key = f"{key}.{name}".lstrip(".")
            if key not in self.joins:
                other = f"t{len(self.joins) + 1}"
                on = " AND ".join(f"{alias}.{quoted(a)} = {other}.{quoted(b)}" for a, b in relation.keys)
                target = self.schema.model(relation.target)
                self.joins[key] = (other, relation.target, f"LEFT JOIN {quoted(target.table or target.name)} AS {other} ON {on}")
            alias, model = self.joins[key][:2]
        if not names:
            raise RuleError(f"{path} is a table")
        first = f"{alias}.{quoted(names[0])}"
        kind = self.schema.model(model).fields.get(names[0]) if self.schema is not None and model is not None else None
        if len(names) > 1 and kind is not None and kind.kind == "String":
            steps = json_path(names[1:])
            return f"try_variant_get(try_parse_json({first}), {self.param(steps)}, 'string')" if '"' in steps else f"get_json_object({first}, {self.param(steps)})"
        return ".".join([first, *map(quoted, names[1:])])

    def rhs(self, n: FieldRule | DateRule | AggregateRule) -> tuple[str, Any]:
        """Text of the right side, and its value if it has one."""
        s = n.rhs
        if s.bind is not None:
            raise RuleError(f"no value is bound to {s.bind}")
        if s.value is not MISSING:
            return "", s.value
        if s.path.startswith("$."):
            return self.path(s.path[2:]), MISSING
        if self.context is None:
            raise RuleError(f"{s.path} needs a context")
        v: Any = self.context
        for name in s.path.split("."):
            v = v.get(name) if isinstance(v, dict) else None
        return "", v

    def node(self, n: Node) -> str:
        match n:
            case Literal(value):
                return "TRUE" if value else "FALSE"
            case All(parts):
                return "(" + " AND ".join(map(self.node, parts)) + ")" if parts else "TRUE"
            case Any_(parts):
                return "(" + " OR ".join(map(self.node, parts)) + ")" if parts else "FALSE"
            case If(test, then, other):
                a, b = self.node(test), self.node(then)
                again = self.node(test) if other is not None else ""
                return f"((NOT {a} OR {b})" + (f" AND ({again} OR {self.node(other)}))" if other is not None else ")")
            case FieldRule():
                return self.field(n)
            case DateRule():
                return self.date(n)
            case ArrayRule() if n.operator in ("empty", "notEmpty") and n.path is not None and not n.window:
                c = self.path(n.path)
                return f"({c} IS NULL OR size({c}) = 0)" if n.operator == "empty" else f"({c} IS NOT NULL AND size({c}) > 0)"
            case AggregateRule() if n.condition is None and not n.window:
                c = self.path(n.path)
                item = f"x -> cast(x.{quoted(n.item)} AS double)" if n.item else "x -> cast(x AS double)"
                total = f"aggregate(transform({c}, {item}), 0D, (a, x) -> a + x)"
                total = total if n.mode == "sum" else f"({total} / nullif(size({c}), 0))"
                return self.compare(n.operator, total, *self.rhs(n))
        raise RuleError("the text form has no such rule: use Engine.where")

    def compare(self, op: str, c: str, text: str, value: Any, ci: bool = False) -> str:
        low = (lambda x: f"lower({x})") if ci else (lambda x: x)
        if op in ("between", "notBetween"):
            if value is MISSING:
                a, b = f"{text}[0]", f"{text}[1]"
            else:
                a, b = map(self.param, sorted(value))
            return f"{c} BETWEEN {a} AND {b}" if op == "between" else f"({c} < {a} OR {c} > {b})"
        if op in ("equals", "notEquals") and value is None:
            return f"{c} IS NULL" if op == "equals" else f"{c} IS NOT NULL"
        return f"{low(c)} {_SIGNS[op]} {low(text or self.param(value))}"

    def field(self, n: FieldRule) -> str:
        c, op = self.path(n.path), n.operator
        if op in ("exists", "notExists"):
            return f"{c} IS {'NOT ' if op == 'exists' else ''}NULL"
        if op in ("isEmpty", "notEmpty"):
            return f"({c} IS NULL OR {c} = '')" if op == "isEmpty" else f"({c} IS NOT NULL AND {c} <> '')"
        text, value = self.rhs(n)
        ci = self.options.case_insensitive if n.ci is None else n.ci
        base = op[3].lower() + op[4:] if op.startswith("not") else op
        deny = "NOT " if base != op else ""
        if base in _CALLS:
            if n.fuzzy and base == "contains" and isinstance(value, str) and words(value):
                raise RuleError("the text form has no fuzzy rules: use Engine.where")
            right = text or self.param(value)
            return f"{deny}{_CALLS[base]}(lower({c}), lower({right}))" if ci else f"{deny}{_CALLS[base]}({c}, {right})"
        if base == "matches":
            from gristmill.operators.scalar import java_pattern

            return f"{deny}rlike({c}, {text or self.param(java_pattern(value))})"
        if base == "in":
            if value is MISSING:
                return f"{deny}array_contains({text}, {c})"
            return f"{c} {deny}IN ({', '.join(map(self.param, value))})" if value else ("TRUE" if deny else "FALSE")
        return self.compare(op, c, text, value, ci and op in ("equals", "notEquals"))

    def date(self, n: DateRule) -> str:
        c, op = f"cast({self.path(n.path)} AS timestamp_ntz)", n.operator
        if self.options.time_zone != "UTC":
            c = f"convert_timezone({self.param(self.options.time_zone)}, 'UTC', {c})"
        text, value = self.rhs(n)
        at = lambda m: f"cast({self.param(m.strftime('%Y-%m-%d %H:%M:%S.%f'))} AS timestamp_ntz)"
        if op in ("dayIn", "dayNotIn"):
            return f"dayofweek({c}) {'NOT ' if op == 'dayNotIn' else ''}IN ({', '.join(map(self.param, dates.weekdays(value)))})"
        if op in ("within", "between", "notBetween"):
            low, high = dates.span(value, self.options) if op == "within" else sorted((dates.resolve(value[0], self.options), dates.resolve(value[1], self.options, "end")))
            return f"({c} < {at(low)} OR {c} >= {at(high + dates.MS)})" if op == "notBetween" else f"({c} >= {at(low)} AND {c} < {at(high + dates.MS)})"
        if value is MISSING:
            return f"{c} {dict(before='<', after='>', onOrBefore='<=', onOrAfter='>=')[op]} cast({text} AS timestamp_ntz)"
        m = dates.resolve(value, self.options, "end" if op in ("after", "onOrAfter") else "start")
        return {"before": lambda: f"{c} < {at(m)}", "after": lambda: f"{c} >= {at(m + dates.MS)}", "onOrBefore": lambda: f"{c} < {at(m + dates.MS)}", "onOrAfter": lambda: f"{c} >= {at(m)}"}[op]()


def to_sql(rule: Any, schema: SchemaSet | None = None, model: str | None = None, alias: str = "t0", context: dict | None = None, bind: dict | None = None, options: EngineOptions | None = None) -> tuple[str, dict[str, Any], list[str]]:
    """Condition, parameters by name, and joins."""
    own = _Text(options or get_options(), schema, model, alias, context)
    text = own.node(bindings.resolve(rule, bind or {}))
    return text, own.params, [j for _, _, j in own.joins.values()]


def select(spark: SparkSession, table: str, rule: Any, columns: str = "t0.*", **more: Any) -> DataFrame:
    """Runs the text form over a registered table or view."""
    text, params, joins = to_sql(rule, **more)
    return spark.sql(f"SELECT {columns} FROM {quoted(table)} AS t0 {' '.join(joins)} WHERE {text}", args=params)
