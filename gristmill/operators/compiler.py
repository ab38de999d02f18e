"""Rules over rows and embedded arrays as columns; rules over related tables by way of a planner.

Polarity: a rule in a positive place stays bare, since a filter drops NULL as it drops false, and a bare comparison reaches the scan.
Only where truth is counted, negated or returned is NULL made false.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any, Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.operators import scalar
from gristmill.operators.scalar import PHRASES, Value, Verdict, family, literal, shown_column
from gristmill.options import EngineOptions
from gristmill.rules import MISSING, AggregateRule, All, Any_, ArrayRule, DateRule, FieldRule, If, Literal, Node, RuleError, Slice, Source, extremal


class Relations(Protocol):
    """What a model's planner answers to the compiler."""

    def to_one(self, path: str, hint: str) -> Value | None: ...
    def many(self, rule: ArrayRule | AggregateRule) -> Verdict | None: ...


@dataclass
class Frame:
    """Where names are looked up: a row (no column) or an element of an array."""

    schema: T.StructType | T.DataType
    column: Column | None = None
    relations: Relations | None = None
    prefix: str = ""

    def top(self, name: str) -> Value:
        if not isinstance(self.schema, T.StructType):
            return inside(Value(self.column, self.schema), name) if self.column is not None else Value(F.lit(None), None)
        if name not in self.schema.fieldNames():
            return Value(F.lit(None), None)
        dtype = self.schema[name].dataType
        return Value(F.col(f"{self.prefix}`{name}`") if self.column is None else self.column.getField(name), dtype)


def inside(v: Value, name: str) -> Value:
    t = v.type
    if isinstance(t, T.StructType):
        return Value(v.column.getField(name), t[name].dataType) if name in t.fieldNames() else Value(F.lit(None), None)
    if isinstance(t, T.MapType):
        return Value(F.try_element_at(v.column, F.lit(name)), t.valueType)
    if isinstance(t, T.ArrayType):
        return Value(F.get(v.column, F.lit(int(name))), t.elementType) if name.isdigit() else Value(F.lit(None), None)
    return Value(F.lit(None), None)


#: How a JSON value is read, by what it is compared with.
_JSON_TYPES = {"number": ("double", T.DoubleType()), "boolean": ("boolean", T.BooleanType()), "array": ("array<variant>", T.ArrayType(T.VariantType())), "variant": ("variant", T.VariantType())}


def json_path(names: list[str]) -> str:
    """Steps into a JSON value. A key stands in the quotes that it doesn't hold."""
    steps = []
    for n in names:
        if "'" in n and '"' in n:
            raise RuleError(f"{n}: a key may not hold both kinds of quotes")
        steps.append(f"[{n}]" if n.isdigit() else f'["{n}"]' if "'" in n else f"['{n}']")
    return "$" + "".join(steps)


def in_json(v: Value, names: list[str], hint: str) -> Value:
    """A part of a JSON text or variant, read by `hint`. A JSON null is NULL, save as a variant."""
    kind, dtype = _JSON_TYPES.get(hint, ("string", T.StringType()))
    variant = F.try_parse_json(v.column) if isinstance(v.type, T.StringType) else v.column
    return Value(F.try_variant_get(variant, json_path(names), kind), dtype)


def resolve(frame: Frame, path: str, hint: str = "text") -> Value:
    """A dotted path: columns, fields, map keys, array indices; the rest of a JSON text or variant is read by `hint`."""
    if frame.relations is not None and (found := frame.relations.to_one(path, hint)) is not None:
        return found
    names = path.split(".")
    if frame.column is not None and isinstance(frame.schema, T.VariantType):
        return in_json(Value(frame.column, frame.schema), names, hint)
    v = frame.top(names[0])
    for i, name in enumerate(names[1:], 1):
        if isinstance(v.type, (T.StringType, T.VariantType)):
            return in_json(v, names[i:], hint)
        v = inside(v, name)
    return in_json(v, [], hint) if hint == "array" and isinstance(v.type, (T.StringType, T.VariantType)) or isinstance(v.type, T.VariantType) and hint != "variant" else v


class Compiler:
    def __init__(self, options: EngineOptions, root: Frame, context: dict[str, Any] | None = None, outer: Callable[[str], Value] | None = None):
        self.options, self.root, self.context, self.outer = options, root, context, outer

    # Logic.

    def compile(self, node: Node, frame: Frame | None = None) -> Verdict:
        frame = frame or self.root
        match node:
            case Literal(value):
                return Verdict(F.lit(value), F.lit("false"), sure=True)
            case All(parts, error):
                return self._all([self.compile(p, frame) for p in parts], error)
            case Any_(parts, error):
                return self._any([(self.compile(p, frame), p) for p in parts], error)
            case If():
                return self._if(node, frame)
            case ArrayRule():
                return self.array(node, frame)
            case AggregateRule():
                return self.aggregate(node, frame)
            case DateRule():
                return scalar.date_rule(node, resolve(frame, node.path), self.rhs(node.rhs, frame), self.options)
            case FieldRule():
                rhs = None if node.rhs == Source() else self.rhs(node.rhs, frame)
                hint = rhs.family if rhs is not None and not isinstance(rhs.literal, (list, tuple)) else family(literal(rhs.literal[0]).type) if rhs is not None and rhs.literal else "text"
                if node.operator in ("exists", "notExists") and self.options.profile != "sql":
                    hint = "variant"  # a JSON null exists
                return scalar.field_rule(node, resolve(frame, node.path, hint), rhs, self.options)
        raise RuleError(f"unknown rule {node!r}")

    def _all(self, verdicts: list[Verdict], error: str | None) -> Verdict:
        if not verdicts:
            return Verdict(F.lit(True), F.lit(""), sure=True)
        ok = reduce(Column.__and__, [v.ok for v in verdicts])
        texts = F.array_compact(F.array(*[F.when(~v.strict(), v.error) for v in verdicts]))
        text = F.lit(error) if error is not None else F.when(F.size(texts) == 1, texts[0]).otherwise(F.concat(F.lit("All conditions must pass: "), F.array_join(texts, " AND ")))
        return Verdict(ok, text, all(v.sure for v in verdicts))

    def _any(self, verdicts: list[tuple[Verdict, Node]], error: str | None) -> Verdict:
        if not verdicts:
            return Verdict(F.lit(False), F.lit(error or "At least one condition must pass: "), sure=True)
        ok = reduce(Column.__or__, [v.ok for v, _ in verdicts])
        texts = [v.error for v, n in verdicts if not isinstance(n, Literal)]
        text = F.lit(error) if error is not None else texts[0] if len(texts) == 1 else F.concat(F.lit("At least one condition must pass: "), F.concat_ws(" OR ", *texts))
        return Verdict(ok, text, all(v.sure for v, _ in verdicts))

    def _if(self, node: If, frame: Frame) -> Verdict:
        test, then = self.compile(node.test, frame), self.compile(node.then, frame)
        other = self.compile(node.other, frame) if node.other is not None else Verdict(F.lit(True), F.lit(""), sure=True)
        if self.options.profile == "sql":
            return Verdict((~test.ok | then.ok) & (test.ok | other.ok), F.when(test.strict(), then.error).otherwise(other.error))
        return Verdict(F.when(test.strict(), then.strict()).otherwise(other.strict()), F.when(test.strict(), then.error).otherwise(other.error), sure=True)

    # Right sides.

    def rhs(self, source: Source, frame: Frame) -> Value:
        if source.bind is not None:
            raise RuleError(f"no value is bound to {source.bind}")
        if source.value is not MISSING:
            return literal(source.value)
        if source.path is None:
            raise RuleError("no value")
        if source.path.startswith("$."):
            return resolve(frame, source.path[2:])
        if self.context is not None:
            v: Any = self.context
            for name in source.path.split("."):
                v = v.get(name) if isinstance(v, dict) else v[int(name)] if isinstance(v, list) and name.isdigit() and int(name) < len(v) else None
            return literal(v)
        return self.outer(source.path) if self.outer is not None else resolve(self.root, source.path)

    # Embedded arrays.

    def _elements(self, v: Value, window: Slice) -> Column:
        """The window's part of an array: filter, stable order, skip, take."""
        arr, element = v.column, v.type.elementType
        if window.filter is not None:
            arr = F.filter(arr, lambda x: self.compile(window.filter, Frame(element, x)).strict())
        if window.order:
            keyed = F.transform(arr, lambda x, i: F.struct(*[resolve(Frame(element, x), p).column.alias(f"k{n}") for n, (p, _) in enumerate(window.order)], i.alias("i"), x.alias("x")))

            def compare(a: Column, b: Column) -> Column:
                out = a["i"] - b["i"]
                for n in reversed(range(len(window.order))):
                    x, y, sign = a[f"k{n}"], b[f"k{n}"], -1 if window.order[n][1] == "desc" else 1
                    out = F.when(x.isNull() & y.isNull(), out).when(x.isNull(), F.lit(sign)).when(y.isNull(), F.lit(-sign)).when(x < y, F.lit(-sign)).when(x > y, F.lit(sign)).otherwise(out)
                return out

            arr = F.transform(F.array_sort(keyed, compare), lambda s: s["x"])
        if window.skip or window.take is not None:
            begin = (window.skip or 0) + 1
            arr = F.slice(arr, F.lit(begin), F.lit(window.take) if window.take is not None else F.greatest(F.size(arr), F.lit(0)))
        return arr

    def _bad_data(self, bad: Column, v: Verdict, what: str) -> Verdict:
        """The policy for data that no rule can be applied to."""
        policy = self.options.on_data_error
        if policy == "raise":
            return replace(v, ok=F.when(bad, F.raise_error(F.lit(what)).cast("boolean")).otherwise(v.ok))
        if policy == "null" or self.options.profile == "sql":
            return Verdict(F.when(~bad, v.ok), F.when(bad, F.lit(what)).otherwise(v.error))
        return Verdict(F.when(bad, F.lit(False)).otherwise(v.strict()), F.when(bad, F.lit(what)).otherwise(v.error), sure=True)

    def array(self, rule: ArrayRule, frame: Frame) -> Verdict:
        if rule.path is None:
            raise RuleError("an array rule without a field judges a whole table: use check_all")
        if frame.relations is not None and (found := frame.relations.many(rule)) is not None:
            return found
        v = resolve(frame, rule.path, "array")
        if v.family != "array":
            return Verdict(F.lit(False), F.lit(rule.error or f"{rule.path} is no array"), sure=True)
        rule = extremal(rule)
        arr, op, element = self._elements(v, rule.window), rule.operator, v.type.elementType
        null = v.column.isNull()
        if op in ("empty", "notEmpty"):
            ok = F.size(arr) == 0 if op == "empty" else F.size(arr) > 0
            if self.options.profile == "sql":
                return Verdict(null | ok if op == "empty" else ok, quantified(rule))
            return self._bad_data(null, Verdict(ok, quantified(rule)), f"{rule.path} is no array")
        if not isinstance(element, (T.StructType, T.MapType, T.ArrayType, T.VariantType)):
            vacuous = quantifier(rule, F.lit(0), F.lit(0))
            verdict = Verdict(F.when(F.size(arr) > 0, F.lit(False)).otherwise(vacuous), F.lit(rule.error or self._plain(rule)))
            return self._bad_data(null, verdict, f"{rule.path} is no array")
        holds = lambda x: self.compile(rule.condition, Frame(element, x)).strict()
        matched = F.size(F.filter(arr, holds))
        if op == "all":
            ok = F.forall(arr, holds)
        elif op in ("any", "none"):
            ok = F.exists(arr, holds) if op == "any" else ~F.exists(arr, holds)
        else:
            ok = quantifier(rule, matched, F.size(arr))
        verdict = Verdict(ok, quantified(rule, matched, F.size(arr) - matched))
        if isinstance(element, T.VariantType):  # a JSON array of plain values only, which is known by its values alone
            plain = (F.size(arr) > 0) & ~F.exists(arr, lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT")))
            verdict = Verdict(F.when(plain, F.lit(False)).otherwise(ok), F.when(plain, F.lit(rule.error or self._plain(rule))).otherwise(verdict.error))
        return self._bad_data(null, verdict, f"{rule.path} is no array")

    @staticmethod
    def _plain(rule: ArrayRule) -> str:
        return f"{rule.path} holds plain values; compare them with contains or in"

    def aggregate(self, rule: AggregateRule, frame: Frame) -> Verdict:
        if frame.relations is not None and (found := frame.relations.many(rule)) is not None:
            return found
        v = resolve(frame, rule.path, "array")
        if v.family != "array":
            return Verdict(F.lit(False), F.lit(rule.error or f"{rule.path} is no array"), sure=True)
        element, arr = v.type.elementType, self._elements(v, rule.window)
        if rule.condition is not None:
            arr = F.filter(arr, lambda x: self.compile(rule.condition, Frame(element, x)).strict())
        hint = "variant" if self.options.profile != "sql" else "number"
        item = lambda x: resolve(Frame(element, x), rule.item, hint) if rule.item else Value(x, element)

        def number(x: Column) -> Column:
            value = item(x)
            if isinstance(value.type, T.VariantType):  # of a JSON value, a number only; the sql profile casts a text
                read = F.try_variant_get(value.column, "$", "double")
                return read if self.options.profile == "sql" else F.when(F.schema_of_variant(value.column).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), read)
            return value.column.cast("double") if value.family == "number" else F.lit(None).cast("double")

        values = F.transform(arr, number)
        total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
        n = F.size(values)
        if rule.mode == "sum":
            result = total
        else:
            result = F.when(n > 0, total / n)
            result = result if self.options.profile == "sql" else F.when(n == 0, F.lit(0.0)).otherwise(result)
        bad = v.column.isNull() | F.coalesce(F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
        return self._bad_data(bad, compared(rule, result, self.rhs(rule.rhs, frame), self.options), f"{rule.path} holds a value that is no number")


def quantifier(rule: ArrayRule, matched: Column, n: Column) -> Column:
    match rule.operator:
        case "all":
            return matched == n
        case "any":
            return matched > 0
        case "none":
            return matched == 0
        case "atLeast":
            return matched >= rule.count
        case "atMost":
            return matched <= rule.count
        case "exactly":
            return matched == rule.count
        case "empty":
            return n == 0
        case "notEmpty":
            return n > 0
    raise RuleError(rule.operator)


def quantified(rule: ArrayRule, matched: Column | None = None, failed: Column | None = None) -> Column:
    """The error text of an array rule."""
    if rule.error is not None:
        return F.lit(rule.error)
    name, k = rule.path or "undefined", rule.count
    failed = F.lit(0) if rule.condition == Literal(False) else failed  # an item that is denied without a text is no failure
    texts = {"empty": "must be empty", "notEmpty": "must not be empty", "all": "all elements must match ({failed} failed)", "any": "at least one element must match", "none": "no elements should match ({matched} matched)"}
    texts |= {op: f"{words} {k} elements must match ({{matched}} matched)" for op, words in (("atLeast", "at least"), ("atMost", "at most"), ("exactly", "exactly"))}
    text = f"{name} {texts[rule.operator]}"
    for mark, value in (("{failed}", failed), ("{matched}", matched)):
        if mark in text:
            before, after = text.split(mark)
            return F.concat(F.lit(before), F.coalesce(value, F.lit(0)).cast("string"), F.lit(after))
    return F.lit(text)


def compared(rule: AggregateRule, result: Column, rhs: Value, options: EngineOptions) -> Verdict:
    """An aggregate against its right side."""
    own = Value(result, T.DoubleType())
    text = F.lit(rule.error) if rule.error is not None else F.concat(F.lit(f"{rule.path} {rule.mode} {PHRASES[rule.operator]} "), shown_column(rhs))
    as_field = FieldRule(rule.path, rule.operator, Source(), rule.error)
    out = scalar.field_rule(as_field, own, rhs, options)
    return Verdict(out.ok, text, out.sure)

