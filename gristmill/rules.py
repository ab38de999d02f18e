"""The rule tree: plain JSON values read strictly into frozen nodes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from gristmill import catalog


class RuleError(ValueError):
    """A rule, path or option that can't be compiled."""


MISSING = object()


@dataclass(frozen=True)
class Source:
    """Where a rule's right side comes from: a value, a path, or a late-bound name."""

    value: Any = MISSING
    path: str | None = None
    bind: str | None = None


@dataclass(frozen=True)
class Slice:
    """filter, then order, then skip, then take."""

    filter: Node | None = None
    order: tuple[tuple[str, str], ...] = ()
    skip: int | None = None
    take: int | None = None

    def __bool__(self) -> bool:
        return self.filter is not None or bool(self.order) or self.skip is not None or self.take is not None


@dataclass(frozen=True)
class Literal:
    value: bool


@dataclass(frozen=True)
class All:
    parts: tuple[Node, ...]
    error: str | None = None


@dataclass(frozen=True)
class Any_:
    parts: tuple[Node, ...]
    error: str | None = None


@dataclass(frozen=True)
class If:
    test: Node
    then: Node
    other: Node | None = None


@dataclass(frozen=True)
class FieldRule:
    path: str
    operator: str
    rhs: Source
    error: str | None = None
    ci: bool | None = None
    fuzzy: Any = None
    coerce: str | None = None


@dataclass(frozen=True)
class DateRule:
    path: str
    operator: str
    rhs: Source
    error: str | None = None


@dataclass(frozen=True)
class ArrayRule:
    path: str | None
    operator: str
    condition: Node | None = None
    count: int | None = None
    window: Slice = field(default_factory=Slice)
    error: str | None = None


@dataclass(frozen=True)
class AggregateRule:
    path: str
    mode: str
    item: str | None
    operator: str
    rhs: Source
    condition: Node | None = None
    window: Slice = field(default_factory=Slice)
    error: str | None = None


Node = Literal | All | Any_ | If | FieldRule | DateRule | ArrayRule | AggregateRule


def parse(rule: Any) -> Node:
    """A rule as a node. Anything ambiguous or unknown raises; `gristmill.validation` lists all such findings instead."""
    if isinstance(rule, bool):
        return Literal(rule)
    if not isinstance(rule, dict):
        if type(rule) in _NODES:
            return rule
        raise RuleError(f"not a rule: {rule!r}")
    kinds = [k for k in ("all", "any", "arrayOperator", "dateOperator", "aggregate", "if") if k in rule]
    if len(kinds) > 1:
        raise RuleError(f"ambiguous rule: {', '.join(kinds)}")
    error = rule.get("error")
    kind = kinds[0] if kinds else ""
    if kind in ("all", "any"):
        if not isinstance(rule[kind], list):
            raise RuleError(f"{kind} takes a list")
        return (All if kind == "all" else Any_)(tuple(map(parse, rule[kind])), error)
    if kind == "if":
        if "then" not in rule:
            raise RuleError("if without then")
        return If(parse(rule["if"]), parse(rule["then"]), parse(rule["else"]) if "else" in rule else None)
    if kind == "arrayOperator":
        op = rule["arrayOperator"]
        if op not in catalog.ARRAY_OPERATORS:
            raise RuleError(f"unknown array operator {op}")
        needs, counts, _ = catalog.ARRAY_OPERATORS[op]
        if needs and "condition" not in rule:
            raise RuleError(f"{op} needs a condition")
        if counts and not (isinstance(rule.get("count"), int) and not isinstance(rule["count"], bool) and rule["count"] >= 0):
            raise RuleError(f"{op} needs a count")
        return ArrayRule(rule.get("field"), op, parse(rule["condition"]) if needs else None, rule.get("count"), _slice(rule), error)
    if not isinstance(rule.get("field"), str):
        raise RuleError("a rule needs a field")
    if kind == "dateOperator":
        if rule["dateOperator"] not in catalog.DATE_OPERATORS:
            raise RuleError(f"unknown date operator {rule['dateOperator']}")
        return DateRule(rule["field"], rule["dateOperator"], _source(rule), error)
    op = rule.get("operator")
    if kind == "aggregate":
        own = rule["aggregate"] if isinstance(rule["aggregate"], dict) else {}
        if own.get("mode") not in catalog.AGGREGATE_MODES:
            raise RuleError(f"unknown aggregate mode {own.get('mode')}")
        if op not in (*catalog.AGGREGATE_SINGLE, *catalog.AGGREGATE_RANGE):
            raise RuleError(f"{op} doesn't compare aggregates")
        return AggregateRule(rule["field"], own["mode"], own.get("field"), op, _source(rule), parse(rule["condition"]) if "condition" in rule else None, _slice(rule), error)
    if op not in catalog.FIELD_OPERATORS:
        raise RuleError(f"unknown operator {op}")
    rhs = Source() if op in catalog.PRESENCE else _source(rule)
    return FieldRule(rule["field"], op, rhs, error, rule.get("caseInsensitive"), rule.get("fuzzy"), rule.get("coerceType"))


def _source(rule: dict) -> Source:
    value = rule.get("value", MISSING)
    if isinstance(value, dict) and set(value) == {"bind"}:
        return Source(bind=value["bind"])
    out = Source(value, rule.get("path"), rule.get("bind"))
    if out.value is MISSING and out.path is None and out.bind is None:
        raise RuleError(f"no value, bind or path for {rule.get('field')}")
    return out


def _slice(rule: dict) -> Slice:
    for key in ("skip", "take"):
        if key in rule and (not isinstance(rule[key], int) or isinstance(rule[key], bool) or rule[key] < 0):
            raise RuleError(f"{key} takes a count")
    order = tuple((o["field"], o.get("dir", "asc")) for o in rule.get("orderBy") or ())
    return Slice(parse(rule["filter"]) if "filter" in rule else None, order, rule.get("skip"), rule.get("take"))


def children(node: Node) -> list[Node]:
    """Nodes directly below, window filters included."""
    match node:
        case All(parts) | Any_(parts):
            return list(parts)
        case If(test, then, other):
            return [x for x in (test, then, other) if x is not None]
        case ArrayRule() | AggregateRule():
            return [x for x in (node.condition, node.window.filter) if x is not None]
    return []


def rebuild(node: Node, change) -> Node:
    """The tree with `change` applied from the leaves up."""
    match node:
        case All() | Any_():
            node = replace(node, parts=tuple(rebuild(p, change) for p in node.parts))
        case If():
            node = If(rebuild(node.test, change), rebuild(node.then, change), rebuild(node.other, change) if node.other is not None else None)
        case ArrayRule() | AggregateRule():
            own = rebuild(node.window.filter, change) if node.window.filter is not None else None
            node = replace(node, condition=rebuild(node.condition, change) if node.condition is not None else None, window=replace(node.window, filter=own))
    return change(node)


def nodes(node: Node) -> Iterator[Node]:
    yield node
    for c in children(node):
        yield from nodes(c)


def extremal(rule: ArrayRule) -> ArrayRule:
    """Drops a window that only picks the extreme row, where the quantifier over all rows says the same.

    take 1 by one key and a bound on that key: if the least row meets a lower bound, all do; if it meets an upper bound, some row does.
    """
    w, c = rule.window, rule.condition
    if rule.operator not in ("all", "any") or w.take != 1 or w.skip or len(w.order) != 1 or not isinstance(c, FieldRule) or c.path != w.order[0][0] or c.rhs.path is not None:
        return rule
    upward = c.operator in ("greaterThan", "greaterThanEquals")
    if not upward and c.operator not in ("lessThan", "lessThanEquals"):
        return rule
    every = upward == (w.order[0][1] == "asc")
    if every != (rule.operator == "all"):
        return rule
    return replace(rule, window=Slice(filter=w.filter))


_NODES = (Literal, All, Any_, If, FieldRule, DateRule, ArrayRule, AggregateRule)