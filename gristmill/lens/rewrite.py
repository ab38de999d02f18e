"""Rules rewritten so that the engine sees only rows in scope, and with the kinds of the schema stamped on."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from gristmill import catalog
from gristmill.lens.policy import Lens, Narrowing, chain, resolve_visit
from gristmill.rules import AggregateRule, All, Any_, ArrayRule, DateRule, FieldRule, If, Node, RuleError, parse


def _and(*parts: Node | None) -> Node | None:
    own = [p for p in parts if p is not None]
    return None if not own else own[0] if len(own) == 1 else All(tuple(own))


def _grant(lens: Lens | Narrowing, at: tuple[str, ...]) -> Node | None:
    return _and(*[parse(w) for w in resolve_visit(lens, at).wheres])


def rerooted(n: Node, prefix: str) -> Node:
    """A condition on a related row as one on the row that leads to it. What can't be moved raises, so nothing gets through unscoped."""
    match n:
        case All(parts, error):
            return All(tuple(rerooted(p, prefix) for p in parts), error)
        case Any_(parts, error):
            return Any_(tuple(rerooted(p, prefix) for p in parts), error)
        case If(test, then, other):
            return If(rerooted(test, prefix), rerooted(then, prefix), rerooted(other, prefix) if other is not None else None)
        case FieldRule() | DateRule():
            if n.rhs.path is not None:
                raise RuleError(f"a grant with a path can't be moved to {prefix}")
            return replace(n, path=f"{prefix}.{n.path}")
        case ArrayRule() | AggregateRule():
            if n.condition is not None or n.window:
                raise RuleError(f"a grant with a condition can't be moved to {prefix}")
            return replace(n, path=f"{prefix}.{n.path}")
    return n


def apply_lens(rule: Any, lens: Lens | Narrowing) -> Node:
    """The rule with every grant at its anchor: AND at the root, the window's filter under `all`, AND in other conditions, and on to-one
    hops moved to the row that they start from."""
    base = chain(lens)[0]

    def hops(path: str, at: tuple[str, ...]) -> tuple[list[tuple[str, ...]], tuple[str, ...]]:
        model, passed, here = resolve_visit(lens, at).model, [], at
        for name in path.split("."):
            if name not in model.relations:
                break
            here = (*here, name)
            passed.append(here)
            model = base.schema.model(model.relations[name].target)
        return passed, here

    def many(place: tuple[str, ...]) -> bool:
        return resolve_visit(lens, place[:-1]).model.relations[place[-1]].many

    def visit(n: Node, at: tuple[str, ...]) -> Node:
        match n:
            case All(parts, error):
                return All(tuple(visit(p, at) for p in parts), error)
            case Any_(parts, error):
                return Any_(tuple(visit(p, at) for p in parts), error)
            case If(test, then, other):
                return If(visit(test, at), visit(then, at), visit(other, at) if other is not None else None)
            case FieldRule() | DateRule():
                passed, _ = hops(n.path, at)
                if any(map(many, passed)):
                    raise RuleError(f"{n.path} passes many rows without a quantifier")
                return _and(*[rerooted(g, ".".join(p[len(at) :])) for p in passed if (g := _grant(lens, p)) is not None], n)
            case ArrayRule() | AggregateRule() if n.path is not None:
                passed, place = hops(n.path, at)
                grant = _grant(lens, place) if passed and place == passed[-1] else None
                before = [rerooted(g, ".".join(p[len(at) :])) for p in passed[:-1] if (g := _grant(lens, p)) is not None]
                if any(map(many, passed[:-1])) and before:
                    raise RuleError(f"{n.path}: a grant on rows in between can't be kept")
                own = visit(n.condition, place) if n.condition is not None else None
                keep = visit(n.window.filter, place) if n.window.filter is not None else None
                counts = isinstance(n, ArrayRule) and (n.operator == "all" or n.condition is None) or bool(n.window)
                if grant is not None and counts:
                    keep = _and(grant, keep)
                elif grant is not None:
                    own = _and(grant, own)
                out = replace(n, condition=own, window=replace(n.window, filter=keep) if keep is not None else n.window)
                return _and(*before, out)
        return n

    return _and(_grant(lens, ()), visit(parse(rule), ()))


def stamp_coercions(rule: Any, lens: Lens | Narrowing) -> Node:
    """Field rules on scalar fields get the kind of their field, unless they name one."""
    base = chain(lens)[0]

    def end(path: str, model: str) -> tuple[str, str | None]:
        at = base.schema.model(model)
        for name in path.split("."):
            if name in at.relations:
                at = base.schema.model(at.relations[name].target)
                continue
            f = at.fields.get(name)
            return at.name, f.kind if f is not None and not f.many and "." not in path[path.index(name) + len(name) :] else None
        return at.name, None

    def visit(n: Node, model: str) -> Node:
        match n:
            case All(parts, error):
                return All(tuple(visit(p, model) for p in parts), error)
            case Any_(parts, error):
                return Any_(tuple(visit(p, model) for p in parts), error)
            case If(test, then, other):
                return If(visit(test, model), visit(then, model), visit(other, model) if other is not None else None)
            case FieldRule():
                kind = end(n.path, model)[1]
                return replace(n, coerce=kind) if n.coerce is None and kind in catalog.COERCIBLE and n.operator not in catalog.PRESENCE else n
            case ArrayRule() | AggregateRule() if n.path is not None:
                target = end(n.path, model)[0]
                keep = visit(n.window.filter, target) if n.window.filter is not None else None
                return replace(n, condition=visit(n.condition, target) if n.condition is not None else None, window=replace(n.window, filter=keep))
        return n

    return visit(parse(rule), base.model)

