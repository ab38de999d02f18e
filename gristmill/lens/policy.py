"""Lenses, chains of narrowings, and what they come to at one place of the schema.

A narrowing is {root, mapDefaults}: root applies at the lens's model and, by `relations`, at the paths below it; the defaults apply
wherever a model or enum turns up. Along a chain picks intersect, omits add up, wheres are joined by AND.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from gristmill.rules import RuleError
from gristmill.sources.schema import Model, SchemaSet


@dataclass(frozen=True)
class Lens:
    schema: SchemaSet
    model: str

    def __post_init__(self) -> None:
        self.schema.model(self.model)


@dataclass(frozen=True)
class Narrowing:
    parent: Lens | Narrowing
    root: dict = field(default_factory=dict)
    defaults: dict = field(default_factory=dict)


def chain(lens: Lens | Narrowing) -> tuple[Lens, list[Narrowing]]:
    """The lens itself and its narrowings, the oldest first."""
    found: list[Narrowing] = []
    while isinstance(lens, Narrowing):
        if any(lens is x for x in found):
            raise RuleError("the chain of parents is a circle")
        found.append(lens)
        lens = lens.parent
    return lens, found[::-1]


def defaults_of(narrowing: Narrowing, model: str) -> dict:
    """What a layer says of a model wherever it occurs. Defaults are keyed by map, or hold models at once."""
    source, _, name = model.rpartition(":")
    own = narrowing.defaults.get(source, narrowing.defaults) if source else narrowing.defaults
    models = own.get("models", {}) if isinstance(own, dict) else {}
    return models.get(name, models.get(model, {}))


def enum_defaults(narrowing: Narrowing, model: str, enum: str) -> dict:
    source = model.rpartition(":")[0]
    own = narrowing.defaults.get(source, narrowing.defaults) if source else narrowing.defaults
    return own.get("enums", {}).get(enum.rpartition(":")[2], {})


@dataclass
class Visit:
    """The narrowing in force where a model is reached."""

    model: Model
    path: tuple[str, ...]
    visible: set[str]
    relations: set[str]
    wheres: list[Any]
    sources: dict[str, dict]
    enums: dict[str, list[str]]

    def sees(self, name: str) -> bool:
        return name in self.visible or name in self.relations


def spec(value: Any) -> dict:
    """A source as {where, label, groupBy}."""
    if isinstance(value, dict) and not ({"field", "all", "any", "if"} & value.keys()):
        out = dict(value)
        if "groupBy" in out and isinstance(out["groupBy"], str):
            out["groupBy"] = [out["groupBy"]]
        return out
    return {"where": value}


#: No path of relations: what a layer says of a model there are its defaults alone.
OFF_PATH = ("",)


def nodes_at(lens: Lens | Narrowing, model: str, path: tuple[str, ...]) -> Iterator[tuple[int, dict]]:
    """Each layer's defaults for the model, then its node at the path."""
    for i, n in enumerate(chain(lens)[1]):
        if own := defaults_of(n, model):
            yield i, own
        node: Any = n.root
        for name in path:
            node = (node or {}).get("relations", {}).get(name)
        if node:
            yield i, node


def resolve_visit(lens: Lens | Narrowing, path: tuple[str, ...] = (), model_name: str | None = None) -> Visit:
    """The visit at a path, or with `model_name` at OFF_PATH."""
    base, layers = chain(lens)
    model = base.schema.model(model_name or base.model)
    for name in () if model_name else path:
        if name not in model.relations:
            raise RuleError(f"{model.name} has no relation {name}")
        model = base.schema.model(model.relations[name].target)
    every = set(model.fields) | set(model.relations)
    seen, wheres, sources = set(every), [], {}
    allowed: dict[str, list[set[str]]] = {}
    denied: dict[str, set[str]] = {}
    for _, node in nodes_at(lens, model.name, path):
        if "picks" in node:
            seen &= set(node["picks"]) | set(node.get("relations", {}))
        seen -= set(node.get("omits", ()))
        if "where" in node:
            wheres.append(node["where"])
        for name, values in node.get("enumPicks", {}).items():
            allowed.setdefault(name, []).append(set(values))
        for name, values in node.get("enumOmits", {}).items():
            denied.setdefault(name, set()).update(values)
        for name, value in node.get("sources", {}).items():
            own, before = spec(value), sources.get(name, {})
            both = [x for x in (before.get("where"), own.get("where")) if x is not None]
            sources[name] = before | own | ({"where": both[0] if len(both) == 1 else {"all": both}} if both else {})
    enums = {}
    for name, f in model.fields.items():
        values = f.values if f.values is not None else base.schema.enums.get(f.enum or "") if f.kind == "Enum" else None
        if f.kind == "Enum" and f.values is not None and f.enum in base.schema.enums:
            values = [v for v in f.values if v in base.schema.enums[f.enum]]
        if values is None:
            continue
        for layer in layers:
            own = enum_defaults(layer, model.name, f.enum) if f.enum else {}
            values = [v for v in values if ("picks" not in own or v in own["picks"]) and v not in own.get("omits", ())]
        enums[name] = [v for v in values if all(v in a for a in allowed.get(name, ())) and v not in denied.get(name, set())]
    return Visit(model, path, seen & set(model.fields), seen & set(model.relations), wheres, sources, enums)


def walk_lens_path(lens: Lens | Narrowing, path: str, start: tuple[str, ...] = ()) -> tuple[tuple[str, ...], str | None]:
    """The relations that a dotted path passes, and the field it ends on (None: on a relation). Raises where something isn't visible."""
    at, names = start, path.split(".")
    for i, name in enumerate(names):
        visit = resolve_visit(lens, at)
        if not visit.sees(name):
            raise RuleError(f"{path}: {name} is not visible on {visit.model.name}")
        if name in visit.relations:
            at = (*at, name)
            continue
        if i < len(names) - 1 and visit.model.fields[name].kind != "Json":
            raise RuleError(f"{path}: {name} has no parts")
        return at, name
    return at, None
