"""Findings about a chain of narrowings: a layer may only name what is there, and only take away from what older layers left."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from gristmill.lens.gate import check_rule_against_lens, validate_bind_names
from gristmill.lens.policy import OFF_PATH, Lens, Narrowing, chain, defaults_of, enum_defaults, nodes_at, spec
from gristmill.sources.schema import Model


def validate_narrowing(lens: Narrowing) -> list[str]:
    """Where a layer refers to what isn't there, takes what is gone already, or gives back what an older layer took. Empty: all is well."""
    base, layers = chain(lens)
    found: list[str] = []
    for i, layer in enumerate(layers):
        found += _Layer(base, layers[i - 1] if i else base, layer).findings()
    return found + validate_bind_names(lens)


def _gone(name: str, nodes: Iterable[dict], with_relations: bool = False) -> str | None:
    """Why a name isn't left by older nodes. with_relations: one that a node narrows as a relation counts as picked."""
    for n in nodes:
        if "picks" in n and name not in n["picks"] and not (with_relations and name in n.get("relations", {})):
            return "is not picked there"
        if name in n.get("omits", ()):
            return "is omitted there"
    return None


class _Layer:
    """One layer against the older ones. A node at a path is judged with its path; a default, which holds wherever its model is, at OFF_PATH."""

    def __init__(self, base: Lens, before: Lens | Narrowing, layer: Narrowing):
        self.base, self.before, self.layer, self.schema = base, before, layer, base.schema
        self.found: list[str] = []

    def say(self, where: str, what: str) -> None:
        self.found.append(f"{where}: {what}")

    def findings(self) -> list[str]:
        own = self.layer.defaults
        for source, part in (own if "models" not in own and "enums" not in own else {"": own}).items():
            self._defaults(source, part)
        self._node(self.layer.root, (), self.schema.model(self.base.model))
        return self.found

    def _older(self, model: str, path: tuple[str, ...]) -> list[dict]:
        """What older layers say of a model there, their defaults included."""
        return [n for _, n in nodes_at(self.before, model, path)]

    def _defaults(self, source: str, part: dict) -> None:
        known = lambda name, among: f"{source}:{name}" if source and f"{source}:{name}" in among else name
        for name, own in part.get("models", {}).items():
            full = known(name, self.schema.models)
            if full not in self.schema.models:
                self.say(f"unknown model {name}", "no model of that name")
                continue
            if own.get("relations"):
                self.say(full, "a default holds wherever the model is, so it narrows no relations")
            self._node({k: v for k, v in own.items() if k != "relations"}, OFF_PATH, self.schema.model(full))
        for name, own in part.get("enums", {}).items():
            values = self.schema.enums.get(known(name, self.schema.enums))
            if values is None:
                self.say(name, "no enum of that name")
                continue
            older = [enum_defaults(n, f"{source}:" if source else "", name) for n in chain(self.before)[1]]
            for key in ("picks", "omits"):
                for v in own.get(key, ()):
                    if v not in values:
                        self.say(f"{name}.{key}", f"{v} is no value of the enum")
                    elif why := _gone(v, older):
                        self.say(f"{name}.{key}", f"{v} {why} by an older layer")

    def _node(self, own: dict, path: tuple[str, ...], model: Model) -> None:
        at, older = (f"{model.name} by default" if path == OFF_PATH else ".".join((self.base.model, *path))), self._older(model.name, path)
        same = [] if path == OFF_PATH else [defaults_of(self.layer, model.name)]
        if "picks" in own and "omits" in own:
            self.say(at, "picks and omits exclude each other")
        for key in ("picks", "omits"):
            for name in own.get(key, ()):
                if name not in model.fields and name not in model.relations:
                    self.say(f"{at}.{key}", f"{name} is unknown")
                elif why := _gone(name, older):
                    self.say(f"{at}.{key}", f"{name} {why} by an older layer")
                elif why := _gone(name, same):
                    self.say(f"{at}.{key}", f"{name} {why} by this layer's default")
        for key in ("enumPicks", "enumOmits"):
            for name, values in own.get(key, {}).items():
                self._enum(f"{at}.{key}", model, name, values, older, same)
        if "where" in own:
            # At the root a condition filters rows as older layers show them; below, it may name any column, as it shows none.
            scope = self.before if path == () else Lens(self.schema, model.name)
            for x in check_rule_against_lens(own["where"], scope):
                self.say(f"{at}.where", x)
        for name, value in own.get("sources", {}).items():
            self._source(f"{at}.sources.{name}", model, path, name, spec(value), older)
        for name, inner in own.get("relations", {}).items():
            if name not in model.relations:
                self.say(f"{at}.relations", f"{name} is no relation" if name in model.fields else f"{name} is unknown")
            elif model.relations[name].target in self.schema.models:
                self._node(inner, (*path, name), self.schema.model(model.relations[name].target))

    def _enum(self, at: str, model: Model, name: str, values: list[str], older: list[dict], same: list[dict]) -> None:
        if name not in model.fields:
            return self.say(at, f"{name} is unknown")
        f = model.fields[name]
        if f.kind != "Enum":
            return self.say(at, f"{name} is no enum")
        known = f.values if f.values is not None else self.schema.enums.get(f.enum or "")
        types = [enum_defaults(n, model.name, f.enum) for n in (*chain(self.before)[1], self.layer)] if f.enum else []
        fields = [{k: n[long][name] for k, long in (("picks", "enumPicks"), ("omits", "enumOmits")) if name in n.get(long, {})} for n in (*older, *same)]
        for v in values:
            if known is not None and v not in known:
                self.say(at, f"{v} is no value of {name}")
            elif why := _gone(v, [*types, *fields]):
                self.say(at, f"{v} {why} before")

    def _source(self, at: str, model: Model, path: tuple[str, ...], name: str, own: dict[str, Any], older: list[dict]) -> None:
        if name not in model.fields:
            return self.say(at, "the field is unknown")
        if "where" in own and own["where"] is not None:
            for x in check_rule_against_lens(own["where"], Lens(self.schema, model.name)):
                self.say(at, x)
        # Labels and axes become visible as options. What an older layer declared itself stays allowed.
        declared = [spec(n["sources"][name]) for n in older if name in n.get("sources", {})]
        if (label := own.get("label")) is not None:
            if label not in model.fields:
                self.say(at, f"the label {label} is unknown")
            elif all(d.get("label") != label for d in declared) and (why := _gone(label, older, True)):
                self.say(at, f"the label {label} {why} by an older layer")
        axes = own.get("groupBy")
        for axis in axes or ():
            self._axis(at, axis, model)
        if not axes or any(d.get("groupBy") == axes for d in declared):
            return None
        if other := next((d["groupBy"] for d in declared if d.get("groupBy")), None):
            self.say(at, f"grouped by {axes}, but by {other} in an older layer")
        for axis in axes:
            at_model, at_path = model, path
            for hop in axis.split("."):
                if why := _gone(hop, self._older(at_model.name, at_path), True):
                    self.say(at, f"{hop} of the axis {axis} {why} by an older layer")
                    break
                if hop not in at_model.relations:
                    break
                at_model, at_path = self.schema.model(at_model.relations[hop].target), (*at_path, hop)
        return None

    def _axis(self, at: str, axis: str, model: Model) -> None:
        *hops, last = axis.split(".")
        for hop in hops:
            if hop not in model.relations or model.relations[hop].many:
                return self.say(at, f"{axis} doesn't lead to one row")
            model = self.schema.model(model.relations[hop].target)
        if last not in model.fields or model.fields[last].many:
            self.say(at, f"{axis} doesn't end on a scalar")
        return None
