"""What a lens shows: by path, and as the union over all paths."""

from __future__ import annotations

from typing import Any

from gristmill.lens.policy import OFF_PATH, Lens, Narrowing, chain, nodes_at, resolve_visit
from gristmill.rules import RuleError


def declared_paths(lens: Lens | Narrowing) -> list[tuple[str, ...]]:
    """The root and every path that some layer narrows."""
    found: dict[tuple[str, ...], None] = {(): None}
    for layer in chain(lens)[1]:
        todo: list[tuple[tuple[str, ...], dict]] = [((), layer.root)]
        while todo:
            path, node = todo.pop()
            found[path] = None
            todo += [((*path, name), inner) for name, inner in node.get("relations", {}).items()]
    return sorted(found)


def project_by_path(lens: Lens | Narrowing) -> dict[str, dict[str, Any]]:
    """Visible fields, relations, wheres, sources and enum values of each declared path."""
    out = {}
    for path in declared_paths(lens):
        v = resolve_visit(lens, path)
        out[".".join(path)] = {"model": v.model.name, "fields": sorted(v.visible), "relations": sorted(v.relations), "wheres": v.wheres, "sources": v.sources, "enums": {k: x for k, x in v.enums.items() if k in v.visible}}
    return out


def exposed_surface(lens: Lens | Narrowing, option_values: dict[str, list[Any]] | None = None) -> dict[str, dict[str, Any]]:
    """By model, the union of what its visits show. Relations that some layer narrows are followed by path, others to the model as its
    defaults leave it, once; so every reachable model is met, however far.

    option_values: by 'Model.field', options found by `option_frames`; they replace a field's own. One is a value, or {value, label, groups};
    of options with equal groups and value the later counts. A field whose options are grouped by different axes on different paths raises.
    """
    base = chain(lens)[0]
    out: dict[str, dict[str, Any]] = {}
    todo: list[tuple[str, tuple[str, ...], bool]] = [(base.model, (), True)]
    met: set[tuple] = set()
    while todo:
        model, path, declared = todo.pop(0)
        if (key := (model, path if declared else None)) in met:
            continue
        met.add(key)
        v = resolve_visit(lens, path) if declared else resolve_visit(lens, OFF_PATH, model)
        narrowed = {name for _, node in nodes_at(lens, model, path) for name in node.get("relations", {})} if declared else set()
        own = out.setdefault(model, {"fields": {}, "relations": {}})
        for name in sorted(v.visible):
            f = v.model.fields[name]
            entry = own["fields"].setdefault(name, {"kind": f.kind, "many": f.many})
            found = (option_values or {}).get(f"{model}.{name}")
            if found is not None:
                options = [o if isinstance(o, dict) else {"value": o} for o in found]
                entry["options"] = list({(tuple(o.get("groups") or ()), o["value"]): o for o in [*entry.get("options", ()), *options]}.values())
                entry["values"] = list(dict.fromkeys(o["value"] for o in entry["options"]))
            elif (values := v.enums.get(name)) is not None:
                entry["values"] = list(dict.fromkeys([*entry.get("values", []), *values]))
            if axes := v.sources.get(name, {}).get("groupBy"):
                if entry.setdefault("groupBy", axes) != axes:
                    raise RuleError(f"{model}.{name} is grouped by {entry['groupBy']} and by {axes}")
        for name in sorted(v.relations):
            target = v.model.relations[name].target
            own["relations"][name] = target
            todo.append((target, (*path, name), True) if name in narrowed else (target, (), False))
    return out
