"""Late-bound values: which names a rule needs, and the rule with values for them. Window filters are visited too."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from gristmill.rules import Node, Source, nodes, parse, rebuild


def required(rule: Any) -> list[str]:
    found = [n.rhs.bind for n in nodes(parse(rule)) if isinstance(getattr(n, "rhs", None), Source) and n.rhs.bind is not None]
    return list(dict.fromkeys(found))


def resolve(rule: Any, values: dict[str, Any]) -> Node:
    """Names that `values` lacks stay bound, so a rule can be resolved in steps."""

    def change(node: Node) -> Node:
        rhs = getattr(node, "rhs", None)
        if isinstance(rhs, Source) and rhs.bind is not None and rhs.bind in values:
            return replace(node, rhs=Source(value=values[rhs.bind]))
        return node

    return rebuild(parse(rule), change)
