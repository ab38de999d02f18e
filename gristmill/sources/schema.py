"""Models, relations between them, bridges between sources, and the tables behind the models."""

from __future__ import annotations

import copy
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gristmill.rules import RuleError


@dataclass
class Relation:
    """An edge to another model. keys: (column here, column there) pairs."""

    target: str
    keys: list[tuple[str, str]]
    many: bool = False
    bridge: bool = False


@dataclass
class Field:
    kind: str = "String"
    many: bool = False
    values: list[str] | None = None
    enum: str | None = None


@dataclass
class Model:
    name: str
    table: str | None = None
    fields: dict[str, Field] = field(default_factory=dict)
    relations: dict[str, Relation] = field(default_factory=dict)


@dataclass
class SchemaSet:
    """The models of one or more sources. A model of source `s` is named `s:Model` once sources are stitched."""

    models: dict[str, Model] = field(default_factory=dict)
    enums: dict[str, list[str]] = field(default_factory=dict)

    def model(self, name: str) -> Model:
        if name not in self.models:
            raise RuleError(f"unknown model {name}")
        return self.models[name]

    def relate(self, name: str, source: str, target: str, keys: list[tuple[str, str]], back: str | None = None, one: bool = False) -> SchemaSet:
        """A forward relation, and with `back` the reverse one, a list unless `one`."""
        for model, columns in ((source, [a for a, _ in keys]), (target, [b for _, b in keys])):
            own = self.model(model)
            if own.fields and (lost := [c for c in columns if c not in own.fields]):
                raise RuleError(f"{model} lacks {', '.join(lost)}")
        self.model(source).relations[name] = Relation(target, list(keys))
        if back:
            self.model(target).relations[back] = Relation(source, [(b, a) for a, b in keys], many=not one)
        return self


#: Kinds by Spark type.
_KINDS = {T.StringType: "String", T.BooleanType: "Boolean", T.IntegerType: "Int", T.ShortType: "Int", T.ByteType: "Int", T.LongType: "BigInt", T.DoubleType: "Float", T.FloatType: "Float", T.DecimalType: "Decimal", T.TimestampType: "DateTime", T.TimestampNTZType: "DateTime", T.DateType: "DateTime", T.BinaryType: "Bytes"}


def kind_of(dtype: T.DataType) -> str:
    return _KINDS.get(type(dtype), "Json")


def infer_model(name: str, df: DataFrame, table: str | None = None) -> Model:
    fields = {}
    for f in df.schema.fields:
        many = isinstance(f.dataType, T.ArrayType)
        fields[f.name] = Field(kind_of(f.dataType.elementType if many else f.dataType), many)
    return Model(name, table, fields)


def validate(schema: SchemaSet) -> None:
    """Field names may hold neither dots nor colons; relations must lead to known models and columns."""
    for model in schema.models.values():
        for name in model.fields:
            if "." in name or ":" in name:
                raise RuleError(f"{model.name}.{name}: dots and colons separate paths")
        for name, r in model.relations.items():
            if r.target not in schema.models:
                raise RuleError(f"{model.name}.{name} leads to no model")


def stitch(sources: dict[str, SchemaSet], bridges: list[dict[str, Any]]) -> SchemaSet:
    """One set of several sources. A bridge has two endpoints {source, model, on} and is oneToOne or oneToMany (the first is the one).

    Each endpoint's model gets a relation named `source:Model` of the other.
    """
    out = SchemaSet()
    for source, schema in sources.items():
        validate(schema)
        for name, model in schema.models.items():
            own = copy.deepcopy(model)
            own.name, own.table = f"{source}:{name}", model.table or name
            for r in own.relations.values():
                r.target = f"{source}:{r.target}"
            out.models[own.name] = own
        out.enums |= {f"{source}:{k}": list(v) for k, v in schema.enums.items()}
    for bridge in bridges:
        a, b = bridge["endpoints"]
        names = [f"{e['source']}:{e['model']}" for e in (a, b)]
        if names[0] == names[1]:
            raise RuleError(f"{names[0]} is bridged to itself")
        for name, e in zip(names, (a, b), strict=True):
            if name not in out.models:
                raise RuleError(f"unknown endpoint {name}")
            if out.models[name].fields and e["on"] not in out.models[name].fields:
                raise RuleError(f"{name} lacks {e['on']}")
        for here, there, e, o, many in ((names[0], names[1], a, b, bridge.get("kind") == "oneToMany"), (names[1], names[0], b, a, False)):
            if there in out.models[here].relations:
                raise RuleError(f"{here} and {there} are bridged twice")
            out.models[here].relations[there] = Relation(there, [(e["on"], o["on"])], many, bridge=True)
    return out


class Catalog:
    """Finds the table of a model: a frame given by name, or what `load` returns for it."""

    def __init__(self, schema: SchemaSet, tables: dict[str, DataFrame] | None = None, load: Callable[[str], DataFrame] | None = None):
        self.schema, self.tables, self.load = schema, dict(tables or {}), load

    def table(self, model: str) -> DataFrame:
        own = self.schema.model(model)
        for name in (model, own.table):
            if name in self.tables:
                return self.tables[name]
        if self.load is None:
            raise RuleError(f"no table for {model}")
        return self.load(own.table or own.name)
