"""Option sets: the distinct values that a field may take, with labels and groups."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.lens.policy import Lens, Narrowing, resolve_visit
from gristmill.lens.rewrite import rerooted
from gristmill.lens.surface import declared_paths
from gristmill.operators.compiler import Frame, resolve
from gristmill.operators.relational import Planner
from gristmill.options import EngineOptions, get_options
from gristmill.rules import All, Node, RuleError, nodes, parse
from gristmill.sources.schema import Catalog


def guards(lens: Lens | Narrowing, at: tuple[str, ...], paths: list[str], strict: bool) -> list[Node]:
    """The grants of all rows that the paths pass, once each, moved to the row they start from."""
    seen, found = set(), []
    for path in paths:
        here = at
        for name in path.split(".")[: -1 if strict else None]:
            model = resolve_visit(lens, here).model
            if name not in model.relations:
                if strict:
                    raise RuleError(f"{path}: {name} leads nowhere")
                break
            here = (*here, name)
            if model.relations[name].many:
                break
            if here not in seen:
                seen.add(here)
                found += [rerooted(parse(w), ".".join(here[len(at) :])) for w in resolve_visit(lens, here).wheres]
    return found


def natural(column: Column) -> Column:
    """A sort key in the order of English, in which numbers inside texts order by value."""
    padded = F.regexp_replace(F.regexp_replace(column.cast("string"), r"(\d+)", "00000000000000000000$1"), r"0*(\d{20})(?!\d)", "$1")
    return F.collate(padded, "en")


def _options(df: DataFrame, value: Column, many: bool, label: Column | None, axes: list[Column]) -> DataFrame:
    """groups, value, label: one row per option. A row with some axis missing counts as ungrouped; of labels the least counts."""
    all_axes = F.when(sum((a.isNotNull().cast("int") for a in axes), F.lit(0)) == len(axes), F.array(*[a.cast("string") for a in axes])) if axes else F.lit(None).cast("array<string>")
    rows = df.select(all_axes.alias("groups"), (F.explode(value) if many else value).alias("value"), (label.cast("string") if label is not None else F.lit(None).cast("string")).alias("label"))
    return rows.where(F.col("value").isNotNull()).groupBy("groups", "value").agg(F.min("label").alias("label"))


def order_keys() -> list[Column]:
    """Ungrouped options first, then by group, then by label or value with numbers by value."""
    groups = F.transform(F.coalesce("groups", F.array().cast("array<string>")), natural)
    return [F.col("groups").isNotNull(), groups, natural(F.coalesce("label", F.col("value").cast("string"))), F.col("value")]


def ordered(options: DataFrame) -> DataFrame:
    return options.orderBy(*order_keys())


def option_frames(lens: Lens | Narrowing, catalog: Catalog, options: EngineOptions | None = None) -> dict[str, DataFrame]:
    """By 'path.field', the options of each sourced field: distinct rows of its model in scope of the lens, the source and all hops."""
    out = {}
    for path in declared_paths(lens):
        visit = resolve_visit(lens, path)
        for name, source in visit.sources.items():
            if name not in visit.visible:
                continue
            axes = source.get("groupBy", [])
            where: list[Node] = [parse(w) for w in visit.wheres]
            if source.get("where") is not None:
                where.append(parse(source["where"]))
            asked = [n.path for w in where for n in nodes(w) if getattr(n, "path", None)]
            where += guards(lens, path, axes, strict=True) + guards(lens, path, asked, strict=False)
            planner = Planner(catalog, visit.model.name, options or get_options())
            verdict = planner.compile(All(tuple(where)))
            columns = [resolve(planner.frame, a).column for a in axes]
            value = resolve(planner.frame, name)
            label = resolve(planner.frame, source["label"]).column if source.get("label") else None
            out[".".join((*path, name))] = _options(planner.apply().where(verdict.ok), value.column, isinstance(value.type, T.ArrayType), label, columns)
    return out


def options_from_rows(lens: Lens | Narrowing, rows: DataFrame, options: EngineOptions | None = None) -> dict[str, DataFrame]:
    """The same from nested rows that are in scope already: only each source's own condition applies. Arrays on the way are flattened."""
    from gristmill.plans.engine import Engine

    out = {}
    for path in declared_paths(lens):
        visit = resolve_visit(lens, path)
        df = rows
        for name in path:
            dtype = df.schema[name].dataType
            df = df.select(F.explode(name).alias("_e") if isinstance(dtype, T.ArrayType) else F.col(name).alias("_e")).where("_e IS NOT NULL").select("_e.*")
        for name, source in visit.sources.items():
            own = Engine(options=options).where(df, source["where"]) if source.get("where") is not None else df
            frame = Frame(own.schema)
            value = resolve(frame, name)
            label = resolve(frame, source["label"]).column if source.get("label") else None
            out[".".join((*path, name))] = _options(own, value.column, isinstance(value.type, T.ArrayType), label, [resolve(frame, a).column for a in source.get("groupBy", [])])
    return out


def options_from_flat(rows: DataFrame, value: str, label: str | None = None, groups: tuple[str, ...] = ()) -> DataFrame:
    """The same from the flat rows of a query that has run elsewhere: columns for the value, its label and each group axis."""
    many = isinstance(rows.schema[value].dataType, T.ArrayType)
    return _options(rows, F.col(value), many, F.col(label) if label else None, [F.col(g) for g in groups])


def values_of(frames: dict[str, DataFrame], limit: int = 10_000) -> dict[str, list[Any]]:
    """The values as lists, for `exposed_surface`. A set over `limit` raises rather than be cut."""
    out = {}
    for name, df in frames.items():
        rows = ordered(df).limit(limit + 1).collect()
        if len(rows) > limit:
            raise RuleError(f"{name} has over {limit} options")
        out[name] = [r["value"] for r in rows]
    return out
