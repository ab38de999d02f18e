"""The engine: rules in, DataFrames out."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill import bindings
from gristmill.operators.compiler import Compiler, Frame, quantified, quantifier, resolve
from gristmill.operators.relational import Planner
from gristmill.operators.scalar import Verdict
from gristmill.options import EngineOptions, get_options
from gristmill.rules import All, Any_, ArrayRule, If, Literal, Node, RuleError, nodes
from gristmill.sources.schema import Catalog, Model, SchemaSet, infer_model


class Engine:
    """Evaluates rules on frames or on a catalog's models."""

    def __init__(self, schema: SchemaSet | None = None, tables: dict[str, DataFrame] | None = None, load=None, options: EngineOptions | None = None):
        self.catalog, self._options = Catalog(schema or SchemaSet(), tables, load), options

    def options(self, changes: dict[str, Any]) -> EngineOptions:
        return replace(self._options or get_options(), **changes)

    def _planned(self, source: DataFrame | str, rule: Any, bind: dict | None, context: dict | None, changes: dict) -> tuple[Planner, Node]:
        options = self.options(changes)
        node = bindings.resolve(rule, bind or {})
        if isinstance(source, DataFrame):
            model = Model("_frame") if not self.catalog.schema.models else infer_model("_frame", source)
            catalog = Catalog(SchemaSet(self.catalog.schema.models | {"_frame": model}), self.catalog.tables | {"_frame": source}, self.catalog.load)
            return Planner(catalog, "_frame", options, context), node
        return Planner(self.catalog, source, options, context), node

    def evaluate(self, source: DataFrame | str, rule: Any, bindings: dict | None = None, context: dict | None = None, **options: Any) -> DataFrame:
        """The rows with rule_ok (never NULL) and rule_error (NULL where ok)."""
        planner, node = self._planned(source, rule, bindings, context, options)
        own = planner.df.columns
        verdict = planner.compile(node)
        out = planner.apply().withColumn("_ok", verdict.strict()).withColumn("_error", verdict.error.cast("string"))
        return out.select(*[f"`{c}`" for c in own], F.col("_ok").alias("rule_ok"), F.when(~F.col("_ok"), F.col("_error")).alias("rule_error"))

    def where(self, source: DataFrame | str, rule: Any, bindings: dict | None = None, context: dict | None = None, **options: Any) -> DataFrame:
        """The rows that the rule passes. A lone quantifier over a relation is a semi or anti join; comparisons stay bare for the scan."""
        planner, node = self._planned(source, rule, bindings, context, options)
        own = planner.df.columns
        parts, rest = list(node.parts) if isinstance(node, All) else [node], []
        joins = []
        for part in parts:
            (joins if self._semi(planner, part) else rest).append(part)
        verdicts = [planner.compile(p) for p in rest]
        out = planner.apply()
        for v in verdicts:
            out = out.where(v.ok)
        for part in joins:
            out = self._semi_join(planner, out, part)
        return out.select(*[f"`{c}`" for c in own])

    @staticmethod
    def _semi(planner: Planner, part: Node) -> bool:
        if not isinstance(part, ArrayRule) or part.path is None or part.window or part.operator not in ("any", "none", "all", "empty", "notEmpty"):
            return False
        hops, rest, _ = planner.hops(part.path)
        return len(hops) == 1 and not rest and hops[0][1].many and not _asks_outer(part)

    def _semi_join(self, planner: Planner, df: DataFrame, part: ArrayRule) -> DataFrame:
        relation = planner.hops(part.path)[0][0][1]
        child = Planner(planner.catalog, relation.target, planner.options, planner.context, tag="_s")
        ok: Column | None = None
        if part.condition is not None:
            verdict = child.compile(part.condition)
            ok = ~verdict.strict() if part.operator == "all" else verdict.ok
        rows = child.apply()
        rows = rows.where(ok) if ok is not None else rows
        rows = rows.select(*[F.col(f"`{b}`").alias(f"_s_{i}") for i, (_, b) in enumerate(relation.keys)])
        on = [F.col(f"`{a}`") == rows[f"_s_{i}"] for i, (a, _) in enumerate(relation.keys)]
        return df.join(rows, on, "left_semi" if part.operator in ("any", "notEmpty") else "left_anti")

    def check_all(self, source: DataFrame | str, rule: Any, bindings: dict | None = None, context: dict | None = None, **options: Any) -> DataFrame:
        """One row, rule_ok and rule_error, for a rule about the whole table: its leaves are array rules without a field.

        All leaves share one aggregation; one with an order, skip or take counts the first rows of the table apart. Ties, and a window
        without an order, go by all columns in turn.
        """
        planner, node = self._planned(source, rule, bindings, context, options)
        counts: list[Column] = [F.count(F.lit(1)).alias("_n")]
        frame, firsts = Frame(planner.df.schema, None, planner), []

        def counted(flag: Column, kind: str) -> str:
            counts.append(F.count_if(flag).alias(f"_{kind}{len(counts)}"))
            return f"_{kind}{len(counts) - 1}"

        def verdict(n: Node) -> Any:
            match n:
                case Literal():
                    return n
                case All(parts, error):
                    return All(tuple(verdict(p) for p in parts), error)
                case Any_(parts, error):
                    return Any_(tuple(verdict(p) for p in parts), error)
                case If(test, then, other):
                    return If(verdict(test), verdict(then), verdict(other) if other is not None else None)
                case ArrayRule() if n.path is None:
                    w = n.window
                    keep = planner.compiler.compile(w.filter, frame).strict() if w.filter is not None else F.lit(True)
                    hit = planner.compiler.compile(n.condition, frame).strict() if n.condition is not None else F.lit(True)
                    own = ("_n" if w.filter is None else counted(keep, "f"), counted(keep & hit, "c"))
                    if not w.skip and w.take is None:
                        return n, *map(F.col, own)
                    order = [(resolve(frame, p).column, d) for p, d in w.order]
                    order = [c.desc_nulls_first() if d == "desc" else c.asc_nulls_last() for c, d in order]
                    order += [F.col(f"`{f.name}`") for f in planner.df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
                    firsts.append((keep, hit, order, w))
                    i = len(firsts) - 1
                    if w.take is not None:
                        return n, F.col(f"_t{i}"), F.col(f"_h{i}")
                    return n, F.col(own[0]) - F.col(f"_t{i}"), F.col(own[1]) - F.col(f"_h{i}")  # all but those skipped
            raise RuleError("a whole table is judged by array rules without a field")

        tree = verdict(node)
        rows = planner.apply()
        one = rows.agg(*counts).withColumn("_one", F.lit(1))
        for i, (keep, hit, order, w) in enumerate(firsts):
            first = rows.where(keep).withColumn("_hit", hit).orderBy(*order)
            first = first.offset(w.skip or 0).limit(w.take) if w.take is not None else first.limit(w.skip)
            one = one.join(first.agg(F.count(F.lit(1)).alias(f"_t{i}"), F.count_if("_hit").alias(f"_h{i}")).withColumn("_one", F.lit(1)), "_one")
        v = _Judge(planner.options, Frame(one.schema)).compile(tree)
        return one.select(v.strict().alias("rule_ok"), F.when(~v.strict(), v.error).alias("rule_error"))

    def explain_rule(self, source: DataFrame | str, rule: Any, **options: Any) -> str:
        """The physical plan that a filter by the rule has."""
        df = self.where(source, rule, **options)
        return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def join_bridge(self, model: str, bridge: str, as_name: str = "linked", nested: bool = True) -> DataFrame:
        """A model's rows with the rows of the other source: a struct for a one-side, else an array of structs.

        nested=False gives a row for each link instead (one, with a null, where there is none), which no key can make large.
        """
        relation = self.catalog.schema.model(model).relations[bridge]
        (a, b), left, right = relation.keys[0], self.catalog.table(model), self.catalog.table(relation.target)
        row = F.struct(*[F.col(f"`{c}`") for c in right.columns])
        side = right.where(F.col(f"`{b}`").isNotNull())
        if relation.many and not nested:
            side = side.select(F.col(f"`{b}`").alias("_b"), row.alias(as_name))
        elif relation.many:
            side = side.groupBy(F.col(f"`{b}`").alias("_b")).agg(F.collect_list(row).alias(as_name))
        else:
            twice = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit(f"{bridge}: the key is not unique")).cast("string"))
            side = side.groupBy(F.col(f"`{b}`").alias("_b")).agg(F.first(row).alias(as_name), twice.alias("_twice")).where(F.col("_twice").isNull()).drop("_twice")
        return left.join(side, left[a] == side["_b"], "left").drop("_b")


class _Judge(Compiler):
    def compile(self, node: Any, frame: Frame | None = None):
        if isinstance(node, tuple):
            rule, n, matched = node
            return Verdict(quantifier(rule, matched, n), quantified(rule, matched, n - matched), sure=True)
        return super().compile(node, frame)


def _asks_outer(rule: ArrayRule) -> bool:
    return any(getattr(getattr(n, "rhs", None), "path", None) and not n.rhs.path.startswith("$.") for n in nodes(rule.condition)) if rule.condition is not None else False


def check(df: DataFrame, rule: Any, **options: Any) -> DataFrame:
    """`Engine().evaluate` on a frame."""
    return Engine().evaluate(df, rule, **options)

