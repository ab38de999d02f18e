"""Rules over related tables as joins.

To-one paths become left joins, one for each relation path. To-many rules become grouped columns of the child table, joined on the
keys: all unwindowed rules over one relation share one aggregation, so a child is shuffled once however many rules ask about it. The
aggregates combine before the shuffle. Windows number a parent's rows first.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.operators.compiler import Compiler, Frame, compared, quantified, quantifier, resolve
from gristmill.operators.scalar import Value, Verdict
from gristmill.options import EngineOptions
from gristmill.rules import AggregateRule, ArrayRule, Node, RuleError, Slice, extremal
from gristmill.sources.schema import Catalog, Relation


@dataclass
class _Child:
    """One aggregation of a child table: its window and conditions, and the aggregates to make of them."""

    hops: list[tuple[str, Relation]]
    window: Slice
    conditions: list[tuple[str, Node]] = field(default_factory=list)
    items: list[tuple[str, str, str | None]] = field(default_factory=list)  # name, item path, name of its condition
    prefix: str = ""


class Planner:
    """Collects what the rules on one model's table need, then applies it."""

    def __init__(self, catalog: Catalog, model: str, options: EngineOptions, context: dict | None = None, tag: str = "_g"):
        self.catalog, self.model, self.options, self.context, self.tag = catalog, model, options, context, tag
        self.df = catalog.table(model)
        self.joined: dict[str, tuple[str, str]] = {}  # relation path: column of the target's row, target model
        self.children: dict[tuple, _Child] = {}
        self.carried: dict[str, str] = {}
        self.frame = Frame(self.df.schema, None, self)
        self.compiler = Compiler(options, self.frame, context)

    # Paths.

    def hops(self, path: str, model: str | None = None) -> tuple[list[tuple[str, Relation]], list[str], str]:
        """Leading relations of a path, the rest, and the model that the rest belongs to."""
        at, found = self.catalog.schema.model(model or self.model), []
        names = path.split(".")
        while names and names[0] in at.relations:
            name = names.pop(0)
            found.append((name, at.relations[name]))
            at = self.catalog.schema.model(found[-1][1].target)
        return found, names, at.name

    def to_one(self, path: str, hint: str = "text") -> Value | None:
        hops, rest, target = self.hops(path)
        if not hops:
            return None
        if not rest:
            raise RuleError(f"{path} is a table")
        column, schema = self._join(hops), self.catalog.table(target).schema
        return resolve(Frame(schema, F.col(f"`{column}`")), ".".join(rest), hint)

    def _join(self, hops: list[tuple[str, Relation]]) -> str:
        """The column that holds the row at the end of a chain of relations; each chain is joined once."""
        before = ""
        for i, (name, relation) in enumerate(hops):
            key = ".".join(n for n, _ in hops[: i + 1])
            if key not in self.joined:
                if relation.many and not self.options.fanout:
                    raise RuleError(f"{key} leads to many rows: quantify it, or allow fanout")
                column = f"{self.tag}_one{len(self.joined)}"
                target = self.catalog.table(relation.target)
                side = target.select(*[F.col(f"`{b}`").alias(f"{column}_{k}") for k, (_, b) in enumerate(relation.keys)], F.struct(*[F.col(f"`{c}`") for c in target.columns]).alias(column))
                own = [F.col(f"`{a}`") if not before else F.col(f"`{before}`").getField(a) for a, _ in relation.keys]
                on = [x == side[f"{column}_{k}"] for k, x in enumerate(own)]
                self.df = self.df.join(side, on, "left").drop(*[f"{column}_{k}" for k in range(len(on))])
                self.joined[key] = (column, relation.target)
            before = self.joined[key][0]
        return before

    # Many rows.

    def many(self, rule: ArrayRule | AggregateRule) -> Verdict | None:
        hops, rest, _ = self.hops(rule.path)
        if not hops or rest:
            return None
        if not hops[-1][1].many:
            raise RuleError(f"{rule.path} leads to one row")
        if isinstance(rule, ArrayRule):
            rule = extremal(rule)
        key = (tuple(n for n, _ in hops), rule.window)
        child = self.children.setdefault(key, _Child(hops, rule.window, prefix=f"{self.tag}_many{len(self.children)}"))
        condition = None
        if rule.condition is not None:
            condition = next((n for n, c in child.conditions if c == rule.condition), None)
            if condition is None:
                condition = f"{child.prefix}_c{len(child.conditions)}"
                child.conditions.append((condition, rule.condition))
        n = F.coalesce(F.col(f"{child.prefix}_n"), F.lit(0).cast("long"))
        matched = F.coalesce(F.col(condition), F.lit(0).cast("long")) if condition else n
        if isinstance(rule, ArrayRule):
            return Verdict(quantifier(rule, matched, n), quantified(rule, matched, n - matched), sure=True)
        if rule.item is None:
            raise RuleError("an aggregate over rows needs a field")
        name = f"{child.prefix}_v{len(child.items)}"
        child.items.append((name, rule.item, condition))
        total = F.coalesce(F.col(name), F.lit(0.0))
        bad = F.coalesce(F.col(f"{name}_bad"), F.lit(0).cast("long")) > 0
        if rule.mode == "sum":
            result = total
        else:
            result = F.when(matched > 0, total / matched)
            result = result if self.options.profile == "sql" else F.when(matched == 0, F.lit(0.0)).otherwise(result)
        verdict = compared(rule, result, self.compiler.rhs(rule.rhs, self.frame), self.options)
        return self.compiler._bad_data(bad, verdict, f"{rule.path} holds a value that is no number")

    def _apply_child(self, df: DataFrame, child: _Child) -> DataFrame:
        first, last = child.hops[0][1], child.hops[-1][1]
        planner = Planner(self.catalog, last.target, self.options, self.context, tag=f"{child.prefix}x")
        asked: dict[str, str] = {}

        def outer(path: str) -> Value:
            v = resolve(self.frame, path)
            name = asked.setdefault(path, f"{child.prefix}_o{len(asked)}")
            return Value(F.col(name), v.type)

        planner.compiler.outer = outer
        oks = [(name, planner.compiler.compile(c).strict()) for name, c in child.conditions]
        keep = planner.compiler.compile(child.window.filter).strict() if child.window.filter is not None else None
        values = []
        for name, item, condition in child.items:
            v = resolve(planner.frame, item)
            values.append((name, v.column.cast("double") if v.family == "number" else F.lit(None).cast("double"), condition))
        orders = [(resolve(planner.frame, p).column, d) for p, d in child.window.order]
        rows = planner.df
        keys = [f"{child.prefix}_k{i}" for i in range(len(first.keys))]
        if len(child.hops) == 1:
            rows = rows.select("*", *[F.col(f"`{b}`").alias(k) for k, (_, b) in zip(keys, first.keys, strict=True)])
        else:  # a chain: the rows in between carry the first relation's keys
            link = self._chain(child, keys)
            on = [F.col(f"`{b}`") == link[f"{child.prefix}_l{i}"] for i, (_, b) in enumerate(last.keys)]
            rows = rows.join(link, on)
        if asked:  # the parents' values that the conditions ask for: parents that share a key may differ in them
            own = self.df.select(*[F.col(f"`{a}`").alias(f"{child.prefix}_p{i}") for i, (a, _) in enumerate(first.keys)], *[resolve(self.frame, p).column.alias(n) for p, n in asked.items()]).distinct()
            rows = rows.join(own, [F.col(k) == own[f"{child.prefix}_p{i}"] for i, k in enumerate(keys)])
        rows = planner.apply(rows)
        if keep is not None:
            rows = rows.where(keep)
        w = child.window
        if w.order or w.skip is not None or w.take is not None:
            tie = [F.col(f"`{c}`") for c, t in ((f.name, f.dataType) for f in planner.frame.schema.fields) if not isinstance(t, (T.MapType, T.VariantType))]
            order = [c.desc_nulls_first() if d == "desc" else c.asc_nulls_last() for c, d in orders]
            number = F.row_number().over(Window.partitionBy(*keys, *asked.values()).orderBy(*order, *tie))
            rows = rows.withColumn(f"{child.prefix}_r", number)
            if w.skip:
                rows = rows.where(F.col(f"{child.prefix}_r") > w.skip)
            if w.take is not None:
                rows = rows.where(F.col(f"{child.prefix}_r") <= (w.skip or 0) + w.take)
        rows = rows.select(*keys, *asked.values(), *[ok.alias(n) for n, ok in oks], *[v.alias(n) for n, v, _ in values])
        made = [F.count(F.lit(1)).alias(f"{child.prefix}_n"), *[F.count_if(F.col(n)).alias(n) for n, _ in oks]]
        for n, _, condition in values:
            counted = F.col(condition) if condition else F.lit(True)
            made += [F.sum(F.when(counted, F.col(n))).alias(n), F.count_if(counted & (F.col(n).isNull() | F.isnan(n) | (F.abs(F.col(n)) == float("inf")))).alias(f"{n}_bad")]
        grouped = rows.groupBy(*keys, *asked.values()).agg(*made)
        on = [F.col(f"`{a}`") == grouped[k] for k, (a, _) in zip(keys, first.keys, strict=True)]
        on += [resolve(self.frame, p).column.eqNullSafe(grouped[n]) for p, n in asked.items()]
        return df.join(grouped, on, "left").drop(*keys, *asked.values())

    def _chain(self, child: _Child, keys: list[str]) -> DataFrame:
        rows = None
        for i, (_, relation) in enumerate(child.hops[:-1]):
            target, after = self.catalog.table(relation.target), child.hops[i + 1][1]
            ends = [F.col(f"`{a}`").alias(f"{child.prefix}_l{j}" if i == len(child.hops) - 2 else f"{child.prefix}_m{i}_{j}") for j, (a, _) in enumerate(after.keys)]
            starts = [F.col(f"`{b}`").alias(keys[j] if i == 0 else f"{child.prefix}_s{i}_{j}") for j, (_, b) in enumerate(relation.keys)]
            step = target.select(*starts, *ends)
            if rows is None:
                rows = step
            else:
                on = [rows[f"{child.prefix}_m{i - 1}_{j}"] == step[f"{child.prefix}_s{i}_{j}"] for j in range(len(relation.keys))]
                rows = rows.join(step, on).drop(*[f"{child.prefix}_m{i - 1}_{j}" for j in range(len(on))], *[f"{child.prefix}_s{i}_{j}" for j in range(len(on))])
        return rows

    def apply(self, df: DataFrame | None = None) -> DataFrame:
        """The table with every column that the compiled rules refer to."""
        out = self.df if df is None else df
        done: set[tuple] = set()
        while todo := [k for k in self.children if k not in done]:
            for k in todo:
                out = self._apply_child(out, self.children[k])
                done.add(k)
        return out

    def compile(self, node: Node) -> Verdict:
        return self.compiler.compile(node)

