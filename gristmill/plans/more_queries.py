"""Further queries: error texts, the text form's quoting, option and enum sets, and what has to raise."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill import catalog
from gristmill.lens import Lens, Narrowing, exposed_surface, option_frames, options_from_flat, resolve_visit, validate_narrowing
from gristmill.plans import text
from gristmill.plans.engine import Engine
from gristmill.plans.registry import _BIG, _CASES, _MANY, _OPEN, _array, _date, _embedded, _evaluate, _rule, _where, engine
from gristmill.rules import RuleError, parse
from gristmill.sources.schema import Field, SchemaSet, validate
from gristmill.validation import validate_rule

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        name = f.__name__.lstrip("_")
        _QUERIES[name], _SQL[name] = f, sql
        return f

    return keep


# Field rules.
_NEAR = "len(list_filter(string_split_regex(lower(p_type), '[^a-z0-9]+'), lambda w : w <> '' AND levenshtein(w, 'standrd') <= {n})) > 0 OR contains(lower(p_type), 'standrd')"
_where("f_fuzzy_distance", "part", _rule("p_type", "contains", "STANDRD", fuzzy={"maxDistance": 1}), _NEAR.format(n=1))
_where("f_fuzzy_tighter_cap", "part", _rule("p_type", "notContains", "STANDRD", fuzzy={"maxDistance": 2, "maxRatio": 0.1}), f"NOT ({_NEAR.format(n=0)})")
_where("f_coerce_other", "orders", _rule("o_orderstatus", "equals", "O", coerceType="Json"), "o_orderstatus = 'O'")
_zoned = lambda df: df.withColumn("ts", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.when(F.col("event_type") == "click", "+02:00").when(F.col("event_type") == "view", "Z").otherwise("")))
_where("d_text_zones", "events", _date("ts", "before", "2024-01-12T10:30:00Z"), "date_trunc('millisecond', ts) - CASE WHEN event_type = 'click' THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END < TIMESTAMP '2024-01-12 10:30:00'", _zoned)

# Arrays.
_where("a_no_array", "orders", {"any": [_array("o_totalprice", "any", _OPEN), _BIG]}, "o_totalprice > 250000")
_embedded("a_sum_of_texts", {"field": "items", "aggregate": {"mode": "sum", "field": "l_returnflag"}, "operator": "greaterThanEquals", "value": 0}, "len(items) = 0")


def _plain_arrays(name: str, rule: Any, sql: str) -> None:
    """Orders with the plain numbers of their items' quantities."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir)
        items = e.catalog.table("lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("items"))
        orders = e.catalog.table("orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("items", F.coalesce("items", F.array().cast("array<double>")))
        return Engine().where(orders, rule).select("o_orderkey")

    _QUERIES[name], _SQL[name] = run, f"SELECT o_orderkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey HAVING {sql}"


for _op in ("all", "any", "none", "atMost"):
    _plain_arrays(f"a_plain_{_op}", _array("items", _op, _MANY, **_CASES[_op][0]), "false" if _op == "any" else "count(l_orderkey) = 0")
_plain_arrays("a_plain_contains", _rule("items", "contains", 7.0), "count(*) FILTER (l_quantity = 7) > 0")
_plain_arrays("a_plain_sum", {"field": "items", "aggregate": {"mode": "sum"}, "operator": "greaterThan", "value": 150}, "coalesce(sum(l_quantity), 0) > 150")

# Error texts.
_ROWS = "(SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey{})"
_HITS = _ROWS.format(" AND l_quantity > 10")
_evaluate("l_text_all", "orders", _array("items", "all", _MANY), f"({_HITS} = {_ROWS.format('')})", f"'items all elements must match (' || ({_ROWS.format('')} - {_HITS}) || ' failed)'")
_evaluate("l_text_at_least", "orders", _array("items", "atLeast", _MANY, count=3), f"({_HITS} >= 3)", f"'items at least 3 elements must match (' || {_HITS} || ' matched)'")
_evaluate("l_text_none", "orders", _array("items", "none", _MANY), f"({_HITS} = 0)", f"'items no elements should match (' || {_HITS} || ' matched)'")
_evaluate("l_text_false_items", "orders", _array("items", "all", False), f"({_ROWS.format('')} = 0)", "'items all elements must match (0 failed)'")
_evaluate("l_text_sum", "orders", {"field": "items", "aggregate": {"mode": "sum", "field": "l_quantity"}, "operator": "lessThan", "value": 50}, "(coalesce((SELECT sum(l_quantity) FROM lineitem WHERE l_orderkey = o_orderkey), 0) < 50)", "'items sum must be less than 50'")
_evaluate("l_text_own", "orders", _array("items", "notEmpty", error="nothing ordered"), f"({_ROWS.format('')} > 0)", "'nothing ordered'")
_evaluate("l_text_date", "orders", _date("o_orderdate", "after", "1996-05-01"), "(o_orderdate >= TIMESTAMP '1996-05-01 00:00:00.001')", "'o_orderdate must be after 1996-05-01T00:00:00.000Z'")


# Text form.
def _select(spark: SparkSession, frame: DataFrame, rule: Any, key: str, **more: Any) -> DataFrame:
    frame.createOrReplaceTempView("gristmill_text")
    return text.select(spark, "gristmill_text", rule, f"t0.{key}", **more)


@_query("SELECT p_partkey FROM part WHERE p_size < 20 AND contains(p_name, 'an')")
def q_odd_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = engine(spark, sf_dir).catalog.table("part").withColumnsRenamed({"p_size": "the `size`; --", "p_name": "select"})
    return _select(spark, part, {"all": [_rule("the `size`; --", "lessThan", 20), _rule("select", "contains", "an")]}, "p_partkey")


@_query("SELECT p_partkey FROM part WHERE p_size % 2 = 0 AND p_size BETWEEN 10 AND 30")
def q_columns_on_the_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contains, in and between with another column on the right."""
    part = engine(spark, sf_dir).catalog.table("part").withColumns({"head": F.when(F.col("p_size") % 2 == 0, F.substring("p_name", 1, 3)).otherwise("?"), "sizes": F.array(F.col("p_size"), F.lit(-1)), "bounds": F.array(F.lit(10), F.lit(30))})
    right = lambda field, op, path: {"field": field, "operator": op, "path": f"$.{path}"}
    return _select(spark, part, {"all": [right("p_name", "contains", "head"), right("p_size", "in", "sizes"), right("p_size", "between", "bounds")]}, "p_partkey")


@_query("SELECT o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey HAVING sum(l_quantity) > 150")
def q_item_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate's item key is quoted, whatever it holds."""
    items = engine(spark, sf_dir).catalog.table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(F.col("l_quantity").alias("a`b'c"))).alias("items"))
    return _select(spark, items, {"field": "items", "aggregate": {"mode": "sum", "field": "a`b'c"}, "operator": "greaterThan", "value": 150}, "o_orderkey")


# Option and enum sets.
def _enums(spark: SparkSession, sf_dir: str) -> tuple[Engine, Narrowing]:
    """A registry, the field's own values, and three layers that pick and omit."""
    e = engine(spark, sf_dir)
    e.catalog.schema.enums["Segment"] = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    e.catalog.schema.models["customer"].fields["c_mktsegment"] = Field("Enum", enum="Segment", values=["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "OTHER"])
    lens = Narrowing(Lens(e.catalog.schema, "customer"), {}, {"enums": {"Segment": {"omits": ["HOUSEHOLD"]}}})
    lens = Narrowing(lens, {}, {"models": {"customer": {"enumPicks": {"c_mktsegment": ["AUTOMOBILE", "BUILDING", "HOUSEHOLD"]}}}})
    return e, Narrowing(lens, {"enumOmits": {"c_mktsegment": ["AUTOMOBILE"]}})


@_query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def n_enum_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, lens = _enums(spark, sf_dir)
    return e.where("customer", _rule("c_mktsegment", "in", resolve_visit(lens).enums["c_mktsegment"])).select("c_custkey")


@_query("SELECT DISTINCT n_name AS value FROM nation WHERE n_regionkey <> 2")
def o_surface_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The options that two paths to one model show, together."""
    e = engine(spark, sf_dir)
    some = lambda op, v: {"relations": {"nation": {"sources": {"n_name": {"where": _rule("n_regionkey", op, v)}}}}}
    lens = Narrowing(Lens(e.catalog.schema, "lineitem"), {"relations": {"supplier": some("lessThan", 2), "order": {"relations": {"customer": some("greaterThan", 2)}}}})
    found = [r["value"] for frame in option_frames(lens, e.catalog).values() for r in frame.collect()]
    shown = exposed_surface(lens, {"nation.n_name": [*found, *found]})["nation"]["fields"]["n_name"]["options"]
    return spark.createDataFrame([(o["value"],) for o in shown], "value string")


@_query("SELECT DISTINCT unnest([o_orderstatus, o_orderpriority]) AS value FROM orders WHERE o_totalprice > 250000")
def o_source_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.catalog.tables["orders"] = e.catalog.table("orders").withColumn("tags", F.array("o_orderstatus", "o_orderpriority"))
    e.catalog.schema.models["orders"].fields["tags"] = Field("String", many=True)
    return option_frames(Narrowing(Lens(e.catalog.schema, "orders"), {"sources": {"tags": {"where": _BIG}}}), e.catalog)["tags"].select("value")


@_query("SELECT DISTINCT r_name AS group_0, n_nationkey::VARCHAR AS value, n_name AS label FROM nation JOIN region ON n_regionkey = r_regionkey")
def o_source_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    rows = e.catalog.table("nation").join(e.catalog.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).join(e.catalog.table("customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return options_from_flat(rows, "n_nationkey", "n_name", ("r_name",)).select(F.col("groups")[0].alias("group_0"), F.col("value").cast("string").alias("value"), "label")


# What a rule or a narrowing may not be. The findings are joined to the columns that they are about.
def _refused(f: Callable[[], Any]) -> bool:
    try:
        return bool(f())
    except (RuleError, ValueError):
        return True


def _bad_rules(e: Engine) -> dict[str, Callable[[], Any]]:
    """By name, what has to raise or to be found. Each names a column of orders."""
    orders, schema = e.catalog.table("orders"), e.catalog.schema
    lens, on = Lens(schema, "orders"), lambda rule, **o: lambda: Engine().where(orders, rule, **o)
    circle = Narrowing(lens)
    object.__setattr__(circle, "parent", circle)
    odd = SchemaSet({"m": replace(schema.models["orders"], fields={"a.b": Field()}, relations={})})
    return {
        "o_orderkey: unknown node": lambda: parse({"nothing": "o_orderkey"}), "o_orderkey: unknown operator": on({"field": "o_orderkey", "operator": "nope", "value": 1}),
        "o_orderdate: expression without now": on(_date("o_orderdate", "within", {"last": "year"}), now=None), "o_orderdate: unknown expression": on(_date("o_orderdate", "within", {"some": "year"}), now="2024-01-01"),
        "o_orderkey: no count": on({"field": "o_orderkey", "arrayOperator": "atLeast", "condition": True}), "o_totalprice: bad mode": on({"field": "o_totalprice", "aggregate": {"mode": "median"}, "operator": "equals", "value": 1}),
        "o_custkey: unbound": on({"field": "o_custkey", "operator": "equals", "bind": "who"}), "o_custkey: unbound text": lambda: text.to_sql({"field": "o_custkey", "operator": "equals", "bind": "who"}),
        "o_orderstatus: windows in text": lambda: validate_rule(_array("items", "all", _MANY, take=1), "sql"), "o_orderstatus: key with both quotes": lambda: text.to_sql(_rule("o_orderstatus.it's\"", "equals", "x"), schema, "orders"),
        "o_orderkey: dots in names": lambda: validate(odd), "o_orderkey: circle of parents": lambda: resolve_visit(circle), "o_custkey: axis to many": lambda: validate_narrowing(Narrowing(lens, {"sources": {"o_custkey": {"groupBy": "items.l_tax"}}})),
        "o_custkey: axis on a table": lambda: validate_narrowing(Narrowing(lens, {"sources": {"o_custkey": {"groupBy": "customer"}}})), "o_custkey: where on what was taken": lambda: validate_narrowing(Narrowing(Narrowing(lens, {"omits": ["o_custkey"]}), {"where": _rule("o_custkey", "equals", 1)})),
        "o_orderstatus: pick of what was taken": lambda: validate_narrowing(Narrowing(Narrowing(lens, {"omits": ["o_orderstatus"]}), {"picks": ["o_orderstatus"]})),
    }


@_query("SELECT o_orderstatus AS status, count(*) AS n, 16::BIGINT AS refused, 3::BIGINT AS taken FROM orders GROUP BY o_orderstatus")
def v_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many bad rules are refused, and good ones taken, beside the rows that a good one counts."""
    e = engine(spark, sf_dir)
    lens = Lens(e.catalog.schema, "orders")
    good = [lambda: validate_rule(_array("items", "all", _MANY, orderBy=[]), "prisma"), lambda: validate_narrowing(Narrowing(lens, {"omits": ["o_custkey"], "where": _rule("o_custkey", "equals", 1)})), lambda: validate_narrowing(Narrowing(lens, {"sources": {"o_custkey": {"groupBy": "customer.nation.n_name"}}}))]
    refused, taken = sum(map(_refused, _bad_rules(e).values())), sum(not _refused(f) for f in good)
    return e.catalog.table("orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.lit(refused).cast("long").alias("refused"), F.lit(taken).cast("long").alias("taken"))


@_query("SELECT column_name AS field, CASE WHEN column_type LIKE 'TIMESTAMP%' THEN 23 WHEN column_type IN ('VARCHAR') THEN 20 ELSE 14 END::BIGINT AS operators FROM (DESCRIBE orders)")
def v_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each column of orders, how many operators the catalog offers for its kind."""
    fields = engine(spark, sf_dir).catalog.schema.models["orders"].fields
    return spark.createDataFrame([(name, len(catalog.operators_for(f.kind))) for name, f in fields.items()], "field string, operators long")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL
