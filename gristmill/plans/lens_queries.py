"""Queries of the authority layer, the text form, the validator and streams over the supplied tables."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill import bindings
from gristmill.lens import Lens, Narrowing, apply_lens, check_rule_against_lens, describe_rule, exposed_surface, option_frames, options_from_rows, project_by_path, resolve_lens_bindings, stamp_coercions, validate_narrowing
from gristmill.lens.sources import order_keys
from gristmill.plans import text
from gristmill.plans.engine import Engine
from gristmill.streaming import rules as streams
from gristmill.validation import validate_rule

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_MANY = {"field": "l_quantity", "operator": "greaterThan", "value": 10}
_RETURNED = {"models": {"lineitem": {"where": {"field": "l_returnflag", "operator": "notEquals", "value": "R"}}}}
_ASIA = {"models": {"customer": {"where": {"field": "c_acctbal", "operator": "greaterThan", "value": 0}}}}


def _engine(spark: SparkSession, sf_dir: str) -> Engine:
    from gristmill.plans import registry

    return registry.engine(spark, sf_dir)


def _lensed(name: str, model: str, keys: list[str], rule: Any, narrow: Callable[[Lens], Any], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = _engine(spark, sf_dir)
        return e.where(model, apply_lens(rule, narrow(Lens(e.catalog.schema, model)))).select(*keys)

    _QUERIES[name], _SQL[name] = run, sql


_BUILDING = {"field": "customer.c_mktsegment", "operator": "equals", "value": "BUILDING"}
_lensed("n_lens_root", "orders", ["o_orderkey"], {"field": "o_totalprice", "operator": "greaterThan", "value": 200000}, lambda x: Narrowing(x, {"where": {"field": "o_orderstatus", "operator": "equals", "value": "O"}}), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 200000")
_R = "SELECT o_orderkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag <> 'R' GROUP BY o_orderkey HAVING {}"
_lensed("n_lens_default_all", "orders", ["o_orderkey"], {"field": "items", "arrayOperator": "all", "condition": _MANY}, lambda x: Narrowing(x, {}, _RETURNED), _R.format("count(*) FILTER (l_quantity <= 10) = 0"))
_lensed("n_lens_default_any", "orders", ["o_orderkey"], {"field": "items", "arrayOperator": "atMost", "count": 1, "condition": _MANY}, lambda x: Narrowing(x, {}, _RETURNED), _R.format("count(*) FILTER (l_quantity > 10) <= 1"))
_lensed("n_lens_to_one", "orders", ["o_orderkey"], _BUILDING, lambda x: Narrowing(x, {}, _ASIA), "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0")
_lensed(
    "n_lens_chain", "orders", ["o_orderkey"], {"all": [_BUILDING, {"field": "items", "aggregate": {"mode": "sum", "field": "l_quantity"}, "operator": "lessThan", "value": 40}]},
    lambda x: Narrowing(Narrowing(x, {"where": {"field": "o_orderstatus", "operator": "in", "value": ["O", "F"]}}, _RETURNED), {"relations": {"customer": {"where": {"field": "c_nationkey", "operator": "lessThan", "value": 12}}}}),
    "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag <> 'R' WHERE o_orderstatus IN ('O', 'F') AND c_mktsegment = 'BUILDING' AND c_nationkey < 12 GROUP BY o_orderkey HAVING coalesce(sum(l_quantity), 0) < 40",
)


def _bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark, sf_dir)
    lens = Narrowing(Lens(e.catalog.schema, "orders"), {"where": {"field": "o_custkey", "operator": "lessThan", "bind": "most"}})
    return e.where("orders", apply_lens({"field": "o_orderstatus", "operator": "equals", "value": "O"}, resolve_lens_bindings(lens, {"most": 50}))).select("o_orderkey")


_QUERIES["n_lens_bound"], _SQL["n_lens_bound"] = _bound, "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey < 50"


def _stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark, sf_dir)
    rule = stamp_coercions({"field": "o_custkey", "operator": "lessThan", "value": "50"}, Lens(e.catalog.schema, "orders"))
    return e.where("orders", rule).select("o_orderkey")


_QUERIES["n_stamped"], _SQL["n_stamped"] = _stamped, "SELECT o_orderkey FROM orders WHERE o_custkey < 50"


def _options(name: str, model: str, path: str, narrow: Callable[[Lens], Any], sql: str, axes: int = 0) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = _engine(spark, sf_dir)
        frame = option_frames(narrow(Lens(e.catalog.schema, model)), e.catalog)[path]
        return frame.select(*[F.col("groups")[i].alias(f"group_{i}") for i in range(axes)], F.col("value").cast("string").alias("value"), "label")

    _QUERIES[name], _SQL[name] = run, sql


_options("o_source_distinct", "customer", "c_mktsegment", lambda x: Narrowing(x, {"sources": {"c_mktsegment": True}}), "SELECT DISTINCT c_mktsegment AS value, NULL::VARCHAR AS label FROM customer")
_options("o_source_label", "nation", "n_nationkey", lambda x: Narrowing(x, {"sources": {"n_nationkey": {"label": "n_name", "where": {"field": "n_regionkey", "operator": "lessThan", "value": 3}}}}), "SELECT n_nationkey::VARCHAR AS value, min(n_name) AS label FROM nation WHERE n_regionkey < 3 GROUP BY n_nationkey")
_options("o_source_grouped", "customer", "c_mktsegment", lambda x: Narrowing(x, {"sources": {"c_mktsegment": {"groupBy": ["nation.region.r_name", "nation.n_name"]}}}), "SELECT DISTINCT r_name AS group_0, n_name AS group_1, c_mktsegment AS value, NULL::VARCHAR AS label FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", 2)
_options(
    "o_source_guarded", "customer", "c_mktsegment",
    lambda x: Narrowing(Narrowing(x, {"where": {"field": "c_acctbal", "operator": "greaterThan", "value": 5000}, "sources": {"c_mktsegment": {"groupBy": "nation.n_name"}}}), {}, {"models": {"nation": {"where": {"field": "n_regionkey", "operator": "equals", "value": 1}}}}),
    "SELECT DISTINCT n_name AS group_0, c_mktsegment AS value, NULL::VARCHAR AS label FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000 AND n_regionkey = 1", 1,
)


def _ranked_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options in the order that they are shown in: numbers inside labels by value."""
    from pyspark.sql import Window

    e = _engine(spark, sf_dir)
    frame = option_frames(Narrowing(Lens(e.catalog.schema, "nation"), {"sources": {"n_nationkey": {"label": "n_name", "groupBy": "region.r_name"}}}), e.catalog)["n_nationkey"]
    w = Window.orderBy(*order_keys())
    return frame.select(F.row_number().over(w).alias("turn"), F.col("groups")[0].alias("group_0"), "value", "label")


_QUERIES["o_source_order"] = _ranked_options
_SQL["o_source_order"] = r"SELECT row_number() OVER (ORDER BY r_name, regexp_replace(n_name, '\d+$', ''), TRY_CAST(regexp_extract(n_name, '\d+$') AS INT), n_nationkey)::INT AS turn, r_name AS group_0, n_nationkey AS value, n_name AS label FROM nation JOIN region ON n_regionkey = r_regionkey"


def _surface_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By model that a lens shows, however far it is, its rows and how many of its columns are seen."""
    e = _engine(spark, sf_dir)
    lens = Narrowing(Lens(e.catalog.schema, "events"), {"relations": {"user": {"picks": ["c_name", "orders", "nation"]}}}, {"models": {"lineitem": {"omits": ["part", "l_tax"]}, "region": {"omits": ["r_name"]}}})
    parts = [e.catalog.table(m).agg(F.lit(m).alias("model"), F.count("*").alias("n"), F.lit(len(own["fields"])).cast("long").alias("seen")) for m, own in exposed_surface(lens).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_QUERIES["v_surface_rows"] = _surface_rows
_SQL["v_surface_rows"] = " UNION ALL ".join(f"SELECT '{m}' AS model, count(*) AS n, {seen}::BIGINT AS seen FROM {m}" for m, seen in (("events", 6), ("customer", 5), ("orders", 6), ("lineitem", 10), ("supplier", 4), ("nation", 3), ("region", 1)))


def _quoted_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark, sf_dir)
    e.catalog.table("events").withColumn("props", F.concat(F.lit('{"it\'s": {"b": '), F.get_json_object("props", "$.k"), F.lit("}}"))).createOrReplaceTempView("quoted_events")
    return text.select(spark, "quoted_events", {"field": "props.it's.b", "operator": "in", "value": ["3", "7"]}, "t0.event_id", schema=e.catalog.schema, model="events")


_QUERIES["q_quoted_step"], _SQL["q_quoted_step"] = _quoted_step, "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') IN ('3', '7')"


def _nested_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark, sf_dir)
    rows = e.join_bridge("nation", "customers", "customers")
    lens = Narrowing(Lens(e.catalog.schema, "nation"), {"relations": {"customers": {"sources": {"c_mktsegment": {"where": {"field": "c_acctbal", "operator": "lessThan", "value": 0}}}}}})
    return options_from_rows(lens, rows)["customers.c_mktsegment"].select("value")


_QUERIES["o_source_rows"], _SQL["o_source_rows"] = _nested_options, "SELECT DISTINCT c_mktsegment AS value FROM customer WHERE c_acctbal < 0"


def _text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark, sf_dir)
    for name in ("orders", "customer", "nation"):
        e.catalog.table(name).createOrReplaceTempView(name)
    rule = {"any": [{"all": [{"field": "customer.nation.n_name", "operator": "in", "value": ["CHINA", "JAPAN", "NATION_3", "NATION_7"]}, {"field": "o_totalprice", "operator": "between", "value": [300000, 100000]}]}, {"field": "o_orderdate", "dateOperator": "within", "value": {"last": "month"}}, {"if": {"field": "o_orderstatus", "operator": "equals", "value": "P"}, "then": False}]}
    from dataclasses import replace

    from gristmill.options import get_options

    return text.select(spark, "orders", rule, "t0.o_orderkey", schema=e.catalog.schema, model="orders", options=replace(get_options(), now="1999-07-15"))


_QUERIES["q_text"] = _text
_SQL["q_text"] = "SELECT o_orderkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE (n_name IN ('CHINA', 'JAPAN', 'NATION_3', 'NATION_7') AND o_totalprice BETWEEN 100000 AND 300000) OR (o_orderdate >= TIMESTAMP '1999-06-01' AND o_orderdate < TIMESTAMP '1999-07-01') OR o_orderstatus <> 'P'"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule on a stream, run to its end into a table in memory."""
    static = spark.read.parquet(f"{sf_dir}/events.parquet")
    source = spark.readStream.schema(static.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    kept = streams.where(Engine(), source, {"all": [{"field": "event_type", "operator": "equals", "value": "click"}, {"field": "value", "operator": "greaterThan", "value": 50}]})
    query = kept.select("event_id").writeStream.format("memory").queryName("gristmill_stream").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.sql("SELECT event_id FROM gristmill_stream")


_QUERIES["t_stream"], _SQL["t_stream"] = _stream, "SELECT event_id FROM events WHERE event_type = 'click' AND value > 50"


# Metadata as tables.
def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


_BROKEN = {"all": [{"field": "a", "operator": "nope", "value": 1}, {"field": "b", "operator": "between", "value": [1]}, {"field": "c", "arrayOperator": "atLeast", "condition": True}, {"field": "d", "dateOperator": "within", "value": {"last": "decade"}}]}
_QUERIES["v_validate"] = lambda spark, sf_dir: _rows(spark, [(i.path, i.code) for i in validate_rule(_BROKEN)], "path string, code string")
_SQL["v_validate"] = "SELECT * FROM (VALUES ('all[0]', 'invalid_operator'), ('all[1]', 'invalid_range_value'), ('all[2]', 'missing_count'), ('all[3]', 'invalid_period_unit')) v(path, code)"


def _gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Narrowing(Lens(_engine(spark, sf_dir).catalog.schema, "orders"), {"omits": ["o_totalprice"], "relations": {"customer": {"picks": ["c_mktsegment"]}}})
    rules = {"open": {"field": "o_orderstatus", "operator": "exists"}, "taken": {"field": "o_totalprice", "operator": "exists"}, "below": {"field": "customer.c_acctbal", "operator": "exists"}, "picked": _BUILDING}
    return _rows(spark, [(k, not check_rule_against_lens(r, lens)) for k, r in rules.items()], "rule string, ok boolean")


_QUERIES["v_gate"], _SQL["v_gate"] = _gate, "SELECT * FROM (VALUES ('open', true), ('taken', false), ('below', false), ('picked', true)) v(rule, ok)"


def _describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = describe_rule({"all": [_BUILDING, {"field": "items", "arrayOperator": "any", "condition": _MANY}]}, Lens(_engine(spark, sf_dir).catalog.schema, "orders"))
    return _rows(spark, [(",".join(sorted(out["models"])), ",".join(out["targets"]))], "models string, targets string")


_QUERIES["v_describe"], _SQL["v_describe"] = _describe, "SELECT 'customer,lineitem,orders' AS models, 'check,prisma,spark' AS targets"


def _surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Narrowing(Lens(_engine(spark, sf_dir).catalog.schema, "orders"), {"omits": ["items"], "relations": {"customer": {"picks": ["c_custkey", "c_name"]}}})
    assert not validate_narrowing(lens)
    return _rows(spark, [(m, f) for m, own in exposed_surface(lens).items() for f in own["fields"]], "model string, field string")


_QUERIES["v_surface"] = _surface
_SQL["v_surface"] = "SELECT * FROM (VALUES ('orders', 'o_orderkey'), ('orders', 'o_custkey'), ('orders', 'o_orderstatus'), ('orders', 'o_totalprice'), ('orders', 'o_orderdate'), ('orders', 'o_orderpriority'), ('customer', 'c_custkey'), ('customer', 'c_name')) v(model, field)"


def _projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Narrowing(Lens(_engine(spark, sf_dir).catalog.schema, "orders"), {"picks": ["o_orderkey", "customer"], "relations": {"customer": {"picks": ["c_name"]}}})
    return _rows(spark, [(p, f) for p, own in project_by_path(lens).items() for f in own["fields"]], "path string, field string")


_QUERIES["v_projection"], _SQL["v_projection"] = _projection, "SELECT * FROM (VALUES ('', 'o_orderkey'), ('customer', 'c_name')) v(path, field)"
_QUERIES["v_bindings"] = lambda spark, sf_dir: _rows(spark, [(n,) for n in bindings.required({"all": [{"field": "a", "operator": "equals", "bind": "x"}, {"field": "b", "arrayOperator": "any", "condition": True, "filter": {"field": "c", "operator": "equals", "value": {"bind": "y"}}}]})], "name string")
_SQL["v_bindings"] = "SELECT * FROM (VALUES ('x'), ('y')) v(name)"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
