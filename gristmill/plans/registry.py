"""Named queries over the supplied tables, each a rule run by the engine, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.plans.engine import Engine
from gristmill.sources.schema import SchemaSet, infer_model, stitch

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
NOW = "1999-07-15T12:00:00Z"
#: (name, from, to, keys, name of the way back)
RELATIONS = (
    ("order", "lineitem", "orders", [("l_orderkey", "o_orderkey")], "items"),
    ("part", "lineitem", "part", [("l_partkey", "p_partkey")], "items"),
    ("supplier", "lineitem", "supplier", [("l_suppkey", "s_suppkey")], "items"),
    ("customer", "orders", "customer", [("o_custkey", "c_custkey")], "orders"),
    ("nation", "customer", "nation", [("c_nationkey", "n_nationkey")], "customers"),
    ("nation", "supplier", "nation", [("s_nationkey", "n_nationkey")], "suppliers"),
    ("region", "nation", "region", [("n_regionkey", "r_regionkey")], "nations"),
    ("user", "events", "customer", [("user_id", "c_custkey")], "events"),
)
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def tables(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    read = tables(spark, sf_dir)
    schema = SchemaSet({n: infer_model(n, read(n)) for n in TABLES})
    for name, a, b, keys, back in RELATIONS:
        schema.relate(name, a, b, keys, back)
    return Engine(schema, load=read)


#: Key columns that a query returns for a model.
KEYS = {"orders": ["o_orderkey"], "customer": ["c_custkey"], "part": ["p_partkey"], "events": ["event_id"], "nation": ["n_nationkey"], "region": ["r_regionkey"], "supplier": ["s_suppkey"], "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]}


def _where(name: str, model: str, rule: Any, sql: str | None, prepare: Callable[[DataFrame], DataFrame] | None = None, **options: Any) -> None:
    """Registers the keys of the rows that a rule passes. sql: the condition, or a whole statement."""
    keys = KEYS[model]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir)
        source = prepare(e.catalog.table(model)) if prepare else model
        return e.where(source, rule, **options).select(*keys)

    _QUERIES[name] = run
    if sql:
        _SQL[name] = sql if sql.lstrip().upper().startswith(("SELECT", "WITH")) else f"SELECT {', '.join(keys)} FROM {model} WHERE {sql}"


def _evaluate(name: str, model: str, rule: Any, ok: str, error: str, prepare=None, **options: Any) -> None:
    keys = KEYS[model]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir)
        return e.evaluate(prepare(e.catalog.table(model)) if prepare else model, rule, **options).select(*keys, "rule_ok", "rule_error")

    _QUERIES[name] = run
    _SQL[name] = f"SELECT {', '.join(keys)}, {ok} AS rule_ok, CASE WHEN NOT ({ok}) THEN {error} END AS rule_error FROM {model}"


def _rule(field: str, operator: str, value: Any = ..., **more: Any) -> dict:
    return {"field": field, "operator": operator} | ({} if value is ... else {"value": value}) | more


def _date(field: str, operator: str, value: Any) -> dict:
    return {"field": field, "dateOperator": operator, "value": value}


def _array(field: str, operator: str, condition: Any = None, **more: Any) -> dict:
    return {"field": field, "arrayOperator": operator} | ({} if condition is None else {"condition": condition}) | more


# Manufactured NULLs and empty texts.
_low = lambda df: df.withColumn("o_orderpriority", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")))
_LOW = "nullif(o_orderpriority, '5-LOW')"
_blank = lambda df: df.withColumn("o_orderpriority", F.when(F.col("o_orderpriority") == "1-URGENT", "").when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")))
_BLANK = "CASE WHEN o_orderpriority = '1-URGENT' THEN '' WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END"

for _profile in ("record", "sql"):
    _where(f"f_equals_{_profile}", "orders", _rule("o_orderpriority", "equals", "2-HIGH"), f"{_LOW} = '2-HIGH'", _low, profile=_profile)
_where("f_equals_null", "orders", _rule("o_orderpriority", "equals", None), f"{_LOW} IS NULL", _low)
_where("f_not_equals_record", "orders", _rule("o_orderpriority", "notEquals", "2-HIGH"), f"{_LOW} IS DISTINCT FROM '2-HIGH'", _low)
_where("f_not_equals_sql", "orders", _rule("o_orderpriority", "notEquals", "2-HIGH"), f"{_LOW} <> '2-HIGH'", _low, profile="sql")
_where("f_type_mismatch", "orders", _rule("o_orderkey", "equals", "1"), "false")
for _op, _sign in (("lessThan", "<"), ("lessThanEquals", "<="), ("greaterThan", ">"), ("greaterThanEquals", ">=")):
    _where(f"f_{_op}", "lineitem", _rule("l_quantity", _op, 25), f"l_quantity {_sign} 25")
_where("f_in", "orders", _rule("o_orderpriority", "in", ["1-URGENT", "2-HIGH", 3]), "o_orderpriority IN ('1-URGENT', '2-HIGH')")
_where("f_not_in_record", "orders", _rule("o_orderpriority", "notIn", ["1-URGENT"]), f"{_LOW} IS NULL OR {_LOW} <> '1-URGENT'", _low)
_where("f_not_in_sql", "orders", _rule("o_orderpriority", "notIn", ["1-URGENT"]), f"{_LOW} <> '1-URGENT'", _low, profile="sql")
_where("f_in_empty", "orders", _rule("o_orderpriority", "in", []), "false")
_where("f_not_in_empty", "orders", _rule("o_orderpriority", "notIn", []), "true")
_where("f_contains", "part", _rule("p_name", "contains", "an"), "contains(p_name, 'an')")
_where("f_contains_marks", "part", _rule("p_name", "contains", "%"), "contains(p_name, '%')")
_where("f_not_contains", "part", _rule("p_name", "notContains", "an"), "NOT contains(p_name, 'an')")
_where("f_starts", "part", _rule("p_brand", "startsWith", "Brand#1"), "starts_with(p_brand, 'Brand#1')")
_where("f_ends", "part", _rule("p_brand", "endsWith", "3"), "ends_with(p_brand, '3')")
_where("f_ci_equals", "customer", _rule("c_mktsegment", "equals", "building", caseInsensitive=True), "lower(c_mktsegment) = 'building'")
_where("f_ci_contains", "customer", _rule("c_name", "contains", "CUSTOMER#00000001", caseInsensitive=True), "contains(lower(c_name), 'customer#00000001')")
_where("f_ci_global", "customer", _rule("c_mktsegment", "startsWith", "bui"), "starts_with(lower(c_mktsegment), 'bui')", case_insensitive=True)
_where("f_matches", "part", _rule("p_brand", "matches", "#[12]\\d?$"), "regexp_matches(p_brand, '#[12]\\d?$')")
_where("f_matches_flags", "part", _rule("p_brand", "matches", {"source": "BRAND#2", "flags": "i"}), "regexp_matches(p_brand, 'BRAND#2', 'i')")
_where("f_not_matches", "part", _rule("p_brand", "notMatches", "#[12]\\d?$"), "NOT regexp_matches(p_brand, '#[12]\\d?$')")
_ended = lambda df: df.withColumn("p_brand", F.when(F.col("p_size") % 2 == 0, F.concat("p_brand", F.lit("\n"))).otherwise(F.concat(F.lit("Ä"), "p_brand")))
_where("f_matches_end", "part", _rule("p_brand", "matches", "#\\d+$"), "p_size % 2 = 1", _ended)
_where("f_matches_line", "part", _rule("p_brand", "matches", {"source": "#1\\d*$", "flags": "m"}), "regexp_matches(p_brand, '#1\\d*$')", _ended)
_where("f_matches_fold", "part", _rule("p_brand", "matches", {"source": "^ä?BRAND#1", "flags": "i"}), "starts_with(p_brand, 'Brand#1')", _ended)
_where("f_matches_sets", "part", _rule("p_brand", "notMatches", "[[#]1{x|[^]{9}\\s$"), "NOT regexp_matches(p_brand || CASE WHEN p_size % 2 = 0 THEN chr(10) ELSE '' END, '(.|\\n){9}\\s\\z')", _ended)
_where("f_between_reversed", "orders", _rule("o_totalprice", "between", [200000, 100000]), "o_totalprice BETWEEN 100000 AND 200000")
_where("f_not_between", "orders", _rule("o_totalprice", "notBetween", [100000, 200000]), "o_totalprice < 100000 OR o_totalprice > 200000")
for _op, _cond in (("isEmpty", "{c} IS NULL OR {c} = ''"), ("notEmpty", "{c} IS NOT NULL AND {c} <> ''"), ("exists", "{c} IS NOT NULL"), ("notExists", "{c} IS NULL")):
    _where(f"f_{_op}", "orders", _rule("o_orderpriority", _op), _cond.format(c=f"({_BLANK})"), _blank)
_where("f_path_column", "lineitem", {"field": "l_partkey", "operator": "lessThan", "path": "$.l_suppkey"}, "l_partkey < l_suppkey")
_where("f_context_path", "lineitem", {"field": "l_quantity", "operator": "greaterThan", "path": "limits.high"}, "l_quantity > 45", context={"limits": {"high": 45}})
_where("f_bind", "lineitem", {"field": "l_quantity", "operator": "equals", "bind": "n"}, "l_quantity = 7", bindings={"n": 7})
_text = lambda *names: lambda df: df.withColumns({n: F.col(n).cast("string") for n in names})
_where("f_coerce_int", "orders", _rule("o_custkey", "lessThan", "100", coerceType="Int"), "TRY_CAST(o_custkey::VARCHAR AS DOUBLE) < 100", _text("o_custkey"))
_where("f_coerce_datetime", "orders", _rule("o_orderdate", "lessThan", "1996-01-01", coerceType="DateTime"), "o_orderdate < TIMESTAMP '1996-01-01'", _text("o_orderdate"))
_epoch = lambda df: df.withColumn("o_orderdate", (F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01', o_orderdate)") - 850_000_000_000).cast("string"))
for _name, _at in (("text", "-5000000000"), ("number", -5_000_000_000)):
    _where(f"f_coerce_epoch_{_name}", "orders", _rule("o_orderdate", "lessThan", _at, coerceType="DateTime"), "epoch_ms(o_orderdate) - 850000000000 < -5000000000", _epoch)
_flagged = lambda df: df.withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "O", "true").when(F.col("o_orderstatus") == "F", "false").otherwise("True"))
_where("f_coerce_bool", "orders", _rule("o_orderstatus", "equals", "true", coerceType="Boolean"), "o_orderstatus = 'O'", _flagged)
_where("f_coerce_string", "orders", _rule("o_orderkey", "equals", 17, coerceType="String"), "o_orderkey::VARCHAR = '17'")
_where("f_json_path", "events", _rule("props.k", "lessThan", 30), "CAST(json_extract_string(props, '$.k') AS INT) < 30")
_where("f_json_missing", "events", _rule("props.nothing", "notExists"), "json_extract_string(props, '$.nothing') IS NULL")
_quoted = lambda df: df.withColumn("props", F.concat(F.lit('{"it\'s": {"b": '), F.get_json_object("props", "$.k"), F.lit("}}")))
_where("f_json_quoted", "events", _rule("props.it's.b", "lessThan", 30), "CAST(json_extract_string(props, '$.k') AS INT) < 30", _quoted)
_nulled = lambda df: df.withColumn("props", F.when(F.col("event_type") == "click", '{"k": null}').when(F.col("event_type") == "view", "{}").otherwise(F.col("props")))
for _op, _cond in (("exists", "event_type <> 'view'"), ("notExists", "event_type = 'view'"), ("isEmpty", "event_type IN ('click', 'view')")):
    _where(f"f_json_null_{_op}", "events", _rule("props.k", _op), _cond, _nulled)
_where("f_json_null_exists_sql", "events", _rule("props.k", "exists"), "event_type NOT IN ('click', 'view')", _nulled, profile="sql")
_where("f_fuzzy_digits", "part", _rule("p_brand", "contains", "brandx", fuzzy=True), "levenshtein('brandx', lower(string_split(p_brand, '#')[1])) <= 1")
_where(
    "f_fuzzy", "part", _rule("p_type", "contains", "STANDRD", fuzzy=True),
    "contains(lower(p_type), 'standrd') OR len(list_filter(string_split_regex(lower(p_type), '[^a-z0-9]+'), lambda w : w <> '' AND levenshtein(w, 'standrd') <= 2)) > 0",
)

# Logic.
_OPEN, _BIG = _rule("o_orderstatus", "equals", "O"), _rule("o_totalprice", "greaterThan", 250000)
_where("l_all", "orders", {"all": [_OPEN, _BIG]}, "o_orderstatus = 'O' AND o_totalprice > 250000")
_where("l_any", "orders", {"any": [_OPEN, _BIG]}, "o_orderstatus = 'O' OR o_totalprice > 250000")
_where("l_if_then", "orders", {"if": _OPEN, "then": _BIG}, "o_orderstatus <> 'O' OR o_totalprice > 250000")
_where("l_if_then_else", "orders", {"if": _OPEN, "then": _BIG, "else": _rule("o_orderpriority", "equals", "1-URGENT")}, "CASE WHEN o_orderstatus = 'O' THEN o_totalprice > 250000 ELSE o_orderpriority = '1-URGENT' END")
_where("l_if_null_record", "orders", {"if": _rule("o_orderpriority", "equals", "2-HIGH"), "then": False}, f"{_LOW} IS DISTINCT FROM '2-HIGH'", _low)
_where("l_if_null_sql", "orders", {"if": _rule("o_orderpriority", "equals", "2-HIGH"), "then": False}, f"{_LOW} <> '2-HIGH'", _low, profile="sql")
_where("l_else_false", "orders", {"if": _OPEN, "then": True, "else": False}, "o_orderstatus = 'O'")
_where("l_empty_all_any", "orders", {"any": [{"any": []}, {"all": [_OPEN, {"all": []}]}]}, "o_orderstatus = 'O'")
_evaluate(
    "l_error_text", "orders", {"all": [_OPEN, _rule("o_totalprice", "lessThan", 100000), _rule("o_orderpriority", "in", ["1-URGENT"], error="too slow")]},
    "(o_orderstatus = 'O' AND o_totalprice < 100000 AND o_orderpriority = '1-URGENT')",
    """(WITH t AS (SELECT list_filter([CASE WHEN o_orderstatus <> 'O' THEN 'o_orderstatus must equal "O"' END, CASE WHEN o_totalprice >= 100000 THEN 'o_totalprice must be less than 100000' END, CASE WHEN o_orderpriority <> '1-URGENT' THEN 'too slow' END], lambda x : x IS NOT NULL) AS l)
    SELECT CASE WHEN len(l) = 1 THEN l[1] ELSE 'All conditions must pass: ' || array_to_string(l, ' AND ') END FROM t)""",
)
_evaluate("l_error_any", "orders", {"any": [_OPEN, _BIG]}, "(o_orderstatus = 'O' OR o_totalprice > 250000)", "'At least one condition must pass: o_orderstatus must equal \"O\" OR o_totalprice must be greater than 250000'")

# Dates.
_MS = "date_trunc('millisecond', ts)"
for _op, _sign in (("before", "<"), ("after", ">"), ("onOrBefore", "<="), ("onOrAfter", ">=")):
    _where(f"d_{_op}", "events", _date("ts", _op, "2024-01-12T10:30:00.250"), f"{_MS} {_sign} TIMESTAMP '2024-01-12 10:30:00.250'")
_where("d_between", "events", _date("ts", "between", ["2024-01-20", "2024-01-10"]), f"{_MS} BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'")
_where("d_not_between", "events", _date("ts", "notBetween", ["2024-01-10", "2024-01-20"]), f"{_MS} < TIMESTAMP '2024-01-10' OR {_MS} > TIMESTAMP '2024-01-20'")
_where("d_zone", "events", _date("ts", "before", "2024-01-12T10:30:00+02:00"), f"{_MS} < TIMESTAMP '2024-01-12 08:30:00'")
_where("d_within_ago", "events", _date("ts", "within", {"ago": {"days": 3, "hours": 2}}), f"{_MS} BETWEEN TIMESTAMP '2024-01-12 10:00:00' AND TIMESTAMP '2024-01-15 12:00:00'", now="2024-01-15T12:00:00Z")
_where("d_within_ahead", "events", _date("ts", "within", {"ahead": {"weeks": 1}}), f"{_MS} BETWEEN TIMESTAMP '2024-01-15 12:00:00' AND TIMESTAMP '2024-01-22 12:00:00'", now="2024-01-15T12:00:00Z")
_where("d_within_this_month", "orders", _date("o_orderdate", "within", {"this": "month"}), "o_orderdate >= TIMESTAMP '1999-07-01' AND o_orderdate < TIMESTAMP '1999-08-01'", now=NOW)
_where("d_within_last_week_sunday", "events", _date("ts", "within", {"last": "week"}), "ts >= TIMESTAMP '2024-01-07' AND ts < TIMESTAMP '2024-01-14'", now="2024-01-17T12:00:00Z", week_start=0)
_where("d_within_iso_week", "events", _date("ts", "within", {"last": "isoWeek"}), "ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'", now="2024-01-17T12:00:00Z", week_start=0)
_where("d_implied_edge", "orders", _date("o_orderdate", "after", {"last": "year"}), "o_orderdate >= TIMESTAMP '1999-01-01'", now=NOW)
_where("d_edge_end", "orders", _date("o_orderdate", "onOrBefore", {"end": {"this": "quarter"}}), "o_orderdate < TIMESTAMP '1999-10-01'", now=NOW)
_where("d_quarter", "orders", _date("o_orderdate", "within", {"next": "quarter"}), "o_orderdate >= TIMESTAMP '1999-10-01' AND o_orderdate < TIMESTAMP '2000-01-01'", now=NOW)
_where("d_day_in", "events", _date("ts", "dayIn", ["Saturday", "sunday", "noday"]), "dayofweek(ts) IN (0, 6)")
_where("d_day_not_in", "events", _date("ts", "dayNotIn", ["Monday"]), "dayofweek(ts) <> 1")
_where("d_naive_zone", "events", _date("ts", "before", "2024-01-12T10:30:00Z"), f"{_MS} < TIMESTAMP '2024-01-12 05:30:00'", time_zone="America/New_York")

# Embedded arrays: orders with their items.
_ITEM = "struct<l_quantity: double, l_extendedprice: double, l_returnflag: string, l_shipdate: timestamp_ntz, l_partkey: bigint>"


def _embedded(name: str, rule: Any, sql: str, as_json: bool = False, **options: Any) -> None:
    """Orders with their items as an array, or as the JSON text of one."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir)
        item = F.struct(*[F.col(c.split(":")[0].strip()) for c in _ITEM[7:-1].split(", ")])
        items = e.catalog.table("lineitem").groupBy("l_orderkey").agg(F.collect_list(item).alias("items"))
        orders = e.catalog.table("orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")
        orders = orders.withColumn("items", F.coalesce("items", F.expr(f"cast(array() as array<{_ITEM}>)")))
        if as_json:
            orders = orders.withColumn("items", F.to_json("items")).withColumn("doc", F.concat(F.lit('{"inner": {"items": '), "items", F.lit("}}")))
        return Engine().where(orders, rule, **options).select("o_orderkey")

    _QUERIES[name] = run
    _SQL[name] = f"WITH g AS (SELECT o_orderkey, o_totalprice, list({{'l_quantity': l_quantity, 'l_extendedprice': l_extendedprice, 'l_returnflag': l_returnflag, 'l_shipdate': l_shipdate, 'l_partkey': l_partkey}}) FILTER (l_orderkey IS NOT NULL) AS l FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL), e AS (SELECT o_orderkey, o_totalprice, coalesce(l, []) AS items FROM g) SELECT o_orderkey FROM e WHERE {sql}"


_MANY = _rule("l_quantity", "greaterThan", 10)
_MATCHED = "len(list_filter(items, lambda x : x.l_quantity > 10))"
_CASES = {
    "all": ({}, f"{_MATCHED} = len(items)"), "any": ({}, f"{_MATCHED} > 0"), "none": ({}, f"{_MATCHED} = 0"), "atLeast": ({"count": 3}, f"{_MATCHED} >= 3"),
    "atMost": ({"count": 2}, f"{_MATCHED} <= 2"), "exactly": ({"count": 4}, f"{_MATCHED} = 4"), "empty": (None, "len(items) = 0"), "notEmpty": (None, "len(items) > 0"),
}
for _op, (_more, _sql) in _CASES.items():
    _embedded(f"a_{_op}", _array("items", _op, None if _more is None else _MANY, **(_more or {})), _sql)
_embedded("a_outer_path", _array("items", "any", {"field": "l_extendedprice", "operator": "greaterThan", "path": "o_totalprice"}), "len(list_filter(items, lambda x : x.l_extendedprice > o_totalprice)) > 0")
_embedded("a_sum", {"field": "items", "aggregate": {"mode": "sum", "field": "l_quantity"}, "operator": "lessThan", "value": 60}, "coalesce(list_sum(list_transform(items, lambda x : x.l_quantity)), 0) < 60")
_embedded("a_avg_filtered", {"field": "items", "aggregate": {"mode": "avg", "field": "l_quantity"}, "condition": _rule("l_returnflag", "equals", "R"), "operator": "between", "value": [0, 20]}, "coalesce(list_avg(list_transform(list_filter(items, lambda x : x.l_returnflag = 'R'), lambda x : x.l_quantity)), 0) BETWEEN 0 AND 20")
_embedded("a_window", _array("items", "all", _MANY, filter=_rule("l_returnflag", "notEquals", "R"), orderBy=[{"field": "l_quantity", "dir": "desc"}], skip=1, take=2), "len(list_filter(list_sort(list_transform(list_filter(items, lambda x : x.l_returnflag <> 'R'), lambda x : x.l_quantity), 'DESC')[2:3], lambda q : q <= 10)) = 0")

for _op, (_more, _sql) in _CASES.items():
    _embedded(f"aj_{_op}", _array("items" if _op in ("all", "empty") else "doc.inner.items", _op, None if _more is None else _MANY, **(_more or {})), _sql, as_json=True)
_embedded("aj_sum", {"field": "items", "aggregate": {"mode": "sum", "field": "l_quantity"}, "operator": "lessThan", "value": 60}, "coalesce(list_sum(list_transform(items, lambda x : x.l_quantity)), 0) < 60", as_json=True)
_embedded("aj_avg_sql", {"field": "doc.inner.items", "aggregate": {"mode": "avg", "field": "l_quantity"}, "operator": "lessThan", "value": 15}, "list_avg(list_transform(items, lambda x : x.l_quantity)) < 15", as_json=True, profile="sql")
_embedded("aj_filtered", {"field": "items", "aggregate": {"mode": "sum", "field": "l_extendedprice"}, "condition": _rule("l_returnflag", "equals", "R"), "operator": "greaterThan", "value": 60000}, "coalesce(list_sum(list_transform(list_filter(items, lambda x : x.l_returnflag = 'R'), lambda x : x.l_extendedprice)), 0) > 60000", as_json=True)
_embedded("aj_no_number", {"field": "items", "aggregate": {"mode": "sum", "field": "l_returnflag"}, "operator": "greaterThanEquals", "value": 0}, "len(items) = 0", as_json=True)
_embedded("aj_outer_path", _array("items", "any", {"field": "l_extendedprice", "operator": "greaterThan", "path": "o_totalprice"}), "len(list_filter(items, lambda x : x.l_extendedprice > o_totalprice)) > 0", as_json=True)


def _plain_json(name: str, rule: Any, sql: str, **options: Any) -> None:
    """Events with a JSON array of plain values: as many ones as the key k of the props says, up to four."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = engine(spark, sf_dir).catalog.table("events")
        n = F.get_json_object("props", "$.k").cast("int") % 5
        return Engine().where(events.withColumn("tags", F.to_json(F.array_repeat(F.lit(2), n))), rule, **options).select("event_id")

    _QUERIES[name], _SQL[name] = run, f"SELECT event_id FROM events WHERE {sql}"


_N = "CAST(json_extract_string(props, '$.k') AS INT) % 5"
_plain_json("aj_plain_empty", _array("tags", "empty"), f"{_N} = 0")
_plain_json("aj_plain_not_empty", _array("tags", "notEmpty"), f"{_N} > 0")
_plain_json("aj_plain_any", _array("tags", "all", True), f"{_N} = 0")
_plain_json("aj_plain_sum", {"field": "tags", "aggregate": {"mode": "sum"}, "operator": "greaterThan", "value": 4}, f"2 * ({_N}) > 4")

# Relations: the same over joins.
_R = "SELECT o_orderkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey HAVING {}"
_HIT, _ROWS = "count(*) FILTER (l_quantity > 10)", "count(l_orderkey)"
_RCASES = {
    "all": ({}, f"{_HIT} = {_ROWS}"), "any": ({}, f"{_HIT} > 0"), "none": ({}, f"{_HIT} = 0"), "atLeast": ({"count": 3}, f"{_HIT} >= 3"), "atMost": ({"count": 2}, f"{_HIT} <= 2"),
    "exactly": ({"count": 0}, f"{_HIT} = 0"), "empty": (None, f"{_ROWS} = 0"), "notEmpty": (None, f"{_ROWS} > 0"),
}
for _op, (_more, _sql) in _RCASES.items():
    _where(f"r_{_op}", "orders", _array("items", _op, None if _more is None else _MANY, **(_more or {})), _R.format(_sql))
_where("r_fused", "orders", {"any": [_array("items", "exactly", _MANY, count=1), _array("items", "all", _rule("l_returnflag", "equals", "R")), {"field": "items", "aggregate": {"mode": "sum", "field": "l_quantity"}, "operator": "greaterThan", "value": 200}]}, _R.format(f"{_HIT} = 1 OR count(*) FILTER (l_returnflag = 'R') = {_ROWS} OR coalesce(sum(l_quantity), 0) > 200"))
_where("r_outer_path", "orders", _array("items", "any", {"field": "l_extendedprice", "operator": "greaterThan", "path": "o_totalprice"}), "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_extendedprice > o_totalprice)")


def _shared_key(name: str, rule: Any, sql: str) -> None:
    """Customers and the suppliers of their nation: many parents share a key and differ in what the rule asks of them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir)
        e.catalog.schema.relate("locals", "supplier", "customer", [("s_nationkey", "c_nationkey")], "localSuppliers")
        return e.where("customer", rule).select("c_custkey")

    _QUERIES[name], _SQL[name] = run, f"SELECT c_custkey FROM customer WHERE {sql}"


_RICHER = {"field": "s_acctbal", "operator": "greaterThan", "path": "c_acctbal"}
_shared_key("r_outer_shared_any", _array("localSuppliers", "any", _RICHER), "EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal > c_acctbal)")
_shared_key("r_outer_shared_count", _array("localSuppliers", "atLeast", _RICHER, count=2), "(SELECT count(*) FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal > c_acctbal) >= 2")
_where("r_nested", "customer", _array("orders", "atLeast", _array("items", "atLeast", _MANY, count=5), count=2), "(SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 10) >= 5) >= 2")
_SUM = {"mode": "sum", "field": "l_quantity"}
_AVG = {"mode": "avg", "field": "l_quantity"}
_where("g_sum", "orders", {"field": "items", "aggregate": _SUM, "operator": "lessThanEquals", "value": 50}, _R.format("coalesce(sum(l_quantity), 0) <= 50"))
_where("g_avg_record", "orders", {"field": "items", "aggregate": _AVG, "operator": "lessThan", "value": 15}, _R.format("coalesce(avg(l_quantity), 0) < 15"))
_where("g_avg_sql", "orders", {"field": "items", "aggregate": _AVG, "operator": "lessThan", "value": 15}, _R.format("avg(l_quantity) < 15"), profile="sql")
_where("g_sum_filtered", "orders", {"field": "items", "aggregate": _SUM, "condition": _rule("l_returnflag", "equals", "R"), "operator": "greaterThan", "value": 60}, _R.format("coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) > 60"))
_where("g_between", "orders", {"field": "items", "aggregate": _SUM, "operator": "between", "value": [90, 60]}, _R.format("coalesce(sum(l_quantity), 0) BETWEEN 60 AND 90"))
_where("g_not_between", "orders", {"field": "items", "aggregate": _SUM, "operator": "notBetween", "value": [60, 90]}, _R.format("coalesce(sum(l_quantity), 0) NOT BETWEEN 60 AND 90"))
_where("g_path_rhs", "orders", {"field": "items", "aggregate": {"mode": "sum", "field": "l_extendedprice"}, "operator": "greaterThan", "path": "$.o_totalprice"}, "coalesce((SELECT sum(l_extendedprice) FROM lineitem WHERE l_orderkey = o_orderkey), 0) > o_totalprice")
_where("g_dotted", "customer", {"field": "orders.items", "aggregate": _SUM, "operator": "greaterThan", "value": 1200}, "coalesce((SELECT sum(l_quantity) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey), 0) > 1200")
_where("g_to_one_then_many", "orders", {"field": "customer.events", "aggregate": {"mode": "sum", "field": "value"}, "operator": "greaterThan", "value": 3000}, "coalesce((SELECT sum(value) FROM events WHERE user_id = o_custkey), 0) > 3000")

# Windows: customers' events by time, which is unique.
_W = "SELECT c_custkey FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {o}) AS r FROM events {w}) e ON user_id = c_custkey AND {r} GROUP BY c_custkey HAVING {h}"
_BY, _VALUE = [{"field": "ts", "dir": "desc"}], _rule("value", "greaterThan", 50)
_where("w_take1_all", "customer", {"all": [_array("events", "notEmpty"), _array("events", "all", _VALUE, orderBy=_BY, take=1)]}, _W.format(o="ts DESC", w="", r="r <= 1", h="count(user_id) > 0 AND count(*) FILTER (value > 50) = count(user_id)"))
_where("w_skip_take", "customer", _array("events", "atLeast", _VALUE, count=1, orderBy=_BY, skip=1, take=3), _W.format(o="ts DESC", w="", r="r BETWEEN 2 AND 4", h="count(*) FILTER (value > 50) >= 1"))
_where("w_filter_first", "customer", _array("events", "any", _VALUE, filter=_rule("event_type", "equals", "click"), orderBy=_BY, take=2), _W.format(o="ts DESC", w="WHERE event_type = 'click'", r="r <= 2", h="count(*) FILTER (value > 50) > 0"))
_where("w_multi_key", "customer", _array("events", "any", _VALUE, orderBy=[{"field": "event_type", "dir": "asc"}, {"field": "ts", "dir": "desc"}], take=1), _W.format(o="event_type, ts DESC", w="", r="r <= 1", h="count(*) FILTER (value > 50) > 0"))
_where("w_agg_last_n", "customer", {"field": "events", "aggregate": {"mode": "sum", "field": "value"}, "operator": "greaterThan", "value": 200, "orderBy": _BY, "take": 4}, _W.format(o="ts DESC", w="", r="r <= 4", h="coalesce(sum(value), 0) > 200"))
_where("w_extremal", "customer", {"all": [_array("events", "notEmpty"), _array("events", "all", _rule("value", "greaterThan", 1), orderBy=[{"field": "value", "dir": "asc"}], take=1)]}, "EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey) AND (SELECT min(value) FROM events WHERE user_id = c_custkey) > 1")

# Joins.
_where("j_to_one", "orders", _rule("customer.c_mktsegment", "equals", "BUILDING"), "o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
_where("j_four_hops", "lineitem", _rule("order.customer.nation.region.r_name", "equals", "ASIA"), "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
_where("j_dedup", "orders", {"all": [_rule("customer.c_acctbal", "greaterThan", 0), _rule("customer.nation.n_name", "notEquals", "CHINA"), _rule("customer.c_mktsegment", "in", ["BUILDING", "MACHINERY"])]}, "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 AND n_name <> 'CHINA' AND c_mktsegment IN ('BUILDING', 'MACHINERY')")


def _composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers that occur together, joined back by both keys."""
    e = engine(spark, sf_dir)
    line = e.catalog.table("lineitem")
    pairs = line.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n")).withColumnsRenamed({"l_partkey": "ps_partkey", "l_suppkey": "ps_suppkey"})
    e.catalog.tables["pairs"] = pairs
    e.catalog.schema.models["pairs"] = infer_model("pairs", pairs)
    e.catalog.schema.relate("pair", "lineitem", "pairs", [("l_partkey", "ps_partkey"), ("l_suppkey", "ps_suppkey")], "lines")
    return e.where("pairs", _array("lines", "atLeast", _MANY, count=2)).select("ps_partkey", "ps_suppkey")


_QUERIES["j_composite"] = _composite
_SQL["j_composite"] = "SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey FROM lineitem GROUP BY ALL HAVING count(*) FILTER (l_quantity > 10) >= 2"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two relations between the same models, told apart by name."""
    e = engine(spark, sf_dir)
    e.catalog.schema.relate("neighbour", "customer", "nation", [("c_custkey", "n_nationkey")], "sameNumber", one=True)
    return e.where("customer", {"all": [_rule("nation.n_regionkey", "lessThan", 2), _rule("neighbour.n_regionkey", "greaterThan", 1)]}).select("c_custkey")


_QUERIES["j_named"] = _named
_SQL["j_named"] = "SELECT c_custkey FROM customer JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON c_custkey = b.n_nationkey WHERE a.n_regionkey < 2 AND b.n_regionkey > 1"


# Bridges: customers and events as two sources.
def _bridged(spark: SparkSession, sf_dir: str) -> Engine:
    read = tables(spark, sf_dir)
    crm, web = (SchemaSet({n: infer_model(n, read(n)) for n in names}) for names in (("customer", "nation"), ("events",)))
    crm.relate("nation", "customer", "nation", [("c_nationkey", "n_nationkey")], "customers")
    both = stitch({"crm": crm, "web": web}, [{"kind": "oneToMany", "endpoints": [{"source": "crm", "model": "customer", "on": "c_custkey"}, {"source": "web", "model": "events", "on": "user_id"}]}])
    return Engine(both, load=read)


_QUERIES["b_bridge_one"] = lambda spark, sf_dir: _bridged(spark, sf_dir).where("web:events", _rule("crm:customer.nation.n_regionkey", "equals", 2)).select("event_id")
_SQL["b_bridge_one"] = "SELECT event_id FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2"
_QUERIES["b_bridge_many"] = lambda spark, sf_dir: _bridged(spark, sf_dir).where("crm:customer", _array("web:events", "atLeast", _VALUE, count=10)).select("c_custkey")
_SQL["b_bridge_many"] = "SELECT c_custkey FROM customer WHERE (SELECT count(*) FROM events WHERE user_id = c_custkey AND value > 50) >= 10"
_QUERIES["b_bridge_links"] = lambda spark, sf_dir: _bridged(spark, sf_dir).join_bridge("crm:customer", "web:events", nested=False).groupBy("c_custkey").agg(F.count("linked").alias("n"))
_SQL["b_bridge_links"] = "SELECT c_custkey, count(event_id) AS n FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY c_custkey"
_QUERIES["b_bridge_rows"] = lambda spark, sf_dir: _bridged(spark, sf_dir).join_bridge("crm:customer", "web:events").select("c_custkey", F.coalesce(F.size("linked"), F.lit(0)).cast("long").alias("n"))
_SQL["b_bridge_rows"] = "SELECT c_custkey, count(event_id) AS n FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY c_custkey"

# Whole tables.
for _name, _rule_, _ok in (
    ("s_root_any", {"arrayOperator": "any", "condition": _BIG}, "count(*) FILTER (o_totalprice > 250000) > 0"),
    ("s_root_all", {"arrayOperator": "all", "condition": _BIG}, "bool_and(o_totalprice > 250000)"),
    ("s_root_at_least", {"all": [{"arrayOperator": "atLeast", "count": 100, "condition": _OPEN}, {"arrayOperator": "notEmpty"}]}, "count(*) FILTER (o_orderstatus = 'O') >= 100 AND count(*) > 0"),
):
    _QUERIES[_name] = lambda spark, sf_dir, r=_rule_: engine(spark, sf_dir).check_all("orders", r).select("rule_ok")
    _SQL[_name] = f"SELECT {_ok} AS rule_ok FROM orders"
_DEAR = [{"field": "o_totalprice", "dir": "desc"}]
_RANKED = "WITH o AS (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders {w}) SELECT {ok} AS rule_ok, {error} AS rule_error FROM o"
_OPEN_ROWS = "count(*) FILTER (o_orderstatus = 'O' AND {r})"
for _name, _rule_, _sql in (
    ("s_root_take", {"arrayOperator": "all", "condition": _OPEN, "orderBy": _DEAR, "take": 40}, _RANKED.format(w="", ok=f"{_OPEN_ROWS.format(r='r <= 40')} = least(count(*), 40)", error=f"'undefined all elements must match (' || (least(count(*), 40) - {_OPEN_ROWS.format(r='r <= 40')}) || ' failed)'")),
    ("s_root_skip_take", {"arrayOperator": "atLeast", "count": 1000, "condition": _OPEN, "orderBy": _DEAR, "skip": 10, "take": 40}, _RANKED.format(w="", ok=f"{_OPEN_ROWS.format(r='r BETWEEN 11 AND 50')} >= 1000", error=f"'undefined at least 1000 elements must match (' || {_OPEN_ROWS.format(r='r BETWEEN 11 AND 50')} || ' matched)'")),
    ("s_root_skip", {"arrayOperator": "none", "condition": _OPEN, "orderBy": _DEAR, "skip": 25}, _RANKED.format(w="", ok=f"{_OPEN_ROWS.format(r='r > 25')} = 0", error=f"'undefined no elements should match (' || {_OPEN_ROWS.format(r='r > 25')} || ' matched)'")),
    ("s_root_filter", {"all": [{"arrayOperator": "all", "condition": _OPEN, "filter": _BIG}, {"arrayOperator": "exactly", "count": 3, "condition": _OPEN, "filter": _BIG, "orderBy": _DEAR, "take": 30}]}, _RANKED.format(w="WHERE o_totalprice > 250000", ok="count(*) < 0", error=f"'All conditions must pass: undefined all elements must match (' || count(*) FILTER (o_orderstatus <> 'O') || ' failed) AND undefined exactly 3 elements must match (' || {_OPEN_ROWS.format(r='r <= 30')} || ' matched)'")),
):
    _QUERIES[_name] = lambda spark, sf_dir, r=_rule_: engine(spark, sf_dir).check_all("orders", r)
    _SQL[_name] = _sql

FLAGSHIP = {"all": [_rule("o_orderstatus", "in", ["O", "P"]), _rule("o_totalprice", "between", [20000, 300000]), _date("o_orderdate", "within", {"last": "year"}), _array("items", "any", _MANY), _rule("customer.c_mktsegment", "notEquals", "BUILDING")]}
_where("flagship", "orders", FLAGSHIP, "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('O', 'P') AND o_totalprice BETWEEN 20000 AND 300000 AND o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' AND c_mktsegment <> 'BUILDING' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 10)", now=NOW)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["flagship"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from gristmill.plans import lens_queries, more_queries

    return _QUERIES | lens_queries.queries() | more_queries.queries()


def oracle_sql() -> dict[str, str]:
    from gristmill.plans import lens_queries, more_queries

    return _SQL | lens_queries.oracle_sql() | more_queries.oracle_sql()
