from __future__ import annotations

import re
from datetime import UTC, datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from gristmill import bindings, catalog
from gristmill.functions import dates
from gristmill.functions.fuzzy import max_distance
from gristmill.lens import Lens, Narrowing, apply_lens, check_rule_against_lens, exposed_surface, validate_narrowing
from gristmill.lens.sources import ordered
from gristmill.options import EngineOptions, get_options, scope
from gristmill.plans.engine import Engine, check
from gristmill.plans.text import to_sql
from gristmill.rules import RuleError, extremal, parse
from gristmill.sources.schema import Field, Model, SchemaSet, stitch
from gristmill.validation import RuleInvalid, assert_valid_rule, validate_rule

NOW = EngineOptions(now="2024-02-29T10:00:00Z")
DDL = "id int, s string, n double, flag boolean, xs array<struct<a: int, b: string>>, tags array<string>, ts timestamp_ntz, inner struct<k: string>, m map<string, int>"
ROWS = [
    (1, "abc", 1.5, True, [Row(a=1, b="x"), Row(a=5, b="y")], ["t"], datetime(2024, 1, 1), Row(k="v"), {"p": 1}),
    (2, "", 0.0, False, [], [], datetime(2024, 6, 1, 12), Row(k=None), {}),
    (3, None, None, None, None, None, None, None, None),
    (4, "ABC", float("nan"), True, [Row(a=None, b=None)], ["t", "u"], datetime(2023, 12, 31, 23, 59, 59, 999500), Row(k="w"), {"p": 7}),
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, DDL).cache()


def ids(df, rule, **more):
    return sorted(r["id"] for r in Engine().where(df, rule, **more).select("id").collect())


def judged(df, rule, **more):
    return {r["id"]: (r["rule_ok"], r["rule_error"]) for r in check(df, rule, **more).select("id", "rule_ok", "rule_error").collect()}


@pytest.mark.parametrize(
    ("rule", "record", "sql"),
    [
        ({"field": "s", "operator": "equals", "value": "abc"}, [1], [1]),
        ({"field": "s", "operator": "notEquals", "value": "abc"}, [2, 3, 4], [2, 4]),
        ({"field": "s", "operator": "equals", "value": None}, [3], [3]),
        ({"field": "s", "operator": "equals", "value": 5}, [], []),
        ({"field": "n", "operator": "greaterThan", "value": 1}, [1], [1]),
        ({"field": "n", "operator": "notBetween", "value": [1, 2]}, [2, 3, 4], [2, 4]),
        ({"field": "flag", "operator": "lessThan", "value": True}, [], []),
        ({"field": "s", "operator": "isEmpty"}, [2, 3], [2, 3]),
        ({"field": "s", "operator": "notEmpty"}, [1, 4], [1, 4]),
        ({"field": "missing", "operator": "notExists"}, [1, 2, 3, 4], [1, 2, 3, 4]),
        ({"field": "s", "operator": "in", "value": ["abc", None]}, [1, 3], [1]),
        ({"field": "s", "operator": "contains", "value": "b", "caseInsensitive": True}, [1, 4], [1, 4]),
        ({"field": "tags", "operator": "contains", "value": "u"}, [4], [4]),
        ({"field": "s", "operator": "notMatches", "value": "^a"}, [2, 3, 4], [2, 4]),
        ({"field": "inner.k", "operator": "equals", "value": "v"}, [1], [1]),
        ({"field": "m.p", "operator": "greaterThan", "value": 3}, [4], [4]),
        ({"field": "xs.0.a", "operator": "equals", "value": 1}, [1], [1]),
        ({"field": "xs", "arrayOperator": "empty"}, [2], [2, 3]),
        ({"field": "ts", "dateOperator": "onOrBefore", "value": "2023-12-31T23:59:59.999"}, [4], [4]),
    ],
)
def test_profiles(df, rule, record, sql):
    assert ids(df, rule) == record
    assert ids(df, rule, profile="sql") == sql


def test_ordered_text_against_number(df):
    frame = df.sparkSession.createDataFrame([(1, "12"), (2, "x"), (3, "1d")], "id int, s string")
    assert ids(frame, {"field": "s", "operator": "lessThan", "value": 20}) == [1]


def test_errors(df):
    out = judged(df, {"all": [{"field": "s", "operator": "equals", "value": "abc"}, {"field": "xs", "arrayOperator": "atLeast", "count": 2, "condition": {"field": "a", "operator": "greaterThan", "value": 0}}]})
    assert out[1] == (True, None)
    assert out[2][1] == 'All conditions must pass: s must equal "abc" AND xs at least 2 elements must match (0 matched)'
    assert out[3][1].endswith("xs is no array")
    assert judged(df, {"field": "n", "operator": "lessThan", "path": "id"})[1][1] == "n must be less than 1"


def test_data_errors(df):
    rule = {"field": "xs", "aggregate": {"mode": "sum", "field": "a"}, "operator": "equals", "value": 6}
    assert judged(df, rule)[4] == (False, "xs holds a value that is no number")
    assert ids(df.where("id < 3"), rule) == [1]
    with pytest.raises(Exception, match="no number"):
        check(df, rule, on_data_error="raise").collect()
    assert ids(df, {"field": "tags", "arrayOperator": "none", "condition": True}) == [2]


def test_windows_and_average(df):
    by = [{"field": "a", "dir": "desc"}]
    assert ids(df, {"field": "xs", "arrayOperator": "all", "condition": {"field": "a", "operator": "equals", "value": 5}, "orderBy": by, "take": 1}) == [2, 1][::-1]
    avg = {"field": "xs", "aggregate": {"mode": "avg", "field": "a"}, "operator": "equals", "value": 0}
    assert ids(df.where("id = 2"), avg) == [2]
    assert ids(df.where("id = 2"), avg, profile="sql") == []


def test_binding():
    rule = {"field": "xs", "arrayOperator": "any", "condition": {"field": "a", "operator": "equals", "bind": "x"}, "filter": {"field": "b", "operator": "equals", "value": {"bind": "y"}}}
    assert bindings.required(rule) == ["x", "y"]
    assert bindings.required(bindings.resolve(rule, {"x": 1})) == ["y"]


def test_unbound_raises(df):
    with pytest.raises(RuleError, match="bound"):
        ids(df, {"field": "s", "operator": "equals", "bind": "x"})


@pytest.mark.parametrize(
    ("value", "first", "last"),
    [
        ({"this": "month"}, "2024-02-01T00:00:00.000", "2024-02-29T23:59:59.999"),
        ({"last": "year"}, "2023-01-01T00:00:00.000", "2023-12-31T23:59:59.999"),
        ({"next": "quarter"}, "2024-04-01T00:00:00.000", "2024-06-30T23:59:59.999"),
        ({"this": "isoWeek"}, "2024-02-26T00:00:00.000", "2024-03-03T23:59:59.999"),
        ({"last": "day"}, "2024-02-28T00:00:00.000", "2024-02-28T23:59:59.999"),
    ],
)
def test_periods(value, first, last):
    a, b = dates.period(value, NOW)
    assert (a.isoformat(timespec="milliseconds")[:23], b.isoformat(timespec="milliseconds")[:23]) == (first, last)


def test_rolling_clamps_and_keeps_wall_clock():
    assert dates.rolling({"ago": {"years": 1}}, NOW) == datetime(2023, 2, 28, 10, tzinfo=UTC)
    summer = EngineOptions(now="2024-03-09T12:00:00-05:00", time_zone="America/New_York")
    assert dates.rolling({"ahead": {"days": 1}}, summer) == datetime(2024, 3, 10, 16, tzinfo=UTC)
    with pytest.raises(RuleError, match="now"):
        dates.rolling({"ago": {"days": 1}}, EngineOptions())
    with pytest.raises(RuleError):
        dates.rolling({"ago": {"days": -1}}, NOW)


def test_parse_is_strict():
    for bad in ({"all": [], "any": []}, {"field": "a", "operator": "like", "value": 1}, {"field": "a", "operator": "equals"}, {"field": "a", "arrayOperator": "atLeast", "condition": True}, 5, {"field": "a", "aggregate": {"mode": "min"}, "operator": "equals", "value": 1}):
        with pytest.raises(RuleError):
            parse(bad)


def test_validator_codes():
    codes = lambda rule, target="spark": [i.code for i in validate_rule(rule, target)]
    assert codes({"field": "a", "operator": "matches", "value": "x"}, "prisma") == ["unsupported_prisma_operator"]
    assert codes({"field": "a", "arrayOperator": "any", "condition": True}, "sql") == ["unsupported_sql_array_operator"]
    assert codes({"field": "a", "operator": "equals", "value": 1, "path": "b"}) == ["ambiguous_value_source"]
    assert codes({"field": "a", "operator": "equals", "bind": "x"}) == []
    assert codes({"field": "a", "dateOperator": "dayIn", "value": ["noday"]}) == ["invalid_day_list"]
    assert codes({"field": "a", "arrayOperator": "any", "condition": True, "take": -1}) == ["invalid_window_take"]
    assert codes({"if": True}) == ["invalid_condition"]
    with pytest.raises(RuleInvalid):
        assert_valid_rule({"field": "", "operator": "exists"})


def test_catalog_is_whole():
    from gristmill.operators import scalar

    assert set(scalar.PHRASES) == set(catalog.FIELD_OPERATORS) and len(catalog.FIELD_OPERATORS) == 20
    assert set(scalar.DATE_PHRASES) == set(catalog.DATE_OPERATORS) and len(catalog.DATE_OPERATORS) == 9
    assert len(catalog.ARRAY_OPERATORS) == 8


def test_extremal():
    rule = {"field": "xs", "arrayOperator": "all", "condition": {"field": "a", "operator": "greaterThan", "value": 1}, "orderBy": [{"field": "a", "dir": "asc"}], "take": 1}
    assert not extremal(parse(rule)).window
    assert extremal(parse(rule | {"orderBy": [{"field": "a", "dir": "desc"}]})).window


def test_options_scope():
    with scope(case_insensitive=True), scope(profile="sql") as inner:
        assert inner.case_insensitive and get_options().profile == "sql"
    assert get_options() == EngineOptions()


def test_fuzzy(df):
    assert [max_distance(n) for n in (3, 4, 6, 7)] == [0, 1, 1, 2]
    assert max_distance(10, {"maxDistance": 3, "maxRatio": 0.2}) == 2
    frame = df.sparkSession.createDataFrame([(1, "Acme Corporation"), (2, "Other"), (3, None)], "id int, s string")
    assert ids(frame, {"field": "s", "operator": "contains", "value": "corporaton acme", "fuzzy": True}) == [1]
    assert ids(frame, {"field": "s", "operator": "notContains", "value": "corporaton", "fuzzy": True}) == [2, 3]


def test_pushdown(spark, data):
    plan = Engine().explain_rule(spark.read.parquet(f"{data}/orders.parquet"), {"all": [{"field": "o_totalprice", "operator": "greaterThan", "value": 5}, {"field": "o_orderdate", "dateOperator": "before", "value": "1996-01-01"}]})
    pushed = re.search(r"PushedFilters: (.*)", plan)[1]
    assert "GreaterThan(o_totalprice" in pushed and "LessThan(o_orderdate" in pushed


def test_relation_plans(spark, data):
    from gristmill.plans.registry import engine

    e = engine(spark, data)
    many = {"field": "l_quantity", "operator": "greaterThan", "value": 10}
    assert "LeftSemi" in e.explain_rule("orders", {"field": "items", "arrayOperator": "any", "condition": many})
    fused = e.explain_rule("orders", {"any": [{"field": "items", "arrayOperator": "exactly", "count": n, "condition": many} for n in (1, 2)]})
    assert fused.count("Scan parquet") <= 4 and fused.split("== Initial Plan ==")[0].count("lineitem.parquet") <= 2


def _blog() -> SchemaSet:
    post = Model("Post", fields={"id": Field(), "authorId": Field(), "title": Field(), "deleted": Field("Boolean")})
    user = Model("User", fields={"id": Field(), "role": Field("Enum", values=["admin", "member"]), "email": Field()})
    return SchemaSet({"User": user, "Post": post}).relate("author", "Post", "User", [("authorId", "id")], "posts")


def test_lens_gate_and_rewrite(spark):
    users = spark.createDataFrame([("u1", "admin", "e"), ("u2", "member", "e"), ("u3", "member", "e")], "id string, role string, email string")
    posts = spark.createDataFrame([("p1", "u1", "foo", False), ("p2", "u1", "bar", True), ("p3", "u2", "bar", False)], "id string, authorId string, title string, deleted boolean")
    base = Lens(_blog(), "User")
    live = Narrowing(base, {"omits": ["email"], "enumOmits": {"role": ["admin"]}}, {"models": {"Post": {"where": {"field": "deleted", "operator": "equals", "value": False}}}})
    assert validate_narrowing(live) == []
    assert check_rule_against_lens({"field": "email", "operator": "exists"}, live)
    assert check_rule_against_lens({"field": "role", "operator": "equals", "value": "admin"}, live)
    e = Engine(_blog(), {"User": users, "Post": posts})
    every = {"field": "posts", "arrayOperator": "all", "condition": {"field": "title", "operator": "equals", "value": "foo"}}
    assert sorted(r["id"] for r in e.where("User", every).collect()) == ["u3"]
    assert sorted(r["id"] for r in e.where("User", apply_lens(every, live)).collect()) == ["u1", "u3"]
    back = Narrowing(Narrowing(base, {"omits": ["email"]}), {"picks": ["email"]})
    assert validate_narrowing(back)


def test_stitch_checks():
    one = {"crm": _blog(), "web": SchemaSet({"Hit": Model("Hit", fields={"userId": Field()})})}
    ends = [{"source": "crm", "model": "User", "on": "id"}, {"source": "web", "model": "Hit", "on": "userId"}]
    both = stitch(one, [{"kind": "oneToMany", "endpoints": ends}])
    assert both.models["crm:User"].relations["web:Hit"].many and not both.models["web:Hit"].relations["crm:User"].many
    with pytest.raises(RuleError):
        stitch(one, [{"endpoints": [ends[0], ends[0]]}])
    with pytest.raises(RuleError):
        stitch(one, [{"endpoints": [ends[0], ends[1] | {"on": "nothing"}]}])


def test_text_form():
    text, params, joins = to_sql({"all": [{"field": "author.role", "operator": "in", "value": ["admin"]}, {"field": "title", "operator": "notEquals", "value": None}]}, _blog(), "Post")
    assert text == "(t1.`role` IN (:p0) AND t0.`title` IS NOT NULL)" and params == {"p0": "admin"}
    assert joins == ["LEFT JOIN `User` AS t1 ON t0.`authorId` = t1.`id`"]


# A plain evaluator of a part of the language, against the engine on random rows.
def plain(rule, row):
    if "all" in rule:
        return all(plain(r, row) for r in rule["all"])
    if "any" in rule:
        return any(plain(r, row) for r in rule["any"])
    if "if" in rule:
        return plain(rule["then"], row) if plain(rule["if"], row) else plain(rule.get("else", {"all": []}), row)
    if "arrayOperator" in rule:
        hits = sum(plain(rule["condition"], x) for x in row["xs"])
        return {"all": hits == len(row["xs"]), "any": hits > 0, "none": hits == 0, "atLeast": hits >= rule.get("count", 0), "atMost": hits <= rule.get("count", 0), "exactly": hits == rule.get("count", 0)}[rule["arrayOperator"]]
    v, w, op = row[rule["field"]], rule["value"], rule["operator"]
    if op in ("equals", "notEquals"):
        return (v == w) == (op == "equals")
    if op in ("in", "notIn"):
        return (v in w) == (op == "in")
    if v is None or w is None or isinstance(v, str) != isinstance(w, str):
        return False
    return {"lessThan": v < w, "greaterThanEquals": v >= w}[op]


_leaf = st.one_of(
    st.fixed_dictionaries({"field": st.just("a"), "operator": st.sampled_from(["equals", "notEquals", "lessThan", "greaterThanEquals"]), "value": st.integers(-2, 2)}),
    st.fixed_dictionaries({"field": st.just("s"), "operator": st.sampled_from(["equals", "notEquals"]), "value": st.sampled_from(["x", "y", None])}),
    st.fixed_dictionaries({"field": st.just("s"), "operator": st.sampled_from(["in", "notIn"]), "value": st.lists(st.sampled_from(["x", "y"]), max_size=2)}),
)
_many = st.fixed_dictionaries({"field": st.just("xs"), "arrayOperator": st.sampled_from(["all", "any", "none", "atLeast", "atMost", "exactly"]), "count": st.integers(0, 2), "condition": _leaf})
_rules = st.recursive(st.one_of(_leaf, _many), lambda r: st.one_of(st.fixed_dictionaries({"all": st.lists(r, max_size=3)}), st.fixed_dictionaries({"any": st.lists(r, max_size=3)}), st.fixed_dictionaries({"if": r, "then": r, "else": r})), max_leaves=5)
_RANDOM = [{"id": i, "a": a, "s": s, "xs": xs} for i, (a, s, xs) in enumerate((a, s, xs) for a in (-1, 0, 2, None) for s in ("x", "z", None) for xs in ([], [{"a": 1, "s": "x"}], [{"a": None, "s": "y"}, {"a": 2, "s": None}]))]


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(rule=_rules)
def test_random_rules(spark, rule):
    frame = spark.createDataFrame([Row(**r | {"xs": [Row(**x) for x in r["xs"]]}) for r in _RANDOM], "id int, a int, s string, xs array<struct<a: int, s: string>>")
    assert ids(frame, rule) == [r["id"] for r in _RANDOM if plain(rule, r)]


def _lens(*more):
    schema = SchemaSet({"a": Model("a", fields={n: Field() for n in ("id", "x", "y", "b_id")}), "b": Model("b", fields={n: Field() for n in ("id", "p", "q", "c_id")}), "c": Model("c", fields={n: Field() for n in ("id", "r")})})
    schema.relate("b", "a", "b", [("b_id", "id")], "as")
    schema.relate("c", "b", "c", [("c_id", "id")], "bs")
    lens = Lens(schema, "a")
    for root, defaults in more:
        lens = Narrowing(lens, root, defaults)
    return lens


def _is(field):
    return {"field": field, "operator": "equals", "value": 1}


def test_a_where_may_name_what_older_layers_show_only():
    assert validate_narrowing(_lens(({"omits": ["x"]}, {}), ({"where": _is("x")}, {})))
    assert not validate_narrowing(_lens(({"omits": ["x"], "where": _is("x")}, {})))  # a layer may filter by what it takes itself
    assert not validate_narrowing(_lens(({"omits": ["x"]}, {}), ({"where": _is("y")}, {})))
    assert validate_narrowing(_lens(({}, {"models": {"c": {"omits": ["r"]}}}), ({"where": _is("b.c.r")}, {})))
    below = {"relations": {"b": {"where": _is("p")}}}  # shows no column, so it may name any
    assert not validate_narrowing(_lens(({"relations": {"b": {"omits": ["p"]}}}, {}), (below, {})))
    assert validate_narrowing(_lens(({"relations": {"b": {"where": _is("x")}}}, {}))) and validate_narrowing(_lens(({}, {"models": {"b": {"where": _is("x")}}})))


@pytest.mark.parametrize(
    "layers",
    [
        [({"picks": ["x"], "omits": ["y"]}, {})], [({}, {"models": {"a": {"relations": {"b": {}}}}})], [({"picks": ["nothing"]}, {})], [({"omits": ["nothing"]}, {})], [({}, {"models": {"nothing": {}}})],
        [({"picks": ["x"]}, {}), ({"picks": ["y"]}, {})], [({"omits": ["x"]}, {}), ({"picks": ["x"]}, {})], [({"picks": ["x"]}, {}), ({"omits": ["y"]}, {})], [({"omits": ["x"]}, {}), ({"omits": ["x"]}, {})],
        [({"picks": ["x"]}, {"models": {"a": {"omits": ["x"]}}})], [({"picks": ["x"]}, {"models": {"a": {"picks": ["y"]}}})], [({"omits": ["x"]}, {"models": {"a": {"picks": ["y"]}}})],
        [({}, {"models": {"b": {"omits": ["p"]}}}), ({"relations": {"b": {"picks": ["p"]}}}, {})], [({}, {"models": {"b": {"omits": ["p"]}}}), ({}, {"models": {"b": {"picks": ["p"]}}})],
        [({"relations": {"x": {}}}, {})], [({"relations": {"nothing": {}}}, {})], [({"enumPicks": {"x": ["A"]}}, {})], [({"enumPicks": {"nothing": ["A"]}}, {})], [({"enumPicks": {"e": ["Z"]}}, {})],
        [({"enumOmits": {"e": ["A"]}}, {}), ({"enumPicks": {"e": ["A"]}}, {})], [({"enumPicks": {"e": ["A"]}}, {}), ({"enumOmits": {"e": ["B"]}}, {})], [({"enumPicks": {"e": ["A"]}}, {"enums": {"E": {"omits": ["A"]}}})],
        [({}, {"enums": {"E": {"picks": ["A"]}}}), ({"enumPicks": {"e": ["B"]}}, {})], [({}, {"enums": {"E": {"picks": ["Z"]}}})], [({}, {"enums": {"N": {"picks": ["A"]}}})], [({}, {"enums": {"E": {"omits": ["A"]}}}), ({}, {"enums": {"E": {"picks": ["A"]}}})],
        [({"sources": {"nothing": True}}, {})], [({"sources": {"x": {"label": "nothing"}}}, {})], [({"sources": {"x": {"where": _is("nothing")}}}, {})], [({"sources": {"x": {"groupBy": "as"}}}, {})], [({"sources": {"x": {"groupBy": "b.nothing"}}}, {})],
        [({"sources": {"x": {"groupBy": "y"}}}, {}), ({"sources": {"x": {"groupBy": "b.p"}}}, {})],
    ],
)
def test_narrowings_that_are_found_wrong(layers):
    lens = _lens(*layers)
    schema = lens
    while isinstance(schema, Narrowing):
        schema = schema.parent
    schema.schema.enums["E"] = ["A", "B", "C"]
    schema.schema.models["a"].fields["e"] = Field("Enum", enum="E")
    found = validate_narrowing(lens)
    assert found, layers


def test_narrowings_that_are_right():
    lens = _lens(({"picks": ["id", "x", "b"], "relations": {"b": {"omits": ["q"]}}}, {"models": {"c": {"picks": ["id", "r"]}}}), ({"omits": ["x"], "sources": {"id": {"groupBy": "b.c.r", "label": "x"}}}, {}), ({"sources": {"id": {"groupBy": "b.c.r"}}}, {}))
    assert not validate_narrowing(lens)


def test_labels_and_axes_may_not_show_what_older_layers_took():
    child = lambda own: ({"sources": {"x": own}}, {})
    assert validate_narrowing(_lens(({"omits": ["y"]}, {}), child({"label": "y"})))
    assert validate_narrowing(_lens(({"picks": ["x"]}, {}), child({"label": "y"})))
    assert not validate_narrowing(_lens(({"omits": ["y"], "sources": {"x": {"label": "y"}}}, {}), child({"label": "y"})))  # declared before
    assert not validate_narrowing(_lens(({"sources": {"x": {"label": "y"}}, "omits": ["y"]}, {})))
    assert validate_narrowing(_lens(({"relations": {"b": {"omits": ["p"]}}}, {}), child({"groupBy": "b.p"})))
    assert validate_narrowing(_lens(({}, {"models": {"c": {"omits": ["r"]}}}), child({"groupBy": ["b.q", "b.c.r"]})))
    assert not validate_narrowing(_lens(({}, {"models": {"c": {"omits": ["r"]}}}), child({"groupBy": ["b.q", "b.c.id"]})))
    assert validate_narrowing(_lens(({}, {"models": {"a": {"omits": ["y"]}}}), ({}, {"models": {"a": {"sources": {"x": {"label": "y"}}}}})))


def test_surface_reaches_any_model_and_groups_options():
    models = {f"m{i}": Model(f"m{i}", fields={"id": Field(), "next": Field()}) for i in range(12)}
    schema = SchemaSet(models)
    for i in range(11):
        schema.relate("on", f"m{i}", f"m{i + 1}", [("next", "id")], "back")
    assert set(exposed_surface(Lens(schema, "m0"))) == set(models)
    options = [{"value": 1, "groups": ["g"]}, {"value": 1, "groups": ["h"]}, {"value": 1, "groups": ["g"], "label": "one"}]
    found = exposed_surface(_lens(), {"a.x": options, "a.y": [3, 4, 3]})["a"]["fields"]
    assert found["x"]["options"] == [options[2], options[1]] and found["y"]["values"] == [3, 4]
    grouped = ({"sources": {"x": {"groupBy": "y"}}, "relations": {"b": {"relations": {"as": {"sources": {"x": {"groupBy": "id"}}}}}}}, {})
    with pytest.raises(RuleError):
        exposed_surface(_lens(grouped))


@pytest.mark.parametrize(
    "pattern, text, hit",
    [
        ("^abc$", "abc\n", False), ({"source": "^abc$", "flags": "m"}, "x\nabc\ny", True), ({"source": "^äbc$", "flags": "i"}, "ÄBC", True), (r"a\sb", "a b", True), (r"a[\s]b", "a b", True), (r"^\S$", " ", False),
        ("a.b", "a\u0085b", True), ("a.b", "a b", False), ({"source": "a.b", "flags": "s"}, "a\nb", True), ("a{b", "a{b", True), ("a{2}", "aa", True), ("[[]", "[", True), ("[a&&b]", "&", True), ("[]", "a", False), ("[^]", "\n", True),
        (r"\bé", "é", False), (r"\bx\b", "(x)", True), (r"\Z", "Z", True), (r"\h", "h", True), (r"\v", "\x0b", True), (r"\v", "\n", False), (r"[\b]", "\x08", True), (r"a\/b", "a/b", True), (r"é", "é", True), (r"(?<n>a)\k<n>", "aa", True), (r"^[^\s]+$", "a b", False),
        (r"\$5\.0$", "$5.0", True), (r"[$^.]{3}", "$^.", True),
    ],
)
def test_patterns_match_as_the_evaluators_do(spark, pattern, text, hit):
    df = spark.createDataFrame([(text,)], "t string")
    assert check(df, {"field": "t", "operator": "matches", "value": pattern}).first()["rule_ok"] is hit


def test_json_arrays_of_mixed_and_odd_values(spark):
    rows = [(1, '[{"n": 1}, {"n": 5}]'), (2, '[1, {"n": 5}]'), (3, "[1, 2]"), (4, "[]"), (5, "{}"), (6, "no json"), (7, None), (8, '[{"n": "5"}]'), (9, '[{"n": null}]')]
    df = spark.createDataFrame(rows, "id long, j string")
    passed = lambda rule, **o: [r["id"] for r in check(df, rule, **o).where("rule_ok").orderBy("id").collect()]
    big = {"field": "n", "operator": "greaterThan", "value": 3}
    assert passed({"field": "j", "arrayOperator": "any", "condition": big}) == [1, 2, 8]
    assert passed({"field": "j", "arrayOperator": "none", "condition": big}) == [4, 9]
    assert passed({"field": "j", "arrayOperator": "notEmpty"}) == [1, 2, 3, 8, 9] and passed({"field": "j", "arrayOperator": "empty"}) == [4]
    assert passed({"field": "j", "arrayOperator": "empty"}, profile="sql") == [4, 5, 6, 7]
    assert passed({"field": "j", "aggregate": {"mode": "sum", "field": "n"}, "operator": "greaterThanEquals", "value": 0}) == [1, 4]
    assert passed({"field": "j", "aggregate": {"mode": "sum"}, "operator": "equals", "value": 3}) == [3]
    assert passed({"field": "j", "arrayOperator": "all", "condition": {"field": "n", "operator": "exists"}}) == [1, 4, 8, 9]


def test_options_order_as_in_english(spark):
    texts = ["b", "B", "a10", "a2", "Ä", "ab", "z", "_x", "a02"]
    df = spark.createDataFrame([(None, t, None) for t in texts], "groups array<string>, value string, label string")
    assert [r["value"] for r in ordered(df).collect()] == ["_x", "Ä", "a02", "a2", "a10", "ab", "b", "B", "z"]
