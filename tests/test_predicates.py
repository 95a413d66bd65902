"""Filter strings, the filter parser, lowering to Columns, pushed-down filters."""

import datetime as dt
import uuid

import pytest
from hypothesis import given
from hypothesis import strategies as st

from keytable.model import Entity, schema_of
from keytable.plans.predicate import And, Compare, Const, Flag, In, Not, Or, compare_strings, filter_string, literal, m, parse_filter
from keytable.plans.query import NotFoundError, Query, TooManyError
from keytable.queries import CUSTOMER, ORDERS, context, root


def entity(ddl, name="e"):
    return Entity(name, schema_of(ddl))


def swap(a, b):
    from pyspark.sql import functions as F

    return (lambda s: str(s).replace(a, b)), (lambda c: F.replace(c, F.lit(a), F.lit(b)))


GRID = entity("TenantId string").with_keys(["TenantId"]).with_key_transform("TenantId", *swap("-", ""), "PartitionKey")
FLOW = entity("FlowId string, Id string, Test string").with_keys(["FlowId", "Id"]).with_key_transform("FlowId", *swap("/", "_"))
ONE = entity("Id string, Test string").with_keys(["Id"]).with_key_transform("Id", *swap("/", "_"))


def test_golden_filter_strings():
    assert filter_string(m("TenantId") == "hej-med-dig", GRID) == "PartitionKey eq 'hejmeddig'"
    assert filter_string(m("FlowId") == "test/as", FLOW) == "PartitionKey ge 'test_as' and PartitionKey lt 'test_at'"
    assert filter_string(m("Id") == "test/as", ONE) == "PartitionKey eq 'test_as'"


def test_filter_string_keeps_what_is_no_key():
    e = entity("a string, b string, n int").with_keys(["a"], ["b"])
    assert filter_string((m("a") == "x") & (m("n") > 3), e) == "PartitionKey eq 'x' and n gt 3"
    assert filter_string((m("b") == "y") & (m("a") == "x"), e) == "PartitionKey eq 'x' and RowKey eq 'y'"
    assert filter_string((m("n") == 1) | (m("a") == "x"), e) == "n eq 1 or a eq 'x'"
    assert filter_string((m("n") == 1) & ((m("a") == "x") | (m("b") == "y")), e) == "n eq 1 and (a eq 'x' or b eq 'y')"
    assert filter_string(m("a").startswith("p"), e) == "PartitionKey ge 'p' and PartitionKey lt 'q'"
    assert filter_string(Const(True), e) == "" and filter_string((m("n") == 1) | Const(True), e) == "n eq 1 or true"


def test_literals():
    assert literal("it's") == "'it''s'"
    assert [literal(x) for x in (True, 5, 2**40, 1.25, None, b"\x01\xff")] == ["true", "5", "1099511627776L", "1.25", "null", "X'01ff'"]
    assert literal(dt.datetime(2020, 1, 2, 3, 4, 5)) == "datetime'2020-01-02T03:04:05.000000Z'"
    assert literal(uuid.UUID(int=1)) == "guid'00000000-0000-0000-0000-000000000001'"


def test_parser():
    tree = parse_filter("a eq 'x''y' and (b gt 5L or not c) and 2.5 le d")
    assert tree == And((And((Compare("a", "eq", "x'y"), Or((Compare("b", "gt", 5), Not(Flag("c")))))), Compare("d", "ge", 2.5)))
    assert parse_filter("  ") == Const(True)
    assert parse_filter("t ge datetime'2020-01-01T00:00:00Z'") == Compare("t", "ge", dt.datetime(2020, 1, 1))
    assert parse_filter("x eq null") == Compare("x", "eq", None)
    assert parse_filter("x eq X'01ff'") == Compare("x", "eq", b"\x01\xff")
    for bad in ("a eq", "a eq 'x' b", "(a eq 1", "1 eq 2", "and", "a ~ 1"):
        with pytest.raises(ValueError):
            parse_filter(bad)


names = st.sampled_from(["a", "b", "n"])
values = st.one_of(st.integers(-(2**40), 2**40), st.text(max_size=8), st.booleans(), st.none())
leaves = st.builds(Compare, names, st.sampled_from(["eq", "ne", "gt", "ge", "lt", "le"]), values)
trees = st.recursive(leaves, lambda t: st.one_of(st.builds(lambda x, y: And((x, y)), t, t), st.builds(lambda x, y: Or((x, y)), t, t), st.builds(Not, t)), max_leaves=6)


def meaning(p, row):
    if isinstance(p, Compare):
        return (p.member, p.op, p.value) in row
    if isinstance(p, Not):
        return not meaning(p.inner, row)
    results = [meaning(q, row) for q in p.parts]
    return all(results) if isinstance(p, And) else any(results)


@given(trees, st.randoms())
def test_rendered_trees_parse_to_the_same_meaning(tree, random):
    e = entity("a string, b string, n int")
    back = parse_filter(tree.render(e))

    def atoms(p):
        return [(p.member, p.op, p.value)] if isinstance(p, Compare) else atoms(p.inner) if isinstance(p, Not) else [x for q in p.parts for x in atoms(q)]

    for _ in range(5):
        row = [a for a in atoms(tree) if random.random() < 0.5]
        assert meaning(tree, row) == meaning(back, row)


def pushed(q):
    return [line for line in q.explain().splitlines() if "PushedFilters" in line][-1]


def test_filters_reach_the_scan(spark, small):
    q = root(spark, small, CUSTOMER).where_key(c_mktsegment="BUILDING", c_nationkey=3)
    assert "EqualTo(c_mktsegment,BUILDING)" in pushed(q) and "EqualTo(c_nationkey,3)" in pushed(q)
    assert "StringStartsWith(c_name,Cust)" in pushed(root(spark, small, CUSTOMER).where(m("c_name").startswith("Cust")))
    assert "In(o_orderpriority" in pushed(root(spark, small, ORDERS).where(m("o_orderpriority").isin(["1-URGENT", "2-HIGH"])))
    by_key = root(spark, small, ORDERS).where(Compare("PartitionKey", "eq", "1-URGENT__F"))
    assert "EqualTo(o_orderpriority,1-URGENT)" in pushed(by_key) and by_key.count() > 0
    assert "StringStartsWith(o_orderpriority,1-URGENT)" in pushed(root(spark, small, ORDERS).with_prefix("1-URGENT__F"))


def test_columns_are_pruned(spark, small):
    plan = root(spark, small, CUSTOMER).where(m("c_mktsegment") == "BUILDING").select("c_custkey").df()._jdf.queryExecution().toString()
    assert "ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>" in plan


def test_element_operators(spark, small):
    q = root(spark, small, CUSTOMER)
    assert q.single(m("c_custkey") == 5)["c_custkey"] == 5
    assert q.single_or_default(m("c_custkey") == -5) is None
    assert q.first_or_default(m("c_custkey") == -5) is None
    with pytest.raises(NotFoundError):
        q.first(m("c_custkey") == -5)
    with pytest.raises(NotFoundError):
        q.single(m("c_custkey") == -5)
    with pytest.raises(TooManyError):
        q.single(m("c_custkey") > 5)
    with pytest.raises(TooManyError):
        q.single_or_default(m("c_custkey") > 5)
    with pytest.raises(ValueError):
        q.take(0)
    assert len(q.take_list(3)) == 3 and len(q.take(2).take(7).to_list()) == 2
    assert q.count() == q.df().count() and q.exists(m("c_custkey") == 5) and not q.exists(m("c_custkey") == -5)
    assert q.find_properties("nope", "x") == {}
    row = q.first(m("c_custkey") == 5)
    assert q.find_properties([row["c_mktsegment"]], [row["c_nationkey"], 5], ["c_name"]) == {"c_name": row["c_name"]}


def test_take_is_applied_after_all_filters(spark):
    rows = spark.range(100).withColumnRenamed("id", "n")
    q = Query(Entity("r", rows.schema), lambda _: rows).take(3).where(m("n") >= 97)
    assert sorted(r["n"] for r in q.to_list()) == [97, 98, 99]


def test_strict_keys(spark, small):
    from dataclasses import replace

    strict = replace(CUSTOMER, strict_keys=True)
    with pytest.raises(ValueError):
        context(spark, small).query(strict).where_key(c_custkey=5)
    assert context(spark, small).query(strict).where_key(c_nationkey=5).df().columns


def test_null_logic(spark):
    rows = spark.createDataFrame([("x",), (None,), ("y",)], "a string")
    q = Query(Entity("r", rows.schema), lambda _: rows)
    found = lambda p: sorted(str(r["a"]) for r in q.where(p).to_list())
    assert found(~m("a").isin(["x"])) == ["y"] and found(m("a") != "x") == ["y"]
    assert found(m("a") == None) == ["None"] and found(m("a") != None) == ["x", "y"]  # noqa: E711
    assert found(m("a").startswith("")) == ["x", "y"] and found(In("a", ())) == []
    assert found(compare_strings("a", "x") > 0) == ["y"]
    with pytest.raises(ValueError):
        compare_strings("a", "x") > 1  # noqa: B015


def test_paging_walks_all_rows_in_key_order(spark, small):
    q, token, seen = root(spark, small, CUSTOMER), None, []
    while True:
        page, follow = q.page(40, token)
        rows = page.collect()
        seen += [(r["PartitionKey"], r["RowKey"]) for r in rows]
        token = follow(rows)
        if token is None:
            break
    assert seen == sorted(seen) and len(set(seen)) == q.count()
