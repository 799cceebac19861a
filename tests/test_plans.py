import pytest

from factloom.plans.compiler import compile_plan
from factloom.plans.contract import PlanError, parse_plan

COUNT = {"fn": "count", "alias": "n"}


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(
    "raw",
    [
        {"aggregates": []},
        {"aggregates": [COUNT] * 6},
        {"aggregates": [{"fn": "sum", "alias": "s"}]},
        {"aggregates": [{"fn": "median", "alias": "s", "column": "x"}]},
        {"aggregates": [{"fn": "count", "alias": "1 bad"}]},
        {"aggregates": [COUNT], "groupBy": list("abcd")},
        {"aggregates": [COUNT], "limit": 1001},
        {"aggregates": [COUNT], "limit": 0},
        {"aggregates": [COUNT], "version": 2},
        {"aggregates": [COUNT], "filters": [{"column": "a", "op": "is_null", "value": 1}]},
        {"aggregates": [COUNT], "filters": [{"column": "a", "op": "eq"}]},
        {"aggregates": [COUNT], "filters": [{"column": "a", "op": "in", "value": 3}]},
        {"aggregates": [COUNT], "filters": [{"column": "a", "op": "eq", "value": [3]}]},
        {"aggregates": [COUNT], "filters": [{"column": "a", "op": "like", "value": "x"}]},
        {"aggregates": [COUNT], "filters": [{"op": "eq", "value": "x"}]},
        {"aggregates": [COUNT], "orderBy": [{"column": "n", "direction": "up"}]},
    ],
)
def test_bad_plans_are_refused(raw):
    with pytest.raises(PlanError) as e:
        parse_plan(raw)
    assert e.value.code == "INVALID_QUERY_PLAN" and e.value.faults


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(
        [(0, "a", 1.0, "12abc"), (1, None, 2.0, "x"), (2, "", None, None), (3, "b", 4.0, "3"), (4, "A", 4.0, "-1e2")],
        "i int, k string, v double, t string",
    )


def run(table, **raw):
    return rows(compile_plan(table, parse_plan({"aggregates": [COUNT]} | raw), "i"))


def test_filters(table):
    one = lambda op, column="k", **v: run(table, filters=[{"column": column, "op": op, **v}])[0][0]
    assert one("eq", value="a") == 1
    assert one("neq", value="a") == 4  # null rows pass
    assert one("contains", value="A") == 2
    assert one("gt", value=1) == 0  # text never compares
    assert one("gte", "v", value=2) == 3
    assert one("lt", "v", value=4) == 2
    assert one("in", "v", value=[1, 4, "x"]) == 3
    assert one("is_null") == 1 and one("not_null") == 4
    assert one("is_null", "nowhere") == 5


def test_aggregates_of_nothing_and_of_text(table):
    aggs = [{"fn": f, "column": "t", "alias": f} for f in ("sum", "avg", "min", "max", "count_distinct")]
    assert run(table, aggregates=aggs) == [(-85.0, -85.0 / 3, -100.0, 12.0, 5)]
    assert run(table, aggregates=aggs, filters=[{"column": "v", "op": "gt", "value": 9}]) == [(0.0, 0.0, 0.0, 0.0, 0)]


def test_groups_join_null_and_empty_and_sort_nulls_last(table):
    got = run(table, groupBy=["k"], orderBy=[{"column": "k", "direction": "desc"}])
    assert got == [("b", 1), ("a", 1), ("A", 1), (None, 2)]
    assert run(table, groupBy=["v"], orderBy=[{"column": "n", "direction": "desc"}], limit=1) == [(4.0, 2)]
