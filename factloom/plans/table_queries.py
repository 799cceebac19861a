"""Driver queries of the plan compiler, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.plans.compiler import compile_plan
from factloom.plans.contract import parse_plan
from factloom.session import table

QUERIES, ORACLES = {}, {}


def _plan(name: str, source: str, raw: dict, sql: str, derive=None, row_index: str | None = None):
    def run(spark, sf_dir):
        df = table(spark, sf_dir, source)
        return compile_plan(derive(df) if derive else df, parse_plan(raw), row_index)

    QUERIES[name], ORACLES[name] = run, sql


def _where(column: str, op: str, value=None) -> dict:
    return {"column": column, "op": op} | ({} if value is None else {"value": value})


_COUNT = {"fn": "count", "alias": "n"}

_plan(
    "plan_filter_group_sort_limit",
    "lineitem",
    {
        "filters": [_where("l_quantity", "gte", 10)],
        "groupBy": ["l_returnflag"],
        "aggregates": [_COUNT, {"fn": "count_distinct", "column": "l_suppkey", "alias": "suppliers"}],
        "orderBy": [{"column": "n", "direction": "desc"}],
        "limit": 10,
    },
    """SELECT l_returnflag, count(*)::BIGINT AS n, count(DISTINCT l_suppkey)::BIGINT AS suppliers
       FROM lineitem WHERE l_quantity >= 10 GROUP BY 1 ORDER BY n DESC LIMIT 10""",
)


def _some_null(df):
    """orders with nulls: every seventh priority is null, every fifth price is null."""
    return df.withColumn("prio", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority"))).withColumn("price", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice").cast("double")))


_NULLS = """(SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS prio,
             CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice::DOUBLE END AS price FROM orders)"""

for _name, _filter, _sql in (
    ("plan_eq", _where("prio", "eq", "1-URGENT"), "prio = '1-URGENT'"),
    ("plan_neq_nulls", _where("prio", "neq", "1-URGENT"), "prio IS DISTINCT FROM '1-URGENT'"),
    ("plan_gt", _where("price", "gt", 1500), "price > 1500"),
    ("plan_gte", _where("o_custkey", "gte", 20), "o_custkey >= 20"),
    ("plan_lt", _where("price", "lt", 100000.5), "price < 100000.5"),
    ("plan_lte", _where("o_custkey", "lte", 20), "o_custkey <= 20"),
    ("plan_text_never_compares", _where("prio", "gt", 1), "false"),
    ("plan_type_mismatch", _where("prio", "eq", 1), "false"),
    ("plan_in", _where("prio", "in", ["1-URGENT", "2-HIGH", 7]), "prio IN ('1-URGENT', '2-HIGH')"),
    ("plan_contains", _where("prio", "contains", "urg"), "coalesce(contains(lower(prio), 'urg'), false)"),
    ("plan_is_null", _where("prio", "is_null"), "prio IS NULL"),
    ("plan_not_null", _where("prio", "not_null"), "prio IS NOT NULL"),
    ("plan_missing_column", _where("nowhere", "is_null"), "true"),
):
    _plan(
        _name,
        "orders",
        {"filters": [_filter], "groupBy": ["o_orderstatus"], "aggregates": [_COUNT, {"fn": "max", "column": "price", "alias": "top"}], "orderBy": [{"column": "o_orderstatus"}]},
        f"SELECT o_orderstatus, count(*)::BIGINT AS n, coalesce(max(price), 0.0) AS top FROM {_NULLS} WHERE {_sql} GROUP BY 1 ORDER BY 1 LIMIT 100",
        _some_null,
    )

_plan(
    "plan_count_distinct_nulls",
    "orders",
    {"aggregates": [_COUNT, {"fn": "count", "column": "prio", "alias": "n_prio"}, {"fn": "count_distinct", "column": "prio", "alias": "kinds"}]},
    f"SELECT count(*)::BIGINT AS n, count(*)::BIGINT AS n_prio, (count(DISTINCT prio) + max((prio IS NULL)::INT))::BIGINT AS kinds FROM {_NULLS}",
    _some_null,
)
_plan(
    "plan_sum_empty_zero",
    "orders",
    {"filters": [_where("o_custkey", "lt", 0)], "aggregates": [_COUNT, *({"fn": f, "column": "price", "alias": f"{f}_price"} for f in ("sum", "avg", "min", "max"))]},
    "SELECT 0::BIGINT AS n, 0.0::DOUBLE AS sum_price, 0.0::DOUBLE AS avg_price, 0.0::DOUBLE AS min_price, 0.0::DOUBLE AS max_price",
    _some_null,
)
_plan(
    "plan_avg_min_max",
    "orders",
    {"groupBy": ["o_orderstatus", "prio"], "aggregates": [{"fn": f, "column": "price", "alias": f"{f}_price"} for f in ("avg", "min", "max")], "limit": 1000},
    f"SELECT o_orderstatus, prio, coalesce(avg(price), 0) AS avg_price, coalesce(min(price), 0) AS min_price, coalesce(max(price), 0) AS max_price FROM {_NULLS} GROUP BY ALL",
    _some_null,
)
_plan(
    "plan_text_prefix_numbers",
    "part",
    {"aggregates": [{"fn": "sum", "column": "txt", "alias": "total"}, {"fn": "max", "column": "txt", "alias": "top"}]},
    """SELECT sum(CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size::DOUBLE END) AS total,
              max(CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size::DOUBLE END) AS top FROM part""",
    lambda df: df.withColumn("txt", F.when(F.col("p_partkey") % 3 == 0, "none").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" units")))),
)
_plan(
    "plan_group_null_equals_empty",
    "part",
    {"groupBy": ["tag"], "aggregates": [_COUNT], "orderBy": [{"column": "n", "direction": "desc"}, {"column": "tag"}]},
    """WITH t AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN '' ELSE 'x' END AS tag FROM part)
       SELECT arg_min(coalesce(tag, '<null>'), p_partkey) AS shown, count(*)::BIGINT AS n FROM t GROUP BY coalesce(tag, '')""".replace(
        "SELECT arg_min(coalesce(tag, '<null>'), p_partkey) AS shown", "SELECT nullif(arg_min(coalesce(tag, '<null>'), p_partkey), '<null>') AS tag"
    ),
    lambda df: df.withColumn("tag", F.when(F.col("p_size") % 3 == 0, F.lit(None)).when(F.col("p_size") % 3 == 1, "").otherwise("x")),
    "p_partkey",
)
_plan(
    "plan_nulls_last_desc",
    "orders",
    {"groupBy": ["prio"], "aggregates": [_COUNT], "orderBy": [{"column": "prio", "direction": "desc"}], "limit": 5},
    f"SELECT prio, count(*)::BIGINT AS n FROM {_NULLS} GROUP BY 1 ORDER BY prio DESC NULLS LAST LIMIT 5",
    _some_null,
    "o_orderkey",
)
