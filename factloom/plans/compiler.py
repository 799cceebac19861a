"""Compiles a `TablePlan` into one lazy DataFrame.

The semantics that differ from plain SQL, all expressed with built-in columns:
comparisons match only numbers; `neq` keeps null rows; `count` counts rows;
`count_distinct` counts null once; sum, avg, min and max of nothing are 0; null
and '' share a group, as do 1 and '1', shown by their first row's value; nulls
sort last in both directions and ties keep first-appearance order.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.numbers import parse_float_prefix
from factloom.plans.contract import Aggregate, Filter, TablePlan

ROW = "_row_idx"


def _type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType if name in df.columns else T.NullType()


def _kind(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "number"
    return "boolean" if isinstance(t, T.BooleanType) else "string" if isinstance(t, T.StringType) else "other"


def _kind_of_value(v) -> str:
    return "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string"


def _col(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`") if name in df.columns else F.lit(None)


def predicate(df: DataFrame, f: Filter) -> Column:
    """The filter as a boolean column that is never null; a column that the table lacks counts as null."""
    c, kind = _col(df, f.column), _kind(_type_of(df, f.column))
    if f.op == "is_null":
        return c.isNull()
    if f.op == "not_null":
        return c.isNotNull()
    if f.op == "in":
        same = [v for v in f.value if _kind_of_value(v) == kind]
        return F.coalesce(c.isin(same), F.lit(False)) if same else F.lit(False)
    typed = _kind_of_value(f.value) == kind
    if f.op == "eq":
        return F.coalesce(c == F.lit(f.value), F.lit(False)) if typed else F.lit(False)
    if f.op == "neq":
        return ~c.eqNullSafe(F.lit(f.value)) if typed else F.lit(True)
    if f.op == "contains":
        if not (typed and kind == "string"):
            return F.lit(False)
        return F.coalesce(F.contains(F.lower(c), F.lit(f.value.lower())), F.lit(False))
    if not (typed and kind == "number"):
        return F.lit(False)
    v = F.lit(f.value)
    return F.coalesce({"gt": c > v, "gte": c >= v, "lt": c < v, "lte": c <= v}[f.op], F.lit(False))


def _number(df: DataFrame, name: str) -> Column:
    kind = _kind(_type_of(df, name))
    if kind == "number":
        return _col(df, name).cast("double")
    return parse_float_prefix(_col(df, name)) if kind == "string" else F.lit(None).cast("double")


def aggregate(df: DataFrame, a: Aggregate) -> Column:
    if a.fn == "count":
        return F.count(F.lit(1))
    if a.fn == "count_distinct":
        c = _col(df, a.column)
        return F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("bigint")), F.lit(0))
    return F.coalesce(getattr(F, a.fn)(_number(df, a.column)), F.lit(0.0))


def _out_order(out: DataFrame, plan: TablePlan) -> list[Column]:
    keys = [o for o in plan.order_by if o.column in out.columns]
    return [F.col(f"`{o.column}`").desc_nulls_last() if o.direction == "desc" else F.col(f"`{o.column}`").asc_nulls_last() for o in keys]


def compile_plan(df: DataFrame, plan: TablePlan, row_index: str | None = None) -> DataFrame:
    """The plan over `df`. `row_index` names a column that gives the input order; it decides the
    first-seen key value and ties. Without it the order is that of the group keys."""
    kept = df.filter(reduce(and_, [predicate(df, f) for f in plan.filters], F.lit(True))) if plan.filters else df
    aggs = [aggregate(df, a).alias(a.alias) for a in plan.aggregates]
    if not plan.group_by:
        return kept.agg(*aggs).limit(plan.limit)
    keys = {f"_k{i}": F.coalesce(_col(df, k).cast("string"), F.lit("")) for i, k in enumerate(plan.group_by)}
    order = F.col(f"`{row_index}`") if row_index else F.struct(*[_col(df, k) for k in plan.group_by])
    shown = [F.min_by(_col(df, k), order).alias(k) for k in plan.group_by]
    grouped = kept.groupBy(*[v.alias(k) for k, v in keys.items()]).agg(*shown, *aggs, F.min(order).alias(ROW))
    by = _out_order(grouped, plan)
    return grouped.orderBy(*by, F.col(ROW)).limit(plan.limit).select(*plan.group_by, *[a.alias for a in plan.aggregates])
