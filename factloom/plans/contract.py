"""The declarative table plan: filters, group keys, aggregates, order and limit, with its validator.

A plan is plain data (usually parsed from JSON). `parse_plan` checks it whole and
returns a frozen `TablePlan`; any breach raises `PlanError` with code
INVALID_QUERY_PLAN and the list of faults.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

# Fixed values of the plan contract.
FILTER_OPS = ("eq", "neq", "gt", "gte", "lt", "lte", "in", "contains", "is_null", "not_null")
AGGREGATE_FNS = ("count", "count_distinct", "sum", "avg", "min", "max")
MAX_FILTERS, MAX_GROUP_KEYS, MAX_AGGREGATES, MAX_ORDER_KEYS = 10, 3, 5, 3
DEFAULT_LIMIT, MAX_LIMIT, MAX_IN_VALUES = 100, 1000, 100

_ALIAS = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,63}")
_UNARY = ("is_null", "not_null")


class PlanError(ValueError):
    """A plan that breaks the contract; `faults` lists every breach."""

    code = "INVALID_QUERY_PLAN"

    def __init__(self, faults: Sequence[str]):
        self.faults = tuple(faults)
        super().__init__(f"{self.code}: " + "; ".join(faults))


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: Any = None


@dataclass(frozen=True)
class Aggregate:
    fn: str
    alias: str
    column: str | None = None


@dataclass(frozen=True)
class Order:
    column: str
    direction: str = "asc"


@dataclass(frozen=True)
class TablePlan:
    aggregates: tuple[Aggregate, ...]
    filters: tuple[Filter, ...] = ()
    group_by: tuple[str, ...] = ()
    order_by: tuple[Order, ...] = ()
    limit: int = DEFAULT_LIMIT
    version: int = field(default=1)


def _scalar(value: Any) -> bool:
    return isinstance(value, (str, int, float, bool))


def _filter_faults(i: int, f: Filter) -> list[str]:
    at = f"filters[{i}]"
    if f.op not in FILTER_OPS:
        return [f"{at}: unknown op {f.op!r}"]
    if f.op in _UNARY:
        return [f"{at}: {f.op} takes no value"] if f.value is not None else []
    if f.op == "in":
        ok = isinstance(f.value, (list, tuple)) and 1 <= len(f.value) <= MAX_IN_VALUES and all(map(_scalar, f.value))
        return [] if ok else [f"{at}: in takes 1 to {MAX_IN_VALUES} scalars"]
    return [] if _scalar(f.value) else [f"{at}: {f.op} takes one scalar"]


def faults_of(plan: TablePlan) -> list[str]:
    """Every breach of the contract, in a stable order; empty for a valid plan."""
    found = [] if plan.version == 1 else [f"version {plan.version} is not 1"]
    for name, items, low, high in (
        ("filters", plan.filters, 0, MAX_FILTERS),
        ("groupBy", plan.group_by, 0, MAX_GROUP_KEYS),
        ("aggregates", plan.aggregates, 1, MAX_AGGREGATES),
        ("orderBy", plan.order_by, 0, MAX_ORDER_KEYS),
    ):
        if not low <= len(items) <= high:
            found.append(f"{name} has {len(items)} entries, allowed {low} to {high}")
    for i, f in enumerate(plan.filters):
        found += _filter_faults(i, f)
    for i, a in enumerate(plan.aggregates):
        if a.fn not in AGGREGATE_FNS:
            found.append(f"aggregates[{i}]: unknown fn {a.fn!r}")
        elif a.fn != "count" and not a.column:
            found.append(f"aggregates[{i}]: {a.fn} needs a column")
        if not _ALIAS.fullmatch(a.alias or ""):
            found.append(f"aggregates[{i}]: alias {a.alias!r} is not an identifier")
    for i, o in enumerate(plan.order_by):
        if o.direction not in ("asc", "desc"):
            found.append(f"orderBy[{i}]: direction {o.direction!r}")
    if isinstance(plan.limit, bool) or not isinstance(plan.limit, int) or not 1 <= plan.limit <= MAX_LIMIT:
        found.append(f"limit {plan.limit!r} is not 1 to {MAX_LIMIT}")
    return found


def parse_plan(raw: Mapping[str, Any]) -> TablePlan:
    """A validated plan from its JSON form (keys version, filters, groupBy, aggregates, orderBy, limit)."""
    try:
        plan = TablePlan(
            version=raw.get("version", 1),
            filters=tuple(Filter(x["column"], x["op"], x.get("value")) for x in raw.get("filters") or ()),
            group_by=tuple(raw.get("groupBy") or ()),
            aggregates=tuple(Aggregate(x["fn"], x["alias"], x.get("column")) for x in raw.get("aggregates") or ()),
            order_by=tuple(Order(x["column"], x.get("direction", "asc")) for x in raw.get("orderBy") or ()),
            limit=raw.get("limit", DEFAULT_LIMIT),
        )
    except (KeyError, TypeError, AttributeError) as e:
        raise PlanError([f"malformed plan: {e!r}"]) from e
    if found := faults_of(plan):
        raise PlanError(found)
    return plan
