"""Metrics: named aggregate expressions that know their input columns.

A metric is *additive* when its group values may be summed into coarser groups.
A *ratio* is rebuilt from the sums of its parts at every level. Derived metrics
add and subtract other additive metrics. A metric may count *distinct* keys; a layer then
hands the keys on as a state that coarser layers merge.

A metric is built from aggregates that a provider makes, so that the same declaration can
be computed in one step (`Direct`) or in two (`TwoLevel`).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from reportloom.functions.scalars import safe_ratio


class MetricError(ValueError):
    """A metric is declared inconsistently."""


# How a layer hands on the keys of a distinct count: as rows, as bitmaps of whole-number
# keys (compact where numbers lie close together), or as HyperLogLog sketches (estimates).
STATES = ("keys", "bitmap", "sketch")


@dataclass(frozen=True)
class Distinct:
    """What a distinct count counts, and the state that it has between layers."""

    column: str
    where: str | None = None
    state: str = "keys"

    def __post_init__(self) -> None:
        if self.state not in STATES:
            raise MetricError(f"unknown state {self.state} of a distinct count")

    @property
    def key(self) -> Column:
        """The counted key, NULL where the row does not count."""
        key = F.col(f"`{self.column}`")
        return key if self.where is None else F.when(F.expr(self.where), key)


class Direct:
    """Aggregates of Spark as they are."""

    def sum(self, column: str) -> Column:
        return F.sum(column)

    def count(self, column: str | None = None) -> Column:
        return F.count(F.lit(1) if column is None else F.col(column))

    def min(self, column: str) -> Column:
        return F.min(column)

    def max(self, column: str) -> Column:
        return F.max(column)

    def distinct(self, what: Distinct, approximate: bool = False) -> Column:
        return F.approx_count_distinct(what.key) if approximate else F.count_distinct(what.key)

    def expression(self, sql: str) -> Column:
        return F.expr(sql)


class NotDecomposable(Exception):
    """A metric that cannot be computed in two steps."""


class TwoLevel(Direct):
    """Aggregates over groups of (dimensions, key), to be aggregated again per dimensions.

    Several distinct counts of one key then are counts of flags in one row per key, where
    Spark would multiply every row by their number. `inner` holds the aggregates of the
    first step; `types`, once they are known, keep sums in the type of one step.
    """

    def __init__(self, types: Mapping[str, str] | None = None) -> None:
        self.inner: dict[str, Column] = {}
        self.keys: set[str] = set()
        self.counts: set[Distinct] = set()
        self.types = types or {}

    def _again(self, name: str, inner: Column, outer: Callable[[str], Column]) -> Column:
        self.inner[name] = inner
        result = outer(name)
        return result.cast(self.types[name]) if name in self.types else result

    def sum(self, column: str) -> Column:
        return self._again(f"__sum_{column}", F.sum(column), F.sum)

    def count(self, column: str | None = None) -> Column:
        counted = Direct().count(column)
        return self._again(f"__count_{column or ''}", counted, F.sum)

    def min(self, column: str) -> Column:
        return self._again(f"__min_{column}", F.min(column), F.min)

    def max(self, column: str) -> Column:
        return self._again(f"__max_{column}", F.max(column), F.max)

    def distinct(self, what: Distinct, approximate: bool = False) -> Column:
        if approximate:
            raise NotDecomposable
        self.keys.add(what.column)
        self.counts.add(what)
        name = f"__any_{len(self.inner)}"
        self.inner[name] = F.max(what.key.isNotNull())
        return F.count_if(name)

    def expression(self, sql: str) -> Column:
        raise NotDecomposable


Build = Callable[[Direct], Column]


@dataclass(frozen=True)
class Metric:
    name: str
    make: Build | None
    inputs: tuple[str, ...] = ()
    additive: bool = False
    ratio: bool = False
    add: tuple[str, ...] = ()
    sub: tuple[str, ...] = ()
    distinct: Distinct | None = None

    @property
    def derived(self) -> bool:
        return self.make is None

    def column(self, aggregates: Direct | None = None) -> Column:
        return self.make(aggregates or Direct()).alias(self.name)


def _signed_sum(by: Direct, plus: tuple[str, ...], minus: tuple[str, ...]) -> Column:
    if not plus and not minus:
        raise MetricError("a sum needs at least one column")
    total = None
    for name in plus:
        total = by.sum(name) if total is None else total + by.sum(name)
    for name in minus:
        total = -by.sum(name) if total is None else total - by.sum(name)
    return total


def total(name: str, column: str) -> Metric:
    return Metric(name, lambda by: by.sum(column), (column,), additive=True)


def difference(name: str, plus: tuple[str, ...], minus: tuple[str, ...]) -> Metric:
    return Metric(name, lambda by: _signed_sum(by, plus, minus), (*plus, *minus), additive=True)


def row_count(name: str) -> Metric:
    return Metric(name, lambda by: by.count())


def distinct_count(
    name: str,
    column: str,
    where: str | None = None,
    where_inputs: tuple[str, ...] = (),
    approximate: bool = False,
    state: str = "keys",
) -> Metric:
    """Number of distinct values, optionally only of rows that meet a condition.

    Exact unless `approximate` is asked for. In a layered report the values are handed on
    as `state`; "sketch" makes the layers above estimates.
    """
    what = Distinct(column, where, state)
    return Metric(
        name,
        lambda by: by.distinct(what, approximate),
        (column, *where_inputs),
        distinct=None if approximate else what,
    )


def ratio(
    name: str,
    over: tuple[str, ...],
    under: tuple[str, ...],
    over_minus: tuple[str, ...] = (),
    under_minus: tuple[str, ...] = (),
    digits: int = 4,
) -> Metric:
    """Quotient of two sums of columns, NULL where the lower sum is zero."""
    return Metric(
        name,
        lambda by: safe_ratio(
            _signed_sum(by, over, over_minus), _signed_sum(by, under, under_minus), digits
        ),
        (*over, *over_minus, *under, *under_minus),
        ratio=True,
    )


def per_distinct(
    name: str,
    column: str,
    distinct: str,
    where: str | None = None,
    where_inputs: tuple[str, ...] = (),
    digits: int = 2,
) -> Metric:
    """Sum of a column per distinct value of another one."""
    what = Distinct(distinct, where)
    return Metric(
        name,
        lambda by: safe_ratio(by.sum(column), by.distinct(what), digits),
        (column, distinct, *where_inputs),
    )


def minimum(name: str, column: str) -> Metric:
    return Metric(name, lambda by: by.min(column), (column,))


def maximum(name: str, column: str) -> Metric:
    return Metric(name, lambda by: by.max(column), (column,))


def average(name: str, column: str, digits: int = 4) -> Metric:
    """Mean as exact sum over count, so that it does not depend on the row order."""
    return Metric(name, lambda by: safe_ratio(by.sum(column), by.count(column), digits), (column,))


def expression(
    name: str,
    sql: str,
    inputs: tuple[str, ...],
    additive: bool = False,
    ratio: bool = False,
) -> Metric:
    """Any aggregate written as a Spark SQL expression."""
    if ratio and "/" not in sql:
        raise MetricError(f"metric {name} is declared a ratio but does not divide")
    if ratio and additive:
        raise MetricError(f"metric {name} cannot be both additive and a ratio")
    return Metric(name, lambda by: by.expression(sql), inputs, additive=additive, ratio=ratio)


def derived(name: str, add: tuple[str, ...] = (), sub: tuple[str, ...] = ()) -> Metric:
    """Sum and difference of other metrics."""
    if not add and not sub:
        raise MetricError(f"derived metric {name} is empty")
    return Metric(name, None, additive=True, add=add, sub=sub)


def resolve(name: str, metrics: Mapping[str, Metric], path: tuple[str, ...] = ()) -> Metric:
    """The metric with all its derived parts folded into one expression."""
    metric = metrics[name]
    if not metric.derived:
        return metric
    if name in path:
        raise MetricError("derived metrics form a cycle: " + " -> ".join((*path, name)))
    parts: list[tuple[bool, Metric]] = []
    for positive, names in ((True, metric.add), (False, metric.sub)):
        for part_name in names:
            if part_name not in metrics:
                raise MetricError(f"metric {name} refers to unknown metric {part_name}")
            part = resolve(part_name, metrics, (*path, name))
            if not part.additive:
                raise MetricError(f"metric {name} cannot add {part_name}: it is not additive")
            parts.append((positive, part))

    def make(by: Direct) -> Column:
        whole = None
        for positive, part in parts:
            value = part.make(by)
            if whole is None:
                whole = value if positive else -value
            else:
                whole = whole + value if positive else whole - value
        return whole

    inputs = tuple(dict.fromkeys(c for _, part in parts for c in part.inputs))
    return Metric(name, make, inputs, additive=True)
