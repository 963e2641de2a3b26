"""Reports as tables: dimensions x metrics, directly from the wide table or from
the report below."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from reportloom.functions.metrics import Metric, NotDecomposable, TwoLevel
from reportloom.functions.scalars import null_safe_all, period_of
from reportloom.spec import Dimension, ReportModel


def period_start(day: dt.date, grain: str) -> dt.date:
    """First day of the period that contains the given day."""
    if grain == "week":
        return day - dt.timedelta(days=day.weekday())
    if grain == "month":
        return day.replace(day=1)
    if grain == "quarter":
        return day.replace(month=day.month - (day.month - 1) % 3, day=1)
    if grain == "year":
        return day.replace(month=1, day=1)
    return day


def full_periods(df: DataFrame, dimension: Dimension, as_of: dt.date) -> DataFrame:
    """Rows of periods that had ended by `as_of`. The comparison is on the plain
    column, so it reaches the scan as a pushed filter."""
    return df.where(F.col(dimension.column) < F.lit(period_start(as_of, dimension.grain)))


def dimension_column(dimension: Dimension) -> Column:
    column = F.col(dimension.column)
    if dimension.is_time:
        column = period_of(column, dimension.grain)
    return column.alias(dimension.name)


def _grouped(
    below: DataFrame, groups: list[Column], metrics: list[Metric], carried: list[str]
) -> DataFrame:
    """Metrics per group. Several distinct counts of one key are computed in two steps."""
    direct = [m.column() for m in metrics] + [F.sum(f"`{c}`").alias(c) for c in carried]
    if not direct:
        return below.select(*groups).distinct()
    first = TwoLevel()
    try:
        for metric in metrics:
            metric.column(first)
        for column in carried:
            first.sum(column)
    except NotDecomposable:
        return below.groupBy(*groups).agg(*direct)
    if len(first.keys) != 1 or len(first.counts) < 2:
        return below.groupBy(*groups).agg(*direct)
    key = F.col(f"`{next(iter(first.keys))}`").alias("__key")
    inner = [column.alias(name) for name, column in first.inner.items()]
    names = [f"__group_{i}" for i in range(len(groups))]
    per_key = below.groupBy(*[g.alias(n) for g, n in zip(groups, names)], key).agg(*inner)
    kinds = {n: k for n, k in per_key.dtypes if n.startswith(("__sum_", "__count_"))}
    second = TwoLevel(kinds)
    finished = [m.column(second) for m in metrics]
    finished += [second.sum(c).alias(c) for c in carried]
    # The labels of the groups, which may be names of columns below as well.
    labels = below.limit(0).groupBy(*groups).agg(F.lit(1)).columns[: len(groups)]
    return (
        per_key.groupBy(*names)
        .agg(*finished)
        .withColumnsRenamed(dict(zip(names, labels)))
    )


def build_mart(
    model: ReportModel,
    key: str,
    below: DataFrame,
    as_of: dt.date | None = None,
    states: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """One report.

    `below` is the wide table, or the mart of the report's base. Group columns come
    first (time, dimension, those needed further up), then the metrics, then the
    additive columns that reports built on this one need for their own metrics. A
    layered report with distinct counts takes the `states` of its base, by metric.
    """
    report = model.report(key)
    below, groups = _groups(model, key, below, as_of)
    metrics = [model.metric(m) for m in report.metrics]
    kept = [m for m in metrics if m.distinct is None] if report.base else metrics
    mart = _grouped(below, groups, kept, model.carried(key))
    for metric in metrics:
        if metric not in kept:
            counts = count_state(merged_state(model, key, metric, (states or {})[metric.name]), model.group_dims(key), metric)
            same = null_safe_all("m", "s", model.group_dims(key))
            mart = mart.alias("m").join(counts.alias("s"), same, "left").select(
                "m.*", F.coalesce(f"s.`{metric.name}`", F.lit(0)).alias(metric.name)
            )
    order = [*model.group_dims(key), *report.metrics, *model.carried(key)]
    return mart.select(*[f"`{c}`" for c in order])


def _groups(
    model: ReportModel, key: str, below: DataFrame, as_of: dt.date | None
) -> tuple[DataFrame, list[Column]]:
    """The rows that a report takes in, and what it groups them by."""
    report = model.report(key)
    names = model.group_dims(key)
    if report.base:
        return below, [F.col(f"`{n}`") for n in names]
    time = model.time_dimension(report)
    if report.full_period_only and time is not None:
        below = full_periods(below, time, as_of or dt.date.today())
    return below, [dimension_column(model.dimension(n)) for n in names]


# -- states of distinct counts -----------------------------------------------
def first_state(
    model: ReportModel, key: str, metric: Metric, below: DataFrame, as_of: dt.date | None = None
) -> DataFrame:
    """What the lowest layer hands on of a distinct count: its dimensions, and per group
    the different keys, or bitmaps of them by bucket, or one sketch.

    A bitmap is one number of 64 bits, so a group with few keys is no larger than they
    are, and bitmaps are merged without sorting."""
    below, groups = _groups(model, key, below, as_of)
    what = metric.distinct
    rows = below.select(*groups, what.key.alias("__key")).where(F.col("__key").isNotNull())
    dims = [F.col(f"`{n}`") for n in model.group_dims(key)]
    if what.state == "keys":
        return rows.distinct()
    if what.state == "sketch":
        return rows.groupBy(*dims).agg(F.hll_sketch_agg("__key").alias("__state"))
    number = F.col("__key").cast("bigint")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), number.bitwiseAND(63).cast("int"))
    return rows.groupBy(*dims, F.shiftright(number, 6).alias("__bucket")).agg(
        F.bit_or(bit).alias("__state")
    )


def merged_state(model: ReportModel, key: str, metric: Metric, state: DataFrame) -> DataFrame:
    """The state of the layer below in the coarser groups of a report."""
    dims = [F.col(f"`{n}`") for n in model.group_dims(key)]
    kind = metric.distinct.state
    if kind == "keys":
        return state.select(*dims, "__key").distinct()
    if kind == "sketch":
        return state.groupBy(*dims).agg(F.hll_union_agg("__state").alias("__state"))
    return state.groupBy(*dims, "__bucket").agg(F.bit_or("__state").alias("__state"))


def count_state(state: DataFrame, dims: list[str], metric: Metric) -> DataFrame:
    """The dimensions and the distinct count of each group that has a key."""
    count = {
        "keys": lambda: F.count(F.lit(1)),
        "bitmap": lambda: F.sum(F.bit_count("__state")),
        "sketch": lambda: F.sum(F.hll_sketch_estimate("__state")),
    }[metric.distinct.state]()
    return state.groupBy(*[F.col(f"`{d}`") for d in dims]).agg(count.alias(metric.name))


def build_states(
    model: ReportModel,
    key: str,
    below: DataFrame,
    states: Mapping[str, DataFrame],
    as_of: dt.date | None = None,
) -> dict[str, DataFrame]:
    """The states that a report hands on to the reports built on it, by metric."""
    base = model.report(key).base
    return {
        name: merged_state(model, key, model.metric(name), states[name])
        if base
        else first_state(model, key, model.metric(name), below, as_of)
        for name in model.handed_on(key)
    }


def build_stack(
    model: ReportModel, key: str, wide_df: DataFrame, as_of: dt.date | None = None
) -> DataFrame:
    """A layered report with every layer beneath it, as one lazy plan."""
    return _stacked(model, key, wide_df, as_of)[0]


def _stacked(model: ReportModel, key: str, wide_df: DataFrame, as_of: dt.date | None):
    report = model.report(key)
    below, states = (
        _stacked(model, report.base, wide_df, as_of) if report.base else (wide_df, {})
    )
    mart = build_mart(model, key, below, as_of, states)
    return mart, build_states(model, key, below, states, as_of)


def visible_columns(model: ReportModel, key: str) -> list[str]:
    """Columns of a report that a reader sees; carried ones are internal."""
    return [*model.group_dims(key), *model.report(key).metrics]
