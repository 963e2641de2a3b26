"""Answers to report queries: whitelisted filters, order, limit, options."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from reportloom.operators.marts import visible_columns
from reportloom.operators.membership import MEMBER, membership, rows_of, with_value
from reportloom.spec import ReportModel, SpecError

# The most rows that a page of a report can have.
LARGEST_LIMIT = 5000


def clamp_limit(limit: int) -> int:
    return max(1, min(int(limit), LARGEST_LIMIT))


def filter_names(model: ReportModel, key: str) -> list[str]:
    """Dimensions a report can be filtered by."""
    report = model.report(key)
    return list(dict.fromkeys((report.dimension, *report.filters, *report.own_dims)))


def distinct_values(df: DataFrame, column: Column, name: str) -> DataFrame:
    values = df.select(column.alias(name)).where(F.col(f"`{name}`").isNotNull()).distinct()
    return values.orderBy(F.asc_nulls_last(f"`{name}`"))


def _needs_pairs(key: str, name: str) -> SpecError:
    return SpecError(f"report {key}: filter {name} needs the wide table or the stored pairs")


def option_values(
    model: ReportModel,
    key: str,
    name: str,
    mart: DataFrame,
    wide_df: DataFrame | None = None,
    members: DataFrame | None = None,
) -> DataFrame:
    """Distinct values of one filter: from the mart, or, when the filter is no dimension of
    the mart, from the stored pairs (see membership) or else the wide table."""
    if name not in model.report(key).filters:
        return distinct_values(mart, F.col(f"`{name}`"), name)
    if members is not None:
        return distinct_values(rows_of(members, name), F.col(f"`{name}`"), name)
    if wide_df is None:
        raise _needs_pairs(key, name)
    return distinct_values(wide_df, F.col(model.dimension(name).column), name)


def _stacked_values(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Distinct values of several columns as text in one pass: dimension, value."""
    cells = [
        F.struct(F.lit(name).alias("dimension"), column.cast("string").alias("value"))
        for name, column in columns.items()
    ]
    return df.select(F.inline(F.array(*cells))).where(F.col("value").isNotNull()).distinct()


def filter_options(
    model: ReportModel,
    key: str,
    mart: DataFrame,
    wide_df: DataFrame | None = None,
    members: DataFrame | None = None,
) -> DataFrame:
    """All options of a report in long form, in order: dimension, value (text).

    One pass over the mart and one over the stored pairs, or else the wide table.
    """
    names = filter_names(model, key)
    own = [n for n in names if n not in model.report(key).filters]
    far = [n for n in names if n not in own]
    parts = [_stacked_values(mart, {n: F.col(f"`{n}`") for n in own})] if own else []
    if far and members is not None:
        parts.append(_stacked_values(members, {n: F.col(f"`{n}`") for n in far}))
    elif far:
        if wide_df is None:
            raise _needs_pairs(key, far[0])
        columns = {n: F.col(model.dimension(n).column) for n in far}
        parts.append(_stacked_values(wide_df, columns))
    return reduce(DataFrame.unionByName, parts).orderBy("dimension", "value")


def all_options(options: list[DataFrame]) -> DataFrame:
    """Options of several reports merged, each value once."""
    return reduce(DataFrame.unionByName, options).distinct()


def filter_report(
    model: ReportModel,
    key: str,
    mart: DataFrame,
    wide_df: DataFrame | None,
    filters: Mapping[str, object],
    members: DataFrame | None = None,
) -> DataFrame:
    """Keeps the groups that pass the filters.

    A filter on the report's own dimension compares its value. Any other declared
    filter keeps the groups that occur together with the value, by the stored pairs or
    else the wide table; their figures stay those of the whole group. A value that is no
    option of the whole report is ignored, an unknown dimension is an error.

    Whether a value is an option is decided within the plan, by subqueries, so nothing
    runs while the answer is built.
    """
    report = model.report(key)
    known = filter_names(model, key)
    group = F.col(f"`{report.dimension}`")
    whole = mart
    for name, value in filters.items():
        if name not in known:
            raise SpecError(f"report {key} cannot be filtered by {name}; it has {known}")
        if name not in report.filters:
            hits = with_value(whole, name, value)
            literal = F.lit(value if value is None else str(value))
            fits = F.col(f"`{name}`") == literal.try_cast(whole.schema[name].dataType)
        else:
            if members is None:
                if wide_df is None:
                    raise _needs_pairs(key, name)
                members = membership(model, key, wide_df)
            hits = with_value(rows_of(members, name), name, value)
            fits = group.isin(hits.select(MEMBER))
        mart = mart.where(fits | ~hits.exists())
    return mart


def query_report(
    model: ReportModel,
    key: str,
    mart: DataFrame,
    wide_df: DataFrame | None = None,
    filters: Mapping[str, object] | None = None,
    limit: int | None = None,
    members: DataFrame | None = None,
) -> DataFrame:
    """All rows of a report: newest period first, then by the second column.

    Filters by dimensions that the report does not show need its stored pairs (members, see
    membership) or the wide table. With a limit, one page of it: the first rows, between 1 and LARGEST_LIMIT. A page has
    a total order, by all further columns as well, so equal queries give equal pages.
    """
    report = model.report(key)
    mart = mart.select(*[f"`{c}`" for c in visible_columns(model, key)])
    rows = filter_report(model, key, mart, wide_df, filters or {}, members)
    order, rest = [], rows.columns
    if model.time_dimension(report) is not None:
        time = report.time_dim or report.dimension
        order = [F.desc_nulls_last(f"`{time}`"), F.asc_nulls_last(f"`{rows.columns[1]}`")]
        rest = [c for c in rows.columns if c not in (time, rows.columns[1])]
    if limit is None:
        return rows.orderBy(*order) if order else rows
    order += [F.asc_nulls_last(f"`{c}`") for c in rest]
    return rows.orderBy(*order).limit(clamp_limit(limit))


def json_safe(df: DataFrame) -> DataFrame:
    """Decimals as doubles, dates and midnight timestamps as YYYY-MM-DD."""
    out = []
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind.startswith("decimal"):
            column = column.cast("double")
        elif kind == "date":
            column = F.date_format(column, "yyyy-MM-dd")
        elif kind.startswith("timestamp"):
            midnight = F.date_format(column, "HH:mm:ss") == "00:00:00"
            column = F.when(midnight, F.date_format(column, "yyyy-MM-dd")).otherwise(
                F.date_format(column, "yyyy-MM-dd HH:mm:ss")
            )
        out.append(column.alias(name))
    return df.select(*out)


def stable_order(df: DataFrame, dims: list[str]) -> DataFrame:
    """Order of comparable answers: dimensions ascending, NULL last."""
    return df.orderBy(*[F.asc_nulls_last(f"`{d}`") for d in dims])


def pivot_report(
    mart: DataFrame, time: str, dimension: str, metric: str, values: list
) -> DataFrame:
    """Periods as rows and the declared dimension values as columns.

    A value that is not declared fails the job, NULL too, so nothing is left out in
    silence. Where values are not known beforehand, the report itself is the answer.
    """
    column = F.col(f"`{dimension}`")
    known = F.coalesce(column.isin(values), F.lit(False))
    unknown = F.raise_error(
        F.concat(F.lit(f"{dimension} has the undeclared value "), F.coalesce(column.cast("string"), F.lit("NULL")))
    )
    mart = mart.withColumn(
        dimension, F.when(known, column).otherwise(unknown.cast(mart.schema[dimension].dataType))
    )
    return mart.groupBy(F.col(f"`{time}`")).pivot(dimension, values).agg(F.first(f"`{metric}`"))
