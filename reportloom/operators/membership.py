"""Which groups of a report occur together with which filter values.

A report can be filtered by dimensions that it does not show: such a filter keeps the
groups that occur with the value in the wide table. The pairs of a group and a value are
few, as both are dimensions, so they are found in one pass over the wide table and stored
beside the report. Answers then need the report and its pairs, never the wide table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reportloom.operators.marts import dimension_column
from reportloom.spec import ReportModel

MEMBER, FILTER = "__member", "__filter"
# Name of the stored pairs of a report in the layer of reports.
STORED = "{}.filter_members"


def membership(model: ReportModel, key: str, wide_df: DataFrame) -> DataFrame:
    """The pairs of one report: __member, __filter (its name) and a column per filter.

    Of the filter columns only that of the row's filter has a value, in its own type, so a
    question after one value is a pushed-down comparison. Values that are NULL are no
    options and have no row; groups that are NULL keep theirs, as their values are options.
    One shuffle, of pairs that are distinct within each task.
    """
    report = model.report(key)
    group = dimension_column(model.dimension(report.dimension)).alias(MEMBER)
    sources = {name: F.col(f"`{model.dimension(name).column}`") for name in report.filters}
    kinds = dict(zip(sources, wide_df.select(*sources.values()).schema))

    def row(name: str) -> Column:
        values = [
            (column if other == name else F.lit(None).cast(kinds[other].dataType)).alias(other)
            for other, column in sources.items()
        ]
        return F.struct(F.lit(name).alias(FILTER), *values)

    pairs = wide_df.select(group, F.inline(F.array(*[row(name) for name in sources])))
    present = F.coalesce(*[F.col(f"`{n}`").cast("string") for n in sources]).isNotNull()
    return pairs.where(present).distinct()


def rows_of(members: DataFrame, name: str) -> DataFrame:
    """The pairs of one filter."""
    return members.where(F.col(FILTER) == name)


def with_value(rows: DataFrame, name: str, value: object) -> DataFrame:
    """The rows whose column has the value, read in the column's type; text that is no
    value of that type fits no row."""
    kind = rows.schema[name].dataType
    literal = F.lit(value if value is None else str(value)).try_cast(kind)
    return rows.where(F.col(f"`{name}`") == literal)
