"""Change between periods and rankings, computed on finished reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

CHART_ROWS = 15


def change(current: Column, previous: Column, ratio: bool) -> Column:
    """Difference for ratios, relative change for volumes; NULL without a base."""
    base = F.nullif(previous.cast("double"), F.lit(0.0))
    now = current.cast("double")
    return now - base if ratio else now / base - F.lit(1.0)


def latest_and_previous(mart: DataFrame, time: str, metrics: dict[str, bool]) -> DataFrame:
    """Last period of a report without further dimensions, the one before and the
    change: metric, period, current, previous, change. `metrics` tells for every
    metric whether it is a ratio. A period with several rows fails the job: such a
    report has further dimensions and must be aggregated first.

    Each task hands on its two newest rows, so nothing is gathered in one place.
    """
    newest = (
        mart.where(F.col(f"`{time}`").isNotNull())
        .orderBy(F.desc_nulls_last(f"`{time}`"))
        .limit(2)
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(F.col(f"`{time}`").alias("period"), *[f"`{m}`" for m in metrics])
                )
            ).alias("rows")
        )
        .where(F.size("rows") > 0)
        .withColumn(
            "rows",
            F.when(
                F.size(F.array_distinct(F.transform("rows", lambda r: r["period"])))
                == F.size("rows"),
                F.col("rows"),
            ).otherwise(F.raise_error(F.lit("a period has several rows"))),
        )
        .select(
            F.element_at("rows", -1).alias("current"),
            F.try_element_at("rows", F.when(F.size("rows") > 1, F.lit(1))).alias("previous"),
        )
    )
    cards = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.col("current.period").alias("period"),
                F.col(f"current.`{m}`").cast("double").alias("current_value"),
                F.col(f"previous.`{m}`").cast("double").alias("previous_value"),
                change(F.col(f"current.`{m}`"), F.col(f"previous.`{m}`"), ratio).alias("change"),
            )
            for m, ratio in metrics.items()
        ]
    )
    return newest.select(F.inline(cards))


def period_over_period(
    mart: DataFrame, time: str, dimensions: list[str], metrics: dict[str, bool]
) -> DataFrame:
    """Every row of a report beside the preceding period of the same group.

    dimensions: all that the report groups by besides the time, so that a period has one
    row per group. A window holds one group's periods, whose number the calendar bounds."""
    dims = [F.col(f"`{d}`") for d in dimensions]
    history = Window.partitionBy(*dims).orderBy(F.asc_nulls_first(f"`{time}`"))
    out = [F.col(f"`{time}`"), *dims]
    for m, ratio in metrics.items():
        now = F.col(f"`{m}`")
        before = F.lag(now).over(history)
        out += [
            now.alias(m),
            before.alias(f"{m}_prev"),
            change(now, before, ratio).alias(f"{m}_change"),
        ]
    return mart.select(*out)


def top_rows(
    mart: DataFrame, metric: str, dims: list[str], count: int = CHART_ROWS
) -> DataFrame:
    """The rows with the highest metric; ties go by the dimensions."""
    order = [F.desc_nulls_last(f"`{metric}`"), *[F.asc_nulls_last(f"`{d}`") for d in dims]]
    return mart.orderBy(*order).limit(count)
