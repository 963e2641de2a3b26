"""Conservation checks between the layers of a report, and against the source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from reportloom.functions.scalars import null_safe_all
from reportloom.spec import ReportModel

TOLERANCE = 0.01


def reconcile(
    model: ReportModel,
    child_key: str,
    parent: DataFrame,
    child: DataFrame,
    tolerance: float = TOLERANCE,
) -> DataFrame | None:
    """Rows in which a layer and the layer below it disagree.

    The parent is grouped to the child's dimensions with the child's own metrics.
    Both sides then hold one row per group, so the NULL-safe full outer join has
    no hot keys. Only additive metrics are compared. One join serves all metrics;
    the differences are unpivoted afterwards. None if there is nothing to compare.
    """
    report = model.report(child_key)
    parent_dims = set(model.group_dims(report.base))
    dims = [d for d in model.group_dims(child_key) if d in parent_dims]
    metrics = [m for m in report.metrics if model.metric(m).additive]
    if not dims or not metrics:
        return None
    lower = parent.groupBy(*[F.col(f"`{d}`") for d in dims]).agg(
        *[model.metric(m).column().alias(m) for m in metrics]
    )
    upper = child.select(*[F.col(f"`{c}`") for c in (*dims, *metrics)])
    joined = lower.alias("p").join(upper.alias("c"), null_safe_all("p", "c", dims), "full")
    pairs = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.col(f"p.`{m}`").cast("double").alias("parent_value"),
                F.col(f"c.`{m}`").cast("double").alias("child_value"),
            )
            for m in metrics
        ]
    )
    shared = [F.coalesce(f"p.`{d}`", f"c.`{d}`").alias(d) for d in dims]
    gap = F.coalesce("parent_value", F.lit(0.0)) - F.coalesce("child_value", F.lit(0.0))
    return (
        joined.select(*shared, F.inline(pairs))
        .where(F.abs(gap) > F.lit(tolerance))
        .select("metric", *[f"`{d}`" for d in dims], "parent_value", "child_value")
    )


def conserve_totals(
    model: ReportModel, key: str, mart: DataFrame, wide_df: DataFrame, tolerance: float = TOLERANCE
) -> DataFrame:
    """Grand total of every additive metric in a report and straight from the wide
    table: metric, mart_total, source_total, ok."""
    metrics = [m for m in model.report(key).metrics if model.metric(m).additive]

    def long_form(totals: DataFrame, side: str) -> DataFrame:
        pairs = F.array(
            *[
                F.struct(
                    F.lit(m).alias("metric"),
                    F.coalesce(F.col(f"`{m}`").cast("double"), F.lit(0.0)).alias("total"),
                )
                for m in metrics
            ]
        )
        return totals.select(F.lit(side).alias("side"), F.inline(pairs))

    from_mart = mart.agg(*[F.sum(f"`{m}`").alias(m) for m in metrics])
    from_wide = wide_df.agg(*[model.metric(m).column().alias(m) for m in metrics])
    both = reduce(
        DataFrame.unionByName, [long_form(from_mart, "mart"), long_form(from_wide, "source")]
    )
    totals = both.groupBy("metric").agg(
        F.max(F.when(F.col("side") == "mart", F.col("total"))).alias("mart_total"),
        F.max(F.when(F.col("side") == "source", F.col("total"))).alias("source_total"),
    )
    gap = F.abs(F.col("mart_total") - F.col("source_total"))
    return totals.withColumn("ok", gap <= F.lit(tolerance))
