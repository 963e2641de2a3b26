"""Typed staging tables and the tests that run on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from reportloom.operators.contracts import sql_type
from reportloom.spec import Field, Source


INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def staged(field: Field, kind: str) -> str:
    """Cast of an ingested (already typed) column to its staging type, as a SQL
    expression: a table has many columns, and text is the quickest way to hand them
    over. A column that has its type already stays a plain column, so that filters on
    it reach the scan."""
    column, target = f"`{field.name}`", sql_type(field)
    if field.type == "string":
        cast = f"trim(cast({column} as string))"
    elif kind == target:
        cast = column
    elif field.type == "integer" and kind not in INTEGRAL:
        cast = f"try_cast(bround({column}, 0) as bigint)"
    else:
        cast = f"try_cast({column} as {target})"
    if field.default is not None:
        text = str(field.default).replace("\\", "\\\\").replace("'", "\\'")
        cast = f"coalesce({cast}, cast('{text}' as {target}))"
    return f"{cast} as {column}"


def stage(df: DataFrame, source: Source) -> DataFrame:
    """Typed projection; rows whose required values are absent or unusable go."""
    kinds = dict(df.dtypes)
    out = df.selectExpr(*[staged(f, kinds[f.name]) for f in source.fields])
    required = [f"`{f.name}` is not null" for f in source.fields if f.required]
    return out.where(" and ".join(required)) if required else out


def severity(level: str) -> str:
    return "error" if level == "red" else "warn"


def staging_tests(stage_df: DataFrame, source: Source) -> DataFrame:
    """Every declared staging test with its number of failures.

    Row tests share one pass over the table; a uniqueness test counts the keys
    that occur more than once and needs its own grouping. Columns: source, field,
    test, severity, failures.
    """
    tests: list[tuple[str, str, str, Column]] = []
    for f in source.fields:
        column = F.col(f.name)
        if f.required:
            tests.append((f.name, "not_null", "error", column.isNull()))
        if f.enum:
            foreign = column.isNotNull() & ~column.isin(list(f.enum))
            tests.append((f.name, "accepted_values", severity(f.level), foreign))
        if f.range and f.type in ("integer", "decimal"):
            low, high = f.range
            outside = F.coalesce((column < low) | (column > high), F.lit(False))
            tests.append((f.name, "range", severity(f.level), outside))
    parts = []
    if tests:
        counts = stage_df.agg(
            *[F.count_if(broken).alias(f"t{i}") for i, (_, _, _, broken) in enumerate(tests)]
        )
        rows = F.array(
            *[
                F.struct(
                    F.lit(field).alias("field"),
                    F.lit(test).alias("test"),
                    F.lit(sev).alias("severity"),
                    F.col(f"t{i}").alias("failures"),
                )
                for i, (field, test, sev, _) in enumerate(tests)
            ]
        )
        parts.append(counts.select(F.inline(rows)))
    for f in source.fields:
        if f.unique:
            parts.append(
                duplicate_keys(stage_df, f.name)
                .agg(F.count(F.lit(1)).alias("failures"))
                .select(
                    F.lit(f.name).alias("field"),
                    F.lit("unique").alias("test"),
                    F.lit("error").alias("severity"),
                    "failures",
                )
            )
    if not parts:
        return stage_df.sparkSession.createDataFrame(
            [], "source string, field string, test string, severity string, failures bigint"
        )
    return reduce(DataFrame.unionByName, parts).select(F.lit(source.name).alias("source"), "*")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Non-NULL keys that occur more than once, with their number of rows."""
    counted = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return counted.where(F.col("__n") > 1)
