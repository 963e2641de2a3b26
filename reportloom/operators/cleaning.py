"""Ordered cleaning steps on an all-text feed, then renaming to declared columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from reportloom.functions.scalars import strip_text
from reportloom.spec import Source, SpecError

PROVENANCE = ("_source_file", "_loaded_at")


def trim_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def strip_strings(df: DataFrame) -> DataFrame:
    texts = {name for name, kind in df.dtypes if kind == "string"}
    return df.select(
        *[strip_text(df[f"`{c}`"]).alias(c) if c in texts else df[f"`{c}`"] for c in df.columns]
    )


def drop_rows_if(df: DataFrame, col: str, op: str) -> DataFrame:
    """Rows whose column is NULL are dropped; a missing column is no error."""
    if op != "is_null":
        raise SpecError(f"drop_rows_if: unknown condition {op}")
    return df.where(df[f"`{col}`"].isNotNull()) if col in df.columns else df


def skip_first_rows(df: DataFrame, count: int) -> DataFrame:
    """Drops the first rows of every file that the table is read from.

    Within a file, blocks follow each other and row ids grow within a block. The rows to
    drop are ranked per file, of which each task hands on `count` at most, and taken out
    by an anti-join on the row ids.
    """
    if count <= 0:
        return df
    numbered = df.select(
        "*",
        F.input_file_name().alias("__file"),
        F.expr("input_file_block_start()").alias("__block"),
        F.monotonically_increasing_id().alias("__row"),
    )
    by_place = Window.partitionBy("__file").orderBy("__block", "__row")
    first = (
        numbered.select("__file", "__block", "__row")
        .withColumn("__rank", F.row_number().over(by_place))
        .where(F.col("__rank") <= count)
        .select("__row")
    )
    return numbered.join(first, "__row", "left_anti").drop("__file", "__block", "__row")


def clean(df: DataFrame, steps: tuple) -> DataFrame:
    for step in steps:
        name, arg = (step, {}) if isinstance(step, str) else next(iter(step.items()))
        if name == "trim_columns":
            df = trim_columns(df)
        elif name == "strip_strings":
            df = strip_strings(df)
        elif name == "drop_rows_if":
            df = drop_rows_if(df, **arg)
        else:
            raise SpecError(f"unknown cleaning step {name}")
    return df


def missing_headers(df: DataFrame, source: Source) -> list[str]:
    present = set(df.columns)
    return [f.header for f in source.fields if f.header not in present]


def select_declared(df: DataFrame, source: Source) -> DataFrame:
    """Declared columns under their model names; other columns are left behind."""
    absent = missing_headers(df, source)
    if absent:
        raise SpecError(f"source {source.name}: headers {absent} are missing")
    kept = [f"`{c}`" for c in PROVENANCE if c in df.columns]
    return df.selectExpr(*[f"`{f.header}` as `{f.name}`" for f in source.fields], *kept)
