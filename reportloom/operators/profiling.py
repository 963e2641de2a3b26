"""Profiles of unknown tables and suggestions how to join them.

Everything is read from one frequency table (column, value, n) that is counted in
a single pass and pre-aggregated before its shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from reportloom.functions.scalars import as_date, as_number, strip_text

SAMPLES = 3
SAMPLE_LENGTH = 30
ENUM_LIMIT = 12
TYPE_SHARE = 0.9
KEY_MINIMUM = 3
DATE_FORMATS = ("yyyy/M/d",)
# Only full dates count: codes such as 12-3 would otherwise pass for dates.
DATE_SHAPE = r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}"

# Words in a table's name that mark it as a fact table.
FACT_WORDS = (
    "流水", "台账", "账单", "订单", "明细", "快照", "回款", "工时",
    "order", "ledger", "bill", "payment", "sales", "purchase", "stock",
    "snapshot", "flow", "transaction", "fact",
)


def value_frequencies(df: DataFrame) -> DataFrame:
    """How often every value of every column occurs: column_name, value, n."""
    cells = F.array(
        *[
            F.struct(
                F.lit(name).alias("column_name"),
                strip_text(F.col(f"`{name}`").cast("string")).alias("value"),
            )
            for name in df.columns
        ]
    )
    return (
        df.select(F.inline(cells))
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def profile(df: DataFrame) -> DataFrame:
    """One row per column: rows, null_pct, distinct_count, type, likely_key, samples,
    likely_enum, min_value, max_value."""
    freq = value_frequencies(df)
    number = as_number(F.regexp_replace("value", ",", ""))
    present = F.col("value").isNotNull()
    dated = F.when(F.col("value").rlike(DATE_SHAPE), as_date(F.col("value"), DATE_FORMATS))
    stats = freq.groupBy("column_name").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(present, F.col("n")).otherwise(0)).alias("non_null"),
        F.count("value").alias("distinct_count"),
        F.sum(F.when(number.isNotNull(), F.col("n")).otherwise(0)).alias("numbers"),
        F.sum(F.when(dated.isNotNull(), F.col("n")).otherwise(0)).alias("dates"),
        F.min(number).alias("low"),
        F.max(number).alias("high"),
    )
    # n is part of the order, and NULL goes last instead of being filtered, only to keep
    # both branches on the same shuffle. Lists leave NULL out.
    first = Window.partitionBy("column_name").orderBy(F.asc_nulls_last("value"), "n")
    firsts = (
        freq.withColumn("place", F.row_number().over(first))
        .where(F.col("place") <= ENUM_LIMIT)
        .groupBy("column_name")
        .agg(F.array_sort(F.collect_list("value")).alias("firsts"))
    )
    kind = inferred_type("numbers", "dates", "non_null")
    unique = (F.col("distinct_count") == F.col("non_null")) & (F.col("non_null") > 0)
    key = unique & ((F.col("type") != "string") | (F.col("non_null") >= KEY_MINIMUM))
    enum = (F.col("type") == "string") & F.col("distinct_count").between(1, ENUM_LIMIT)
    numeric = F.col("type") == "decimal"
    nulls = F.col("rows") - F.col("non_null")
    return (
        stats.join(firsts, "column_name", "left")
        .withColumn("type", kind)
        .select(
            "column_name",
            "type",
            F.col("rows").cast("bigint").alias("rows"),
            F.round(nulls.cast("double") / F.col("rows") * 100, 1).alias("null_pct"),
            F.col("distinct_count").cast("bigint").alias("distinct_count"),
            key.alias("likely_key"),
            F.transform(
                F.slice(F.coalesce("firsts", F.array().cast("array<string>")), 1, SAMPLES),
                lambda v: F.substring(v, 1, SAMPLE_LENGTH),
            ).alias("samples"),
            F.when(enum, F.col("firsts")).alias("likely_enum"),
            F.when(numeric, F.round(F.col("low").cast("double"), 4)).alias("min_value"),
            F.when(numeric, F.round(F.col("high").cast("double"), 4)).alias("max_value"),
        )
    )


def inferred_type(numbers: str, dates: str, non_null: str):
    """Type that more than nine tenths of all values have. Numbers are tried before
    dates, since an amount such as 8950 also reads as a year."""
    total = F.nullif(F.col(non_null).cast("double"), F.lit(0.0))
    return (
        F.when(F.col(numbers) / total > TYPE_SHARE, "decimal")
        .when(F.col(dates) / total > TYPE_SHARE, "date")
        .otherwise("string")
    )


def profile_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Profiles of several tables in one table with a leading `table_name`."""
    parts = [
        profile(df).select(F.lit(name).alias("table_name"), "*") for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table: table_name, rows."""
    parts = [
        df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows"))
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def guess_entities(sizes: DataFrame) -> DataFrame:
    """fact or dim per table: by words in its name, else the largest table (among
    equals the first by name) is the fact. `sizes` has table_name and rows, one row
    per table, so the list of all tables is small and is gathered once."""
    named = F.lower("table_name").rlike("|".join(FACT_WORDS))
    listed = sizes.agg(
        F.collect_list(F.struct("table_name", "rows", named.alias("named"))).alias("tables"),
        F.max(named).alias("any_named"),
        F.min_by("table_name", F.struct(-F.col("rows"), F.col("table_name"))).alias("largest"),
    )
    fact = F.when(F.col("any_named"), F.col("named")).otherwise(
        F.col("table_name") == F.col("largest")
    )
    return listed.select("any_named", "largest", F.inline("tables")).select(
        "table_name", "rows", F.when(fact, "fact").otherwise("dim").alias("entity")
    )


def suggest_joins(profiles: DataFrame, entities: DataFrame) -> DataFrame:
    """Fact columns named like the likely key of a dimension: fact, column_name, dim.
    Both sides come from one reading of the profiles, whose size is that of the
    catalogue, not of the data."""
    known = profiles.select("table_name", "column_name", "likely_key").join(
        entities.select("table_name", "entity"), "table_name"
    )
    is_fact = F.col("entity") == "fact"
    key_of_dim = (F.col("entity") == "dim") & F.col("likely_key")
    shared = known.groupBy("column_name").agg(
        F.collect_list(F.when(is_fact, F.col("table_name"))).alias("facts"),
        F.collect_list(F.when(key_of_dim, F.col("table_name"))).alias("dims"),
    )
    pairs = shared.select("column_name", "dims", F.explode("facts").alias("fact"))
    return pairs.select("fact", "column_name", F.explode("dims").alias("dim"))


def profile_summary(entities: DataFrame) -> DataFrame:
    """Number of files, facts, dimensions and rows."""
    return entities.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("entity") == "fact").alias("facts"),
        F.count_if(F.col("entity") == "dim").alias("dims"),
        F.sum("rows").cast("bigint").alias("total_rows"),
    )
