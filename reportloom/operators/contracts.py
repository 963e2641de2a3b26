"""Field contracts: every rule is judged on the row as it arrived.

Counting needs one pass. Each row yields one record per broken rule, the records
are pre-aggregated to (rule, value, n) before the shuffle, so that a rule broken
by a third of all rows or by one repeated value stays cheap, and the count and
the sample of a rule are both read from that one frequency table. A sample keeps
the smallest few values by a group limit that is applied before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from reportloom.functions.scalars import (
    as_bool,
    as_date,
    as_integer,
    as_money,
    as_number,
)
from reportloom.spec import Field, Source

LEDGER = (
    "run_id string, ts timestamp, source string, field string, rule string, "
    "level string, cnt bigint, sample string"
)
SAMPLE_LENGTH = 200
SAMPLE_VALUES = 3
ENUM_SAMPLE_VALUES = 5


@dataclass(frozen=True)
class Rule:
    """One rule of one field: `broken` is never NULL."""

    field: str
    name: str
    level: str
    broken: Column
    value: Column
    keep: int = SAMPLE_VALUES


def typed(field: Field, column: Column | None = None) -> Column:
    """The text of a field as its declared type; NULL where it does not parse."""
    column = F.col(field.name) if column is None else column
    if field.type == "date":
        return as_date(column, field.date_formats)
    if field.type == "integer":
        return as_integer(column, field.strict_integer)
    if field.type == "decimal":
        return as_money(column)
    if field.type == "bool":
        return as_bool(column)
    return column


def field_rules(field: Field) -> list[Rule]:
    """All rules of a field that can be judged row by row."""
    column = F.col(field.name)
    text = column.cast("string")
    level = field.level
    rules = []
    if field.type in ("date", "integer", "decimal"):
        unparsed = column.isNotNull() & typed(field).isNull()
        rules.append(Rule(field.name, "type", level, unparsed, text))
    if field.required:
        rules.append(
            Rule(field.name, "required", level, column.isNull(), F.lit(None).cast("string"))
        )
    if field.range and field.type in ("integer", "decimal"):
        low, high = field.range
        outside = F.coalesce(~as_number(column).between(low, high), F.lit(False))
        rules.append(Rule(field.name, "range", level, outside, text))
    if field.enum:
        foreign = column.isNotNull() & ~column.isin(list(field.enum))
        rules.append(Rule(field.name, "enum", level, foreign, text, ENUM_SAMPLE_VALUES))
    if field.format:
        # Anchored at the start only: a value may go on after the pattern.
        unlike = column.isNotNull() & ~text.rlike(f"^(?:{field.format})")
        rules.append(Rule(field.name, "format", level, unlike, text))
    return rules


def row_rules(fields: tuple[Field, ...]) -> list[Rule]:
    return [rule for f in fields for rule in field_rules(f)]


def _unique_hits(df: DataFrame, field: Field, number: int) -> DataFrame:
    """Values that occur more than once, with all of their rows counted."""
    counted = df.groupBy(F.col(field.name).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    repeated = counted.where(F.col("n") > 1)
    if not field.nulls_equal:
        repeated = repeated.where(F.col("value").isNotNull())
    return repeated.select(F.lit(number).alias("rule_no"), "value", "n")


def _row_hits(df: DataFrame, rules: list[Rule]) -> DataFrame:
    marks = [
        F.when(r.broken, F.struct(F.lit(i).alias("rule_no"), r.value.alias("value")))
        for i, r in enumerate(rules)
    ]
    # Exploding the array with its NULLs and dropping them afterwards stays in one
    # generated loop, and the cleaning below is evaluated once per cell.
    hits = df.select(F.explode(F.array(*marks)).alias("hit")).where(F.col("hit").isNotNull())
    return hits.groupBy("hit.rule_no", "hit.value").agg(F.count(F.lit(1)).alias("n"))


def violations(df: DataFrame, source: Source) -> DataFrame:
    """One row per broken rule of the source: source, field, rule, level, cnt, sample."""
    rules = row_rules(source.fields)
    unique_fields = [f for f in source.fields if f.unique]
    names = [(r.field, r.name, r.level, r.keep) for r in rules]
    names += [(f.name, "unique", "red", SAMPLE_VALUES) for f in unique_fields]
    parts = [_row_hits(df, rules)] if rules else []
    parts += [_unique_hits(df, f, len(rules) + i) for i, f in enumerate(unique_fields)]
    if not parts:
        return df.sparkSession.createDataFrame([], _violation_schema())
    values = reduce(DataFrame.unionByName, parts)

    totals = values.groupBy("rule_no").agg(F.sum("n").alias("cnt"))
    # Ordering by n as well changes nothing, values being distinct within a rule.
    # It keeps n in this branch, so both branches read one shuffled table.
    order = Window.partitionBy("rule_no").orderBy("value", "n")
    firsts = values.withColumn("place", F.row_number().over(order)).where(
        F.col("place") <= ENUM_SAMPLE_VALUES
    )
    # A rule now has one total and at most five values, which are put side by side.
    nothing = F.lit(None).cast("struct<place:int,value:string>")
    merged = (
        totals.select("rule_no", "cnt", nothing.alias("first"))
        .unionByName(
            firsts.select(
                "rule_no",
                F.lit(0).cast("bigint").alias("cnt"),
                F.struct("place", "value").alias("first"),
            )
        )
        .groupBy("rule_no")
        .agg(F.sum("cnt").alias("cnt"), F.array_sort(F.collect_list("first")).alias("firsts"))
    )
    described = F.array(
        *[
            F.struct(
                F.lit(field).alias("field"),
                F.lit(rule).alias("rule"),
                F.lit(level).alias("level"),
                F.lit(keep).alias("keep"),
            )
            for field, rule, level, keep in names
        ]
    )
    about = described[F.col("rule_no")]
    shown = F.array_join(
        F.slice(F.col("firsts.value"), F.lit(1), about["keep"]), ", ", "NULL"
    )
    sample = F.when(
        about["rule"] == "required", F.lit("empty in a required column, rows dropped")
    ).otherwise(F.substring(shown, 1, SAMPLE_LENGTH))
    return merged.select(
        F.lit(source.name).alias("source"),
        about["field"].alias("field"),
        about["rule"].alias("rule"),
        about["level"].alias("level"),
        F.col("cnt").cast("bigint").alias("cnt"),
        sample.alias("sample"),
    )


def _violation_schema() -> str:
    return "source string, field string, rule string, level string, cnt bigint, sample string"


def row_statistics(fields: tuple[Field, ...]) -> list[Column]:
    """Aggregates over a cleaned feed: rows, rows dropped by `required`, rows kept,
    unparsable values. They fit `agg` and `observe`, so a write can collect them
    without a second pass."""
    required = [F.col(f.name).isNull() for f in fields if f.required]
    dropped = reduce(lambda a, b: a | b, required) if required else F.lit(False)
    unparsed = F.lit(0)
    for rule in row_rules(fields):
        if rule.name == "type":
            unparsed = unparsed + rule.broken.cast("int")
    return [
        F.count(F.lit(1)).alias("rows"),
        F.count_if(dropped).alias("dropped"),
        F.count_if(~dropped).alias("kept"),
        F.coalesce(F.sum(unparsed), F.lit(0)).cast("bigint").alias("unparsed"),
    ]


def rule_counts(fields: tuple[Field, ...]) -> list[tuple[Rule, Column]]:
    """One counting aggregate per row-level rule, for `agg` and `observe`."""
    return [
        (rule, F.count_if(rule.broken).alias(f"{rule.field}__{rule.name}"))
        for rule in row_rules(fields)
    ]


def accept(df: DataFrame, source: Source) -> DataFrame:
    """The feed after its contract: rows with an empty required field are dropped,
    values typed, and missing or unparsable values filled where a default exists."""
    extra = [c for c in df.columns if c not in {f.name for f in source.fields}]
    values = {f.name: with_default(f, typed(f)).alias(f.name) for f in source.fields}
    required = [f.name for f in source.fields if f.required]
    if not required:
        return df.select(*values.values(), *extra)
    # Required cells are cleaned and parsed in one place; as plain columns they would be
    # worked out again in every filter on them.
    present = reduce(Column.__and__, [F.col(n).isNotNull() for n in required])
    row = F.struct(present.alias("__present"), *[values[n] for n in required])
    others = [f.name for f in source.fields if not f.required]
    kept = df.select(*others, *extra, F.inline(F.array(row))).where("__present")
    return kept.select(
        *[f.name if f.required else values[f.name] for f in source.fields], *extra
    )


def with_default(field: Field, value: Column) -> Column:
    if field.default is None:
        return value
    return F.coalesce(value, F.lit(field.default).cast(sql_type(field)))


def sql_type(field: Field) -> str:
    return {
        "string": "string",
        "date": "date",
        "integer": "bigint",
        "decimal": "decimal(18,4)",
        "bool": "boolean",
    }[field.type]


def ledger_rows(found: DataFrame, run_id: str) -> DataFrame:
    """Violations or problems in the layout of the contract ledger."""
    return found.select(
        F.lit(run_id).alias("run_id"),
        F.current_timestamp().alias("ts"),
        "source",
        "field",
        "rule",
        "level",
        F.col("cnt").cast("bigint").alias("cnt"),
        F.substring("sample", 1, SAMPLE_LENGTH).alias("sample"),
    )
