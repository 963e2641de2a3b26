"""Problems of a whole feed, and the gate that keeps a red run from going on."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reportloom.spec import Source

PROBLEM_SCHEMA = (
    "source string, field string, rule string, level string, cnt bigint, sample string"
)


def problem_level(source: Source, rule: str) -> str:
    return source.problems.get(rule, "red")


def problem(source: str, rule: str, level: str, detail: str) -> tuple:
    """A problem has no field and no count."""
    return (source, "-", rule, level, 0, detail)


def problem_frame(spark, problems: list[tuple]) -> DataFrame:
    return spark.createDataFrame(problems, PROBLEM_SCHEMA)


def table_problems(statistics: DataFrame, source: Source) -> DataFrame:
    """Problems that follow from the row counts of a feed.

    `statistics` has one row: raw_rows, dropped, kept, unparsed. An empty file
    ends the checks; a feed without rows left ends them before the ratios.
    """
    raw, dropped = F.col("raw_rows"), F.col("dropped")
    kept, unparsed = F.col("kept"), F.col("unparsed")
    candidates = [
        (raw == 0, "empty_file", problem_level(source, "empty_file"), F.lit("no data rows")),
        (
            (raw > 0) & (kept == 0),
            "empty_after_clean",
            problem_level(source, "empty_after_clean"),
            F.concat(F.lit("no rows left of "), raw),
        ),
    ]
    for rule, count in (("row_drop_ratio", dropped), ("type_coerce_ratio", unparsed)):
        setting = source.problems.get(rule)
        if setting:
            share = count / raw
            candidates.append(
                (
                    (raw > 0) & (kept > 0) & (F.when(raw > 0, share) > F.lit(setting["max"])),
                    rule,
                    setting.get("level", "yellow"),
                    F.concat(count, F.lit(" of "), raw),
                )
            )
    rows = F.array(
        *[
            F.struct(
                hit.alias("hit"),
                F.lit(rule).alias("rule"),
                F.lit(level).alias("level"),
                detail.alias("sample"),
            )
            for hit, rule, level, detail in candidates
        ]
    )
    return (
        statistics.select(F.inline(rows))
        .where("hit")
        .select(
            F.lit(source.name).alias("source"),
            F.lit("-").alias("field"),
            "rule",
            "level",
            F.lit(0).cast("bigint").alias("cnt"),
            "sample",
        )
    )


def is_red(ledger: DataFrame) -> bool:
    """True when any row of the ledger is red; stops at the first one."""
    return not ledger.where(F.col("level") == "red").limit(1).isEmpty()
