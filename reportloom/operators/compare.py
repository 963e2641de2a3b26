"""Comparison of two tables: by key with tolerances, or as multisets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from reportloom.functions.scalars import null_safe_all

MONEY_TOLERANCE = 0.01
RATIO_TOLERANCE = 1e-6
# Buckets of a pruned comparison: a table of this many rows is broadcast at most.
BUCKETS = 1 << 16
ROUNDING_SLACK = 1e-9
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def month_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys as text, dates cut to their month, so that both sides write them alike."""
    kinds = dict(df.dtypes)

    def text(name: str) -> Column:
        column = F.col(f"`{name}`")
        if kinds[name] == "date" or kinds[name].startswith("timestamp"):
            return F.date_format(column, "yyyy-MM")
        plain = column.cast("string")
        dated = r"^(\d{4}-\d{2})-\d{2}"
        return F.when(plain.rlike(dated), F.substring(plain, 1, 7)).otherwise(plain)

    return df.select(*[text(c).alias(c) if c in keys else F.col(f"`{c}`") for c in df.columns])


def _one_row_per_key(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Row count and values per key. A key with several rows is reported as such and
    its values are not compared, so the minimum is the value wherever it matters."""
    return df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(
        F.count(F.lit(1)).alias("__rows"), *[F.min(f"`{v}`").alias(v) for v in values]
    )


def keyed_diff(
    expected: DataFrame,
    actual: DataFrame,
    keys: list[str],
    ratios: tuple[str, ...] = (),
) -> DataFrame:
    """Differences between two tables aligned on keys, NULL keys included.

    Columns: the keys, kind, column, expected, actual (text), diff. Kinds are
    missing_key, extra_key, inflation (one key, several rows), repeated_key (several
    expected rows, so that none can be held against the other side), null_mismatch,
    value, percent_literal (a ratio given as a percentage), and, with NULL keys,
    missing_column and extra_column. Rows are counted and reduced per key before the
    join, so repeated keys cannot multiply.
    """
    values = [c for c in expected.columns if c not in keys and c in actual.columns]
    numeric = {n for n, kind in expected.dtypes if kind.split("(")[0] in NUMERIC}
    numeric &= {n for n, kind in actual.dtypes if kind.split("(")[0] in NUMERIC}
    left = _one_row_per_key(expected, keys, values).alias("e")
    right = _one_row_per_key(actual, keys, values).alias("a")
    joined = left.join(right, null_safe_all("e", "a", keys), "full")

    absent, extra = F.col("a.__rows").isNull(), F.col("e.__rows").isNull()
    inflated = F.col("a.__rows") > 1
    key_kind = (
        F.when(absent, "missing_key")
        .when(extra, "extra_key")
        .when(inflated, "inflation")
        .when(F.col("e.__rows") > 1, "repeated_key")
    )
    findings = [_finding(key_kind, "-", None, None, None)]
    for v in values:
        want, got = F.col(f"e.`{v}`"), F.col(f"a.`{v}`")
        if v in numeric:
            kind, gap = _numeric_kind(want.cast("double"), got.cast("double"), v in ratios)
        else:
            kind = F.when(~want.cast("string").eqNullSafe(got.cast("string")), "value")
            gap = F.lit(None).cast("double")
        one_sided = want.isNull() != got.isNull()
        kind = F.when(key_kind.isNotNull() | (want.isNull() & got.isNull()), None).when(
            one_sided, "null_mismatch"
        ).otherwise(kind)
        findings.append(_finding(kind, v, want, got, F.when(~one_sided, gap)))
    shared = [F.coalesce(f"e.`{k}`", f"a.`{k}`").alias(k) for k in keys]
    found = joined.select(*shared, F.inline(F.array(*findings)))
    return found.where(F.col("kind").isNotNull()).unionByName(
        _column_findings(expected, actual, keys, found)
    )


def _column_findings(
    expected: DataFrame, actual: DataFrame, keys: list[str], like: DataFrame
) -> DataFrame:
    """A row for every column that only one side has."""
    sides = [(c, "missing_column") for c in expected.columns if c not in actual.columns]
    sides += [(c, "extra_column") for c in actual.columns if c not in expected.columns]
    rows = expected.sparkSession.createDataFrame(sides, "column string, kind string")
    empty = [F.lit(None).cast(like.schema[c].dataType).alias(c) for c in like.columns if c not in rows.columns]
    return rows.select("*", *empty).select(*like.columns)


def _finding(kind: Column, column: str, want, got, gap) -> Column:
    def or_null(value, kind_name: str) -> Column:
        return (F.lit(None) if value is None else value).cast(kind_name)

    return F.struct(
        kind.alias("kind"),
        F.lit(column).alias("column"),
        or_null(want, "string").alias("expected"),
        or_null(got, "string").alias("actual"),
        or_null(gap, "double").alias("diff"),
    )


def _numeric_kind(want: Column, got: Column, ratio: bool) -> tuple[Column, Column]:
    gap = F.round(got - want, 6)
    limit = (RATIO_TOLERANCE if ratio else MONEY_TOLERANCE) + ROUNDING_SLACK
    kind = F.when(F.abs(gap) > F.lit(limit), "value")
    if ratio:
        as_percent = (want != 0) & (F.abs(got - want * 100) <= F.lit(MONEY_TOLERANCE))
        kind = F.when(as_percent, "percent_literal").otherwise(kind)
    return kind, gap


def multiset_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that do not occur equally often on both sides, with both counts.
    One shuffle; equal rows are counted before it."""
    names = left.columns

    def tagged(df: DataFrame, is_left: int) -> DataFrame:
        return df.select(*[f"`{n}`" for n in names]).withColumn("__left", F.lit(is_left))

    both = reduce(DataFrame.unionByName, [tagged(left, 1), tagged(right, 0)])
    counted = both.groupBy(*[F.col(f"`{n}`") for n in names]).agg(
        F.sum("__left").alias("left_rows"), F.count(F.lit(1)).alias("__rows")
    )
    right_rows = F.col("__rows") - F.col("left_rows")
    return (
        counted.withColumn("right_rows", right_rows)
        .where(F.col("left_rows") != F.col("right_rows"))
        .drop("__rows")
    )


def _digests(df: DataFrame, names: list[str], buckets: int, prefix: str) -> DataFrame:
    """Rows and order-free digests per bucket of rows: sums of the halves of two hashes.
    A hash skips NULLs, so it also takes which columns are NULL."""
    columns = [F.col(f"`{n}`") for n in names]
    columns += [c.isNull() for c in columns]
    hashes = [F.xxhash64(F.lit(seed), *columns) for seed in (1, 2)]
    halves = [h for x in hashes for h in (F.shiftrightunsigned(x, 32), x.bitwiseAND(0xFFFFFFFF))]
    return df.groupBy(F.pmod(F.xxhash64(*columns), F.lit(buckets)).alias("__bucket")).agg(
        F.struct(F.count(F.lit(1)), *[F.sum(h) for h in halves]).alias(prefix)
    )


def pruned(
    left: DataFrame, right: DataFrame, buckets: int = BUCKETS
) -> tuple[DataFrame, DataFrame]:
    """Both tables without the rows of buckets whose digests agree.

    Rows are put into buckets by their hash. Only a count and digests per bucket are
    shuffled; where they agree on both sides, the rows are taken as equal (two different
    sets agree with a chance of about 2^-128). So tables that are equal but for a few rows
    are compared by those rows' buckets. The list of other buckets is broadcast: it has
    `buckets` rows at most. Each table is read twice.
    """
    names = left.columns
    both = _digests(left, names, buckets, "__of_left").join(
        _digests(right, names, buckets, "__of_right"), "__bucket", "full"
    )
    unequal = both.where(~F.col("__of_left").eqNullSafe(F.col("__of_right"))).select("__bucket")

    def kept(df: DataFrame) -> DataFrame:
        columns = [F.col(f"`{n}`") for n in names]
        own = F.pmod(F.xxhash64(*columns, *[c.isNull() for c in columns]), F.lit(buckets))
        rows = df.select(*columns, own.alias("__bucket"))
        return rows.join(F.broadcast(unequal), "__bucket", "left_semi").drop("__bucket")

    return kept(left), kept(right)


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Whether two tables have the same rows equally often; large tables can be pruned
    before."""
    return multiset_diff(left, right).limit(1).isEmpty()
