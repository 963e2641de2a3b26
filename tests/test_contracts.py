from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from reportloom.functions import scalars
from reportloom.operators import cleaning, contracts, problems, staging
from reportloom.spec import Field, Source, SpecError
from tests.conftest import rows


def text_frame(spark, values, name="x"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def found(df, *fields):
    out = contracts.violations(df, Source("s", fields))
    return {(r["field"], r["rule"], r["level"]): (r["cnt"], r["sample"]) for r in out.collect()}


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("  a b ", "a b"),
        ("　全角　", "全角"),
        ("\t\r\n", None),
        ("", None),
        (None, None),
        ("\x1fx\xa0", "x"),
        ("a\n", "a"),
    ],
)
def test_strip_text(spark, text, expected):
    df = text_frame(spark, [text]).select(scalars.strip_text(F.col("x")).alias("x"))
    assert df.first()["x"] == expected
    assert expected == ((text or "").strip() or None)


def test_numbers_and_halves(spark):
    df = text_frame(spark, ["2.5", "3.5", "-2.5", "7", "1,000", "¥5", "1e3", None])
    whole = [r[0] for r in df.select(scalars.as_integer(F.col("x"))).collect()]
    assert whole == [2, 4, -2, 7, None, None, 1000, None]
    strict = [r[0] for r in df.select(scalars.as_integer(F.col("x"), True)).collect()]
    assert strict == [None, None, None, 7, None, None, 1000, None]


def test_dates_in_declared_formats(spark):
    df = text_frame(spark, ["2026-5-7", "2026/5/7", "2026-05-07 10:30:00", "soon"])
    days = [r[0] for r in df.select(scalars.as_date(F.col("x"), ("yyyy/M/d",))).collect()]
    assert days == [dt.date(2026, 5, 7)] * 3 + [None]


def test_type_rule_counts_text_that_does_not_parse(spark):
    df = text_frame(spark, ["1.5", "N/A", "N/A", "1,000", None, "99999999999999999"])
    assert found(df, Field("x", "x", "decimal")) == {
        ("x", "type", "yellow"): (4, "1,000, 99999999999999999, N/A")
    }
    assert found(text_frame(spark, ["1.5"]), Field("x", "x", "integer")) == {}
    strict = Field("x", "x", "integer", strict_integer=True)
    assert found(text_frame(spark, ["1.5"]), strict) == {("x", "type", "yellow"): (1, "1.5")}


def test_range_is_inclusive_and_skips_what_is_no_number(spark):
    df = text_frame(spark, ["0", "1", "999", "1000", "x", None])
    field = Field("x", "x", "integer", range=(1, 999))
    assert found(df, field)[("x", "range", "yellow")] == (2, "0, 1000")
    assert ("x", "range", "yellow") not in found(df, Field("x", "x", range=(1, 999)))


def test_enum_sample_has_up_to_five_sorted_values(spark):
    df = text_frame(spark, ["a", "g", "f", "e", "d", "c", "c", None, "b"])
    assert found(df, Field("x", "x", enum=("a",)))[("x", "enum", "yellow")] == (7, "b, c, d, e, f")


def test_format_is_anchored_at_the_start_only(spark):
    df = text_frame(spark, ["2024-01", "2024-01-05", "x2024-01", None, "24-1"])
    field = Field("x", "x", format=r"\d{4}-\d{2}")
    assert found(df, field)[("x", "format", "yellow")] == (2, "24-1, x2024-01")


def test_unique_counts_all_rows_of_repeated_keys_and_nulls(spark):
    df = text_frame(spark, ["a", "a", "b", None, None, "c", "c", "c"])
    assert found(df, Field("x", "x", unique=True)) == {("x", "unique", "red"): (7, "NULL, a, c")}
    apart = Field("x", "x", unique=True, nulls_equal=False)
    assert found(df, apart) == {("x", "unique", "red"): (5, "a, c")}


def test_rules_do_not_hide_each_other(spark):
    df = spark.createDataFrame([(None, "zz", "5000")], "a string, b string, c string")
    fields = (
        Field("a", "a", required=True, level="red"),
        Field("b", "b", enum=("x",)),
        Field("c", "c", "integer", range=(1, 9), level="pending"),
    )
    assert {k: v[0] for k, v in found(df, *fields).items()} == {
        ("a", "required", "red"): 1,
        ("b", "enum", "yellow"): 1,
        ("c", "range", "pending"): 1,
    }
    assert contracts.accept(df, Source("s", fields)).count() == 0


def test_clean_feed_has_no_rows(spark):
    assert found(text_frame(spark, ["1", None]), Field("x", "x", "integer", range=(0, 2))) == {}


def test_default_fills_missing_and_unparsable(spark):
    df = text_frame(spark, [None, "abc", "0.25"])
    source = Source("s", (Field("x", "x", "decimal", default=0),))
    values = [r["x"] for r in contracts.accept(df, source).collect()]
    assert values == [Decimal("0.0000"), Decimal("0.0000"), Decimal("0.2500")]


def test_required_that_fails_to_parse_is_dropped_in_staging_only(spark):
    source = Source("s", (Field("x", "x", "date", required=True),))
    accepted = contracts.accept(text_frame(spark, ["soon", None, "2026-01-01"]), source)
    assert accepted.count() == 2
    assert rows(staging.stage(accepted, source)) == [(dt.date(2026, 1, 1),)]


def test_staging_default_with_quote(spark):
    source = Source("s", (Field("x", "x", default="it's \\ 未分类"),))
    assert rows(staging.stage(text_frame(spark, [None]), source)) == [("it's \\ 未分类",)]


def test_staging_tests(spark):
    source = Source(
        "s",
        (
            Field("k", "k", required=True, unique=True),
            Field("e", "e", enum=("a",), level="red"),
            Field("n", "n", "integer", range=(1, 3)),
        ),
    )
    df = spark.createDataFrame(
        [("1", "a", 1), ("1", "b", 9), (None, None, None)], "k string, e string, n bigint"
    )
    assert rows(staging.staging_tests(df, source)) == [
        ("s", "e", "accepted_values", "error", 1),
        ("s", "k", "not_null", "error", 1),
        ("s", "k", "unique", "error", 1),
        ("s", "n", "range", "warn", 1),
    ]


def test_cleaning_steps(spark):
    df = spark.createDataFrame([(" a ", "1"), ("　", "2"), (None, "3")], "` k ` string, v string")
    steps = ("trim_columns", "strip_strings", {"drop_rows_if": {"col": "k", "op": "is_null"}})
    assert rows(cleaning.clean(df, steps)) == [("a", "1")]
    absent = {"drop_rows_if": {"col": "nope", "op": "is_null"}}
    assert cleaning.clean(df, (absent,)).count() == 3
    with pytest.raises(SpecError):
        cleaning.clean(df, ("sort_rows",))


def test_skip_first_rows_follows_the_file(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("v\n" + "\n".join(str(i) for i in range(5000)))
    df = spark.read.option("header", True).option("maxPartitionBytes", 4096).csv(str(path))
    kept = cleaning.skip_first_rows(df, 1234)
    assert sorted(int(r["v"]) for r in kept.collect()) == list(range(1234, 5000))
    assert cleaning.skip_first_rows(df, 9000).count() == 0
    assert cleaning.skip_first_rows(df, 0).count() == 5000


def test_missing_header_and_extra_columns(spark):
    source = Source("s", (Field("A", "a"), Field("B", "b")))
    df = spark.createDataFrame([("1", "2")], "A string, Z string")
    assert cleaning.missing_headers(df, source) == ["B"]
    with pytest.raises(SpecError):
        cleaning.select_declared(df, source)


@pytest.mark.parametrize(
    ("counts", "expected"),
    [
        ((0, 0, 0, 0), ["empty_file"]),
        ((10, 10, 0, 0), ["empty_after_clean"]),
        ((10, 1, 9, 0), []),
        ((10, 2, 8, 6), ["row_drop_ratio", "type_coerce_ratio"]),
    ],
)
def test_table_problems(spark, counts, expected):
    source = Source(
        "s",
        (),
        problems={
            "row_drop_ratio": {"max": 0.1},
            "type_coerce_ratio": {"max": 0.5, "level": "red"},
        },
    )
    statistics = spark.createDataFrame(
        [counts], "raw_rows bigint, dropped bigint, kept bigint, unparsed bigint"
    )
    out = problems.table_problems(statistics, source)
    assert sorted(r["rule"] for r in out.collect()) == expected
    assert problems.is_red(out) == any(r != "row_drop_ratio" for r in expected)
