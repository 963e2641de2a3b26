"""Checks of the declared model, and reports built from it."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from reportloom.functions import metrics as m
from reportloom.operators import recon, report_query, wide as wide_ops
from reportloom.operators.marts import build_mart, build_stack, full_periods, period_start
from reportloom.plans.trade import LADDER, SALES, staged_tables, wide_table
from reportloom.spec import Dimension, Field, Join, Report, ReportModel, Source, SpecError, Wide
from tests.conftest import rows

FACT = Source("f", tuple(Field(c, c) for c in ("k", "d", "g", "h", "v")))
DIM = Source("dim", (Field("k", "k"), Field("label", "label")))
DIMS = (Dimension("月", "d", "time"), Dimension("g", "g"), Dimension("h", "h"))
ONE = (m.total("total", "v"),)


def model(reports, metrics=ONE, wide=None, dims=DIMS):
    return ReportModel("t", (FACT, DIM), wide or Wide("w", "f"), dims, metrics, tuple(reports))


@pytest.mark.parametrize(
    "build",
    [
        lambda: model([Report("a", "nope", ("total",))]),
        lambda: model([Report("a", "g", ("nope",))]),
        lambda: model([Report("a", "g", ("total",), time_dim="h")]),
        lambda: model([Report("a", "g", ("total",), base="nope")]),
        lambda: model([Report("a", "g", ("total",), base="b"), Report("b", "g", ("total",), base="a")]),
        lambda: model([Report("a", "g", ("total",)), Report("b", "g", ("total",), base="a", filters=("h",))]),
        # A finer report above would silently refine the one below.
        lambda: model([Report("a", "g", ("total",)), Report("b", "h", ("total",), base="a")]),
        lambda: model([], wide=Wide("w", "f", (Join("dim", "zz", "k"),))),
        lambda: model([], wide=Wide("w", "f", (Join("dim", "k", "zz"),))),
        lambda: model([], wide=Wide("w", "f", (Join("nope", "k", "k"),))),
        lambda: model([], metrics=(m.total("x", "nope"),)),
        lambda: model([], metrics=(m.row_count("n"),), dims=(Dimension("z", "nope"),)),
        # Counts cannot be rebuilt from the layer below.
        lambda: model(
            [Report("a", "g", ("n",)), Report("b", "g", ("n",), base="a")], (m.row_count("n"),)
        ),
        lambda: model([Report(f"r{i}", "g", ("total",), base=f"r{i - 1}" if i else None) for i in range(8)]),
        lambda: Dimension("x", "d", "time", "century"),
        lambda: Field("x", "x", "float"),
        lambda: Join("t", "a", "b", how="cross"),
    ],
)
def test_contradictions_are_refused(build):
    with pytest.raises(SpecError):
        build()


@pytest.mark.parametrize(
    "metrics",
    [
        (m.derived("a", add=("b",)), m.derived("b", add=("a",))),
        (m.derived("a", add=("nope",)),),
        (m.ratio("r", ("v",), ("v",)), m.derived("a", add=("r",))),
    ],
)
def test_derived_metrics_are_checked(metrics):
    with pytest.raises(m.MetricError):
        model([], metrics)


def test_metric_declarations():
    with pytest.raises(m.MetricError):
        m.derived("a")
    with pytest.raises(m.MetricError):
        m.expression("r", "sum(v)", ("v",), ratio=True)


def test_nested_derived_metric(spark):
    metrics = (
        m.total("a", "v"),
        m.total("b", "h"),
        m.derived("c", add=("a",), sub=("b",)),
        m.derived("d", add=("c", "a"), sub=("c",)),
    )
    df = spark.createDataFrame([(5, 2), (1, 1)], "v int, h int")
    built = model([], metrics)
    assert df.agg(built.metric("c").column(), built.metric("d").column()).first() == (3, 6)


@pytest.mark.parametrize("grain", ["day", "week", "month", "quarter", "year"])
def test_full_periods(spark, grain):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(800)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    as_of = dt.date(2025, 8, 20)
    kept = full_periods(df, Dimension("x", "d", "time", grain), as_of)
    expected = df.where(F.date_trunc(grain, "d") < F.date_trunc(grain, F.lit(as_of)))
    assert kept.count() == expected.count() > 0
    assert period_start(as_of, grain) == expected.selectExpr("max(d) + 1").first()[0]


def test_null_groups_and_all_null_sums(spark):
    df = spark.createDataFrame(
        [(dt.date(2024, 1, 5), None, 1), (dt.date(2024, 1, 9), "x", None), (None, "x", 4)],
        "d date, g string, v int",
    )
    built = build_mart(model([Report("a", "g", ("total",), time_dim="月")]), "a", df)
    assert set(rows(built)) == {
        (dt.date(2024, 1, 1), "x", None),
        (dt.date(2024, 1, 1), None, 1),
        (None, "x", 4),
    }


def test_layers_agree_with_the_direct_report(spark, sf_dir):
    df = wide_table(spark, sf_dir, LADDER)
    l1 = build_stack(LADDER, "part_month", df)
    l2 = build_mart(LADDER, "brand_month", l1)
    l3 = build_mart(LADDER, "month_total", l2)
    for key, parent, child in (("brand_month", l1, l2), ("month_total", l2, l3)):
        assert recon.reconcile(LADDER, key, parent, child).count() == 0
    assert all(r["ok"] for r in recon.conserve_totals(LADDER, "month_total", l3, df).collect())
    changed = l2.withColumn("contribution", F.col("contribution") + 0.02)
    gaps = recon.reconcile(LADDER, "brand_month", l1, changed)
    assert gaps.count() == l2.count() > 0


def test_recon_finds_null_groups_and_one_sided_groups(spark):
    two = model(
        [
            Report("fine", "g", ("total",), time_dim="月"),
            Report("coarse", "g", ("total",), base="fine"),
        ]
    )
    parent = spark.createDataFrame(
        [(None, 1, 1), ("x", 2, 2), ("p", 5, 5)], "g string, total int, v int"
    )
    child = spark.createDataFrame([(None, 1), ("x", 2), ("c", 7)], "g string, total int")
    assert rows(recon.reconcile(two, "coarse", parent, child)) == [
        ("total", "c", None, 7.0),
        ("total", "p", 5.0, None),
    ]


# -- wide table --------------------------------------------------------------
def test_left_join_multiplies_on_duplicate_keys_and_keeps_unmatched(spark):
    fact = spark.createDataFrame([("a", 1), ("z", 2), (None, 3)], "k string, v int")
    dim = spark.createDataFrame([("a", "x"), ("a", "y"), ("q", "w")], "k string, label string")
    join = Join("dim", "k", "k", ("label",))
    expected = [("a", 1, "x"), ("a", 1, "y"), ("z", 2, None), (None, 3, None)]
    for spread in (1, 5):
        assert rows(wide_ops.attach(fact, dim, replace(join, spread=spread))) == sorted(
            expected, key=repr
        )
    inner = replace(join, how="inner", spread=3)
    assert rows(wide_ops.attach(fact, dim, inner)) == [("a", 1, "x"), ("a", 1, "y")]
    assert rows(wide_ops.fanout_keys(dim, "k")) == [("a", 2)]
    assert rows(wide_ops.unmatched_keys(fact, "k", dim, "k")) == [("z",)]
    assert rows(wide_ops.orphan_keys(dim, "k", fact, "k")) == [("q",)]


def test_hot_key_join_without_broadcast_equals_broadcast(spark):
    """A third of all rows share one key and a third have none."""
    fact = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, 0)
        .when(F.col("id") % 3 == 1, None)
        .otherwise(F.col("id"))
        .alias("k"),
        F.col("id").alias("v"),
    )
    dim = spark.range(20000).select(F.col("id").alias("k"), (F.col("id") * 7).alias("label"))
    join = Join("dim", "k", "k", ("label",))
    expected = fact.join(F.broadcast(dim), "k", "left").agg(F.sum("label"), F.count("*")).first()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        for spread in (1, 8):
            out = wide_ops.attach(fact, dim, replace(join, spread=spread))
            assert out.agg(F.sum("label"), F.count("*")).first() == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", before)


def test_match_levels():
    wide = Wide(
        "w",
        "f",
        (
            Join("dim", "k", "k", fanout="ignore", null_match="red", orphan_right="red"),
            Join("dim", "g", "k"),
        ),
    )
    assert [(c.rule, c.level) for c in wide_ops.match_contracts(wide)] == [
        ("null_match", "red"),
        ("orphan_right", "yellow"),
        ("fanout", "red"),
        ("null_match", "yellow"),
    ]


def test_union_feeds_composes_document_numbers(spark):
    a = spark.createDataFrame([("1", "x", 5)], "no string, line string, qty int")
    b = spark.createDataFrame([("9", 2.5)], "id string, price double")
    out = wide_ops.union_feeds({"A": a, "B": b}, ("qty", "price"), {"A": ("no", "line"), "B": ("id",)})
    assert rows(out) == [("A", "1-x", 5, None), ("B", "9", None, 2.5)]


# -- queries -----------------------------------------------------------------
def test_filters(spark, sf_dir):
    df = wide_table(spark, sf_dir)
    mart = build_mart(SALES, "region_month", df)
    whole = mart.count()

    def ask(**filters):
        return report_query.query_report(SALES, "region_month", mart, df, filters, 5000)

    assert ask(region="' or 1=1 --").count() == whole
    assert ask(month="not a month").count() == whole
    assert {r["region"] for r in ask(region="ASIA").collect()} == {"ASIA"}
    assert {str(r["month"]) for r in ask(month="1998-03-01").collect()} == {"1998-03-01"}
    with pytest.raises(SpecError):
        ask(priority="1-URGENT")
    assert report_query.query_report(SALES, "region_month", mart, limit=-5).count() == 1
    assert report_query.clamp_limit(10**9) == 5000


def test_stored_pairs_answer_without_the_wide_table(spark, sf_dir, tmp_path):
    from reportloom.operators.membership import membership

    df = wide_table(spark, sf_dir)
    for name, frame in (("mart", build_mart(SALES, "region_month", df)),
                        ("pairs", membership(SALES, "region_month", df))):
        frame.write.parquet(str(tmp_path / name))
    mart, pairs = (spark.read.parquet(str(tmp_path / n)) for n in ("mart", "pairs"))
    assert not pairs.groupBy(*pairs.columns).count().where("count > 1").count()
    # The same answers as from the wide table, unknown values and several filters included.
    nations = [r[0] for r in df.select(SALES.dimension("nation").column).distinct().collect()]
    cases = [{"nation": n} for n in nations[:3]] + [
        {"nation": "none"}, {"segment": None}, {"region": "ASIA", "month": "1998-03-01"},
        {"region": "ASIA", "segment": "BUILDING", "nation": nations[0]},
    ]
    for filters in cases:
        near = report_query.query_report(SALES, "region_month", mart, filters=filters, members=pairs)
        far = report_query.query_report(SALES, "region_month", mart, df, filters)
        assert rows(near) == rows(far)
        plan = near._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" not in plan and "order_key" not in plan
    listed = report_query.filter_options(SALES, "region_month", mart, members=pairs)
    assert rows(listed) == rows(report_query.filter_options(SALES, "region_month", mart, df))
    one = report_query.option_values(SALES, "region_month", "nation", mart, members=pairs)
    assert [r["nation"] for r in one.collect()] == sorted(n for n in nations if n is not None)
    with pytest.raises(SpecError, match="stored pairs"):
        report_query.query_report(SALES, "region_month", mart, filters={"nation": "x"})


def test_no_job_runs_while_an_answer_is_built(spark, sf_dir):
    from reportloom.operators.membership import membership

    df = wide_table(spark, sf_dir)
    mart = build_mart(SALES, "region_month", df)
    broken = F.raise_error(F.lit("the pairs are read")).cast("string")
    pairs = membership(SALES, "region_month", df).withColumn("nation", F.coalesce(broken, "nation"))
    answer = report_query.query_report(
        SALES, "region_month", mart, filters={"nation": "NATION_3", "region": "ASIA"}, members=pairs
    )
    with pytest.raises(Exception, match="the pairs are read"):
        answer.collect()


def test_json_safe(spark):
    df = spark.sql(
        "select cast(1.50 as decimal(9,2)) a, date'2024-02-03' b, timestamp'2024-02-03 00:00:00' c, "
        "timestamp'2024-02-03 04:05:06' d, 'x' e"
    )
    out = report_query.json_safe(df).first()
    assert out == (1.5, "2024-02-03", "2024-02-03", "2024-02-03 04:05:06", "x")


def test_pivot_takes_declared_values_only(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "b", 6), (2, "a", 7)], "t int, d string, v int")
    out = report_query.pivot_report(df, "t", "d", "v", ["a", "b"])
    assert out.columns == ["t", "a", "b"] and rows(out) == [(1, 5, 6), (2, 7, None)]
    with pytest.raises(Exception, match="undeclared value b"):
        report_query.pivot_report(df, "t", "d", "v", ["a"]).collect()
    unknown = df.withColumn("d", F.lit(None).cast("string"))
    with pytest.raises(Exception, match="undeclared value NULL"):
        report_query.pivot_report(unknown, "t", "d", "v", ["a"]).collect()


def test_stable_order(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",)], "x string")
    assert [r["x"] for r in report_query.stable_order(df, ["x"]).collect()] == ["a", "b", None]
