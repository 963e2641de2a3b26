"""Stored tables after failures, and reports whose layers carry distinct counts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import rows
from reportloom.functions import metrics as m
from reportloom.operators.marts import build_mart, build_stack, build_states
from reportloom.plans.catalog import QUERIES
from reportloom.plans.run import RunRecord, build_reports
from reportloom.plans.trade import ORDER_LADDER, wide_table
from reportloom.sources.layers import Layers
from reportloom.spec import Dimension, Field, Report, ReportModel, Source, Wide


@pytest.fixture
def layers(spark, tmp_path):
    return Layers(spark, str(tmp_path / "root"))


def failing(spark):
    broken = F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("id"))
    return spark.range(4).select(broken.cast("bigint").alias("id"))


# -- versions ----------------------------------------------------------------
def test_a_write_that_fails_in_a_task_leaves_the_table(spark, layers):
    layers.replace(spark.range(5), "marts", "r")
    with pytest.raises(Exception, match="lost"):
        layers.replace(failing(spark), "marts", "r")
    assert layers.read("marts", "r").count() == 5
    assert layers.clean_up()
    assert layers.replace(spark.range(2), "marts", "r").count() == 2


def test_a_version_that_was_never_published_is_not_read(spark, layers):
    layers.replace(spark.range(5), "raw", "feed")
    layers.write(spark.range(9), "raw", "feed")  # the driver is lost after this step
    again = Layers(spark, layers.root)
    assert again.read("raw", "feed").count() == 5
    assert len(again.clean_up()) == 1
    assert again.read("raw", "feed").count() == 5


def test_readers_of_the_former_version_go_on(spark, layers):
    before = layers.replace(spark.range(5), "marts", "r")
    after = layers.replace(spark.range(7), "marts", "r")
    assert layers.clean_up() == []
    assert (before.count(), after.count()) == (5, 7)
    layers.replace(before.limit(1), "marts", "r")  # reads the table that it replaces
    removed = layers.clean_up()
    assert [path.rpartition("=")[2] for path in removed] == ["1"]
    assert layers.read("marts", "r").count() == 1


def test_a_table_without_versions_is_read_as_it_is(spark, layers):
    spark.range(3).write.parquet(layers.path("raw", "old"))
    assert layers.read("raw", "old").count() == 3
    assert layers.replace(spark.range(4), "raw", "old").count() == 4


def test_partitioned_versions(spark, layers):
    df = spark.range(10).withColumn("part", F.col("id") % 2)
    assert layers.replace(df, "marts", "p", partition_by="part").where("part = 1").count() == 5


# -- distinct counts in layers -----------------------------------------------
def test_layered_distinct_counts_equal_the_direct_ones(spark, sf_dir):
    wide = wide_table(spark, sf_dir, ORDER_LADDER)
    top = build_stack(ORDER_LADDER, "month_orders", wide)
    month = F.date_trunc("month", "ship_date").cast("date").alias("month")
    direct = wide.groupBy(month).agg(
        F.count_distinct("order_key"),
        F.count_distinct(F.when(F.col("return_flag") == "R", F.col("order_key"))),
    )
    assert rows(top, "month", "order_count", "returned_orders") == rows(direct)
    assert rows(top, "month", "order_numbers") == rows(top, "month", "order_count")
    for r in top.collect():
        assert abs(r.orders_about - r.order_count) <= 0.1 * r.order_count


def small_model(state="keys"):
    return ReportModel(
        "small",
        (Source("f", (Field("D", "d"), Field("E", "e"), Field("K", "k", "integer"), Field("X", "x"))),),
        Wide("w", "f"),
        (Dimension("d", "d"), Dimension("e", "e")),
        (
            m.distinct_count("keys", "k", state=state),
            m.distinct_count("marked", "k", "x = 'y'", ("x",), state=state),
            m.row_count("n"),
            m.minimum("first", "k"),
            m.average("mean", "k"),
            m.per_distinct("per", "k", "k"),
        ),
        (
            Report("fine", "d", ("keys",), rollup=("e",)),
            Report("coarse", "e", ("marked", "keys"), base="fine"),
            Report("wide", "d", ("keys", "marked", "n", "first", "mean", "per")),
        ),
    )


FACTS = [
    ("a", "u", 1, "y"), ("a", "u", 1, "n"), ("a", None, 2, None), ("b", "u", 1, "y"),
    ("b", "v", -5, "n"), (None, "v", None, "y"), (None, None, 40_000_000_000, "y"), ("c", "w", None, "n"),
]


@pytest.mark.parametrize("state", ["keys", "bitmap"])
def test_null_groups_null_keys_and_far_keys_in_layers(spark, state):
    df = spark.createDataFrame(FACTS, "d string, e string, k bigint, x string")
    built = build_stack(small_model(state), "coarse", df)
    assert rows(built) == sorted(
        [("u", 1, 1), ("v", 0, 1), ("w", 0, 0), (None, 1, 2)], key=repr
    )
    empty = build_stack(small_model(state), "coarse", df.limit(0))
    assert empty.count() == 0


def test_bitmaps_of_small_groups_stay_small(spark):
    df = spark.range(1000).select(
        F.col("id").cast("string").alias("d"), F.lit("e").alias("e"), (F.col("id") * 3 - 500).alias("k"), F.lit("y").alias("x")
    )
    model = small_model("bitmap")
    keys = next(n for n in model.handed_on("fine"))
    state = build_states(model, "fine", df, {})[keys]
    assert dict(state.dtypes)["__state"] == "bigint"
    assert state.count() == 1000
    built = build_stack(model, "coarse", df)
    assert "SortAggregate" not in built._jdf.queryExecution().toString()
    assert rows(built, "e", "keys") == [("e", 1000)]


def test_two_level_counts_equal_the_direct_ones(spark):
    df = spark.createDataFrame(FACTS, "d string, e string, k bigint, x string")
    mart = build_mart(small_model(), "wide", df)
    assert "Expand" not in mart._jdf.queryExecution().toString()
    direct = df.groupBy("d").agg(
        F.count_distinct("k"),
        F.count_distinct(F.when(F.col("x") == "y", F.col("k"))),
        F.count(F.lit(1)),
        F.min("k"),
        F.round(F.sum("k").cast("double") / F.nullif(F.count("k"), F.lit(0)).cast("double"), 4),
        F.round(F.sum("k").cast("double") / F.nullif(F.count_distinct("k"), F.lit(0)).cast("double"), 2),
    )
    assert rows(mart) == rows(direct)


@pytest.mark.parametrize("name", ["mart_cond_distinct", "mart_ratio_distinct"])
def test_several_distinct_counts_do_not_multiply_rows(spark, sf_dir, name):
    assert "Expand" not in QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()


def test_a_run_stores_the_states_of_its_layers(spark, layers):
    df = spark.createDataFrame(FACTS, "d string, e string, k bigint, x string")
    model = small_model("bitmap")
    record = RunRecord("run-1")
    build_reports(model, layers, record, df)
    assert record.statuses("marts.") == {"success"}
    stored = layers.read("marts", "coarse")
    assert rows(stored) == rows(build_stack(model, "coarse", df))
    assert layers.read("marts", "fine.keys").columns == ["d", "e", "__bucket", "__state"]


def test_unknown_states_are_refused():
    with pytest.raises(m.MetricError):
        m.distinct_count("n", "k", state="list")
