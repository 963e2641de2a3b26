"""Whole runs over files in a folder."""

from __future__ import annotations

import datetime as dt
import os

import pytest

from reportloom.operators import compare, governance
from reportloom.operators.membership import STORED
from reportloom.operators.report_query import query_report
from reportloom.plans.run import run
from reportloom.sources.layers import Layers, catalogue, export_report
from tests import retail_fixture as retail
from tests.conftest import rows

AS_OF = dt.date(2026, 9, 15)


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    inbox = tmp_path_factory.mktemp("inbox")
    retail.write_files(inbox)
    root = str(tmp_path_factory.mktemp("warehouse"))
    record = run(spark, retail.MODEL, str(inbox), root, "run-1", AS_OF)
    return record, Layers(spark, root), inbox


def test_ledger_has_exactly_the_seeded_violations(done):
    record, layers, _ = done
    found = rows(layers.ledger(), "source", "field", "rule", "level", "cnt")
    assert found == sorted(retail.EXPECTED_LEDGER, key=repr)
    assert record.light == "yellow"
    assert all(r["sample"] for r in layers.ledger().collect())
    assert all(r["run_id"] == "run-1" and r["ts"] for r in layers.ledger().collect())


def test_row_counts_of_the_layers(done):
    _, layers, _ = done
    counts = {name: layers.read("raw", name).count() for name in retail.EXPECTED_ROWS}
    assert counts == retail.EXPECTED_ROWS
    assert layers.read("intermediate", "wide_ledger").count() == 52


def test_raw_rows_name_their_file(done):
    _, layers, _ = done
    raw = layers.read("raw", "stores")
    assert rows(raw.select("_source_file").distinct())[0][0].endswith(".csv")
    assert raw.where("_loaded_at is null").count() == 0
    assert rows(raw.where("store_code = 'S02'"), "open_date") == [(dt.date(2020, 3, 5),)]


def test_report_equals_the_figures_worked_out_by_hand(done):
    _, layers, _ = done
    mart = layers.read("marts", "region_month")
    found = {(r["月份"], r["大区"]): (r["销售额"], r["毛利"]) for r in mart.collect()}
    assert found == retail.expected_region_month()


def test_unreadable_price_is_null_not_zero(done):
    _, layers, _ = done
    wide = layers.read("intermediate", "wide_ledger").where("doc_no = 'SZ-027'")
    assert rows(wide, "unit_price", "sales_net") == [(None, None)]


def test_null_group_stays_a_row(done):
    _, layers, _ = done
    ranked = rows(layers.read("marts", "supplier_rank"), "供应商", "采购额")
    assert len(ranked) == 6 and any(name is None for name, _ in ranked)


def test_nodes_and_light(done, spark):
    record, _, _ = done
    nodes = record.node_frame(spark)
    assert rows(governance.traffic_light(nodes)) == [("run-1", "yellow")]
    warned = {n[1] for n in record.nodes if n[2] == "warn"}
    assert "test.match_stores_fanout" in warned
    assert "test.match_suppliers_null_match" in warned
    assert not any(n[2] in ("error", "fail", "skipped") for n in record.nodes)


def test_full_periods_end_before_the_day_of_the_run(done, spark, tmp_path):
    _, _, inbox = done
    record = run(spark, retail.MODEL, str(inbox), str(tmp_path), "r", dt.date(2026, 8, 31))
    assert record.light == "yellow"
    months = rows(Layers(spark, str(tmp_path)).read("marts", "monthly_kpi"), "月份")
    assert months == [(dt.date(2026, 7, 1),)]


def test_second_run_gives_the_same_rows_and_appends_to_the_ledger(done, spark):
    _, layers, inbox = done
    before = {key: rows(layers.read("marts", key)) for key in retail.MODEL.reports}
    run(spark, retail.MODEL, str(inbox), layers.root, "run-2", AS_OF)
    for key, old in before.items():
        assert rows(layers.read("marts", key)) == old
    assert layers.ledger().count() == 16
    queue = governance.pending_queue(layers.ledger())
    assert {r["run_id"] for r in queue.collect()} == {"run-2"} and queue.count() == 8
    assert rows(governance.latest_runs(layers.runs()), "run_id", "status") == [("run-2", "yellow")]
    kept = [r["run_id"] for r in governance.merged_history(layers.runs()).collect()]
    assert kept == ["run-2", "run-1"]
    assert rows(governance.traffic_light(layers.nodes())) == [
        ("run-1", "yellow"),
        ("run-2", "yellow"),
    ]
    order = [(r["source"], r["field"], r["rule"]) for r in queue.collect()]
    assert order == sorted(order)


def test_group_filter_keeps_whole_group_figures(done):
    _, layers, _ = done
    mart = layers.read("marts", "region_month")
    wide = layers.read("intermediate", "wide_ledger")
    kept = query_report(retail.MODEL, "region_month", mart, wide, {"城市": "杭州"})
    whole = mart.where("`大区` = '华东'").select(*kept.columns)
    assert compare.same_rows(kept, whole) and kept.count() == 2
    pairs = layers.read("marts", STORED.format("region_month"))
    stored = query_report(retail.MODEL, "region_month", mart, filters={"城市": "杭州"}, members=pairs)
    assert compare.same_rows(kept, stored)


def test_catalogue_and_export(done, spark, tmp_path):
    _, layers, _ = done
    mart = layers.read("marts", "region_month")
    listed = catalogue(spark, {("marts", "region_month"): mart})
    assert [r["column_name"] for r in listed.collect()] == ["月份", "大区", "销售额", "毛利"]
    assert listed.collect()[0]["type"] == "date"
    out = str(tmp_path / "export")
    export_report(query_report(retail.MODEL, "region_month", mart), out, note="old data")
    assert len([f for f in os.listdir(out) if f.endswith(".csv")]) == 1
    back = spark.read.option("header", True).csv(out)
    assert back.count() == mart.count() and rows(back, "note")[0] == ("old data",)


# -- files that stop a run ---------------------------------------------------
def broken_run(spark, tmp_path, change):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    retail.write_files(inbox)
    change(inbox)
    root = str(tmp_path / "warehouse")
    record = run(spark, retail.SMALL, str(inbox), root, "run-x", AS_OF)
    return record, Layers(spark, root)


def problems_of(layers):
    return {(r["source"], r["rule"]) for r in layers.ledger().where("level = 'red'").collect()}


@pytest.mark.parametrize(
    ("change", "expected"),
    [
        (lambda d: (d / "门店_202608.csv").unlink(), ("stores", "file_missing")),
        (lambda d: (d / "门店_202608.csv").write_bytes(b""), ("stores", "read_failed")),
        (
            lambda d: (d / "门店_202608.csv").write_bytes(b"\xff\xfe\xff,\x81\n1,2\n"),
            ("stores", "read_failed"),
        ),
        (
            lambda d: (d / "门店_202608.csv").write_text("门店编码,门店名称,城市,大区,开业日期\n"),
            ("stores", "empty_file"),
        ),
        (
            lambda d: (d / "门店_202608.csv").write_text("门店编码,门店名称,城市,大区\nS01,a,b,华东\n"),
            ("stores", "header_changed"),
        ),
        (
            lambda d: (d / "门店_202608.csv").write_text(
                "门店编码,门店名称,城市,大区,开业日期\n　,a,b,华东,\n"
            ),
            ("stores", "empty_after_clean"),
        ),
        (
            lambda d: (d / "门店_202608.csv").write_text(
                "门店编码,门店名称,城市,大区,开业日期\nS01,a,b,华东,,x\n"
            ),
            ("stores", "ingest_crashed"),
        ),
        (
            lambda d: (d / "门店_202608.csv").write_bytes(
                b"\xef\xbb\xbf" * 2 + (d / "门店_202608.csv").read_bytes()[3:]
            ),
            ("stores", "header_changed"),
        ),
    ],
)
def test_bad_file_turns_the_run_red_and_keeps_reports_unbuilt(spark, tmp_path, change, expected):
    record, layers = broken_run(spark, tmp_path, change)
    assert record.light == "red"
    assert problems_of(layers) == {expected}
    assert not record.statuses("marts.")
    # The other feeds were still taken in.
    assert layers.read("raw", "products").count() == 12


def test_newest_of_several_files_is_taken(spark, tmp_path):
    def change(inbox):
        old = inbox / "门店_202607.csv"
        old.write_text("门店编码,门店名称,城市,大区,开业日期\nS01,a,b,华东,\n")
        os.utime(old, (1_000_000, 1_000_000))
        # Patterns cover the whole name.
        (inbox / "旧门店_202609.csv").write_text("x\n1\n")

    record, layers = broken_run(spark, tmp_path, change)
    assert record.light == "yellow"
    notes = layers.ledger().where("rule = 'multi_match'").collect()
    assert [(n["source"], n["level"], n["cnt"], n["field"]) for n in notes] == [
        ("stores", "yellow", 0, "-")
    ]
    assert layers.read("raw", "stores").count() == 6


def test_gbk_file_is_read(spark, tmp_path):
    def change(inbox):
        path = inbox / "商品_202608.csv"
        content = path.read_bytes()[3:].decode("utf-8").encode("gbk")
        path.unlink()
        (inbox / "商品_[1]{a}.csv").write_bytes(content)

    record, layers = broken_run(spark, tmp_path, change)
    assert record.light == "yellow"
    assert rows(layers.read("raw", "products"), "product_name")[0] == ("商品1",)


def test_quoted_line_break_and_quotes(spark, tmp_path):
    def change(inbox):
        path = inbox / "供应商_202608.csv"
        text = path.read_text("utf-8-sig").replace("供应商1", '"供应""商""\n一"')
        path.write_text(text)

    _, layers = broken_run(spark, tmp_path, change)
    names = [r["supplier_name"] for r in layers.read("raw", "suppliers").collect()]
    assert '供应"商"\n一' in names and len(names) == 5


def test_red_fanout_stops_the_wide_table(spark, tmp_path):
    from dataclasses import replace

    from reportloom.spec import ReportModel

    base = retail.MODEL
    joins = (replace(base.wide.joins[0], fanout="red"), *base.wide.joins[1:])
    strict = ReportModel(
        "strict",
        tuple(base.sources.values()),
        replace(base.wide, joins=joins),
        tuple(base.dimensions.values()),
        tuple(base.metrics.values()),
        tuple(base.reports.values()),
    )
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    retail.write_files(inbox)
    record = run(spark, strict, str(inbox), str(tmp_path / "w"), "r", AS_OF)
    assert record.light == "red"
    assert record.statuses("marts.") == {"skipped"}
    assert record.statuses("intermediate.") == {"skipped"}
