"""Ratios of a run, and what a run leaves behind when a feed or the build goes wrong."""

from __future__ import annotations

import os

import pytest

from reportloom.functions import metrics as m
from reportloom.operators import cleaning
from reportloom.plans.run import ingest_feed, run
from reportloom.sources.csv import read_feed
from reportloom.sources.discovery import discover, list_files
from reportloom.sources.layers import Layers
from reportloom.spec import Dimension, Field, Report, ReportModel, Source, Wide


def source(**options):
    fields = (Field("K", "k", required=True), Field("G", "g"), Field("N", "n", "integer", unique=True))
    return Source("feed", fields, patterns=("feed*.csv",), **options)


def write(folder, lines, name="feed.csv"):
    path = folder / name
    path.write_text("\n".join(["K,G,N", *lines, ""]), encoding="utf-8")
    return str(path)


def hundredth_dropped(count=10_000):
    return [f"{'' if i % 100 == 0 else i},g{i % 3},{i}" for i in range(count)]


@pytest.mark.parametrize("most, level", [(0.009, "red"), (0.011, None)])
@pytest.mark.parametrize("skip", [0, 5])
def test_drop_ratio_counts_all_rows(spark, tmp_path, most, level, skip):
    rules = {"row_drop_ratio": {"max": most, "level": "red"}}
    feed_source = source(problems=rules, skip_rows=skip)
    path = write(tmp_path, hundredth_dropped())
    feed = read_feed(spark, path, os.path.getsize(path), feed_source.encodings)
    found = ingest_feed(feed, feed_source, Layers(spark, str(tmp_path / "w")))
    ratios = [f for f in found if f[2] == "row_drop_ratio"]
    assert [f[3] for f in ratios] == ([level] if level else [])
    if level:
        dropped = 99 if skip else 100
        assert ratios[0][5] == f"{dropped} of 10000"


def model():
    return ReportModel(
        "m",
        sources=(source(),),
        wide=Wide("w", "feed"),
        dimensions=(Dimension("g", "g"),),
        metrics=(m.row_count("rows"),),
        reports=(Report("r", "g", ("rows",)),),
    )


def test_a_field_named_n_and_an_empty_feed(spark, tmp_path):
    inbox, root = tmp_path / "in", str(tmp_path / "w")
    inbox.mkdir()
    write(inbox, ["a,x,1", "b,x,2"])
    assert run(spark, model(), str(inbox), root, "run-1").light == "green"
    write(inbox, [])
    assert run(spark, model(), str(inbox), root, "run-2").light == "red"
    layers = Layers(spark, root)
    assert layers.read("raw", "feed").count() == 2
    assert {r["rule"] for r in layers.ledger().collect()} == {"empty_file"}


def test_a_crash_of_the_build_is_recorded(spark, tmp_path, monkeypatch):
    inbox, root = tmp_path / "in", str(tmp_path / "w")
    inbox.mkdir()
    write(inbox, ["a,x,1"])
    monkeypatch.setattr("reportloom.plans.run.widen", lambda *a: 1 / 0)
    assert run(spark, model(), str(inbox), root, "run-1").light == "red"
    nodes = {r["node"]: r["status"] for r in Layers(spark, root).nodes().collect()}
    assert nodes["build"] == "error"


def test_the_newest_file_is_chosen_even_beside_an_empty_one(spark, tmp_path):
    (tmp_path / "feed_old.csv").write_text("")
    os.utime(tmp_path / "feed_old.csv", (10**9, 10**9))
    write(tmp_path, ["a,x,1"], "feed_new.csv")
    found = discover(list_files(spark, str(tmp_path)), [source()]).where("chosen").collect()
    assert [r["file"] for r in found] == ["feed_new.csv"]


def test_first_rows_are_skipped_in_every_file(spark, tmp_path):
    spark.range(0, 10).coalesce(1).write.parquet(str(tmp_path / "a"))
    spark.range(10, 5000).coalesce(1).write.parquet(str(tmp_path / "b"))
    df = spark.read.parquet(str(tmp_path / "a"), str(tmp_path / "b"))
    rest = sorted(r["id"] for r in cleaning.skip_first_rows(df, 5).collect())
    assert rest == [*range(5, 10), *range(15, 5000)]
