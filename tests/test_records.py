"""Files with quoted line breaks, against Spark's own reader of such files."""

from __future__ import annotations

import os
import random

import pytest

from reportloom.plans.catalog import QUERIES
from reportloom.sources import records
from reportloom.sources.csv import charset, read_feed, scan_text_table
from tests.conftest import rows


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def random_cell(draw: random.Random) -> str:
    text = "".join(draw.choice(["a", "b ", "é", "中", ",", '"', "\n", "\n\n", ""]) for _ in range(draw.randint(0, 9)))
    if draw.random() < 0.05:
        text += "long\n" * 150
    return text


def written(path, table, ending="\n", encoding="utf-8"):
    def cell(text):
        return '"' + text.replace('"', '""') + '"' if set(text) & set(',"\n\r') else text

    data = ending.join(",".join(cell(c) for c in row) for row in table) + ending
    path.write_bytes(data.encode(encoding))
    return str(path)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def one_piece(spark, path, encoding="UTF-8"):
    """All rows as the reader gives them that takes a file in one task."""
    reader = spark.read.option("header", True).option("escape", '"').option("encoding", encoding)
    return rows(reader.option("multiLine", True).csv(path).na.replace("", None))


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "gbk"])
def test_random_files_equal_the_reader_of_whole_files(spark, tmp_path, small_blocks, ending, encoding):
    draw = random.Random(f"{ending!r}{encoding}")
    table = [["key", "note", "rest"]]
    table += [[f"k{i}", random_cell(draw), random_cell(draw)] for i in range(150)]
    if encoding == "gbk":
        table = [[c.replace("é", "元") for c in row] for row in table]
    path = written(tmp_path / "feed.csv", table, ending, encoding)
    assert records.splittable(spark, path, charset(encoding), table[0])
    feed = read_feed(spark, path, os.path.getsize(path), (encoding,))
    assert "FileScan text" in plan_of(feed)
    assert feed.columns == ["key", "note", "rest", "_overflow", "_source_file", "_loaded_at"]
    expected = sorted((tuple(c or None for c in row) for row in table[1:]), key=repr)
    assert rows(feed, "key", "note", "rest") == expected
    if encoding == "utf-8":
        assert one_piece(spark, path) == expected
    assert feed.where("_overflow is not null").isEmpty()
    assert rows(feed.select("_source_file").distinct()) == [("feed.csv",)]


def test_many_tasks_read_one_file(spark, tmp_path, small_blocks):
    table = [["key", "note"]] + [[f"k{i}", "line\n" * (i % 7)] for i in range(200)]
    path = written(tmp_path / "feed.csv", table)
    assert records.splittable(spark, path, "UTF-8", ["key", "note"])
    assert records.numbered_lines(spark, path, "UTF-8").rdd.getNumPartitions() > 10
    feed = scan_text_table(spark, path, "UTF-8", True)
    assert feed.count() == 200
    assert "FileScan text" in plan_of(feed) and "FileScan csv" not in plan_of(feed)


def test_header_with_breaks_blank_lines_and_long_rows(spark, tmp_path, small_blocks):
    path = tmp_path / "feed.csv"
    path.write_text('\n\n"ke\ny",note\n\n1,"a\nb"\n2,x,"more\nthan told"\n\n3\n')
    feed = scan_text_table(spark, str(path), "UTF-8", True)
    assert feed.columns[:3] == ["ke\ny", "note", "_overflow"]
    found = [tuple(r)[:3] for r in feed.collect()]
    assert sorted(found) == [("1", "a\nb", None), ("2", "x", "more\nthan told"), ("3", None, None)]


def test_several_files_keep_their_own_headers_and_names(spark, tmp_path, small_blocks):
    paths = [
        written(tmp_path / f"part{i}.csv", [["key", "note"]] + [[f"{i}-{j}", "x\ny"] for j in range(60)])
        for i in range(3)
    ]
    feed = scan_text_table(spark, paths, "UTF-8", True)
    assert "FileScan text" in plan_of(feed)
    counts = rows(feed.groupBy("_source_file").count())
    assert counts == [(f"part{i}.csv", 60) for i in range(3)]
    assert feed.where("key = 'key' or note != 'x\\ny'").isEmpty()


@pytest.mark.parametrize(
    "body",
    [
        '1,5" pipe\n2,plain\n3,6" pipe\n4,"a\nb"\n',
        '1,5" pipe\n2,"a\nb"\n3,plain\n',
        '1,"a\nb"\n2,"never closed\n3,c\n',
    ],
)
def test_stray_quotes_are_read_in_one_piece(spark, tmp_path, body):
    path = tmp_path / "feed.csv"
    path.write_text("key,note\n" + body)
    assert not records.splittable(spark, str(path), "UTF-8", ["key", "note"])
    feed = scan_text_table(spark, str(path), "UTF-8", True)
    assert "FileScan csv" in plan_of(feed)
    assert rows(feed, "key", "note") == one_piece(spark, str(path))


def test_line_ends_within_cells_are_those_of_the_other_reader(spark, tmp_path, small_blocks):
    for number, end in enumerate([b"\r\n", b"\n"]):
        path = tmp_path / f"feed{number}.csv"
        lines = [b"key,note", b'1,"a\r\nb"', b'2,"a\nb"', b"3,c", b'4,"d\r\n"']
        path.write_bytes(end.join(lines))
        feed = scan_text_table(spark, str(path), "UTF-8", True)
        assert "FileScan text" in plan_of(feed)
        assert rows(feed, "key", "note") == one_piece(spark, str(path))


def test_carriage_returns_alone_are_left_to_the_reader_of_whole_files(spark, tmp_path):
    path = tmp_path / "feed.csv"
    path.write_bytes(b'key,note\r1,"a\rb"\r2,c\r')
    assert not records.splittable(spark, str(path), "UTF-8", ["key", "note"])


def test_a_file_of_a_header_alone(spark, tmp_path):
    path = tmp_path / "feed.csv"
    path.write_text('"ke\ny",note\n')
    assert scan_text_table(spark, str(path), "UTF-8", True).isEmpty()


def test_both_kinds_of_records_read_one_shuffled_table(spark, sf_dir):
    df = QUERIES["csv_quoted_breaks"](spark, sf_dir)
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()
