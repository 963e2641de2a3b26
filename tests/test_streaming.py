"""The inbox as a stream, against the batch run and through failures."""

from __future__ import annotations

import pytest

from conftest import rows
from reportloom.plans.run import run
from reportloom.sources.layers import Layers
from reportloom.spec import Dimension, Field, Report, ReportModel, Source, Wide
from reportloom.functions import metrics as m
from reportloom.streaming.inbox import StreamedInbox

LEDGER = ("source", "field", "rule", "level", "cnt", "sample")
SALES = Source(
    "sales",
    (
        Field("No", "no", "integer", required=True, unique=True),
        Field("Kind", "kind", enum=("a", "b")),
        Field("Amount", "amount", "decimal", range=(0, 100), default=0),
    ),
    patterns=("sales*.csv",),
)
SHOPS = Source("shops", (Field("Shop", "shop", required=True),), patterns=("shops*.csv",))


def drop(inbox, name, *lines):
    (inbox / name).write_text("\n".join([*lines, ""]), encoding="utf-8")


@pytest.fixture
def inbox(tmp_path):
    folder = tmp_path / "inbox"
    folder.mkdir()
    return folder


@pytest.fixture
def stream(spark, inbox, tmp_path):
    return StreamedInbox(spark, [SALES, SHOPS], str(inbox), str(tmp_path / "stream"))


FIRST = ("No,Kind,Amount", "1,a,5", "2,x,500", "2,b,oops", ",a,1")


def test_the_ledger_equals_that_of_the_batch_run(spark, inbox, stream, tmp_path):
    drop(inbox, "sales_1.csv", *FIRST)
    drop(inbox, "shops.csv", "Shop", "north", '""', "south")
    model = ReportModel(
        "m", (SALES, SHOPS), Wide("w", "sales"), (Dimension("kind", "kind"),),
        (m.row_count("n"),), (Report("r", "kind", ("n",)),),
    )
    root = str(tmp_path / "w")
    run(spark, model, str(inbox), root, "run-1")
    assert stream.start() == 1
    layers = Layers(spark, root)
    expected = layers.ledger().where("source in ('sales', 'shops')")
    assert rows(stream.ledger(), *LEDGER) == rows(expected, *LEDGER)
    raw = layers.read("raw", "sales")
    assert rows(stream.feed("sales"), "no", "kind", "amount") == rows(raw, "no", "kind", "amount")


def test_a_start_reads_new_files_only(inbox, stream):
    drop(inbox, "sales_1.csv", *FIRST)
    assert stream.start() == 1
    before = rows(stream.ledger())
    assert stream.start() == 0
    assert rows(stream.ledger()) == before
    drop(inbox, "sales_2.csv", "No,Kind,Amount", "7,c,1")
    drop(inbox, "other.txt", "not a feed")
    assert stream.start() == 1
    assert rows(stream.feed("sales").where("batch_id = 1"), "no") == [(7,)]
    assert rows(stream.ledger().where("batch_id = 1"), "rule", "sample") == [("enum", "c")]
    assert rows(stream.batches(), "batch_id", "files") == [(0, 1), (1, 1)]


@pytest.mark.parametrize("lost_at", ["ledger", "batches"])
def test_a_batch_that_is_repeated_adds_nothing_twice(inbox, stream, monkeypatch, lost_at):
    drop(inbox, "sales_1.csv", *FIRST)
    put = StreamedInbox._put

    def failing(self, df, table, batch_id):
        if table == lost_at:
            raise RuntimeError("driver lost")
        put(self, df, table, batch_id)

    monkeypatch.setattr(StreamedInbox, "_put", failing)
    with pytest.raises(Exception, match="driver lost"):
        stream.start()
    # What the broken batch has written is not seen.
    assert stream.ledger().count() == 0 and stream.feed("sales").count() == 0
    monkeypatch.setattr(StreamedInbox, "_put", put)
    drop(inbox, "sales_2.csv", "No,Kind,Amount", "9,a,1")
    stream.start()
    assert sorted(r[0] for r in rows(stream.feed("sales"), "no")) == [1, 2, 2, 9]
    assert [r[:2] for r in rows(stream.ledger(), "rule", "cnt")] == [
        ("enum", 1), ("range", 1), ("required", 1), ("type", 1), ("unique", 2),
    ]


def test_files_of_one_batch_are_one_feed_and_bad_ones_are_problems(inbox, stream):
    drop(inbox, "sales_1.csv", *FIRST)
    drop(inbox, "sales_2.csv", "No,Kind,Amount", "1,a,1")
    drop(inbox, "shops_1.csv", "Store", "north")
    assert stream.start(files_per_batch=10) == 1
    found = rows(stream.ledger(), "source", "rule", "cnt")
    assert ("sales", "unique", 4) in found and ("shops", "header_changed", 0) in found
    drop(inbox, "sales_3.csv", "Kind,No,Amount", "a,50,1")
    drop(inbox, "sales_4.csv", "No,Kind,Amount", "51,a,1")
    stream.start()
    assert ("sales", "read_failed", 0) in rows(stream.ledger(), "source", "rule", "cnt")


def test_nothing_is_there_before_the_first_start(stream):
    assert stream.start() == 0
    assert stream.batches().count() == 0 and stream.ledger().count() == 0
