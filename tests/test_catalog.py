"""Every registered query against its DuckDB statement on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from check_oracles import compare, connect

# The text operators have tests of their own.
QUERIES = entry_points.QUERIES
ORACLES = entry_points.ORACLES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_statement(spark, con, sf_dir, name):
    outcome = compare(spark, con, sf_dir, name, QUERIES[name], ORACLES[name])
    assert outcome.startswith("ok"), outcome


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_sorted_and_counted_rows_come_in_small_shares(spark):
    # A distinct count beside a merge join holds many times the bytes that it reads.
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"
