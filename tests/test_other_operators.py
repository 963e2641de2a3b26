"""Governance, comparison, periods and profiles on small tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from reportloom.operators import compare, governance, periods, profiling
from tests.conftest import rows


def test_traffic_light_and_counts(spark):
    nodes = spark.createDataFrame(
        [("r1", "success"), ("r1", "warn"), ("r2", "warn"), ("r2", "runtime error"), ("r3", "pass")],
        "run_id string, status string",
    )
    assert rows(governance.traffic_light(nodes)) == [
        ("r1", "yellow"),
        ("r2", "red"),
        ("r3", "green"),
    ]
    assert ("r1", "warn", 1) in rows(governance.status_counts(nodes))


def test_history_keeps_the_newest_of_each_instance(spark):
    base = dt.datetime(2026, 1, 1)
    runs = spark.createDataFrame(
        [("a", i, base + dt.timedelta(days=i), "red" if i == 99 else "green") for i in range(100)]
        + [("b", 1, base, "green")],
        "instance string, run_id int, started_at timestamp, status string",
    )
    kept = governance.run_history(runs)
    assert sorted(r["run_id"] for r in kept.where("instance = 'a'").collect()) == list(range(40, 100))
    assert rows(governance.stale_instances(runs)) == [("a", 99, True), ("b", 1, False)]


def test_timeline(spark):
    t = dt.datetime(2026, 1, 1)
    s = dt.timedelta(seconds=1)
    nodes = spark.createDataFrame(
        [("r", "x", t, t + 2 * s), ("r", "y", t + s, t + 5 * s), ("r", "z", t + 3 * s, t)],
        "run_id string, node string, started_at timestamp, ended_at timestamp",
    )
    assert rows(governance.run_timeline(nodes)) == [
        ("r", "x", 0.0, 2.0, 5.0),
        ("r", "y", 1.0, 4.0, 5.0),
        ("r", "z", 3.0, 0.0, 5.0),
    ]


def test_missing_sources(spark):
    declared = spark.createDataFrame([("a",), ("b",)], "source string")
    found = spark.createDataFrame([("a",), ("a",)], "source string")
    assert rows(governance.missing_sources(declared, found)) == [("b",)]


def test_keyed_diff_kinds(spark):
    schema = "k string, m date, amount double, rate double, note string"
    day = dt.date(2026, 1, 1)
    expected = spark.createDataFrame(
        [
            ("same", day, 1.0, 0.5, "n"),
            ("close", day, 1.0, 0.5, "n"),
            ("value", day, 1.0, 0.5, "n"),
            ("percent", day, 1.0, 0.5, "n"),
            ("null", day, 1.0, None, "n"),
            (None, day, 1.0, 0.5, "n"),
            ("gone", day, 1.0, 0.5, "n"),
            ("many", day, 1.0, 0.5, "n"),
            ("text", day, 1.0, 0.5, "n"),
        ],
        schema,
    )
    actual = spark.createDataFrame(
        [
            ("same", day, 1.0, 0.5, "n"),
            ("close", day, 1.01, 0.5000005, "n"),
            ("value", day, 1.02, 0.50001, "n"),
            ("percent", day, 1.0, 50.0, "n"),
            ("null", day, None, None, "n"),
            (None, day, 1.0, 0.5, "n"),
            ("many", day, 9.0, 0.5, "n"),
            ("many", day, 9.0, 0.5, "n"),
            ("new", day, 1.0, 0.5, "n"),
            ("text", day, 1.0, 0.5, "m"),
        ],
        schema,
    )
    out = compare.keyed_diff(expected, actual, ["k", "m"], ("rate",))
    assert rows(out, "k", "kind", "column") == sorted(
        [
            ("value", "value", "amount"),
            ("value", "value", "rate"),
            ("percent", "percent_literal", "rate"),
            ("null", "null_mismatch", "amount"),
            ("gone", "missing_key", "-"),
            ("many", "inflation", "-"),
            ("new", "extra_key", "-"),
            ("text", "value", "note"),
        ],
        key=repr,
    )


def test_month_keys(spark):
    df = spark.createDataFrame(
        [(dt.date(2026, 3, 9), "2026-03-01", 1)], "a date, b string, v int"
    )
    assert rows(compare.month_keys(df, ["a", "b"])) == [("2026-03", "2026-03", 1)]


def test_multisets(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, v string")
    b = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "k int, v string")
    assert rows(compare.multiset_diff(a, b)) == [(1, None, 2, 1), (3, "y", 0, 1)]
    assert compare.same_rows(a, a.select("*")) and not compare.same_rows(a, b)


@pytest.mark.parametrize("buckets", [1, 7, 1 << 16])
def test_pruned_comparison(spark, buckets):
    # NULLs in different places, repeated rows, rows on one side only.
    a = [(1, None), (None, 1), (2, 2), (2, 2), (3, 3), (None, None)] + [(i, i) for i in range(10, 200)]
    b = [(None, 1), (None, 1), (2, 2), (3, 3), (None, None), (4, 4)] + [(i, i) for i in range(10, 200)]
    left, right = (spark.createDataFrame(x, "x int, y int") for x in (a, b))
    few = compare.pruned(left, right, buckets)
    assert rows(compare.multiset_diff(*few)) == rows(compare.multiset_diff(left, right))
    if buckets > 7:
        assert few[0].count() < 10
    same = compare.pruned(left, left.repartition(3), buckets)
    assert same[0].count() == same[1].count() == 0
    none = left.where("false")
    assert compare.pruned(none, none, buckets)[0].count() == 0
    assert compare.pruned(left, none, buckets)[0].count() == len(a)


def test_latest_and_previous(spark):
    df = spark.createDataFrame([(3, 30.0, 0.3), (1, 10.0, 0.5), (2, 0.0, 0.1)], "t int, v double, r double")
    cards = {c["metric"]: c for c in periods.latest_and_previous(df, "t", {"v": False, "r": True}).collect()}
    assert cards["v"]["period"] == 3 and cards["v"]["change"] is None
    assert abs(cards["r"]["change"] - 0.2) < 1e-12
    alone = periods.latest_and_previous(df.where("t = 1"), "t", {"v": False}).collect()
    assert [(c["current_value"], c["previous_value"], c["change"]) for c in alone] == [(10.0, None, None)]
    assert periods.latest_and_previous(df.where("t > 9"), "t", {"v": False}).count() == 0


def test_period_over_period(spark):
    df = spark.createDataFrame([(1, "a", 10.0), (2, "a", 15.0), (5, "b", 1.0)], "t int, d string, v double")
    assert rows(periods.period_over_period(df, "t", ["d"], {"v": False})) == [
        (1, "a", 10.0, None, None),
        (2, "a", 15.0, 10.0, 0.5),
        (5, "b", 1.0, None, None),
    ]


def test_profile(spark):
    df = spark.createDataFrame(
        [("A1", "1,200.5", "2024-01-01", "x", None), ("A2", "8950", "2024/2/1", "y", None), ("A3 ", "7", "2024-03-01", "x", "")],
        "code string, fee string, day string, kind string, none string",
    )
    out = {r["column_name"]: r for r in profiling.profile(df).collect()}
    assert {c: r["type"] for c, r in out.items()} == {
        "code": "string", "fee": "decimal", "day": "date", "kind": "string", "none": "string",
    }
    assert {c for c, r in out.items() if r["likely_key"]} == {"code", "fee", "day"}
    assert out["kind"]["likely_enum"] == ["x", "y"] and out["fee"]["likely_enum"] is None
    assert (out["fee"]["min_value"], out["fee"]["max_value"]) == (7.0, 8950.0)
    assert out["none"]["null_pct"] == 100.0 and out["none"]["samples"] == []
    assert out["code"]["samples"] == ["A1", "A2", "A3"]


def test_entities_and_joins(spark):
    facts = spark.createDataFrame([("a", 5), ("a", 6), ("b", 7)], "k string, amount int")
    dims = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "y")], "k string, name string")
    tables = {"big": facts.unionByName(facts), "names": dims}
    entities = profiling.guess_entities(profiling.table_sizes(tables))
    assert rows(entities, "table_name", "entity") == [("big", "fact"), ("names", "dim")]
    joins = profiling.suggest_joins(profiling.profile_tables(tables), entities)
    assert rows(joins) == [("big", "k", "names")]
    named = profiling.guess_entities(profiling.table_sizes({"x订单": dims, "big": facts.union(facts)}))
    assert rows(named, "table_name", "entity") == [("big", "dim"), ("x订单", "fact")]
    assert rows(profiling.profile_summary(entities)) == [(2, 1, 1, 9)]


def test_inclusions_equal_sets_of_values(spark):
    import random

    from reportloom.operators.inclusion import inclusions, with_containment

    rng = random.Random(7)
    # More columns than bits of one number.
    frames, values = {}, {}
    for t in range(5):
        names = [f"c{i}" for i in range(14)]
        data = [[rng.choice([None, *range(i, 3 * i + 2)]) for i in range(14)] for _ in range(20)]
        frames[f"t{t}"] = spark.createDataFrame(data, ", ".join(f"{n} int" for n in names))
        for i, n in enumerate(names):
            values[f"t{t}", n] = {row[i] for row in data} - {None}
    expected = sorted(
        (*a, *b, len(values[a]), len(values[a] & values[b]), round(len(values[a] & values[b]) / len(values[a]), 4))
        for a in values for b in values if a != b and values[a] & values[b]
    )
    found = inclusions(frames, list(values))
    assert sorted(map(tuple, found.collect())) == expected
    assert inclusions(frames, list(values), 1.0).count() == sum(e[-1] == 1.0 for e in expected)
    suggested = spark.createDataFrame([("t0", "c3", "t1"), ("t0", "none", "t2")], "fact string, column_name string, dim string")
    ratios = {r.column_name: r.ratio for r in with_containment(suggested, found).collect()}
    share = len(values["t0", "c3"] & values["t1", "c3"]) / len(values["t0", "c3"])
    assert ratios == {"c3": round(share, 4), "none": 0.0}


def test_inclusions_shuffle_values_once(spark):
    df = spark.range(10).selectExpr("id as a", "id % 3 as b")
    from reportloom.operators.inclusion import value_sets

    plan = value_sets({"t": df}, [("t", "a"), ("t", "b")])._jdf.queryExecution().toString()
    assert "ObjectHashAggregate" not in plan and "Join" not in plan
