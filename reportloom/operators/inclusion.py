"""Which columns' values are contained in which: evidence for joins and foreign keys.

One grouping serves all pairs. Each value is reduced to the set of columns that hold it, as
bits of whole numbers, so rows are merged within tasks before the only shuffle of values.
Values with the same set are counted; there are few different sets, and all shared counts
and containments follow from them. No two columns are joined.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Columns per whole number of a set.
WORD = 62


def value_sets(tables: Mapping[str, DataFrame], columns: Sequence[tuple[str, str]]) -> DataFrame:
    """The different sets of columns that hold a value: members (numbers of columns), n
    (values held by exactly these). NULL is no value; values are compared as text."""
    numbers = {pair: i for i, pair in enumerate(columns)}
    parts = []
    for name, df in tables.items():
        own = [(column, i) for (table, column), i in numbers.items() if table == name]
        if own:
            cells = F.array(
                *[
                    F.struct(F.lit(i).alias("no"), F.col(f"`{c}`").cast("string").alias("value"))
                    for c, i in own
                ]
            )
            parts.append(df.select(F.inline(cells)))
    cells = reduce(DataFrame.unionByName, parts).where(F.col("value").isNotNull())
    words = range(-(-len(columns) // WORD))
    no = F.col("no")

    def bits(word: int) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), no % WORD)
        return F.bit_or(F.when(F.floor(no / WORD) == word, bit).otherwise(F.lit(0).cast("bigint")))

    masks = [f"mask{w}" for w in words]
    held = cells.groupBy("value").agg(*[bits(w).alias(m) for w, m in zip(words, masks)])
    counted = held.groupBy(*masks).agg(F.count(F.lit(1)).alias("n"))
    mask = F.array(*masks)
    members = F.filter(
        F.sequence(F.lit(0), F.lit(len(columns) - 1)),
        lambda i: F.call_function(
            "shiftright", F.get(mask, F.floor(i / WORD).cast("int")), i % WORD
        ).bitwiseAND(1)
        == 1,
    )
    return counted.select(members.alias("members"), "n")


def inclusions(
    tables: Mapping[str, DataFrame], columns: Sequence[tuple[str, str]], least: float = 0.0
) -> DataFrame:
    """Ordered pairs of columns that share a value: table_name, column_name, in_table,
    in_column, distinct_values (of the first), shared, ratio (of the first's values that the
    second holds), as far as the ratio is at least `least`."""
    if not columns:
        raise ValueError("no columns to compare")
    sets = value_sets(tables, columns)
    names = F.array(
        *[F.struct(F.lit(t).alias("table_name"), F.lit(c).alias("column_name")) for t, c in columns]
    )
    pairs = (
        sets.select("members", "n", F.explode("members").alias("a"))
        .select("a", "n", F.explode("members").alias("b"))
        .groupBy("a", "b")
        .agg(F.sum("n").alias("shared"))
    )
    # A column shares all of its values with itself.
    own = pairs.where("a = b").select("a", F.col("shared").alias("distinct_values"))
    ratio = F.round(F.col("shared").cast("double") / F.col("distinct_values"), 4)
    first, second = F.get(names, F.col("a")), F.get(names, F.col("b"))
    return (
        pairs.where("a <> b")
        .join(own, "a")
        .where(ratio >= least)
        .select(
            first["table_name"].alias("table_name"),
            first["column_name"].alias("column_name"),
            second["table_name"].alias("in_table"),
            second["column_name"].alias("in_column"),
            "distinct_values",
            "shared",
            ratio.alias("ratio"),
        )
    )


def with_containment(suggested: DataFrame, included: DataFrame) -> DataFrame:
    """Join suggestions (fact, column_name, dim) with the share of the fact's keys that the
    dimension has; 0 if it has none."""
    same = included.where(F.col("column_name") == F.col("in_column")).select(
        F.col("table_name").alias("fact"), "column_name", F.col("in_table").alias("dim"), "ratio"
    )
    joined = suggested.join(same, ["fact", "column_name", "dim"], "left")
    return joined.withColumn("ratio", F.coalesce("ratio", F.lit(0.0)))
