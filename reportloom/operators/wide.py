"""The wide table: one fact, ordered joins to its dimensions, derived columns,
and the match contracts that report what the joins did.

No join is forced to broadcast. Spark broadcasts a dimension while its size is
below the session's threshold and otherwise sorts and merges, splitting hot fact
keys at run time; `Join.spread` adds salting on top of that.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from reportloom.operators.contracts import SAMPLE_LENGTH
from reportloom.spec import Join, SpecError, Wide

FEED_SEPARATOR = "-"
MATCH_RULES = ("fanout", "null_match", "orphan_right")


def attach(fact: DataFrame, dimension: DataFrame, join: Join) -> DataFrame:
    """Joins the declared columns of one dimension to the fact."""
    key = f"__{join.table}_key"
    right = dimension.selectExpr(
        f"`{join.right}` as `{key}`", *[f"`{c}`" for c in join.columns]
    )
    condition = F.col(join.left) == F.col(key)
    if join.spread == 1:
        return fact.join(right, condition, join.how).drop(key)
    # The salt is a hash of the row's values, so a task that runs again gives the same
    # rows. NULL keys match nothing but are spread as well.
    values = join.spread_by or fact.columns
    salted = fact.withColumn("__salt", F.pmod(F.xxhash64(*values), F.lit(join.spread)))
    copies = F.sequence(F.lit(0).cast("bigint"), F.lit(join.spread - 1).cast("bigint"))
    right = right.withColumn("__copy", F.explode(copies))
    condition = condition & (F.col("__salt") == F.col("__copy"))
    return salted.join(right, condition, join.how).drop(key, "__salt", "__copy")


def _fits_broadcast(df: DataFrame) -> bool:
    """Whether Spark, by its own estimate, would broadcast a table on its side of a join."""
    limit = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    estimate = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(estimate)) <= _bytes(limit)


def _bytes(text: str) -> int:
    """A size setting as a number of bytes."""
    number = text.lower().rstrip("b")
    unit = number[-1:] if number[-1:] in "kmgt" else ""
    return int(number.removesuffix(unit)) << 10 * (" kmgt".index(unit) if unit else 0)


def folded(tables: Mapping[str, DataFrame], wide: Wide) -> list[tuple[Join, DataFrame]]:
    """The joins that the fact takes part in, each with its dimension.

    A left join whose key comes from an earlier left join is done within that dimension
    beforehand, if that dimension is too large to broadcast. The rows are the same, but the
    fact is not shuffled by the later key, which is often an uneven one. A salted join stays
    salted there. Dimensions that are broadcast stay a chain, in which the fact is not
    shuffled at all.
    """
    joins = list(wide.joins)
    frames = [tables[j.table].select(*dict.fromkeys((j.right, *j.columns))) for j in joins]
    for at in reversed(range(len(joins))):
        join = joins[at]
        owner = next((i for i in range(at) if join.left in joins[i].columns), None)
        if owner is None:
            continue
        before = joins[owner]
        if {join.how, before.how} != {"left"} or before.right in join.columns:
            continue
        if _fits_broadcast(frames[owner]):
            continue
        # The fact's columns are not there to salt by, but the owner's key is.
        salted = replace(join, spread_by=(before.right,)) if join.spread != 1 else join
        frames[owner] = attach(frames[owner], frames[at], salted)
        joins[owner] = replace(before, columns=(*before.columns, *join.columns))
        joins[at] = None
    return [(j, f) for j, f in zip(joins, frames) if j is not None]


def widen(tables: Mapping[str, DataFrame], wide: Wide) -> DataFrame:
    """Fact with all joins in declared order; a left key may come from an earlier join."""
    df = tables[wide.main].drop(*wide.drop)
    order = [*df.columns, *[c for j in wide.joins for c in j.columns]]
    for join, dimension in folded(tables, wide):
        df = attach(df, dimension, join)
    df = df.select(*[f"`{c}`" for c in order])
    derived = [f"{text} as `{name}`" for name, text in wide.derived]
    return df.selectExpr("*", *derived) if derived else df


def union_feeds(
    feeds: Mapping[str, DataFrame],
    columns: tuple[str, ...],
    doc_parts: Mapping[str, tuple[str, ...]],
    type_column: str = "entry_type",
    doc_column: str = "doc_no",
) -> DataFrame:
    """Stacks several fact feeds into one ledger.

    Every feed is labelled with its event type and gets a document number composed
    of the columns in `doc_parts`; columns a feed lacks are NULL.
    """
    parts = []
    for label, feed in feeds.items():
        present = [c for c in columns if c in feed.columns]
        parts.append(
            feed.select(
                F.lit(label).alias(type_column),
                F.concat_ws(FEED_SEPARATOR, *doc_parts[label]).alias(doc_column),
                *present,
            )
        )
    if not parts:
        raise SpecError("no feeds to stack")
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.select(type_column, doc_column, *columns)


# -- match contracts ---------------------------------------------------------
@dataclass(frozen=True)
class MatchContract:
    """What is known of a match test before it runs."""

    test: str
    wide: str
    table: str
    field: str
    rule: str
    level: str


def match_contracts(wide: Wide) -> list[MatchContract]:
    out = []
    for join in wide.joins:
        for rule, level in (
            ("fanout", join.fanout),
            ("null_match", join.null_match),
            ("orphan_right", join.orphan_right),
        ):
            if level == "ignore":
                continue
            # Orphans never stop a run; a level other than red is a warning.
            shown = "red" if level == "red" and rule != "orphan_right" else "yellow"
            name = f"match_{join.table}_{rule}"
            out.append(MatchContract(name, wide.name, join.table, join.left, rule, shown))
    return out


def fanout_keys(dimension: DataFrame, key: str) -> DataFrame:
    """Keys of a dimension that occur more than once: each would multiply fact rows.
    A NULL key joins nothing, yet its repetition is reported like any other."""
    counted = dimension.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return counted.where(F.col("__n") > 1)


def unmatched_keys(fact: DataFrame, left: str, dimension: DataFrame, right: str) -> DataFrame:
    """Distinct non-NULL fact keys without a row in the dimension."""
    keys = fact.select(left).where(F.col(left).isNotNull()).distinct()
    known = dimension.select(F.col(right).alias("__known"))
    return keys.join(known, F.col(left) == F.col("__known"), "left_anti")


def orphan_keys(dimension: DataFrame, right: str, fact: DataFrame, left: str) -> DataFrame:
    """Distinct dimension keys that no fact row uses. Both sides are made distinct
    first, so a hot fact key reaches the join as a single row."""
    keys = dimension.select(right).distinct()
    used = fact.select(F.col(left).alias("__used")).where(F.col(left).isNotNull()).distinct()
    return keys.join(used, F.col(right) == F.col("__used"), "left_anti")


def match_failures(
    wide_df: DataFrame | None,
    tables: Mapping[str, DataFrame],
    wide: Wide,
    contract: MatchContract,
) -> DataFrame:
    """The offending keys of one match contract, as text in column `key`."""
    join = next(
        j for j in wide.joins if j.table == contract.table and j.left == contract.field
    )
    dimension = tables[join.table]
    if contract.rule == "fanout":
        keys = fanout_keys(dimension, join.right).select(join.right)
    elif contract.rule == "null_match":
        keys = unmatched_keys(wide_df, join.left, dimension, join.right)
    else:
        # The main fact lacks the key of a chained join; the wide table has it.
        main = tables[wide.main]
        fact = main if join.left in main.columns else wide_df
        keys = orphan_keys(dimension, join.right, fact, join.left)
    return keys.select(F.col(keys.columns[0]).cast("string").alias("key"))


def match_results(
    wide_df: DataFrame | None,
    tables: Mapping[str, DataFrame],
    wide: Wide,
    rules: tuple[str, ...] = MATCH_RULES,
) -> DataFrame:
    """One row per match contract, broken or not: test, source (the wide table),
    field, rule, level, cnt (offending keys), sample. Fan-out alone can be judged
    before the wide table exists."""
    parts = []
    for contract in match_contracts(wide):
        if contract.rule not in rules:
            continue
        failures = match_failures(wide_df, tables, wide, contract)
        shown = F.concat(
            F.lit(f"{contract.table}: "),
            F.col("cnt"),
            F.lit(" keys, first "),
            F.coalesce("first", F.lit("NULL")),
        )
        parts.append(
            failures.agg(F.count(F.lit(1)).alias("cnt"), F.min("key").alias("first")).select(
                F.lit(contract.test).alias("test"),
                F.lit(contract.wide).alias("source"),
                F.lit(contract.field).alias("field"),
                F.lit(contract.rule).alias("rule"),
                F.lit(contract.level).alias("level"),
                "cnt",
                F.substring(shown, 1, SAMPLE_LENGTH).alias("sample"),
            )
        )
    if parts:
        return reduce(DataFrame.unionByName, parts)
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(
        [],
        "test string, source string, field string, rule string, level string, "
        "cnt bigint, sample string",
    )


def match_violations(
    wide_df: DataFrame, tables: Mapping[str, DataFrame], wide: Wide
) -> DataFrame:
    """Ledger rows of the broken match contracts."""
    results = match_results(wide_df, tables, wide)
    return results.where(F.col("cnt") > 0).drop("test")
