"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken target / size of the source times. The whole
part of that number is taken for sure; the fraction makes the document a unit with a mass
of fraction * words. Units of a source are paired: at random, but so that no expectation
changes, as many words move from one to the other as it takes until one of them is empty
or full, thus settled. The other one is paired with the next unit.

Words, not documents, move, so a source keeps its sum of words exactly; only its very last
unit is rounded to the nearer end, which costs half a document at most. Groups of about GROUP units settle all but one of theirs; the
ones left over form the groups of the next level, up to one group per source. Groups are
dealt by a hash of source and document, so a large source is many groups.

Only DataFrame operations are used. Random numbers are hashes, so every run agrees.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from reportloom.llm.common import stored, uniform

GROUP = 256
WEIGHTS = (5, 2, 1)


def source_targets(
    sizes: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
) -> DataFrame:
    """One row per source: source, units, source_size, target.

    sizes: rows with source and size. Sources in code point order, null last, weigh as
    listed, again and again; together they get share times all sizes. A target stops at
    most times its source's size, and the excess goes to the others by weight until none
    is above. The driver sees one row of sums per round of that.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]),
        ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"),
    )
    sums = sizes.groupBy("source").agg(
        F.count(F.lit(1)).alias("units"), F.sum("size").alias("source_size")
    )
    sources = stored(sums.withColumn("weight", weight), "mix-sources")
    cap = F.col("source_size") * F.lit(float(most))
    full, level = None, 0.0
    while True:
        above = F.lit(False) if full is None else cap < F.col("weight") * F.lit(level)
        row = sources.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(above, F.col("source_size"))).alias("capped"),
            F.sum(F.when(~above, F.col("weight"))).alias("weight"),
            F.count(F.when(above, 1)).alias("full"),
        ).first()
        if row["full"] == full or not row["weight"]:
            break
        full = row["full"]
        level = (share * (row["all"] or 0) - most * (row["capped"] or 0)) / row["weight"]
    if row["weight"] is None and row["full"]:
        target = cap
    else:
        target = F.least(cap, F.col("weight") * F.lit(float(level)))
    return sources.select("source", "units", "source_size", target.alias("target"))


def _pair(state: Column, unit: Column, seed: str, done_type: str) -> Column:
    """The state after one more unit: its open unit and the settled ones so far."""
    none = F.array().cast(done_type)
    up = F.least(state["size"] - state["mass"], unit["mass"])
    down = F.least(state["mass"], unit["size"] - unit["mass"])
    step = F.struct(
        up.alias("up"),
        down.alias("down"),
        (uniform(seed, state["key"], unit["key"]) * (up + down) < down).alias("rises"),
    )

    def settled(u: Column, taken: Column) -> Column:
        return F.array(F.struct(u["key"].alias("key"), u["size"].alias("size"), taken.alias("up")))

    def move(s: Column) -> Column:
        moved = F.when(s["rises"], s["up"]).otherwise(-s["down"])
        old_done = F.when(s["rises"], s["up"] >= state["size"] - state["mass"]).otherwise(
            s["down"] >= state["mass"]
        )
        new_done = F.when(s["rises"], s["up"] >= unit["mass"]).otherwise(
            s["down"] >= unit["size"] - unit["mass"]
        )
        return F.struct(
            (~old_done | ~new_done).alias("open"),
            F.when(old_done, unit["key"]).otherwise(state["key"]).alias("key"),
            F.when(old_done, unit["size"]).otherwise(state["size"]).alias("size"),
            F.when(old_done, unit["mass"] - moved).otherwise(state["mass"] + moved).alias("mass"),
            F.concat(
                state["done"],
                F.when(old_done, settled(state, s["rises"])).otherwise(none),
                F.when(new_done, settled(unit, ~s["rises"])).otherwise(none),
            ).alias("done"),
        )

    opened = F.struct(
        F.lit(True).alias("open"),
        unit["key"].alias("key"),
        unit["size"].alias("size"),
        unit["mass"].alias("mass"),
        state["done"].alias("done"),
    )
    paired = F.element_at(F.transform(F.array(step), move), 1)
    return F.when(state["open"], paired).otherwise(opened)


def _settle_groups(units: DataFrame, seed: str, key_type: str) -> DataFrame:
    """One row per source and group with its open unit, if any, and the settled ones.

    Larger units come first, so that the one left over tends to be small.
    """
    done_type = f"array<struct<key:{key_type},size:bigint,up:boolean>>"
    state_type = f"struct<open:boolean,key:{key_type},size:bigint,mass:double,done:{done_type}>"
    order = F.sort_array(
        F.collect_list(F.struct((-F.col("size")).alias("order"), "key", "size", "mass"))
    )
    start = F.struct(
        F.lit(False).alias("open"),
        F.lit(None).cast(key_type).alias("key"),
        F.lit(0).cast("bigint").alias("size"),
        F.lit(0.0).alias("mass"),
        F.array().cast(done_type).alias("done"),
    ).cast(state_type)
    grouped = units.groupBy("source", "group").agg(order.alias("__units"))
    return grouped.select(
        "source",
        "group",
        F.aggregate(
            "__units", start, lambda s, u: _pair(s, u, seed, done_type).cast(state_type)
        ).alias("state"),
    )


def mix(
    df: DataFrame,
    document: str = "doc_id",
    source: str = "source",
    size: str = "size",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
    group: int = GROUP,
) -> DataFrame:
    """One row per row of the table: document, source, copies, size, source_size, target, taken.

    copies is the whole number of times that a document is taken, taken its words times
    copies. Documents without words give no words and are taken the whole part of their
    number. A null size is 0; a null source is a source. Rows that repeat a document are
    units of their own. An empty table gives no rows.
    """
    sizes = df.select(
        F.col(document).alias("__id"),
        F.col(source).alias("source"),
        F.coalesce(F.col(size).cast("long"), F.lit(0)).cast("long").alias("size"),
    )
    same = Window.partitionBy("__id").orderBy("source", "size")
    keyed = sizes.select(
        F.struct(F.col("__id").alias("id"), F.row_number().over(same).alias("row")).alias("key"),
        "source",
        "size",
    )
    keyed = stored(keyed, "mix-sizes")
    key_type = keyed.schema["key"].dataType.simpleString()
    targets = source_targets(keyed, weights, share, most)
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = keyed.join(
        targets.withColumnRenamed("source", "__source"),
        F.col("source").eqNullSafe(F.col("__source")),
    ).drop("__source")
    rates = joined.withColumn("whole", F.floor(times)).withColumn("rest", times - F.col("whole"))
    groups = F.ceil(F.col("units") / group)
    open_units = (F.col("rest") > 0) & (F.col("size") > 0)
    dealt = rates.where(open_units).select(
        "source",
        F.pmod(F.xxhash64(F.lit(seed), "key"), groups).alias("group"),
        "key",
        "size",
        (F.col("rest") * F.col("size")).alias("mass"),
    )
    most_units = targets.agg(F.max("units")).first()[0] or 0
    levels = max(1, math.ceil(math.log(max(most_units, 1), group)))
    settled = []
    for level in range(levels):
        states = stored(_settle_groups(dealt, f"{seed}-{level}", key_type), f"mix-{level}")
        settled.append(states.select(F.explode("state.done").alias("d")).select("d.key", "d.up"))
        left = states.where("state.open").select("source", "group", "state.*")
        dealt = left.select(
            "source", F.floor(F.col("group") / group).alias("group"), "key", "size", "mass"
        )
    last = dealt.select("key", (F.col("mass") * 2 >= F.col("size")).alias("up"))
    for part in settled:
        last = last.unionByName(part)
    copies = F.col("whole") + F.when(F.coalesce("up", F.lit(False)), 1).otherwise(0)
    return (
        rates.join(last, "key", "left")
        .select(
            F.col("key.id").alias(document),
            F.col("source").alias(source),
            copies.cast("long").alias("copies"),
            F.col("size").alias(size),
            "source_size",
            "target",
        )
        .withColumn("taken", F.col("copies") * F.col(size))
    )
