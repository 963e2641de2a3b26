"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reportloom.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """One row per linked number: id and root, the smallest number that it reaches.

    links: pairs a, b of numbers, in any direction, repeated or not.

    Each round first links all larger neighbours of a number to the smallest one, then all
    neighbours of a number that are not larger. Paths shorten exponentially, and links
    become stars, so even a hot number only has as many rows as it has members, which are
    reduced to a minimum within tasks. Rounds end when all links are stars: every number
    has one root, and no root has one itself.
    """
    edges = stored(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a <> b")
        .distinct(),
        "links",
    )
    while True:
        edges = stored(_small_star(_large_star(edges)), "stars")
        ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("up")).unionByName(
            edges.select(F.col("b").alias("id"), F.lit(0).alias("up"))
        )
        both = ends.groupBy("id").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
        if both.where("ups > 1 or (ups = 1 and least = 0)").isEmpty():
            break
    roots = edges.select(F.col("b").alias("id")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(
        roots.select("id", F.col("id").alias("root"))
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of every number go to the smallest of it and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    # Links where b > a: each larger neighbour b of a goes to a's minimum.
    larger = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    moved = larger.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """The number and its smaller neighbours go to the smallest of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return moved.unionByName(own).where("a <> b").distinct()
