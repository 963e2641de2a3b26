"""Finding the file of every declared feed in an inbox folder."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from reportloom.spec import Source

READABLE = (".csv",)


def list_files(spark: SparkSession, inbox: str) -> DataFrame:
    """Path, file name, time and size of what was dropped in a folder, empty files included,
    as the session's file system lists them: one row per drop of the inbox.

    A drop is a file, or a folder of part files that has the name of a readable file.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(inbox)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    rows = []
    for entry in files.listStatus(folder):
        name = entry.getPath().getName()
        if not entry.isFile() and not name.lower().endswith(READABLE):
            continue
        size = entry.getLen() if entry.isFile() else files.getContentSummary(entry.getPath()).getLength()
        rows.append((entry.getPath().toString(), name, entry.getModificationTime(), size))
    listed = spark.createDataFrame(rows, "path string, file string, ms bigint, length bigint")
    return listed.select("path", "file", F.timestamp_millis("ms").alias("modified"), "length")


def matches(files: DataFrame, sources: Iterable[Source]) -> DataFrame:
    """Files with each feed and pattern that they fit: the files' columns, source,
    pattern_no, pattern. Of the patterns of a feed that a file fits, the first counts."""
    patterns = F.array(
        *[
            F.struct(
                F.lit(s.name).alias("source"),
                F.lit(i).alias("pattern_no"),
                F.lit(pattern).alias("pattern"),
                F.lit("^" + fnmatch.translate(pattern)).alias("regex"),
            )
            for s in sources
            for i, pattern in enumerate(s.file_patterns)
        ]
    )
    fitting = F.filter(patterns, lambda p: F.regexp_like(F.col("file"), p["regex"]))
    first = F.filter(
        fitting,
        lambda p: ~F.exists(
            fitting, lambda q: (q["source"] == p["source"]) & (q["pattern_no"] < p["pattern_no"])
        ),
    )
    return files.select("*", F.inline(first)).drop("regex")


def discover(files: DataFrame, sources: Iterable[Source]) -> DataFrame:
    """Files that match a feed's patterns: source, pattern_no, pattern, path, file,
    length, modified, chosen.

    Only hits of the first pattern with any hit are kept; the newest of them (by
    name among equals) is chosen, the others are listed with chosen = false. Empty files
    compete by their time like all others.
    """
    hits = matches(files, sources)
    first = hits.groupBy("source").agg(F.min("pattern_no").alias("pattern_no"))
    newest = Window.partitionBy("source").orderBy(F.desc_nulls_last("modified"), F.asc("file"))
    return (
        hits.join(first, ["source", "pattern_no"])
        .withColumn("chosen", F.row_number().over(newest) == 1)
        .select(
            "source", "pattern_no", "pattern", "path", "file", "length", "modified", "chosen"
        )
    )


def ignored_matches(found: DataFrame) -> DataFrame:
    """One yellow problem per feed whose pattern matched more than one file."""
    others = F.array_join(
        F.array_sort(F.collect_list(F.when(~F.col("chosen"), F.col("file")))), ", "
    )
    return (
        found.groupBy("source")
        .agg(
            F.count(F.lit(1)).alias("hits"),
            F.max(F.when(F.col("chosen"), F.col("file"))).alias("newest"),
            others.alias("others"),
        )
        .where(F.col("hits") > 1)
        .select(
            "source",
            F.lit("-").alias("field"),
            F.lit("multi_match").alias("rule"),
            F.lit("yellow").alias("level"),
            F.lit(0).cast("bigint").alias("cnt"),
            F.concat(F.lit("took "), "newest", F.lit(", ignored "), "others").alias("sample"),
        )
    )
