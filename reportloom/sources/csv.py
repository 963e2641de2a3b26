"""Reading delimited text: every cell stays text, empty cells are NULL."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from reportloom.sources import records

BOM = "\ufeff"
# Names of encodings as declared, and as the reader knows them.
CHARSETS = {"utf-8": "UTF-8", "utf8": "UTF-8", "utf-8-sig": "UTF-8", "gbk": "GBK"}
REPLACEMENT = "\ufffd"
OVERFLOW = "_overflow"


class ReadFailed(RuntimeError):
    """The file cannot be read as declared."""


@dataclass(frozen=True)
class TextFacts:
    """What one pass over a file's lines tells about how to read it."""

    lines: int
    valid_utf8: bool
    open_quotes: bool
    header: str


def literal_path(path: str) -> str:
    """A file's path with the characters escaped that a reader takes for a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


Paths = str | list[str]


def examine(spark: SparkSession, path: Paths) -> TextFacts:
    """Checks all lines of a file, or of files read together, in parallel: are they valid UTF-8, and does a
    quoted cell run over a line end."""
    lines = spark.read.text(path)
    value = F.col("value")
    quotes = F.octet_length(value) - F.octet_length(F.replace(value, F.lit('"'), F.lit("")))
    row = lines.agg(
        F.count(F.lit(1)).alias("lines"),
        F.coalesce(F.bool_and(F.is_valid_utf8(value)), F.lit(True)).alias("valid"),
        F.coalesce(F.bool_or(quotes % 2 == 1), F.lit(False)).alias("open"),
    ).first()
    first = lines.where(value != "").select(F.make_valid_utf8(value).alias("value")).head(1)
    header = first[0]["value"] if first else ""
    return TextFacts(row["lines"], row["valid"], row["open"], header)


def charset(encoding: str) -> str:
    return CHARSETS.get(encoding.lower(), encoding)


def decodes(spark: SparkSession, path: Paths, encoding: str, facts: TextFacts) -> bool:
    """Whether the whole file is valid in an encoding."""
    if charset(encoding) == "UTF-8":
        return facts.valid_utf8
    cells = spark.read.option("encoding", charset(encoding)).option("sep", "\x01").csv(path)
    return cells.where(F.col("_c0").contains(REPLACEMENT)).limit(1).isEmpty()


def choose_encoding(
    spark: SparkSession, path: Paths, encodings: tuple[str, ...], facts: TextFacts
) -> str:
    """First declared encoding in which the file is valid."""
    for encoding in encodings:
        if decodes(spark, path, encoding, facts):
            return charset(encoding)
    raise ReadFailed(f"none of the encodings {list(encodings)} fits")


def scan_text_table(
    spark: SparkSession, path: Paths, encoding: str = "UTF-8", multi_line: bool = False
) -> DataFrame:
    """A CSV file, folder or list of files with a header as text columns plus provenance columns.

    `_overflow` holds the first cell beyond the header, so that a row that is too
    long is noticed instead of being cut. With `multi_line`, quoted cells may run over
    line ends; such files are still read by many tasks unless they have stray quotes.
    """
    reader = (
        spark.read.option("header", True)
        .option("encoding", encoding)
        .option("escape", '"')
        .option("multiLine", multi_line)
    )
    columns = [*reader.csv(path).columns, OVERFLOW]
    if multi_line and records.splittable(spark, path, encoding, columns):
        df = records.scan_records(spark, path, encoding, columns)
        file_name = F.col("__name")
    else:
        text = StructType([StructField(c, StringType()) for c in columns])
        df = reader.schema(text).csv(path)
        file_name = F.col("_metadata.file_name")
    cells = [F.nullif(df[f"`{c}`"], F.lit("")).alias(c) for c in columns]
    return df.select(
        *cells,
        file_name.alias("_source_file"),
        F.current_timestamp().alias("_loaded_at"),
    )


def whole_rows(feed: DataFrame) -> DataFrame:
    """The feed without `_overflow`. A row with more cells than the header fails the job
    that reads it."""
    if OVERFLOW not in feed.columns:
        return feed
    too_long = F.raise_error(F.lit("a row has more cells than the header"))
    first = feed.columns[0]
    return feed.withColumn(
        first, F.when(F.col(OVERFLOW).isNotNull(), too_long).otherwise(feed[f"`{first}`"])
    ).drop(OVERFLOW)


def read_feed(
    spark: SparkSession,
    path: str,
    length: int,
    encodings: tuple[str, ...],
    further: tuple[str, ...] = (),
) -> DataFrame:
    """The file of a feed, with the encoding and the line handling it needs; further files
    are read together with it if they have the same header.

    Quoted line breaks cost further passes, so they are only allowed for in files that
    have them.
    """
    if not all(p.lower().endswith(".csv") for p in (path, *further)):
        raise ReadFailed("only CSV files are read")
    if length == 0:
        raise ReadFailed("the file has zero bytes")
    paths = [literal_path(p) for p in (path, *further)]
    facts = examine(spark, paths)
    encoding = choose_encoding(spark, paths, encodings, facts)
    df = scan_text_table(spark, paths, encoding, facts.open_quotes)
    for other in paths[1:]:
        if scan_text_table(spark, other, encoding).columns != df.columns:
            raise ReadFailed("files of one feed differ in their headers")
    # The line reader drops one byte-order mark; a second one belongs to the header.
    first = df.columns[0]
    if facts.header.startswith(BOM) and not first.startswith(BOM):
        df = df.withColumnRenamed(first, BOM + first)
    return df
