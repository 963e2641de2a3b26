"""Delimited text whose quoted cells run over line ends, read by many tasks.

A reader that allows for such cells takes a file as one task. Here the lines of a file
are read block by block, and the number of quotes in each line tells where records
start: a line starts a record if the quotes before it are even in number. Within a block
that is a running sum; between blocks it is a sum over one row per block. Lines that are
a record of their own stay as they are, only the others are grouped. The records are
then parsed by Spark.

Counting quotes is right as long as quotes within a cell are doubled. A stray quote
(`5" pipe`) is a plain character to the parser, yet counts here. `splittable` finds files
where the two disagree; they have to be read in one piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# A record beyond this size is no row of a feed but the work of a stray quote.
RECORD_BYTES = 64 << 20
RETURN = "\r"


def numbered_lines(spark: SparkSession, path: str | list[str], encoding: str) -> DataFrame:
    """The lines of files with their places: file, name, block, at, line, odd (whether the
    line has an odd number of quotes), bytes, text (whether it is not empty), returning
    (whether it ends with a carriage return). `at` orders the lines of a block. What is known
    of a line stands beside it, so that steps that need no more do not shuffle the text."""
    value = F.col("value")
    line = value if encoding == "UTF-8" else F.decode(value.cast("binary"), encoding)
    quotes = F.octet_length("line") - F.octet_length(F.replace("line", F.lit('"'), F.lit("")))
    return (
        spark.read.option("lineSep", "\n")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_name").alias("name"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("at"),
            line.alias("line"),
        )
        .withColumns(
            {
                "odd": quotes % 2,
                "bytes": F.octet_length("line").cast("bigint"),
                "text": ~F.col("line").isin("", RETURN),
                "returning": F.endswith("line", F.lit(RETURN)),
            }
        )
    )


def record_lines(lines: DataFrame) -> DataFrame:
    """The lines with the record that each belongs to: its number within the file (from
    1), whether the line is `whole` (a record of its own), whether the record is the
    `header` (the first that is not empty), `unclosed` (the file ends within quotes) and
    `returns` (the file's first line ends with a carriage return, so all are taken to)."""
    ordered = Window.partitionBy("file", "block").orderBy("at")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    # Both cases are kept side by side: the block begins outside quotes, or within.
    placed = (
        lines.withColumn("turned", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
        .withColumn("outside", F.sum(1 - F.col("turned")).over(upto))
        .withColumn("inside", F.sum("turned").over(upto))
    )
    blocks = placed.groupBy("file", "block").agg(
        F.sum("odd").alias("odds"),
        F.max("outside").alias("outsides"),
        F.max("inside").alias("insides"),
        F.min(F.when(F.col("text"), F.col("outside"))).alias("first_text"),
        F.min_by("returning", "at").alias("returning"),
    )
    # One row per block of a file, so even a very large file is a short list here.
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    whole_file = Window.partitionBy("file").orderBy("block").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    started = F.when(F.col("open") == 0, F.col("outsides")).otherwise(F.col("insides"))
    known = (
        blocks.withColumn("open", F.coalesce(F.sum("odds").over(earlier), F.lit(0)) % 2)
        .withColumn("offset", F.coalesce(F.sum(started).over(earlier), F.lit(0)))
        .select(
            "file",
            "block",
            "open",
            "offset",
            F.min(F.col("offset") + F.col("first_text")).over(whole_file).alias("first_record"),
            (F.sum("odds").over(whole_file) % 2 == 1).alias("unclosed"),
            F.first("returning").over(whole_file).alias("returns"),
        )
    )
    begins = F.col("turned") == F.col("open")
    number = F.when(F.col("open") == 0, F.col("outside")).otherwise(F.col("inside"))
    return (
        placed.drop("text", "returning")
        .join(known, ["file", "block"])
        .withColumn("record", F.col("offset") + number)
        .select(
            "file",
            "name",
            "block",
            "at",
            "line",
            "bytes",
            "record",
            (begins & (F.col("odd") == 0)).alias("whole"),
            (F.col("record") == F.col("first_record")).alias("header"),
            "unclosed",
            "returns",
        )
    )


def records(lines: DataFrame) -> DataFrame:
    """Text of each record, its line ends included: name, header, record. In files whose
    lines end with carriage returns, line ends become plain ones."""
    # The name is no key, so both branches need the same columns and read one shuffled table.
    joined = (
        lines.where(~F.col("whole"))
        .groupBy("file", "record", "header", "returns")
        .agg(
            F.min("name").alias("name"),
            F.array_sort(F.collect_list(F.struct("block", "at", "line"))).alias("parts"),
        )
        .select("name", "header", "returns", F.array_join("parts.line", "\n").alias("record"))
    )
    alone = lines.where("whole").select("name", "header", "returns", F.col("line").alias("record"))
    plain = F.regexp_replace("record", r"\r(\n|\z)", "$1")
    return (
        alone.unionByName(joined)
        .select("name", "header", F.when(F.col("returns"), plain).otherwise(F.col("record")).alias("record"))
        .where(F.col("record") != "")
    )


def parsed(found: DataFrame, columns: list[str]) -> DataFrame:
    """The records as cells of text, named by place: name, header, record, cells. A line
    end is a plain character here, also outside quotes."""
    # Headers may hold any character, so their names stay out of the schema's text.
    schema = ", ".join(f"{cell} string" for cell in cell_names(columns))
    return found.withColumn("cells", F.from_csv("record", schema, {"escape": '"'}))


def cell_names(columns: list[str]) -> list[str]:
    return [f"c{i}" for i in range(len(columns))]


def splittable(
    spark: SparkSession, path: str | list[str], encoding: str, columns: list[str]
) -> bool:
    """Whether counting quotes finds the records that the parser finds: quotes are closed,
    no record is too large, and every line end within a record lies in one of its cells.
    Files that have carriage returns within their lines, or as line ends, are refused."""
    numbered = numbered_lines(spark, path, encoding)
    if not numbered.where(F.col("line").rlike(r"\r.")).limit(1).isEmpty():
        return False
    lines = record_lines(numbered)
    sizes = (
        lines.where(~F.col("whole"))
        .groupBy("file", "record")
        .agg(
            F.sum("bytes").alias("bytes"),
            F.bool_or("unclosed").alias("unclosed"),
        )
    )
    if not sizes.where((F.col("bytes") > RECORD_BYTES) | F.col("unclosed")).limit(1).isEmpty():
        return False

    # Each cell with line ends is taken out of the record as it is written within quotes.
    # What is left has a line end only if one lies outside quotes.
    several = parsed(records(lines.where(~F.col("whole"))), columns)
    cells = F.filter(
        F.array(*[F.col("cells")[c] for c in cell_names(columns)]),
        lambda cell: F.contains(cell, F.lit("\n")),
    )
    rest = F.aggregate(
        cells,
        F.concat(F.lit(","), "record"),
        lambda text, cell: F.replace(text, quoted(cell), F.lit("")),
    )
    return several.where(F.contains(rest, F.lit("\n"))).limit(1).isEmpty()


def quoted(cell: Column) -> Column:
    """A cell as it stands in its record, with the separator before it."""
    inner = F.replace(cell, F.lit('"'), F.lit('""'))
    return F.concat(F.lit(',"'), inner, F.lit('"'))


def scan_records(
    spark: SparkSession, path: str | list[str], encoding: str, columns: list[str]
) -> DataFrame:
    """The cells of all records but the headers, with the name of their file in `__name`."""
    found = records(record_lines(numbered_lines(spark, path, encoding)))
    cells = parsed(found.where(~F.col("header")), columns)
    return cells.select(
        *[F.col("cells")[c].alias(n) for c, n in zip(cell_names(columns), columns)],
        F.col("name").alias("__name"),
    )
