"""The inbox as a stream: every start takes in the files that are new since the last one.

Structured Streaming's file source remembers in its checkpoint which files it has handed
over. A micro-batch is a listing of new files, without their content; the files of a feed in
one batch are read together and go through the same cleaning and contracts as in a batch
run. What a batch gives is written below `batch_id=<n>` with overwrite, so a batch that
Spark repeats after a failure replaces what it had written and adds nothing twice. A batch
counts once its row in the table of batches is written, which is its last step; readers see
the rows of such batches only.

Unlike a batch run, which replaces a feed by its newest file, a stream adds up the files of a
feed. Uniqueness is judged within a batch. A feed without new files is no problem here.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from reportloom.operators import cleaning, contracts, problems
from reportloom.operators.contracts import LEDGER
from reportloom.sources.csv import ReadFailed, read_feed, whole_rows
from reportloom.sources.discovery import matches
from reportloom.spec import Source

# Columns of a listing by the binary file source; the content is never read.
LISTING = "path string, modificationTime timestamp, length bigint, content binary"
BATCHES = "started_at timestamp, files bigint, violations bigint, batch_id bigint"
STREAM_LEDGER = f"{LEDGER}, batch_id bigint"


class StreamedInbox:
    """Feeds of an inbox, taken in file by file below one root folder."""

    def __init__(self, spark: SparkSession, sources: Iterable[Source], inbox: str, root: str) -> None:
        self.spark = spark
        self.sources = {s.name: s for s in sources}
        self.inbox = inbox
        self.root = root.rstrip("/")

    # -- writing -------------------------------------------------------------
    def start(self, files_per_batch: int = 1000) -> int:
        """Takes in all files that are new, in batches, and returns how many batches ran."""
        listing = (
            self.spark.readStream.format("binaryFile")
            .schema(LISTING)
            .option("maxFilesPerTrigger", files_per_batch)
            .load(self.inbox)
            .select("path", F.regexp_extract("path", "[^/]*$", 0).alias("file"), "length",
                    F.col("modificationTime").alias("modified"))
        )
        ran: list[int] = []

        def take(files: DataFrame, batch_id: int) -> None:
            self.take_batch(files, batch_id)
            ran.append(batch_id)

        stream = (
            listing.writeStream.foreachBatch(take)
            .option("checkpointLocation", f"{self.root}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        stream.awaitTermination()
        return len(ran)

    def take_batch(self, files: DataFrame, batch_id: int) -> None:
        """One micro-batch: files of all feeds, then the ledger, then the batch itself.

        At most files_per_batch rows, the listing, reach the driver.
        """
        hits = matches(files, self.sources.values()).orderBy("source", "path").collect()
        by_source: dict[str, list] = {}
        for hit in hits:
            by_source.setdefault(hit["source"], []).append(hit)
        found = []
        for name, own in by_source.items():
            found += self._take_feed(self.sources[name], own, batch_id)
        rows = self.spark.createDataFrame(found, problems.PROBLEM_SCHEMA)
        ledger = contracts.ledger_rows(rows, f"batch-{batch_id}")
        self._put(ledger.coalesce(1), "ledger", batch_id)
        done = self.spark.range(1).select(
            F.current_timestamp().alias("started_at"),
            F.lit(len(hits)).cast("bigint").alias("files"),
            F.lit(len(found)).cast("bigint").alias("violations"),
        )
        self._put(done, "batches", batch_id)

    def _take_feed(self, source: Source, hits: list, batch_id: int) -> list[tuple]:
        empty = [h for h in hits if h["length"] == 0]
        full = [h for h in hits if h["length"] > 0]
        found = [
            problems.problem(source.name, "read_failed", "red", f"{h['file']} has zero bytes")
            for h in empty
        ]
        if not full:
            return found
        paths = [h["path"] for h in full]
        try:
            feed = read_feed(self.spark, paths[0], full[0]["length"], source.encodings, tuple(paths[1:]))
        except ReadFailed as failure:
            return [*found, problems.problem(source.name, "read_failed", "red", str(failure))]
        cleaned = cleaning.clean(whole_rows(feed), source.clean)
        cleaned = cleaning.skip_first_rows(cleaned, source.skip_rows)
        absent = cleaning.missing_headers(cleaned, source)
        if absent:
            level = problems.problem_level(source, "header_changed")
            return [*found, problems.problem(source.name, "header_changed", level, f"missing {absent}")]
        declared = cleaning.select_declared(cleaned, source)
        self._put(contracts.accept(declared, source), f"raw/{source.name}", batch_id)
        return found + [tuple(r) for r in contracts.violations(declared, source).collect()]

    def _put(self, df: DataFrame, table: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{table}/batch_id={batch_id}")

    # -- reading -------------------------------------------------------------
    def _table(self, table: str, schema: str | None = None) -> DataFrame:
        path = f"{self.root}/{table}"
        reader = self.spark.read.option("mergeSchema", True)
        return (reader.schema(schema) if schema else reader).parquet(path)

    def batches(self) -> DataFrame:
        """The batches that are complete."""
        try:
            return self._table("batches", BATCHES)
        except AnalysisException:
            return self.spark.createDataFrame([], BATCHES)

    def _complete(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.batches().select("batch_id"), "batch_id", "left_semi")

    def ledger(self) -> DataFrame:
        """Violations and problems of all complete batches."""
        try:
            rows = self._table("ledger", STREAM_LEDGER)
        except AnalysisException:
            rows = self.spark.createDataFrame([], STREAM_LEDGER)
        return self._complete(rows)

    def feed(self, name: str) -> DataFrame:
        """Accepted rows of a feed from all complete batches."""
        return self._complete(self._table(f"raw/{name}"))
