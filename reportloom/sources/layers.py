"""The stored layers of a model: raw, staging, intermediate, marts, and the ledger."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from reportloom.operators.contracts import LEDGER

LAYERS = ("raw", "staging", "intermediate", "marts")
LEDGER_TABLE = "contract_report"
RUN_TABLE = "run_history"
NODE_TABLE = "run_nodes"
VERSION, MARKER = "version=", "published-"
RUNS = "instance string, run_id string, started_at timestamp, ended_at timestamp, status string"
NODES = (
    "run_id string, node string, status string, failures bigint, message string, "
    "started_at timestamp, ended_at timestamp"
)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder that all executors can reach: under the session's checkpoint
    folder, or, where none is set, under the warehouse, which they share as well."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


class Layers:
    """Parquet tables below one root folder, one folder per layer and table.

    A table is a folder of numbered versions. Writing makes a new version; it becomes the
    table when an empty marker file with its number is put beside it, which is one step of
    the file system. So a write that fails, or a driver that is lost at any time, leaves
    the former version in place. Readers take the highest marked number. `clean_up` removes
    what no reader can need; one run at a time writes to a root.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, layer: str, name: str) -> str:
        """The folder of a table, which holds its versions."""
        if layer not in LAYERS:
            raise ValueError(f"unknown layer {layer}")
        return f"{self.root}/{layer}/{name}"

    def _folder(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        folder, files = self._folder(path)
        return [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []

    def versions(self, layer: str, name: str) -> tuple[list[int], list[int]]:
        """Numbers of the versions that are written or begun, and of those marked."""
        names = self._names(self.path(layer, name))
        return tuple(
            sorted(int(n[len(start) :]) for n in names if n.startswith(start))
            for start in (VERSION, MARKER)
        )

    def current(self, layer: str, name: str) -> str:
        """Where the rows of a table are; a folder without versions is a table itself."""
        marked = self.versions(layer, name)[1]
        path = self.path(layer, name)
        return f"{path}/{VERSION}{marked[-1]}" if marked else path

    def write(
        self, df: DataFrame, layer: str, name: str, partition_by: str | None = None
    ) -> int:
        """Writes a new version beside the stored one, which stays the table until the new
        one is published."""
        written, marked = self.versions(layer, name)
        version = max([0, *written, *marked]) + 1
        writer = df.write.partitionBy(partition_by) if partition_by else df.write
        writer.parquet(f"{self.path(layer, name)}/{VERSION}{version}")
        return version

    def publish(self, layer: str, name: str, version: int) -> None:
        """Makes a written version the table."""
        marker, files = self._folder(f"{self.path(layer, name)}/{MARKER}{version}")
        files.create(marker, True).close()

    def replace(
        self, df: DataFrame, layer: str, name: str, partition_by: str | None = None
    ) -> DataFrame:
        """Writes a whole table anew and returns it as read back."""
        self.publish(layer, name, self.write(df, layer, name, partition_by))
        return self.read(layer, name)

    def read(self, layer: str, name: str) -> DataFrame:
        return self.spark.read.parquet(self.current(layer, name))

    def clean_up(self, keep: int = 2) -> list[str]:
        """Removes unpublished versions and all but the last published ones, for readers
        that still use the one before. Returns the removed folders."""
        removed = []
        for layer in LAYERS:
            for name in self._names(f"{self.root}/{layer}"):
                written, marked = self.versions(layer, name)
                for version in written:
                    if version not in marked[-keep:]:
                        path = f"{self.path(layer, name)}/{VERSION}{version}"
                        # The marker goes first: a marked version is always a whole one.
                        for target in (f"{self.path(layer, name)}/{MARKER}{version}", path):
                            folder, files = self._folder(target)
                            files.delete(folder, True)
                        removed.append(path)
        return removed

    def append_ledger(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path("raw", LEDGER_TABLE))

    def ledger(self) -> DataFrame:
        """All ledger rows so far; empty before the first run."""
        return self._log(LEDGER_TABLE, LEDGER)

    def append_run(self, run: DataFrame, nodes: DataFrame) -> None:
        run.coalesce(1).write.mode("append").parquet(self.path("raw", RUN_TABLE))
        nodes.coalesce(1).write.mode("append").parquet(self.path("raw", NODE_TABLE))

    def runs(self) -> DataFrame:
        return self._log(RUN_TABLE, RUNS)

    def nodes(self) -> DataFrame:
        return self._log(NODE_TABLE, NODES)

    def _log(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(self.path("raw", name))
        except AnalysisException:
            return self.spark.createDataFrame([], schema)


def catalogue(spark: SparkSession, tables: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """Column names and types of the given (layer, name) tables."""
    rows = [
        (layer, name, position, field.name, field.dataType.simpleString())
        for (layer, name), df in tables.items()
        for position, field in enumerate(df.schema, 1)
    ]
    schema = "layer string, table_name string, position int, column_name string, type string"
    return spark.createDataFrame(rows, schema)


def export_report(rows: DataFrame, path: str, note: str | None = None) -> None:
    """A queried report as CSV files with headers, one per task that has rows of it. A
    note, such as a warning of old data, becomes a leading column."""
    if note:
        rows = rows.select(F.lit(note).alias("note"), "*")
    rows.write.mode("overwrite").option("header", True).csv(path)
