"""Questions about runs, their nodes and the contract ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

RUNS_KEPT = 60
FAILED = ("error", "fail", "runtime error")
LIGHTS = ("green", "yellow", "red")


def pending_queue(ledger: DataFrame) -> DataFrame:
    """Open items: the ledger rows of the latest run."""
    latest = ledger.select(F.max("run_id")).scalar()
    return (
        ledger.where(F.col("run_id") == latest)
        .select("run_id", "source", "field", "rule", "level", "cnt", "sample")
        .orderBy(*[F.asc_nulls_last(c) for c in ("source", "field", "rule")])
    )


def severity_rank(status: str = "status"):
    state = F.col(status)
    return F.when(state.isin(*FAILED), 2).when(state == "warn", 1).otherwise(0)


def traffic_light(nodes: DataFrame) -> DataFrame:
    """Light of every run: red after any failure, yellow after any warning."""
    worst = nodes.groupBy("run_id").agg(F.max(severity_rank()).alias("worst"))
    lights = F.array(*[F.lit(x) for x in LIGHTS])
    return worst.select("run_id", lights[F.col("worst")].alias("light"))


def status_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("run_id", "status").agg(F.count(F.lit(1)).alias("nodes"))


def severity_summary(ledger: DataFrame) -> DataFrame:
    """Number of ledger rows per run and level."""
    return ledger.groupBy("run_id", "level").agg(F.count(F.lit(1)).alias("violations"))


def run_history(runs: DataFrame, keep: int = RUNS_KEPT) -> DataFrame:
    """Newest runs of every instance. The limit is applied before the shuffle, so
    an instance with most of the runs costs no more than any other."""
    newest = Window.partitionBy("instance").orderBy(
        F.desc_nulls_last("started_at"), F.desc_nulls_last("run_id")
    )
    ranked = runs.withColumn("place", F.row_number().over(newest))
    return ranked.where(F.col("place") <= keep)


def merged_history(runs: DataFrame, keep: int = RUNS_KEPT) -> DataFrame:
    """The kept runs of all instances in one list, newest first."""
    return run_history(runs, keep).drop("place").orderBy(F.desc_nulls_last("started_at"))


def latest_runs(runs: DataFrame) -> DataFrame:
    return run_history(runs, 1).drop("place")


def stale_instances(runs: DataFrame) -> DataFrame:
    """Instances whose last run was red: what they show is older data."""
    latest = latest_runs(runs)
    return latest.select("instance", "run_id", (F.col("status") == "red").alias("stale"))


def run_timeline(nodes: DataFrame) -> DataFrame:
    """Offset and duration of every node in its run, in seconds, and the run's total.

    The bounds of a run are aggregated and joined back instead of a window over
    the run, so a run with very many nodes is never held by one task.
    """
    bounds = nodes.groupBy("run_id").agg(
        F.min("started_at").alias("first"), F.max("ended_at").alias("last")
    )

    def seconds(end: str, start: str):
        micros = F.greatest(F.timestamp_diff("MICROSECOND", F.col(start), F.col(end)), F.lit(0))
        # Rounded to milliseconds as whole numbers, so that halves are exact.
        return F.floor((micros + 500) / F.lit(1000)).cast("double") / F.lit(1000.0)

    return nodes.join(bounds, "run_id").select(
        "run_id",
        "node",
        seconds("started_at", "first").alias("offset_s"),
        seconds("ended_at", "started_at").alias("duration_s"),
        seconds("last", "first").alias("total_s"),
    )


def missing_sources(declared: DataFrame, found: DataFrame) -> DataFrame:
    """Declared sources without a discovered file."""
    return declared.join(found.select("source").distinct(), "source", "left_anti")
