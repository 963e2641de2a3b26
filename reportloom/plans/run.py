"""One batch run: inbox files to raw tables, ledger, wide table and reports.

What is collected to the driver is one row per feed, rule, test or report. All
data moves through tables in the layers, so a lost executor costs only the tasks
it was running. The wide table is written once because every report reads it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Observation, Row, SparkSession, functions as F

from reportloom.operators import cleaning, contracts, problems, recon
from reportloom.operators.contracts import LEDGER
from reportloom.operators.marts import build_mart, build_states
from reportloom.operators.membership import STORED, membership
from reportloom.operators.staging import stage, staging_tests
from reportloom.operators.wide import match_results, widen
from reportloom.sources.csv import ReadFailed, read_feed, whole_rows
from reportloom.sources.discovery import discover, ignored_matches, list_files
from reportloom.sources.layers import NODES, RUNS, Layers
from reportloom.spec import ReportModel, Source

PARALLEL = 4


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


@dataclass
class RunRecord:
    run_id: str
    nodes: list[tuple] = field(default_factory=list)
    findings: list[tuple] = field(default_factory=list)
    light: str = "green"

    def note(self, node: str, status: str, failures: int = 0, message: str = "", began=None):
        ended = _now()
        self.nodes.append(
            (self.run_id, node, status, failures, message, began or ended, ended)
        )

    @property
    def red(self) -> bool:
        return any(level == "red" for _, _, _, level, _, _ in self.findings)

    def statuses(self, prefix: str = "") -> set[str]:
        return {n[2] for n in self.nodes if n[1].startswith(prefix)}

    def node_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.nodes, NODES)


# -- ingest ------------------------------------------------------------------
def ingest_feed(feed: DataFrame, source: Source, layers: Layers) -> list[tuple]:
    """Cleans, checks and stores one feed; returns its problems and violations.

    All counts are observed while the rows are written beside the stored table, and it
    takes that table's place only if rows are left. Only if something was broken, the
    broken fields are read once more for the samples.
    """
    feed = whole_rows(feed)
    arrived = Observation()
    counted = feed.observe(arrived, F.count(F.lit(1)).alias("raw_rows"))
    cleaned = cleaning.skip_first_rows(cleaning.clean(counted, source.clean), source.skip_rows)
    absent = cleaning.missing_headers(cleaned, source)
    if absent:
        level = problems.problem_level(source, "header_changed")
        return [problems.problem(source.name, "header_changed", level, f"missing {absent}")]
    declared = cleaning.select_declared(cleaned, source)
    judged = Observation()
    counts = [column for _, column in contracts.rule_counts(source.fields)]
    watched = declared.observe(judged, *contracts.row_statistics(source.fields), *counts)
    version = layers.write(contracts.accept(watched, source), "raw", source.name)

    raw_rows, seen = arrived.get["raw_rows"], judged.get
    for rule, rows, detail in (
        ("empty_file", raw_rows, "no data rows"),
        ("empty_after_clean", seen["kept"], "no rows left"),
    ):
        if not rows:
            level = problems.problem_level(source, rule)
            return [problems.problem(source.name, rule, level, detail)]
    layers.publish("raw", source.name, version)
    statistics = declared.sparkSession.createDataFrame(
        [(raw_rows, seen["dropped"], seen["kept"], seen["unparsed"])],
        "raw_rows bigint, dropped bigint, kept bigint, unparsed bigint",
    )
    found = [tuple(r) for r in problems.table_problems(statistics, source).collect()]
    broken = {
        rule.field
        for rule, _ in contracts.rule_counts(source.fields)
        if seen[f"{rule.field}__{rule.name}"]
    }
    suspects = tuple(f for f in source.fields if f.unique or f.name in broken)
    if suspects:
        rows = contracts.violations(declared, replace(source, fields=suspects))
        found += [tuple(r) for r in rows.collect()]
    return found


def ingest_source(
    spark: SparkSession, source: Source, hit: Row | None, layers: Layers
) -> list[tuple]:
    """Findings of one feed, whatever happens to it."""
    try:
        if hit is None:
            level = problems.problem_level(source, "file_missing")
            detail = f"nothing fits {source.file_patterns}"
            return [problems.problem(source.name, "file_missing", level, detail)]
        feed = read_feed(spark, hit["path"], hit["length"], source.encodings)
        return ingest_feed(feed, source, layers)
    except ReadFailed as failure:
        return [problems.problem(source.name, "read_failed", "red", str(failure))]
    except Exception as failure:  # noqa: BLE001 - recorded, and the run turns red
        detail = f"{type(failure).__name__}: {failure}"
        return [problems.problem(source.name, "ingest_crashed", "red", detail)]


def ingest(
    spark: SparkSession, model: ReportModel, inbox: str, layers: Layers, record: RunRecord
) -> None:
    """All feeds of a model, several at a time. One that crashes does not stop the
    others."""
    sources = list(model.sources.values())
    found = discover(list_files(spark, inbox), sources)
    hits = [tuple(r) for r in ignored_matches(found).collect()]
    record.findings += hits
    chosen = {r["source"]: r for r in found.where("chosen").collect()}

    def one(source: Source) -> tuple[dt.datetime, list[tuple]]:
        return _now(), ingest_source(spark, source, chosen.get(source.name), layers)

    with ThreadPoolExecutor(PARALLEL) as pool:
        for source, (began, rows) in zip(sources, pool.map(one, sources)):
            record.findings += rows
            red = any(r[3] == "red" for r in rows)
            status = "error" if red else "success"
            record.note(f"raw.{source.name}", status, len(rows), began=began)


# -- build -------------------------------------------------------------------
def _tests(record: RunRecord, rows: list, level_of: Callable) -> bool:
    """Notes the tests; whether one fails as an error."""
    failed = False
    for row in rows:
        name, failures, error = level_of(row)
        status = "success" if failures == 0 else ("fail" if error else "warn")
        record.note(f"test.{name}", status, failures)
        failed |= status == "fail"
    return failed


def build(
    spark: SparkSession,
    model: ReportModel,
    layers: Layers,
    record: RunRecord,
    as_of: dt.date | None = None,
) -> None:
    """Staging, wide table, match contracts, reports and their reconciliation. A test
    that fails as an error keeps everything that depends on it from being built."""
    tables = {s.name: stage(layers.read("raw", s.name), s) for s in model.sources.values()}
    with ThreadPoolExecutor(PARALLEL) as pool:
        tested = pool.map(
            lambda name: staging_tests(tables[name], model.sources[name]).collect(), tables
        )
    wide = model.wide
    joined = {name: tables[name] for name in {wide.main, *[j.table for j in wide.joins]}}
    broken = False
    for name, rows in zip(tables, tested):
        failed = _tests(
            record,
            rows,
            lambda r: (
                f"{r['test']}_{r['source']}_{r['field']}",
                r["failures"],
                r["severity"] == "error",
            ),
        )
        # A source that is not joined keeps nothing from being built.
        broken |= failed and name in joined

    def match(wide_df: DataFrame | None, rules: tuple[str, ...]) -> bool:
        rows = match_results(wide_df, joined, wide, rules).collect()
        failed = _tests(record, rows, lambda r: (r["test"], r["cnt"], r["level"] == "red"))
        record.findings += [
            (r["source"], r["field"], r["rule"], r["level"], r["cnt"], r["sample"])
            for r in rows
            if r["cnt"]
        ]
        return failed

    broken |= match(None, ("fanout",))
    if broken:
        record.note(f"intermediate.{wide.name}", "skipped")
        for key in model.layers():
            record.note(f"marts.{key}", "skipped")
        return
    began = _now()
    wide_df = layers.replace(widen(joined, wide), "intermediate", wide.name)
    record.note(f"intermediate.{wide.name}", "success", began=began)
    blocked = match(wide_df, ("null_match", "orphan_right"))
    build_reports(model, layers, record, wide_df, blocked, as_of)


def build_reports(
    model: ReportModel,
    layers: Layers,
    record: RunRecord,
    wide_df: DataFrame,
    blocked: bool = False,
    as_of: dt.date | None = None,
) -> None:
    """All reports, bottom layer first; those of one layer are built side by side."""
    halted: set[str] = set()

    def one(key: str) -> None:
        report = model.report(key)
        if blocked or report.base in halted:
            halted.add(key)
            record.note(f"marts.{key}", "skipped")
            return
        began = _now()
        try:
            below, states = wide_df, {}
            if report.base:
                below = layers.read("marts", report.base)
                states = {
                    name: layers.read("marts", f"{report.base}.{name}")
                    for name in model.handed_on(report.base)
                }
            for name, state in build_states(model, key, below, states, as_of).items():
                layers.replace(state, "marts", f"{key}.{name}")
            if report.filters:
                pairs = membership(model, key, wide_df)
                layers.replace(pairs, "marts", STORED.format(key))
            mart = layers.replace(build_mart(model, key, below, as_of, states), "marts", key)
        except Exception as failure:  # noqa: BLE001 - recorded, and the run turns red
            halted.add(key)
            record.note(f"marts.{key}", "error", message=str(failure), began=began)
            return
        record.note(f"marts.{key}", "success", began=began)
        if report.base:
            gaps = recon.reconcile(model, key, below, mart)
            if gaps is not None:
                failures = gaps.count()
                record.note(f"test.recon_{key}", "fail" if failures else "success", failures)
                if failures:
                    halted.add(key)

    by_depth: dict[int, list[str]] = {}
    for key, depth in model.levels().items():
        by_depth.setdefault(depth, []).append(key)
    with ThreadPoolExecutor(PARALLEL) as pool:
        for level in sorted(by_depth):
            list(pool.map(one, by_depth[level]))


def run(
    spark: SparkSession,
    model: ReportModel,
    inbox: str,
    root: str,
    run_id: str,
    as_of: dt.date | None = None,
) -> RunRecord:
    """A whole run. Any red finding of the ingest keeps the reports as they were."""
    layers = Layers(spark, root)
    layers.clean_up()
    record = RunRecord(run_id)
    began = _now()
    ingest(spark, model, inbox, layers, record)
    gated = record.red
    if not gated:
        try:
            build(spark, model, layers, record, as_of)
        except Exception as failure:  # noqa: BLE001 - recorded, and the run turns red
            record.note("build", "error", message=f"{type(failure).__name__}: {failure}")
    if record.findings:
        found = spark.createDataFrame(record.findings, problems.PROBLEM_SCHEMA)
        layers.append_ledger(contracts.ledger_rows(found, run_id).coalesce(1))
    states = record.statuses()
    if gated or states & {"error", "fail"}:
        record.light = "red"
    elif "warn" in states:
        record.light = "yellow"
    entry = [(model.name, run_id, began, _now(), record.light)]
    layers.append_run(spark.createDataFrame(entry, RUNS), record.node_frame(spark))
    return record


__all__ = ["LEDGER", "RunRecord", "build", "build_reports", "ingest", "ingest_feed", "run"]
