"""The declared report model: sources, wide table, dimensions, metrics, reports."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field as dc_field, replace
from typing import Any

from reportloom.functions.metrics import Metric, resolve

FIELD_TYPES = ("string", "date", "integer", "decimal", "bool")
LEVELS = ("ignore", "pending", "yellow", "red")
GRAINS = ("day", "week", "month", "quarter", "year")
JOIN_HOWS = ("left", "inner", "right", "full")
MAX_LAYERS = 6


class SpecError(ValueError):
    """The declared model contradicts itself."""


@dataclass(frozen=True)
class Field:
    """One column of a feed: its header in the file, its name, type and contract."""

    header: str
    name: str
    type: str = "string"
    required: bool = False
    unique: bool = False
    range: tuple[float, float] | None = None
    enum: tuple[str, ...] | None = None
    format: str | None = None
    default: Any = None
    level: str = "yellow"
    strict_integer: bool = False
    nulls_equal: bool = True
    date_formats: tuple[str, ...] = ("yyyy/M/d",)

    def __post_init__(self) -> None:
        if self.type not in FIELD_TYPES:
            raise SpecError(f"field {self.name}: unknown type {self.type}")
        if self.level not in LEVELS:
            raise SpecError(f"field {self.name}: unknown level {self.level}")


@dataclass(frozen=True)
class Source:
    """One feed. `clean` holds "trim_columns", "strip_strings" or
    {"drop_rows_if": {"col": ..., "op": "is_null"}} in the order they run."""

    name: str
    fields: tuple[Field, ...]
    patterns: tuple[str, ...] = ()
    encodings: tuple[str, ...] = ("utf-8-sig",)
    clean: tuple[Any, ...] = ("trim_columns", "strip_strings")
    problems: Mapping[str, Any] = dc_field(default_factory=dict)
    skip_rows: int = 0

    def field(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise SpecError(f"source {self.name} has no field {name}")

    @property
    def file_patterns(self) -> tuple[str, ...]:
        return self.patterns or (f"{self.name}.*",)


@dataclass(frozen=True)
class Join:
    """One ordered equi-join of the wide table and its match contract.

    `spread` above 1 salts the join: every fact key, NULL included, is divided
    over that many tasks and the dimension is copied as often. It is for
    dimensions too large to broadcast whose fact keys are very uneven. `spread_by`
    names fact columns that tell the rows of a hot key apart; without it the salt is
    taken from all columns, which then are all read.
    """

    table: str
    left: str
    right: str
    columns: tuple[str, ...] = ()
    how: str = "left"
    fanout: str = "red"
    null_match: str = "yellow"
    orphan_right: str = "ignore"
    spread: int = 1
    spread_by: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.how not in JOIN_HOWS:
            raise SpecError(f"join {self.table}: unknown kind {self.how}")
        if self.spread > 1 and self.how not in ("left", "inner"):
            raise SpecError(f"join {self.table}: only left and inner joins can be spread")


@dataclass(frozen=True)
class Wide:
    name: str
    main: str
    joins: tuple[Join, ...] = ()
    derived: tuple[tuple[str, str], ...] = ()
    drop: tuple[str, ...] = ()


@dataclass(frozen=True)
class Dimension:
    name: str
    column: str
    type: str = "category"
    grain: str = "month"

    @property
    def is_time(self) -> bool:
        return self.type == "time"

    def __post_init__(self) -> None:
        if self.is_time and self.grain not in GRAINS:
            raise SpecError(f"dimension {self.name}: unknown grain {self.grain}")


@dataclass(frozen=True)
class Report:
    key: str
    dimension: str
    metrics: tuple[str, ...]
    time_dim: str | None = None
    filters: tuple[str, ...] = ()
    base: str | None = None
    rollup: tuple[str, ...] = ()
    full_period_only: bool = False
    title: str = ""

    @property
    def own_dims(self) -> tuple[str, ...]:
        return (self.time_dim, self.dimension) if self.time_dim else (self.dimension,)


class ReportModel:
    """All declarations of one company, checked when the object is built."""

    def __init__(
        self,
        name: str,
        sources: tuple[Source, ...],
        wide: Wide,
        dimensions: tuple[Dimension, ...],
        metrics: tuple[Metric, ...],
        reports: tuple[Report, ...],
    ) -> None:
        self.name = name
        self.sources = {s.name: s for s in sources}
        self.wide = wide
        self.dimensions = {d.name: d for d in dimensions}
        self.metrics = {m.name: m for m in metrics}
        self.reports = {r.key: r for r in reports}
        self._check_wide()
        self._check_metrics()
        self._check_reports()

    # -- lookups -----------------------------------------------------------
    def report(self, key: str) -> Report:
        if key not in self.reports:
            raise SpecError(f"model {self.name} has no report {key}")
        return self.reports[key]

    def dimension(self, name: str) -> Dimension:
        if name not in self.dimensions:
            raise SpecError(f"model {self.name} has no dimension {name}")
        return self.dimensions[name]

    def metric(self, name: str) -> Metric:
        """The metric with its derived parts already folded in."""
        if name not in self.metrics:
            raise SpecError(f"model {self.name} has no metric {name}")
        return resolve(name, self.metrics)

    def children(self, key: str) -> list[Report]:
        return [r for r in self.reports.values() if r.base == key]

    def time_dimension(self, report: Report) -> Dimension | None:
        """The report's time axis: its own time_dim, else a time dimension."""
        dim = self.dimension(report.time_dim or report.dimension)
        return dim if dim.is_time else None

    def group_dims(self, key: str) -> list[str]:
        """Own dimensions, then those that the reports built on top still need."""
        self.report(key)
        return self._grains()[key]

    def _grains(self) -> dict[str, list[str]]:
        """The dimensions that each report groups by. Every report hands its own down to
        its base, the uppermost first, so one pass over the layers settles all of them."""
        grains = {key: dict.fromkeys(report.own_dims) for key, report in self.reports.items()}
        for key in reversed(self.layers()):
            base = self.reports[key].base
            if base:
                grains[base] = {**grains[base], **grains[key]}
        for key, grain in grains.items():
            report = self.reports[key]
            lacking = sorted(grain.keys() - {*report.own_dims, *report.rollup})
            if lacking:
                raise SpecError(f"rollup of report {key} lacks {lacking}, which layers above use")
        return {key: list(grain) for key, grain in grains.items()}

    def subtree_inputs(self, key: str, counted: bool = True) -> set[str]:
        """Wide columns used by the metrics of a report and of its descendants, with or
        without those that only distinct counts use."""
        inputs: set[str] = set()
        for name in self.report(key).metrics:
            metric = self.metric(name)
            if counted or metric.distinct is None:
                inputs |= set(metric.inputs)
        for child in self.children(key):
            inputs |= self.subtree_inputs(child.key, counted)
        return inputs

    def handed_on(self, key: str) -> list[str]:
        """Distinct counts of the reports built on one, whose states it hands on."""
        names: dict[str, None] = {}
        for child in self.children(key):
            own = [n for n in self.report(child.key).metrics if self.metric(n).distinct]
            names |= dict.fromkeys([*own, *self.handed_on(child.key)])
        return list(names)

    def carried(self, key: str) -> list[str]:
        """Additive columns a report hands on so its descendants can recompute."""
        needed: set[str] = set()
        for child in self.children(key):
            needed |= self.subtree_inputs(child.key, counted=False)
        return sorted(needed - set(self.group_dims(key)) - set(self.report(key).metrics))

    def layers(self) -> list[str]:
        """Report keys with every base before the reports built on it."""
        levels = self.levels()
        return sorted(levels, key=levels.get)

    def levels(self) -> dict[str, int]:
        """The number of layers below each report. Reports are added level by level, so
        one whose bases lead nowhere or in a circle is not among them."""
        levels = {key: 0 for key, report in self.reports.items() if not report.base}
        while True:
            above = {
                key: levels[report.base] + 1
                for key, report in self.reports.items()
                if key not in levels and report.base in levels
            }
            if not above:
                return levels
            levels |= above

    @property
    def wide_columns(self) -> list[str]:
        main = self.sources[self.wide.main]
        columns = [f.name for f in main.fields if f.name not in self.wide.drop]
        for join in self.wide.joins:
            columns += join.columns
        return columns + [name for name, _ in self.wide.derived]

    def narrowed(self, key: str) -> Wide:
        """The wide table as far as a report, its layers included, needs it.

        A left join is left out if none of its columns is used and its key is declared
        unique, which the contract of its feed enforces, so that no row count changes.
        """
        bottom = key
        while self.report(bottom).base:
            bottom = self.report(bottom).base
        wanted = {self.dimension(d).column for d in self.group_dims(bottom)}
        wanted |= self.subtree_inputs(bottom)
        derived = []
        for name, text in reversed(self.wide.derived):
            if name in wanted:
                derived.insert(0, (name, text))
                # Every word of the expression, so at least the columns in it.
                wanted |= set(re.findall(r"\w+", text))
        joins = []
        for join in reversed(self.wide.joins):
            safe = join.how == "left" and self.sources[join.table].field(join.right).unique
            if not safe or wanted & set(join.columns):
                joins.insert(0, join)
                wanted.add(join.left)
        return replace(self.wide, joins=tuple(joins), derived=tuple(derived))

    # -- checks ------------------------------------------------------------
    def _check_wide(self) -> None:
        wide = self.wide
        if wide.main not in self.sources:
            raise SpecError(f"wide table {wide.name}: unknown main source {wide.main}")
        main = self.sources[wide.main]
        available = {f.name for f in main.fields} - set(wide.drop)
        for join in wide.joins:
            if join.table not in self.sources:
                raise SpecError(f"join: unknown source {join.table}")
            if join.left not in available:
                raise SpecError(f"join {join.table}: left key {join.left} is not available yet")
            for column in (join.right, *join.columns):
                self.sources[join.table].field(column)
            clash = available & set(join.columns)
            if clash:
                raise SpecError(f"join {join.table}: columns {sorted(clash)} exist already")
            available |= set(join.columns)

    def _check_metrics(self) -> None:
        columns = set(self.wide_columns)
        for name in self.metrics:
            metric = self.metric(name)
            unknown = sorted(set(metric.inputs) - columns)
            if unknown:
                raise SpecError(f"metric {name} uses columns {unknown} missing in the wide table")
        for dim in self.dimensions.values():
            if dim.column not in columns:
                raise SpecError(f"dimension {dim.name}: no wide column {dim.column}")

    def _check_reports(self) -> None:
        for report in self.reports.values():
            for dim in (*report.own_dims, *report.filters, *report.rollup):
                self.dimension(dim)
            for name in report.metrics:
                self.metric(name)
            if report.time_dim and not self.dimension(report.time_dim).is_time:
                raise SpecError(f"report {report.key}: {report.time_dim} is not a time dimension")
            if report.base:
                self._check_layer(report)
        for key in self.reports:
            self.group_dims(key)
        for report in self.reports.values():
            if report.base:
                self._check_layer_columns(report)

    def _check_layer(self, report: Report) -> None:
        if report.filters:
            raise SpecError(f"report {report.key}: a layered report takes no filters")
        for name in report.metrics:
            metric = self.metric(name)
            if not (metric.additive or metric.ratio or metric.distinct):
                raise SpecError(
                    f"report {report.key}: metric {name} is neither additive, a ratio of "
                    "sums nor a distinct count, so it cannot be rebuilt from the layer below"
                )
        if report.base not in self.reports:
            raise SpecError(f"report {report.key}: unknown base {report.base}")
        level = self.levels().get(report.key)
        if level is None:
            raise SpecError(f"report {report.key}: its bases form a cycle or end at an unknown one")
        if level > MAX_LAYERS:
            raise SpecError(f"report {report.key}: more than {MAX_LAYERS} layers")

    def _check_layer_columns(self, report: Report) -> None:
        base = report.base
        outputs = {*self.group_dims(base), *self.report(base).metrics, *self.carried(base)}
        missing = [d for d in self.group_dims(report.key) if d not in outputs]
        missing += [c for c in self.carried(report.key) if c not in outputs]
        if missing:
            raise SpecError(f"report {report.key}: {missing} are not produced by {base}")
