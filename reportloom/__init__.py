"""Governed management reporting as Spark DataFrame jobs."""

from reportloom.spec import (
    Dimension,
    Field,
    Join,
    Report,
    ReportModel,
    Source,
    SpecError,
    Wide,
)

__all__ = [
    "Dimension",
    "Field",
    "Join",
    "Report",
    "ReportModel",
    "Source",
    "SpecError",
    "Wide",
]
