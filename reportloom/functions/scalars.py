"""Row-level expressions. All are built-in Spark functions, no Python code per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DecimalType

MONEY = DecimalType(18, 4)
CHECK = DecimalType(38, 18)

# Every character that counts as white space in a text cell.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip_text(column: Column) -> Column:
    """Text without surrounding white space (full-width blanks too); empty is NULL.
    Cells are only trimmed where the first or last character is blank, since trimming
    against the whole list is slow. An empty edge is found in every list, too."""
    blanks = F.lit(WHITESPACE)
    blank_edge = F.contains(blanks, F.left(column, F.lit(1))) | F.contains(
        blanks, F.right(column, F.lit(1))
    )
    trimmed = F.btrim(column, blanks)
    return F.nullif(F.when(blank_edge, trimmed).otherwise(column), F.lit(""))


def as_number(column: Column) -> Column:
    """Exact number or NULL; thousands separators and currency signs do not parse."""
    return column.try_cast(CHECK)


def as_money(column: Column) -> Column:
    return column.try_cast(MONEY)


def as_integer(column: Column, strict: bool = False) -> Column:
    """Whole number, halves to the even neighbour. With `strict`, fractions are NULL."""
    number = as_number(column)
    whole = F.bround(number, 0)
    if strict:
        whole = F.when(whole == number, whole)
    # Plain digits need no exact decimal.
    return F.coalesce(column.try_cast("bigint"), whole.try_cast("bigint"))


def as_date(column: Column, formats: tuple[str, ...] = ()) -> Column:
    """Date in ISO form, else in the first of the declared formats that fits."""
    parsed = [F.try_to_date(column, f) for f in formats]
    return F.coalesce(column.try_cast("date"), *parsed)


def as_bool(column: Column) -> Column:
    return column.try_cast("boolean")


def null_safe_all(left: str, right: str, names: list[str]) -> Column:
    """Join condition in which NULL matches NULL on every name."""
    pairs = [F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}")) for n in names]
    return reduce(lambda a, b: a & b, pairs)


def safe_ratio(numerator: Column, denominator: Column, digits: int) -> Column:
    """Rounded quotient; NULL when the denominator is zero."""
    top = numerator.cast("double")
    bottom = F.nullif(denominator.cast("double"), F.lit(0.0))
    return F.round(top / bottom, digits)


def period_of(column: Column, grain: str) -> Column:
    """First day of the period a date falls in."""
    day = column.cast("date")
    return day if grain == "day" else F.trunc(day, grain)


def ten_thousands(column: Column) -> Column:
    """Display scale of amounts: units of ten thousand with one decimal."""
    return F.round(column.cast("double") / F.lit(10000.0), 1)


def percent(column: Column) -> Column:
    """Display scale of rates: percent with one decimal."""
    return F.round(column.cast("double") * F.lit(100.0), 1)
