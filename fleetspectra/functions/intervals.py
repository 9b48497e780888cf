"""Interval text such as ``(0, 1]`` or ``[12000, 13000)`` as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bin_center(col: Column | str, strict: bool = False) -> Column:
    """Midpoint of an interval text, as double; brackets and blanks are ignored.

    Lenient mode gives NULL for text that is not two numbers. Strict mode raises at run time.
    NULL stays NULL in both.
    """
    text = _column(col)
    pieces = F.split(F.translate(text, "()[]", ""), ",", 2)
    # A missing second piece is NULL, and a piece that still holds a comma is no number.
    left = F.get(pieces, F.lit(0)).try_cast("double")
    right = F.get(pieces, F.lit(1)).try_cast("double")
    center = (left + right) / 2
    if not strict:
        return center
    bad = F.raise_error(F.concat(F.lit("not an interval: "), text)).cast("double")
    return let(center, lambda c: F.when(text.isNotNull() & c.isNull(), bad).otherwise(c))


def interval_text(lo: Column, width: float) -> Column:
    """Half-open interval text ``[lo, lo + width)``; whole edges are written without decimals."""

    def edge(value: Column) -> Column:
        whole = value == F.floor(value)
        return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))

    return F.concat(F.lit("["), edge(lo), F.lit(", "), edge(lo + F.lit(width)), F.lit(")"))


def is_finite(col: Column | str) -> Column:
    """True for a number that is neither NULL, NaN nor infinite."""
    c = _column(col)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
