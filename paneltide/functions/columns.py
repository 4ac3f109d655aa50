"""Small column expressions."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, functions as F


def tidy(col: Column | str, digits: int = 6) -> Column:
    """Round for output; adding zero turns -0.0 into 0.0."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def finite(col: Column | str) -> Column:
    """True when the value is neither NULL, NaN nor infinite."""
    c = F.col(col) if isinstance(col, str) else col
    c = c.cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def nan_to_null(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.when(~F.isnan(c), c)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it, also inside lambdas.

    A column used in a lambda would be evaluated again for every element; as
    the only element of an array it becomes a lambda variable.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
