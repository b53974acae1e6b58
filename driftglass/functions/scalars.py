"""Small rules of numbers and names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TITLE = 110  # fixed value: characters of a title


def whole(value: Column) -> Column:
    """The nearest whole number, halves to even."""
    return F.bround(value, 0).cast("long")


def to_tick(price: Column, tick: float) -> Column:
    """The nearest multiple of a tick, one tick at least."""
    return F.greatest(F.bround(price / F.lit(tick), 0) * F.lit(tick), F.lit(tick))


def percent_steps(price: Column, before: Column) -> Column:
    return 100 * (price - before)


def capped_pair(a: Column, b: Column, most: float = 0.95) -> tuple[Column, Column]:
    """Two weights, made smaller by the same factor where their sum is above `most`."""
    factor = F.when(a + b > most, most / (a + b)).otherwise(F.lit(1.0))
    return a * factor, b * factor


def safe_id(name: Column) -> Column:
    """An id as a file name."""
    return F.replace(name, F.lit("/"), F.lit("_"))


def short_title(title: Column) -> Column:
    return F.substring(F.coalesce(title, F.lit("")), 1, TITLE)
