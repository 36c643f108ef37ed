"""Dates and decay."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNDATED = 0.6


def recency(year: Column, now: int) -> Column:
    """0.88 per year of age, 0.35 at least; ``UNDATED`` without a year."""
    age = F.greatest(F.lit(0), F.lit(now) - year)
    return F.when(year.isNull() | (year <= 0), F.lit(UNDATED)).otherwise(F.greatest(F.lit(0.35), F.pow(F.lit(0.88), age)))


def human_date(iso: Column) -> Column:
    return F.date_format(F.to_date(F.substring(iso, 1, 10)), "d MMM yyyy")


def gap_phrase(first: Column, second: Column) -> Column:
    """How much later the second date is, in words."""
    d = F.datediff(second, first)
    return (
        F.when(d <= 0, F.lit("the same day"))
        .when(d == 1, F.lit("the next day"))
        .when(d < 14, F.concat(d.cast("string"), F.lit(" days later")))
        .when(d <= 60, F.lit("a few weeks later"))
        .when(d <= 400, F.lit("months later"))
        .when(d > 400, F.lit("years later"))
        .otherwise(F.lit("later"))
    )
