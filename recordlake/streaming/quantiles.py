"""Percentiles that merge: values counted by bins of a constant relative width.

A sketch is a table of (keys, place, n). ``place`` numbers the bins in the order of their values, and a
bin's middle is within ``accuracy`` of each of its values. Counts add up, so sketches of hours give those of days
without reading the log again, and what comes out equals a sketch made at once. A key has at most
some 150,000 places at one percent, however many values it counts.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .logs import _timed

c = F.col

ACCURACY = 0.01
#: Added to a bin's number, so that places of positive values are above 0 and those of negative ones below.
SHIFT = 10_000_000
_LARGEST = 1.7e308


def _log_width(accuracy: float) -> float:
    if not 0 < accuracy < 1:
        raise ValueError("accuracy must lie between 0 and 1")
    return math.log((1 + accuracy) / (1 - accuracy))


def place_of(value: Column, accuracy: float = ACCURACY) -> Column:
    """The bin of a value; null for null and NaN. Infinite values lie in the outermost bins."""
    number = value.cast("double")
    size = F.least(F.abs(number), F.lit(_LARGEST))
    at = F.ceil(F.ln(size) / F.lit(_log_width(accuracy))) + F.lit(SHIFT)
    return F.when(number.isNull() | F.isnan(number), None).when(number == 0, F.lit(0).cast("bigint")).otherwise(
        F.when(number > 0, at).otherwise(-at)
    )


def value_of(place: Column, accuracy: float = ACCURACY) -> Column:
    """The middle of a bin: within ``accuracy``, relatively, of every value counted there."""
    width = _log_width(accuracy)
    size = F.exp((F.abs(place) - F.lit(SHIFT)) * F.lit(width)) * F.lit(2 / (1 + math.exp(width)))
    return F.when(place == 0, F.lit(0.0)).otherwise(F.signum(place.cast("double")) * size)


def sketch(rows: DataFrame, by: Sequence[str], value: str, accuracy: float = ACCURACY) -> DataFrame:
    """(by, place, n); null and NaN values are not counted."""
    placed = rows.select(*by, place_of(c(value), accuracy).alias("place")).where(c("place").isNotNull())
    return placed.groupBy(*by, "place").agg(F.count(F.lit(1)).alias("n"))


def window_sketch(
    log: DataFrame, ts: str, value: str, by: Sequence[str], width: str = "1 hour", lateness: str = "1 hour", accuracy: float = ACCURACY
) -> DataFrame:
    """(window_start, by, place, n) per time window, on tables and on streams."""
    placed = _timed(log, ts, lateness).withColumn("place", place_of(c(value), accuracy)).where(c("place").isNotNull())
    grouped = placed.groupBy(F.window(ts, width), *by, "place").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(c("window.start").alias("window_start"), *by, "place", "n")


def merge(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sketches added up over all columns that ``by`` leaves out."""
    return sketches.groupBy(*by, "place").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, by: Sequence[str], shares: Mapping[str, float], accuracy: float = ACCURACY) -> DataFrame:
    """(by, n, one column per share): the value of rank ceil(share * n), within ``accuracy`` of the true one.

    Sketches are merged first. The window runs over the places of a key, whose number is bounded.
    """
    merged = merge(sketches, by)
    upto = Window.partitionBy(*by).orderBy("place")
    whole = Window.partitionBy(*by).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = merged.select(*by, "place", "n", F.sum("n").over(upto).alias("_upto"), F.sum("n").over(whole).alias("_all"))
    first = {
        name: F.min(F.when(c("_upto") >= F.greatest(F.lit(1), F.ceil(F.lit(float(share)) * c("_all"))), c("place")))
        for name, share in shares.items()
    }
    return ranked.groupBy(*by).agg(F.sum("n").alias("n"), *[value_of(p, accuracy).alias(name) for name, p in first.items()])
