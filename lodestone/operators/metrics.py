"""Counters, gauges and cumulative histograms over event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counter(events: DataFrame, labels: list[str], amount: str | None = None) -> DataFrame:
    return events.groupBy(*labels).agg((F.sum(amount) if amount else F.count("*")).alias("value"))


def gauge(events: DataFrame, labels: list[str], value: str, order: list[str]) -> DataFrame:
    """The last value by labels."""
    return events.groupBy(*labels).agg(F.max_by(value, F.struct(*order)).alias("value"))


def linear_buckets(start: float, width: float, n: int) -> list[float]:
    return [start + i * width for i in range(n)]


def exponential_buckets(start: float, factor: float, n: int) -> list[float]:
    return [start * factor**i for i in range(n)]


def histogram(events: DataFrame, value: str, bounds: list[float], labels: list[str] | None = None) -> DataFrame:
    """labels, le (bound, or +Inf), count of the values up to it, and the sum of all values. One aggregation, however many bounds."""
    labels = labels or []
    counts = [F.sum((F.col(value) <= b).cast("long")).alias(f"b{i}") for i, b in enumerate(bounds)]
    one = events.filter(F.col(value).isNotNull()).groupBy(*labels).agg(F.count("*").alias("n"), F.sum(value).alias("total"), *counts)
    rows = F.array(*[F.struct(F.lit(f"{b:g}").alias("le"), F.coalesce(f"b{i}", F.lit(0)).alias("count")) for i, b in enumerate(bounds)], F.struct(F.lit("+Inf").alias("le"), F.col("n").alias("count")))
    return one.select(*labels, F.explode(rows).alias("r"), "total").select(*labels, "r.le", "r.count", "total")
