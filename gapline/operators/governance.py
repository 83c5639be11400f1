"""Rules that act on results: registered numbers, comparable periods, visible denominators, joins by code."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTER = "metric string, value double, numerator bigint, denominator bigint, basis string, allowed boolean, reason string"


@dataclass(frozen=True)
class Measure:
    """A column of results with what may be done with it: unit `count`, `percent` or `value`, period `flow` or `stock`."""

    df: DataFrame
    key: str
    column: str
    unit: str
    period: str
    key_kind: str


def compare(a: Measure, b: Measure) -> DataFrame:
    """key and diff_pp, rounded after the subtraction: give unrounded columns. A share that one side lacks is 0; a count or a
    value that one side lacks is not. Counts of unlike periods are refused, all keys but codes too, and there is no ratio
    form."""
    if (a.key_kind, b.key_kind) != ("code", "code"):
        raise ValueError("results are joined by code, not by name")
    if a.unit != b.unit:
        raise ValueError(f"units differ: {a.unit} and {b.unit}")
    if a.unit == "count" and a.period != b.period:
        raise ValueError("counts of a flow and of a stock do not compare; use percentages")
    left = a.df.select(F.col(a.key).alias("key"), F.col(a.column).alias("_a"))
    right = b.df.select(F.col(b.key).alias("key"), F.col(b.column).alias("_b"))
    side = lambda c: F.coalesce(c, F.lit(0.0)) if a.unit == "percent" else F.col(c)
    return left.join(right, "key", "full_outer").select("key", F.round(side("_a") - side("_b"), 1).alias("diff_pp"))


def register(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """The register of numbers; each has its numerator, denominator and basis."""
    return spark.createDataFrame(rows, REGISTER)


def usable(registered: DataFrame) -> DataFrame:
    """The numbers that may be published."""
    return registered.filter("allowed")


def forbidden(results: DataFrame, registered: DataFrame, metric: str = "metric") -> DataFrame:
    """Results whose number is not registered, or registered as not allowed."""
    return results.join(registered.filter("allowed").select(F.col("metric").alias(metric)), metric, "left_anti")
