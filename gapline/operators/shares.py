"""Distributions, funnels, cross-tabs and differences of shares.

Each is one aggregation with map-side partial sums; totals are windows over the aggregated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import low_sample, one_decimal, percent



def distribution(df: DataFrame, category: Column, name: str = "category") -> DataFrame:
    """name, n, pct: the categories' shares of all rows."""
    counts = df.groupBy(category.alias(name)).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", one_decimal(percent(F.col("n"), F.sum("n").over(Window.partitionBy()))))


def funnel(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """step, label, n, pct: rows that pass all conditions up to each step, in percent of the first. One pass over df."""
    passed, sums = F.lit(True), []
    for i, (_, condition) in enumerate(steps):
        passed = passed & F.coalesce(condition, F.lit(False))
        sums.append(F.count_if(passed).alias(f"n{i}"))
    rows = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(label).alias("label"), F.col(f"n{i}").alias("n"), F.col("n0").alias("_first")) for i, (label, _) in enumerate(steps)])
    return df.agg(*sums).select(F.inline(rows)).select("step", "label", "n", one_decimal(percent(F.col("n"), F.col("_first"))).alias("pct"))


def crosstab(df: DataFrame, group: str, classes: dict[str, Column], least: int = 100) -> DataFrame:
    """group, n, a percentage of the group's rows for each class, low_sample."""
    counted = df.groupBy(group).agg(F.count("*").alias("n"), *[F.count_if(c).alias(f"_{k}") for k, c in classes.items()])
    return counted.select(group, "n", *[one_decimal(percent(F.col(f"_{k}"), F.col("n"))).alias(k) for k in classes], low_sample(F.col("n"), least).alias("low_sample"))


def totals(df: DataFrame, group: str, value: Column | None = None) -> DataFrame:
    """group, n: rows, or the sum of a value."""
    return df.groupBy(group).agg((F.count("*") if value is None else F.sum(value)).alias("n"))


def classified_shares(df: DataFrame, group: str, share: str, unclassified: Column) -> DataFrame:
    """group, n, share (unrounded): of the rows that are classified only."""
    counts = df.filter(~F.coalesce(unclassified, F.lit(True))).groupBy(group).agg(F.count("*").alias("n"))
    return counts.withColumn(share, percent(F.col("n"), F.sum("n").over(Window.partitionBy())))


def share_difference(left: DataFrame, right: DataFrame, key: str, least: int = 100) -> DataFrame:
    """Two populations' shares by code, and their difference in percentage points, rounded after the subtraction. Each
    side has key, n and share. A key of one side only stays, with a share of 0 on the other and a null count, so that a
    missing count is not taken for a small one."""
    a = left.select(key, F.col("share").alias("_a"))
    b = right.select(key, F.col("share").alias("_b"), F.col("n").alias("n_right"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return a.join(b, key, "full_outer").select(
        key,
        one_decimal(zero(F.col("_a"))).alias("left_share"),
        one_decimal(zero(F.col("_b"))).alias("right_share"),
        one_decimal(zero(F.col("_a")) - zero(F.col("_b"))).alias("diff_pp"),
        "n_right",
        low_sample(F.col("n_right"), least).alias("low_sample"),
    )


def top(df: DataFrame, by: str, tie: str, k: int) -> DataFrame:
    """The k largest rows, ties by key; the rest is not marked, so publish the coverage beside it."""
    return df.orderBy(F.desc(by), tie).limit(k)


def ranked(df: DataFrame, by: str, tie: str) -> DataFrame:
    """A result set in its published order: adds `position`, largest first, ties by key. For results, a row a group."""
    return df.withColumn("position", F.row_number().over(Window.orderBy(F.desc(by), tie)))
