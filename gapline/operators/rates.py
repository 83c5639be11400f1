"""Conditional rates, rates per head and stay-or-leave rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import low_sample, one_decimal, per_people, percent


def conditional_rates(df: DataFrame, group: str, rates: dict[str, Column], least: int = 100) -> DataFrame:
    """group, n, a percentage for each condition, low_sample. Null groups are kept as `(unknown)`."""
    counted = df.groupBy(F.coalesce(F.col(group), F.lit("(unknown)")).alias(group)).agg(F.count("*").alias("n"), *[F.count_if(c).alias(f"_{k}") for k, c in rates.items()])
    return counted.select(group, "n", *[one_decimal(percent(F.col(f"_{k}"), F.col("n"))).alias(k) for k in rates], low_sample(F.col("n"), least).alias("low_sample"))


def rate_per_people(counts: DataFrame, population: DataFrame, key: str, base: float = 1e4) -> DataFrame:
    """key, n, people, rate: counts (key, n) for each `base` people; keys without population stay, with a null rate."""
    return counts.join(population, key, "left").select(key, "n", "people", one_decimal(per_people(F.col("n"), F.col("people"), base)).alias("rate"))


def exit_rates(df: DataFrame, field: str, left: Column, income: Column) -> DataFrame:
    """field, n, exit_pct, stay_income, leave_income."""
    return df.groupBy(field).agg(
        F.count("*").alias("n"),
        one_decimal(percent(F.count_if(left), F.count("*"))).alias("exit_pct"),
        one_decimal(F.avg(F.when(~left, income))).alias("stay_income"),
        one_decimal(F.avg(F.when(left, income))).alias("leave_income"),
    )


def with_totals(rows: DataFrame, counts: DataFrame, key: str, name: str) -> DataFrame:
    """rows with counts (key, n) looked up by code; rows without one stay."""
    return rows.join(counts.select(key, F.col("n").alias(name)), key, "left")


def bridge(counts: DataFrame, weights: DataFrame, source: str, target: str) -> DataFrame:
    """target, value: counts (source, n) spread over targets by weights (source, target, weight)."""
    return counts.join(weights, source).groupBy(target).agg(F.sum(F.col("n") * F.col("weight")).alias("value"))
