"""Counts by stage, small samples, denominators and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import low_sample, one_decimal, percent


def stage_counts(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """stage_no, stage, n: rows left after each filter, in one pass."""
    passed, sums = F.lit(True), []
    for i, (_, keep) in enumerate(stages):
        passed = passed & F.coalesce(keep, F.lit(False))
        sums.append(F.count_if(passed).alias(f"n{i}"))
    rows = F.array(*[F.struct(F.lit(i).alias("stage_no"), F.lit(name).alias("stage"), F.col(f"n{i}").alias("n")) for i, (name, _) in enumerate(stages)])
    return df.agg(*sums).select(F.inline(rows))


def low_groups(counts: DataFrame, group: str, least: int) -> DataFrame:
    """One row: min_sample and the sorted names of groups below it, joined. Group names are few by nature."""
    low = F.sort_array(F.collect_list(F.when(low_sample(F.col("n"), least), F.col(group))))
    return counts.agg(F.lit(least).alias("min_sample"), F.array_join(low, ",").alias("low_groups"))


def two_denominators(df: DataFrame, group: str, hit: Column, stated: Column) -> DataFrame:
    """group, num, den_all, den_stated, rate_all, rate_stated: one numerator over both denominators, which stay visible."""
    num = F.count_if(F.coalesce(hit, F.lit(False)))
    return df.groupBy(group).agg(num.alias("num"), F.count("*").alias("den_all"), F.count_if(stated).alias("den_stated")).select(
        group, "num", "den_all", "den_stated",
        one_decimal(percent(F.col("num"), F.col("den_all"))).alias("rate_all"), one_decimal(percent(F.col("num"), F.col("den_stated"))).alias("rate_stated"),
    )


def checks(parts: list[tuple[str, DataFrame, Column, Column]]) -> DataFrame:
    """check, expected, actual, ok: a row for each (name, table, expected aggregate, actual aggregate)."""
    out = None
    for name, df, expected, actual in parts:
        row = df.agg(expected.cast("double").alias("expected"), actual.cast("double").alias("actual")).select(F.lit(name).alias("check"), "expected", "actual")
        out = row if out is None else out.unionByName(row)
    return out.withColumn("ok", F.abs(F.col("expected") - F.col("actual")) < 1e-6)
