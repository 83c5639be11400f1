"""Gaps between two groups: means, medians, a Welch statistic, sensitivity to outliers, robustness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import net, one_decimal

_LEAVE, _STAY = "leave", "stay"


def welch_gap(df: DataFrame, group: list[str], left: Column, value: Column, critical: float = 1.96) -> DataFrame:
    """group, gap, t_stat, df, significant: the mean of those who left less the mean of those who stayed, and whether
    Welch's t is beyond the critical value (a parameter: no test is prescribed). One row a side: not significant."""
    part = lambda f, c: f(F.when(c, value))
    stats = df.groupBy(*group).agg(
        part(F.avg, left).alias("_m1"), part(F.avg, ~left).alias("_m0"), part(F.var_samp, left).alias("_v1"), part(F.var_samp, ~left).alias("_v0"),
        part(F.count, left).alias("_n1"), part(F.count, ~left).alias("_n0"),
    )
    e1, e0 = F.col("_v1") / F.nullif(F.col("_n1"), F.lit(0)), F.col("_v0") / F.nullif(F.col("_n0"), F.lit(0))
    t = (F.col("_m1") - F.col("_m0")) / F.nullif(F.sqrt(e1 + e0), F.lit(0.0))
    freedom = (e1 + e0) * (e1 + e0) / F.nullif(e1 * e1 / F.nullif(F.col("_n1") - 1, F.lit(0)) + e0 * e0 / F.nullif(F.col("_n0") - 1, F.lit(0)), F.lit(0.0))
    return stats.select(
        *group, one_decimal(F.col("_m1") - F.col("_m0")).alias("gap"), one_decimal(t).alias("t_stat"), one_decimal(freedom).alias("df"),
        F.coalesce(F.abs(t) > critical, F.lit(False)).alias("significant"),
    )


def segment_stats(df: DataFrame, segment: str, income: Column, cost: Column) -> DataFrame:
    """segment, n, means of income, cost and net, exact medians of income and cost."""
    means = df.groupBy(segment).agg(
        F.count("*").alias("n"), F.avg(income).alias("_i"), F.avg(cost).alias("_c"),
        one_decimal(F.median(income)).alias("income_median"), one_decimal(F.median(cost)).alias("cost_median"),
    )
    return means.select(
        segment, "n", one_decimal(F.col("_i")).alias("income"), one_decimal(F.col("_c")).alias("cost"),
        one_decimal(net(F.col("_i"), F.col("_c"))).alias("net"), "income_median", "cost_median",
    )


def retained_gap(df: DataFrame, segment: str, baseline: str, income: Column, cost: Column) -> DataFrame:
    """segment, gap, net_gap, retained_pct: what is left of each segment's gap over the baseline once costs are paid."""
    means = df.groupBy(segment).agg(F.avg(income).alias("_i"), F.avg(net(income, cost)).alias("_n"))
    base = lambda c: F.max(F.when(F.col(segment) == baseline, F.col(c))).over(Window.partitionBy())
    gaps = means.withColumns({"_gi": F.col("_i") - base("_i"), "_gn": F.col("_n") - base("_n")}).filter(F.col(segment) != baseline)
    return gaps.select(
        segment, one_decimal(F.col("_gi")).alias("gap"), one_decimal(F.col("_gn")).alias("net_gap"),
        one_decimal(F.lit(100.0) * F.col("_gn") / F.nullif(F.col("_gi"), F.lit(0.0))).alias("retained_pct"),
    )


def outlier_sensitivity(df: DataFrame, left: Column, value: Column) -> DataFrame:
    """treatment, n, gap of means under five treatments of outliers: raw, trimmed to the 1st..99th percentile, clipped to
    it, within 1.5 interquartile ranges, and of medians."""
    rows = df.select(left.alias("_l"), value.cast("double").alias("_v")).filter("_v is not null and _l is not null")
    # one row of bounds, whatever the input
    bounds = rows.agg(F.percentile("_v", F.array(F.lit(0.01), F.lit(0.25), F.lit(0.75), F.lit(0.99))).alias("_p"))
    at = lambda i: F.col("_p")[i]
    spread = F.lit(1.5) * (at(2) - at(1))
    v = F.col("_v")
    treated = {
        "raw": v,
        "trimmed": F.when(v.between(at(0), at(3)), v),
        "clipped": F.least(F.greatest(v, at(0)), at(3)),
        "iqr": F.when(v.between(at(1) - spread, at(2) + spread), v),
    }
    gap = lambda f, x: f(F.when(F.col("_l"), x)) - f(F.when(~F.col("_l"), x))
    sums = []
    for name, x in treated.items():
        sums += [F.count(x).alias(f"n_{name}"), gap(F.avg, x).alias(f"g_{name}")]
    sums += [F.count(v).alias("n_median"), gap(F.median, v).alias("g_median")]
    out = rows.crossJoin(F.broadcast(bounds)).agg(*sums)
    names = [*treated, "median"]
    return out.select(F.inline(F.array(*[F.struct(F.lit(k).alias("treatment"), F.col(f"n_{k}").alias("n"), one_decimal(F.col(f"g_{k}")).alias("gap")) for k in names])))


def robustness(df: DataFrame, subset: str, x: Column, y: Column) -> DataFrame:
    """subset, n, corr: the correlation in each subset and over all (`(all)`), in one grouping."""
    return (
        df.select(F.col(subset).alias("subset"), x.cast("double").alias("_x"), y.cast("double").alias("_y"))
        .rollup("subset").agg(F.count("*").alias("n"), (one_decimal(F.corr("_x", "_y") * 100) + F.lit(0.0)).alias("corr_pct"), F.grouping("subset").alias("_g"))
        .select(F.when(F.col("_g") == 1, "(all)").otherwise(F.col("subset")).alias("subset"), "n", "corr_pct")
    )
