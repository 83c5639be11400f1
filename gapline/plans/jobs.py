"""The whole run from landed rows to classified items, a table for each stage."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import cleaning

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@dataclass(frozen=True)
class Rules:
    """What a run needs to know: the columns, and the rules of each stage."""

    text: str  #: what is cleaned and classified
    key: list[str]  #: rows with equal keys are one item
    newest: list[Column]  #: which of them stays: the first by this order, which must break ties
    region: Column  #: whether an item is in the target region
    exact: dict[str, str] = field(default_factory=dict)
    patterns: list[tuple[str, str]] = field(default_factory=list)
    least_length: int = 1


def prepare(landed: DataFrame, rules: Rules, folder: str) -> DataFrame:
    """Writes `normalised`, `rejected`, `merged`, `region` and `classified` below `folder`; reruns replace them. Each stage
    reads the table of the one before. Returns stage_no, stage and n, the rows collected and left by each stage."""
    spark = landed.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        # texts take two thirds of Spark's own codec's room; a written table needs its shuffle's files no more
        before = spark.conf.get(CLEANUP, None)
        spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}")
        finally:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    judged = cleaning.normalise(landed, rules.text, rules.least_length)
    stored(judged.filter("reason is not null").drop("clean"), "rejected")
    normalised = stored(judged.filter("reason is null").drop("reason"), "normalised")
    merged = stored(cleaning.latest(normalised, rules.key, rules.newest), "merged")
    region = stored(merged.filter(rules.region), "region")
    classified = stored(cleaning.classify(region, F.col("clean"), rules.exact, rules.patterns), "classified")
    stages = [("collected", landed), ("normalised", normalised), ("merged", merged), ("region", region), ("classified", classified.filter("code is not null"))]
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(i).alias("stage_no"), F.lit(name).alias("stage"), "n") for i, (name, df) in enumerate(stages)]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out
