"""Normalising, snapshots, classification, field extraction and merging of duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, LongType, StringType, TimestampType

from ..functions.scalars import clean_text


def normalise(df: DataFrame, text: str, least_length: int = 1) -> DataFrame:
    """Adds clean text and reason: rows that would be dropped keep a reason instead, so that counts add up. Where the
    beginning of a text is long enough when clean, so is the whole: a filter on reason cleans few texts whole."""
    clean, beginning = clean_text(F.col(text)), clean_text(F.substring(text, 1, 2 * least_length + 64))
    known = F.when(F.col(text).isNull(), "missing").when(F.length(beginning) >= least_length, F.lit(None).cast("string"))
    return df.withColumns({"clean": clean, "reason": known.when(clean.isNull(), "blank").when(F.length(clean) < least_length, "short")})


def as_of(df: DataFrame, start: str, end: str, day: str) -> DataFrame:
    """Rows open on a day; an open end is open."""
    at = F.lit(day).cast("date")
    return df.filter((F.col(start) <= at) & (F.col(end).isNull() | (F.col(end) >= at)))


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first by the order, which must break ties. A partial top row for each key is kept before
    the shuffle by the aggregation, so hot keys cost no more than others."""
    # equal keys of these types are the same value, which the group has already; a zero's sign and a collation's cases are not
    same = [f.name for f in df.schema if f.name in key and f.dataType in (StringType(), IntegerType(), LongType(), DateType(), TimestampType())]
    rest = F.struct(*[F.col(c) for c in df.columns if c not in same])
    rows = df.groupBy(*key).agg(F.min_by(rest, F.struct(*order)).alias("_row"))
    return rows.select(*[F.col(c if c in same else f"_row.{c}").alias(c) for c in df.columns])


def merge_items(df: DataFrame, key: list[str], **merged: Column) -> DataFrame:
    """Rows become items: one for each key, with the given aggregates."""
    return df.groupBy(*key).agg(*[v.alias(k) for k, v in merged.items()])


def classify(df: DataFrame, text: Column, exact: dict[str, str], rules: list[tuple[str, str]]) -> DataFrame:
    """Adds code, confidence and reason. An exact dictionary match is `high`; else the first of the rules (pattern, code)
    that fits gives `medium`; else the code is null and the reason says why. The dictionary and the rules are parameters
    of the job, not data, and become expressions."""
    known = F.create_map(*[F.lit(x) for pair in exact.items() for x in pair]) if exact else None
    by_name = known[text] if known is not None else F.lit(None).cast("string")
    by_rule = F.coalesce(*[F.when(text.rlike(p), F.lit(c)) for p, c in rules], F.lit(None).cast("string"))
    # the chain of patterns is matched once a row; what follows reads its result
    matched = df.withColumn("_by", F.struct(by_name.alias("name"), F.when(by_name.isNull(), by_rule).alias("rule"), (text.isNull() | (text == "")).alias("none")))
    code = F.coalesce("_by.name", "_by.rule")
    return matched.withColumns(
        {
            "code": code,
            "confidence": F.when(F.col("_by.name").isNotNull(), "high").when(F.col("_by.rule").isNotNull(), "medium").otherwise("none"),
            "reason": F.when(code.isNotNull(), None).when(F.col("_by.none"), "no text").otherwise("no rule"),
        }
    ).drop("_by")


def first_class(text: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """The class of the first pattern that fits; `other` for texts that none fits and for null."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(c)) for p, c in rules], F.lit(other))


def validated(df: DataFrame, found: Column, known: DataFrame, key: str, unknown: str = "(unknown)") -> DataFrame:
    """Adds `key`: what was found (say a district in an address), if the list has it, else `unknown`; no row is lost."""
    listed = known.select(F.col(key).alias("_known")).distinct()
    return df.withColumn("_found", found).join(listed, F.col("_found") == F.col("_known"), "left").withColumn(key, F.coalesce("_known", F.lit(unknown))).drop("_found", "_known")


def kept_group(group: Column, label: str = "unclassified") -> Column:
    """Unclassified rows are a category of their own."""
    return F.coalesce(group, F.lit(label))


def lookup(df: DataFrame, codes: DataFrame, key: str) -> DataFrame:
    """Joins a dimension by code, never by name. The planner sends it to all executors if its size is under the session's
    threshold, and shuffles both sides if not."""
    return df.join(codes, key, "left")


def unmatched(df: DataFrame, codes: DataFrame, key: str) -> DataFrame:
    """Rows whose code the dimension lacks: the audit of a lookup."""
    return df.join(codes.select(key).distinct(), key, "left_anti")


def page_fields(html: Column, url: Column) -> dict[str, Column]:
    """Title and host of a page."""
    return {"title": F.regexp_extract(html, "<title>([^<]*)</title>", 1), "host": F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1)}


def segment(region: Column, home: list[str], capital: list[str]) -> Column:
    """Stayed, went to the capital area, or elsewhere."""
    return F.when(region.isin(home), "stay").when(region.isin(capital), "capital").otherwise("other")
