"""Column functions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_decimal(value: Column) -> Column:
    """Rounds last, half up, to the one decimal that results are published with."""
    return F.round(value, 1)


def percent(part: Column, whole: Column) -> Column:
    """part of whole in percent, unrounded; null over an empty whole."""
    return F.lit(100.0) * part / F.nullif(whole, F.lit(0))


def per_people(count: Column, people: Column, base: float = 1e4) -> Column:
    """count for each `base` people; null without people."""
    return F.lit(base) * count / F.nullif(people, F.lit(0))


def complement(value: Column) -> Column:
    """What is missing to 100 percent."""
    return F.lit(100.0) - value


def low_sample(count: Column, least: int = 100) -> Column:
    """Marks groups below the least sample; a group of exactly `least` is large enough."""
    return count < F.lit(least)


def net(income: Column, cost: Column) -> Column:
    return income - cost


def clean_text(value: Column) -> Column:
    """Lower-cased, trimmed, with single blanks; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(value), "\\s+", " ")), F.lit(""))
