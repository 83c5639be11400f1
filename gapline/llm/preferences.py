"""Preference formatting.

A chosen and a rejected conversation are cut at the end of their longest common prefix of turns (equal role and text).
The prefix is rendered once, as the prompt; the rest of each is a completion with a mask: the spans of characters to learn
from are what assistants say and the end mark after it, headers and other roles are masked.

One shuffle by pair brings the turns together; a pair's turns make one row, so memory is bounded by a pair of
conversations. All else is built-in functions on arrays.

Defined results: turns are ordered by number (null first), then role and text, so repeated turns stay, in an order that
reruns agree on; a null text is empty, a null role is `user`; pairs without both sides, null pairs and other sides are
left out; equal conversations have empty completions; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The format of a turn: fixed values.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
LEARNED = "assistant"


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE), t["text"], F.lit(END))), "")


def _spans(turns: Column) -> Column:
    """Start and end (exclusive) of the characters to learn from in the rendered turns."""

    def add(acc: Column, t: Column) -> Column:
        start = acc["at"] + len(OPEN) + F.length(t["role"]) + len(CLOSE)
        end = start + F.length(t["text"]) + len(END)
        span = F.struct(start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(t["role"] == LEARNED, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    none = F.array().cast("array<struct<start:int,end:int>>")
    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), none.alias("spans")), add)["spans"]


def preferences(turns: DataFrame, pair: str, side: str, turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each pair: pair, n_common, prompt, chosen, rejected, chosen_spans, rejected_spans. `side` says `chosen` or
    `rejected` for each turn."""
    said = F.struct(
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("user")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )
    of = lambda name: F.array_sort(F.collect_list(F.when(F.col(f"`{side}`") == name, said)))
    both = (
        turns.filter(F.col(f"`{pair}`").isNotNull())
        .groupBy(F.col(f"`{pair}`").alias("_pair"))
        .agg(of("chosen").alias("_c"), of("rejected").alias("_r"))
        .filter((F.size("_c") > 0) & (F.size("_r") > 0))
    )
    fits = lambda k, i: (k == i - 1) & F.col("_c")[i - 1]["role"].eqNullSafe(F.col("_r")[i - 1]["role"]) & F.col("_c")[i - 1]["text"].eqNullSafe(F.col("_r")[i - 1]["text"])
    common = F.aggregate(F.sequence(F.lit(1), F.least(F.size("_c"), F.size("_r"))), F.lit(0), lambda k, i: F.when(fits(k, i), i).otherwise(k))
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.size(c))
    return both.withColumn("n_common", common).select(
        F.col("_pair").alias(pair),
        "n_common",
        _rendered(F.slice("_c", F.lit(1), F.col("n_common"))).alias("prompt"),
        _rendered(rest(F.col("_c"))).alias("chosen"),
        _rendered(rest(F.col("_r"))).alias("rejected"),
        _spans(rest(F.col("_c"))).alias("chosen_spans"),
        _spans(rest(F.col("_r"))).alias("rejected_spans"),
    )
