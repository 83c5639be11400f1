"""Mixing sources to target weights, with DataFrame functions only.

Each source's words, document after document, are packed into blocks of `block` words. The output is a row of slots in
shards. Every shard draws how many slots each source gets: the whole part of its expected number, and the rest of the
shard's slots by a multinomial draw over the fractional parts, so that totals stay within a few slots of the targets.
The j-th slot of a source takes block `perm(j mod n)` of its n blocks, with a pseudorandom permutation for each pass
j div n; slots and blocks are then joined by index. A source is passed `cap` times at most (rounded up), so no document
is taken more often.

All draws are hashes of fixed numbers: reruns agree, whatever the partitioning.

Words and slots are placed by running sums in steps: within a range of rows, over the ranges of a group and over the
groups of a source, so that no task has a source's rows. Only what is one row a source (targets) is done in one task.

Defined results: a null source is a source of its own, the last; null, empty and blank texts have size 0 and are never
taken; very long texts span many blocks; rows that share an id are rows of their own and their words count each; columns
named like a result are replaced; an empty table gives an empty result. Only sizes and offsets are shuffled, never texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import without, word_count, written

#: Rows of a range, in the mean, and ranges of a group.
RANGE_ROWS, GROUP_RANGES = 512, 4096
#: Rounds of a permutation, two to four for each halving of what a round leaves in order.
ROUNDS = 16


@dataclass(frozen=True)
class Mix:
    sizes: DataFrame  #: the input's rows with _row, size, _source, source_size, target
    pieces: DataFrame  #: _row, block, pass, first, words: which words of a row a taken block holds


def _unit(*parts) -> Column:
    """A pseudorandom number in [0, 1) from the parts."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / F.lit(float(1 << 40))


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """Adds weight and target to (source, source_size): `share` of all sizes is dealt by weight; no target is above
    `cap` times its source's size, and what is over goes to the others by weight until none is above.

    Sources are ranked by their ratio size / weight: the level of the fill is the first at which the sources that are
    not full can take the rest, so a running sum finds it without rounds. One row a source."""
    ordered = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sources.withColumn("_n", F.row_number().over(ordered) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumns({"_cap": F.lit(cap) * F.col("source_size"), "_ratio": F.lit(cap) * F.col("source_size") / F.col("weight")})
    every = Window.partitionBy()
    before = Window.orderBy("_ratio", "_n").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    # the level if this source and all later ones were not full
    filled = ranked.withColumn("_level", rest / left).withColumn("_open", F.col("_level") <= F.col("_ratio"))
    level = F.min(F.when(F.col("_open"), F.struct("_ratio", "_n", "_level"))).over(every)["_level"]
    return filled.withColumn("_fill", level).withColumn(
        "target", F.when(F.col("_fill").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_fill") * F.col("weight")))
    ).select("source", "source_size", "weight", "target")


def _permuted(position: Column, n: Column, *key) -> Column:
    """A pseudorandom permutation of 0..n-1, whatever n is, by swap-or-not rounds: each pairs x with k - x (modulo n), for a
    keyed k, and swaps the two or not by a keyed hash of the larger one."""

    def turn(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(r, *key), n) - x, n)
        swaps = F.xxhash64(F.greatest(x, other), r, *key) % 2 == 0
        return F.when(swaps, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), position.cast("long"), turn)


def _before(rows: DataFrame, value: str, source: str, part: str, order: list, name: str) -> DataFrame:
    """Adds the sum of `value` over the rows of the same source before each row: by `part`, a number, then by `order`."""
    group = F.floor(F.col(part) / GROUP_RANGES).alias("_g")
    sums = rows.groupBy(F.col(source).alias("_s"), F.col(part).alias("_p"), group).agg(F.sum(value).alias("_v"))
    groups = sums.groupBy("_s", "_g").agg(F.sum("_v").alias("_gv"))
    up_to = lambda by, key: Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("_s", "_g", F.coalesce(F.sum("_gv").over(up_to(["_s"], "_g")), F.lit(0)).alias("_gbase"))
    sums = sums.select("_s", "_p", "_g", F.coalesce(F.sum("_v").over(up_to(["_s", "_g"], "_p")), F.lit(0)).alias("_pbase"))
    bases = sums.alias("a").join(groups.alias("b"), F.expr("a._s <=> b._s and a._g = b._g")).select("a._s", "a._p", (F.col("_pbase") + F.col("_gbase")).alias("_base"))
    inside = Window.partitionBy(source, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    placed = placed.join(bases, F.col("_s").eqNullSafe(F.col(source)) & (F.col("_p") == F.col(part)))
    return placed.withColumn(name, F.col("_base") + F.col("_inside")).drop("_s", "_p", "_base", "_inside")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block: int = 256, shard_slots: int = 4096, seed: int = 0) -> Mix:
    """The sizes and targets of the rows of `docs`, and the pieces that the mix takes of them."""
    spark = docs.sparkSession
    max_passes = math.ceil(cap)
    docs = without(docs, {"size", "source_size", "target", "taken", "_source", "_key", "_row", "_range", "_s", "_r"}, key, text, source)
    row = docs.withColumns(
        {
            "size": word_count(F.col(f"`{text}`")),
            "_source": F.col(f"`{source}`").cast("string"),
            "_key": F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")),
        }
    )
    # ids of rows hold only while nothing is computed again: the small columns are written once
    keep = [c for c in row.columns if c != text]
    sized, _ = written(row.select(*[F.col(f"`{c}`") for c in keep]).withColumn("_row", F.monotonically_increasing_id()))
    sized = sized.withColumn("_range", F.pmod("_key", F.lit(max(1, sized.count() // RANGE_ROWS))))

    per_range = sized.groupBy("_source", "_range").agg(F.sum("size").alias("_words"))
    per_source = targets(per_range.groupBy(F.col("_source").alias("source")).agg(F.sum("_words").alias("source_size")), weights, share, cap)
    per_source = per_source.withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block)).cast("long"))
    # a slot of a source brings source_size / blocks words on average; a pass too many is cut, never refilled
    per_source = per_source.withColumn("_want", F.col("target") * F.col("blocks") / F.nullif(F.col("source_size"), F.lit(0)))
    per_source, _ = written(per_source)

    # places of words: the order is one of hashed ids and texts, not of files
    placed = _before(sized.filter("size > 0"), "size", "_source", "_range", ["_key", F.col(f"`{key}`"), "_row"], "_at")
    parts = placed.select(
        "_row", "_source", "_at", "size",
        F.explode(F.sequence(F.floor(F.col("_at") / block), F.floor((F.col("_at") + F.col("size") - 1) / block))).alias("block"),
    ).select(
        "_row", "_source", "block",
        F.greatest(F.col("block") * block - F.col("_at"), F.lit(0)).alias("first"),
        (F.least((F.col("block") + 1) * block, F.col("_at") + F.col("size")) - F.greatest(F.col("block") * block, F.col("_at"))).alias("words"),
    )
    slots = _slots(spark, per_source, shard_slots, max_passes, seed)
    # slots come from a few rows of sources, so the planner takes them for few: without the hint it would broadcast them
    slots = slots.hint("merge")
    pieces = parts.join(slots, parts["_source"].eqNullSafe(slots["_slot_source"]) & (parts["block"] == slots["_slot_block"])).select(
        "_row", "_source", "block", "pass", "shard", "slot", "first", "words"
    )
    back = per_source.select(F.col("source").alias("_s"), "source_size", "target")
    sizes = sized.join(back, F.col("_s").eqNullSafe(F.col("_source")), "left").drop("_s", "_range", "_key")
    return Mix(sizes, pieces)


def _slots(spark, per_source: DataFrame, shard_slots: int, max_passes: int, seed: int) -> DataFrame:
    """Which block each taken slot holds: shard, slot (in its source), source, block, pass."""
    total = F.sum("_want").over(Window.partitionBy())
    wanted = per_source.filter("_want > 0").select(
        "source", "blocks", "_want", F.ceil(total / shard_slots).cast("long").alias("_shards"), total.alias("_total")
    )
    # a row for each shard and source; the last shard is as full as the others, expected numbers are total / shards
    mean = F.col("_want") / F.col("_shards")
    dealt = wanted.select(
        "source", "blocks", "_want", F.col("_total"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_shards") - 1)).alias("shard"), "_shards"
    ).withColumns({"_whole": F.floor(mean).cast("long"), "_part": mean - F.floor(mean)})
    shard = Window.partitionBy("shard").orderBy(F.col("source").isNull(), "source")
    up_to = F.sum("_part").over(shard.rowsBetween(Window.unboundedPreceding, 0))
    dealt = dealt.withColumns({"_to": up_to, "_parts": F.sum("_part").over(Window.partitionBy("shard"))})
    # the multinomial draw: as many uniform numbers a shard as the fractional parts sum to (rounded by a hash), each
    # falls into one source's interval
    draws = F.floor(F.col("_parts") + _unit(F.lit("n"), "shard", F.lit(seed))).cast("int")
    uniform = F.transform(F.sequence(F.lit(1), F.greatest(draws, F.lit(1))), lambda k: _unit(k, F.col("shard"), F.lit(seed)) * F.col("_parts"))
    drawn = F.when(draws > 0, F.size(F.filter(uniform, lambda u: (u >= F.col("_to") - F.col("_part")) & (u < F.col("_to"))))).otherwise(0)
    counted = dealt.withColumn("_count", F.col("_whole") + drawn)
    counted = _before(counted.withColumn("_range", F.floor(F.col("shard") / RANGE_ROWS)), "_count", "source", "_range", ["shard"], "_first").withColumn(
        "_count", F.least(F.col("_count"), F.greatest(F.col("blocks") * max_passes - F.col("_first"), F.lit(0)))
    ).filter("_count > 0")
    # shards come from a few rows of sources: without a fixed number of partitions one task would have them all
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = counted.select("source", "blocks", "shard", "_first", "_count").repartition(partitions, "shard", "source")
    slots = counted.select(
        "source", "blocks", "shard", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_count") - 1)).alias("slot")
    ).withColumn("pass", F.floor(F.col("slot") / F.col("blocks")).cast("long"))
    return slots.select(
        F.col("source").alias("_slot_source"), "shard", "slot", "pass",
        _permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.col("source"), F.col("pass"), F.lit(seed)).alias("_slot_block"),
    )


def taken(mixed: Mix) -> DataFrame:
    """The rows with their sizes and how many words of each the mix takes, repeats counted."""
    sums = mixed.pieces.groupBy(F.col("_row").alias("_r")).agg(F.sum("words").alias("taken"))
    return mixed.sizes.join(sums, F.col("_r") == F.col("_row"), "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long")).drop("_r")


def mixed_documents(docs: DataFrame, columns: list[str], text: str = "text", **options) -> DataFrame:
    """The mix as rows with the given columns of `docs`: for each pass, a row of the words taken of a document, whole
    texts as they are, others with their words joined by blanks."""
    # texts are written with row ids once, so that pieces find them again
    key, source = options.get("key", "doc_id"), options.get("source", "source")
    held, _ = written(docs.select(*[F.col(f"`{c}`") for c in docs.columns if not c.startswith("_mix_")], F.monotonically_increasing_id().alias("_mix_id")))
    m = mix(held.select("_mix_id", *dict.fromkeys([key, text, source])), text=text, **options)
    per = m.pieces.join(m.sizes.select("_row", "_mix_id", "size"), "_row").groupBy(F.col("_mix_id").alias("_mix_of"), "pass", F.col("size").alias("_mix_size")).agg(
        F.sum("words").alias("_mix_words"), F.sort_array(F.collect_list(F.struct("first", "words"))).alias("_mix_spans")
    ).drop("pass")
    split = F.split(F.btrim(F.col(f"`{text}`"), F.lit(" \t\n\x0b\x0c\r")), "[\\x20\\x09-\\x0D]+")
    piece = lambda s: F.slice(F.col("_mix_split"), (s["first"] + 1).cast("int"), s["words"].cast("int"))
    cut = F.array_join(F.flatten(F.transform("_mix_spans", piece)), " ")
    whole = F.col("_mix_words") == F.col("_mix_size")
    out = held.join(per, F.col("_mix_id") == F.col("_mix_of")).withColumn("_mix_split", F.when(~whole, split))
    out = out.withColumn("_mix_new", F.when(whole, F.col(f"`{text}`")).otherwise(cut))
    made = {text: F.col("_mix_new")} | ({"n_chars": F.length("_mix_new").cast("long")} if "n_chars" in columns else {})
    return out.select(*[made.get(c, F.col(f"`{c}`")).alias(c) for c in columns])
