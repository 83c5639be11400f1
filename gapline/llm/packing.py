"""Variable-capacity best-fit packing.

Sequences may have one of several permitted lengths. Documents over the longest are cut into full sequences of that
length and a rest. Rests and shorter documents are items, longest first: an item goes to the open bin with the least
room that holds it; if there is none, a bin of the size of least cost opens. That cost weighs all sizes jointly: for
each size, the padding that remains if the bin is filled on with the longest items still to come that fit, plus a fixed
cost for each sequence, as a share of the words that the bin then holds. At the end each bin shrinks to
the smallest permitted length that holds its contents.

Items are dealt to groups of about `group_rows` at random (a hash of row and seed), and each group is packed in a task:
groups have no hot key, and a group's bins depend on nothing else. In a group only counts for each length are searched,
so work grows with items and lengths, not with pairs.

Defined results: null, empty and blank texts have no words and take no place; very long ones fill sequences of the longest
length; columns named like a result (in any case of letters) are replaced; repeated rows are packed each; of bins with the
same room the one that came to it last is filled; an empty table gives an empty result; no word is lost or placed twice.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import word_count, written

SCHEMA = "bin string, capacity int, used int, slot int, offset int, _row long, start long, words long"


def opening_size(lengths: np.ndarray, left: np.ndarray, first: int, sizes: tuple[int, ...], cost: float) -> int:
    """The permitted size of least cost a word for a new bin whose first item has length `first`. left[n]: how many items
    of n words are still to come."""
    present = lengths[left[lengths] > 0]
    best, chosen = None, sizes[-1]
    for size in sizes:
        if size < first:
            continue
        room = size - first
        fill = reachable(present, left, room)
        padding = room - fill
        score = (padding + cost) / (size - padding)
        if best is None or score < best - 1e-12:
            best, chosen = score, size
    return chosen


def reachable(present: np.ndarray, left: np.ndarray, room: int) -> int:
    """The sum up to `room` that the longest items left which fit, one after another, reach."""
    total = 0
    used: dict[int, int] = {}
    while room - total > 0:
        i = int(np.searchsorted(present, room - total, "right")) - 1
        while i >= 0 and used.get(int(present[i]), 0) >= left[present[i]]:
            i -= 1
        if i < 0:
            break
        n = int(present[i])
        k = min((room - total) // n, int(left[n]) - used.get(n, 0))
        used[n] = used.get(n, 0) + k
        total += n * k
    return total


def pack(lengths: list[int], sizes: tuple[int, ...], cost: float = 16.0) -> list[tuple[int, int, list[int]]]:
    """Bins as (capacity, used, items by number), each item of 1..sizes[-1] words in one bin."""
    sizes = tuple(sorted(set(sizes)))
    most = sizes[-1]
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    left = np.bincount(np.asarray(lengths, np.int64), minlength=most + 1) if lengths else np.zeros(most + 1, np.int64)
    distinct = np.flatnonzero(left)
    open_bins: list[list[int]] = [[] for _ in range(most + 1)]  # numbers of bins by room left
    rooms = np.zeros(most + 2, np.int64)  # how many are open by room; a tree over blocks finds the least room
    step = 64
    blocks = np.zeros(most // step + 2, np.int64)
    bins: list[tuple[int, list[int]]] = []
    used: list[int] = []

    def least_room(n: int) -> int:
        b = n // step
        within = np.flatnonzero(rooms[n : (b + 1) * step])
        if len(within):
            return n + int(within[0])
        full = np.flatnonzero(blocks[b + 1 :])
        if not len(full):
            return -1
        b += 1 + int(full[0])
        return b * step + int(np.flatnonzero(rooms[b * step : (b + 1) * step])[0])

    def put(room: int, number: int) -> None:
        if 0 < room:
            open_bins[room].append(number)
            rooms[room] += 1
            blocks[room // step] += 1

    for i in order:
        n = lengths[i]
        left[n] -= 1
        room = least_room(n)
        if room < 0:
            size = opening_size(distinct, left, n, sizes, cost)
            bins.append((size, [i]))
            used.append(n)
            put(size - n, len(bins) - 1)
        else:
            number = open_bins[room].pop()
            rooms[room] -= 1
            blocks[room // step] -= 1
            bins[number][1].append(i)
            used[number] += n
            put(room - n, number)
    small = np.asarray(sizes)
    return [(int(small[np.searchsorted(small, u)]), u, items) for (_, items), u in zip(bins, used)]


def pack_documents(docs: DataFrame, text: str = "text", sizes: tuple[int, ...] = (512, 1024, 2048, 4096), cost: float = 16.0, group_rows: int = 20000, seed: int = 0) -> DataFrame:
    """The pieces of the rows of `docs` in their places: bin, capacity, used, slot and offset in the bin, _row, start and
    words of the piece, and the row's other columns but its text."""
    sizes = tuple(sorted(set(sizes)))
    most = sizes[-1]
    taken = {"bin", "capacity", "used", "slot", "offset", "start", "words", "_row", "_words", "_group", "_k"}
    keep = [c for c in docs.columns if c != text and c.lower() not in taken]
    sized, _ = written(
        docs.select(*[F.col(f"`{c}`") for c in keep], word_count(F.col(f"`{text}`")).alias("_words")).withColumn("_row", F.monotonically_increasing_id())
    )
    sized = sized.filter("_words > 0")
    # full sequences need no search
    full = sized.filter(F.col("_words") >= most).select(
        "_row", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_words") / most) - 1)).alias("_k")
    ).select(
        F.concat(F.lit("f"), F.col("_row"), F.lit("-"), F.col("_k")).alias("bin"), F.lit(most).alias("capacity"), F.lit(most).alias("used"),
        F.lit(0).alias("slot"), F.lit(0).alias("offset"), "_row", (F.col("_k") * most).alias("start"), F.lit(most).cast("long").alias("words"),
    )
    rests = sized.filter(F.col("_words") % most > 0).select(
        "_row", (F.col("_words") - F.col("_words") % most).alias("start"), (F.col("_words") % most).alias("words")
    )
    groups = max(1, -(-rests.count() // group_rows))
    dealt = rests.withColumn("_group", F.pmod(F.xxhash64("_row", F.lit(seed)), F.lit(groups)).cast("int"))

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_row", ignore_index=True)
        lengths = rows["words"].tolist()
        bins = pack(lengths, sizes, cost)
        items = np.concatenate([np.asarray(b, np.int64) for _, _, b in bins])
        many = np.array([len(b) for _, _, b in bins])
        number = np.repeat(np.arange(len(bins)), many)
        firsts = np.repeat(np.cumsum(many) - many, many)
        words = rows["words"].to_numpy()[items]
        before = np.cumsum(words) - words
        return pd.DataFrame(
            {
                "bin": [f"g{key[0]}-{b}" for b in number],
                "capacity": np.repeat([c for c, _, _ in bins], many).astype(np.int32),
                "used": np.repeat([u for _, u, _ in bins], many).astype(np.int32),
                "slot": (np.arange(len(items)) - firsts).astype(np.int32),
                "offset": (before - before[firsts]).astype(np.int32),
                "_row": rows["_row"].to_numpy()[items],
                "start": rows["start"].to_numpy()[items],
                "words": words,
            }
        )

    placed = full.unionByName(dealt.groupBy("_group").applyInPandas(packed, SCHEMA))
    return placed.join(sized.drop("_words"), "_row")
