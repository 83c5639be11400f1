"""N-gram Jaccard join by parity sketches.

A text's set is its distinct `words`-word shingles. Two sets A, B link when `den * |A n B| >= num * |A u B|`, which is the
same as a symmetric difference of at most (|A| + |B|) (den - num) / (den + num).

Every shingle's hash flips one bit of a wide bit sketch, so the Hamming distance of two sketches is a lower bound of the
symmetric difference. Sets are compared in size bands: a ladder for each band (U/2, U], and one for the pairs on both
sides of each U. All pairs of a ladder differ in D shingles at most, so of D + 1 + s blocks of the sketch at least s + 1
are equal. A block's content is named by the XOR of the 64-bit hashes in it, and sets with an equal block meet in a
bucket. Empty blocks name nothing; a set with more than s of them (all the blocks that a pair has in common could then
be empty) is dealt again under the next hash, as its partner is, and at the last one with its empty blocks too. So no
link is lost, whatever the data.

A bucket gives links to its smallest member only, not all pairs. They are tested by the Hamming distance of narrower,
foldable sketches and then exactly, on whole texts; the texts of a star come to one task, or to several that each have
its smallest member. What a bucket still holds of different components after that is tested by the sketches, over
components only: small buckets many to a task, larger ones cut into parts of `large` rows, two of which are compared in
a task, which gives pairs that the sketches let pass and no others. Equal sets are one class and are never compared; only
the first of a task's equal sets is dealt (of its last `SEEN` ones), and the others join their class at the end.

The links themselves are counted after that (`links=True`): every link lies within a component, so all pairs of classes of a
component are intersected exactly, on whole texts. Large components are cut in blocks, and a task takes two of them; it gives
a sum for each row, never the pairs. Of two classes in a component of two, each links with the other.

Defined results: null, empty and blank texts (also very long blank ones) have no set and link with nothing; a text of fewer words has the one
sequence of all its words; rows that share an id are nodes of their own (their component is the smallest id reached);
null ids are never the smallest (all null: null);
extra columns play no part, whatever their names; very long texts are read whole; an empty table gives an empty result. Sets are compared as sets of
64-bit hashes: within a pair of 10,000 shingles each, a collision has odds of about 1 : 10^11.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import drop, lean, small_batches, tidied, written
from .text import coded, mix, slices, words

LEVELS = 4
TURNS = 4
SEEN = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles."""
    flat, counts = words(texts)
    index, distinct = coded(flat)
    token = np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct.to_pylist()), np.uint64, len(distinct))[index] if len(flat) else np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        n = max(len(token) - size + 1, 0)
        rolled = np.zeros(n, np.uint64)
        for k in range(size):
            rolled = rolled * _BASE + token[k : k + n]
        rolled = mix(rolled)
        ends = np.cumsum(counts)
        for stop, count in zip(ends.tolist(), counts.tolist()):
            if count >= size:
                part = np.sort(rolled[stop - count : stop - size + 1])
                yield part[np.concatenate([[True], part[1:] != part[:-1]])]
            elif count:
                short = np.uint64(count)
                for t in token[stop - count : stop]:
                    short = short * _BASE + t
                yield mix(np.array([short]))
            else:
                yield np.empty(0, np.uint64)


def bounds(limit: int) -> list[int]:
    """The upper sizes of the bands up to one that holds `limit`."""
    out = [6]
    while out[-1] < limit:
        out.append(out[-1] * 2)
    return out


def ladders(n: int, num: int, den: int) -> list[tuple[int, int]]:
    """(ladder, D) for a set of n: its band, and the edges between bands that its partners can be across."""
    tops = bounds(n + 1)
    band = next(i for i, u in enumerate(tops) if n <= u)
    out = [(2 * band, 2 * tops[band] * (den - num) // (den + num))]
    for i in (band - 1, band):
        if i >= 0:
            u = tops[i]
            over = u * den // num  # the largest partner of a set of u
            if num * (u + 1) <= den * n and n <= over and over > u:
                out.append((2 * i + 1, (u + over) * (den - num) // (den + num)))
    return [x for x in out if x[1] > 0]  # D = 0: only equal sets, which are one class already


def slack(d: int) -> int:
    return 1 + -(-6 * (d + 1) // 100)


def names(hashes: np.ndarray, num: int, den: int) -> np.ndarray:
    """The names of all blocks that the set is dealt under."""
    out = []
    with np.errstate(over="ignore"):
        for ladder, d in ladders(len(hashes), num, den):
            s = slack(d)
            blocks = np.uint64(d + 1 + s)
            for level in range(LEVELS):
                h = hashes if level == 0 else np.sort(mix(hashes ^ np.uint64(level * 0x5851F42D4C957F2D & (2**64 - 1))))
                block = ((h >> np.uint64(32)) * blocks) >> np.uint64(32)
                starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
                salt = np.uint64((ladder * LEVELS + level) << 40)
                out.append(mix(np.bitwise_xor.reduceat(mix(h), starts) ^ mix(block[starts] + salt)))
                if int(blocks) - len(starts) <= s:
                    break
                if level == LEVELS - 1:
                    empty = np.setdiff1d(np.arange(int(blocks), dtype=np.uint64), block[starts])
                    out.append(mix(mix(empty + salt)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def sketch(hashes: np.ndarray) -> bytes:
    """Parities of the hashes' low bits, in 2 to 4 bits a shingle."""
    bits = 1 << max(6, int(2 * len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(data: bytes, size: int) -> np.ndarray:
    """A sketch of fewer bits: halves are XORed, as if hashes had lost their high bits."""
    a = np.frombuffer(data, np.uint8)
    while len(a) > size:
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return a


def distances(raw: list[bytes], a: np.ndarray, b: np.ndarray, most: int = 4 << 20) -> np.ndarray:
    """The Hamming distances of pairs of the sketches with numbers a and b, each folded to the narrower one of its pair."""
    width = np.array([len(x) for x in raw], np.int64)
    out = np.zeros(len(a), np.int64)
    kinds = width[a] << 32 | width[b]
    order = np.argsort(kinds, kind="stable")
    for of in np.split(order, np.flatnonzero(np.diff(kinds[order])) + 1) if len(a) else ():
        step = max(1, most // int(width[a[of[0]]] + width[b[of[0]]]))
        for i in range(0, len(of), step):
            part = of[i : i + step]
            pair = [np.frombuffer(b"".join([raw[k] for k in x[part].tolist()]), np.uint8).reshape(len(part), -1) for x in (a, b)]
            size = min(x.shape[1] for x in pair)
            for k in (0, 1):
                while pair[k].shape[1] > size:
                    half = pair[k].shape[1] // 2
                    pair[k] = pair[k][:, :half] ^ pair[k][:, half:]
            out[part] = np.bitwise_count(pair[0] ^ pair[1]).sum(1, dtype=np.int64)
    return out


SETS = "node long, id long, mark long, n int, size int, fp1 long, fp2 long, sketch binary, names array<long>"


def sets(docs: DataFrame, key: str, text: str, size: int, num: int, den: int) -> DataFrame:
    """A row for each row of docs: node (a number of its own), id, mark (hash of the text), n, the text's bytes, the set's fingerprint, its
    narrow sketch and the names of its blocks (none if the task has dealt an equal set before)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                n, fp1, fp2, narrow, blocks, many = [], [], [], [], [], [0]
                for h in shingles(part.column("text"), size):
                    n.append(len(h))
                    x, y = int(np.bitwise_xor.reduce(h)) if len(h) else 0, int(h.sum(dtype=np.uint64)) if len(h) else 0
                    fp1.append(x)
                    fp2.append(y)
                    new = len(h) > 0 and (x, y) not in seen
                    narrow.append(sketch(h) if len(h) else None)
                    if new:
                        if len(seen) >= SEEN:  # sets that are dealt twice only cost time
                            seen.clear()
                        seen.add((x, y))
                        blocks.append(names(h, num, den))
                    many.append(many[-1] + (len(blocks[-1]) if new else 0))
                flat = np.concatenate(blocks) if blocks else np.empty(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(first, first + len(n))),
                        part.column("id"),
                        part.column("mark"),
                        pa.array(n, pa.int32()),
                        pc.binary_length(part.column("text")),
                        pa.array(np.array(fp1, np.uint64).view(np.int64)),
                        pa.array(np.array(fp2, np.uint64).view(np.int64)),
                        pa.array(narrow, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(many, pa.int32()), pa.array(flat.view(np.int64))),
                    ],
                    ["node", "id", "mark", "n", "size", "fp1", "fp2", "sketch", "names"],
                )
                first += len(n)

    t = F.col(f"`{text}`").cast("string")
    return docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.xxhash64(t).alias("mark"), t.alias("text")).mapInArrow(lean(made), SETS)


def _split(rows: DataFrame, hashed, wanted: DataFrame, bits: int = 1 << 22) -> tuple[DataFrame, DataFrame]:
    """The rows whose hash is perhaps in `wanted` (one column of hashes), and those whose is surely not, so that a join
    after it shuffles few others. The filter is a bitmap of a fixed size, whatever the tables' sizes; when it is full, all
    rows are perhaps in `wanted`."""
    place = wanted.select(F.pmod(wanted[0], F.lit(bits)).alias("_p")).select(F.floor(F.col("_p") / 64).alias("_w"), (F.col("_p") % 64).cast("int").alias("_b"))
    words = place.groupBy("_w").agg(F.bit_or(F.expr("shiftleft(1L, _b)")).alias("_v"))
    every = rows.sparkSession.range(bits // 64).join(words, F.col("id") == F.col("_w"), "left").select("id", F.coalesce("_v", F.lit(0)).alias("_v"))
    bitmap = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "_v"))), lambda x: x["_v"]).alias("_map")).scalar()
    word = F.get(bitmap, F.floor(F.col("_at") / 64).cast("int"))
    marked = rows.withColumn("_at", F.pmod(hashed, F.lit(bits))).withColumn("_word", word)
    there = F.expr("shiftrightunsigned(_word, int(_at % 64)) & 1 = 1")
    return marked.filter(there).drop("_at", "_word"), marked.filter(~there).drop("_at", "_word")


def _thinned(rows: DataFrame, hashed, wanted: DataFrame) -> DataFrame:
    return _split(rows, hashed, wanted)[0]


def _texts(docs: DataFrame, key: str, text: str, wanted: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """(_id, _mark, text) of at least the rows whose mark is in `wanted`, one of those with equal ids and texts. Null ids
    are 0 here: which of the rows with the same text it is makes no difference."""
    t = F.col(f"`{text}`").cast("string")
    rows = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(0)).alias("_id"), F.xxhash64(t).alias("_mark"), t.alias("text"))
    rows = _thinned(rows, F.col("_mark"), wanted)
    if repeated is None:
        return rows
    return rows.join(repeated, ["_id", "_mark"], "left_anti").union(rows.join(repeated, ["_id", "_mark"], "left_semi").dropDuplicates(["_id", "_mark"]))


def _packed(small, number, packs: int, *large):
    """The number of a task's share: small ones by the hash of `number`, `packs` in all, others each alone."""
    return F.when(small, F.pmod(F.xxhash64(number), F.lit(packs))).otherwise(F.xxhash64(number, *large))


def _sketched(pairs: DataFrame, faces: DataFrame, num: int, den: int, most: int = 6 << 20) -> DataFrame:
    """The pairs (a, b) of nodes whose sketches are near enough. A task has some of the stars, with each sketch once; a star
    with more than `most` bytes of sketches is dealt to several."""
    spark = pairs.sparkSession
    of = lambda x: faces.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.length("sketch").alias(f"w_{x}"))
    fit, fit_path = written(pairs.join(of("a"), "a").join(of("b"), "b").filter(den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b")).select("a", "b", "w_a", "w_b"))
    stars, stars_path = written(fit.groupBy("b").agg(F.sum(F.col("w_a") + 64).alias("_bytes"), F.greatest(F.lit(1), F.ceil(F.sum("w_a") / most)).alias("_cuts")))
    packs = 1 + (stars.filter("_cuts = 1").agg(F.sum("_bytes")).first()[0] or 0) // most
    pack = _packed(F.col("_cuts") == 1, F.col("b"), packs, F.pmod(F.xxhash64("a"), F.col("_cuts")))
    members, path = written(fit.join(stars, "b").select(pack.alias("pack"), "a", "b"))
    needed = members.select("pack", F.col("a").alias("node")).union(members.select("pack", "b")).distinct()
    shown = needed.join(faces.select("node", "n", "sketch"), "node")

    def passed(rows: pa.Table) -> pa.Table:
        ours = rows.filter(pc.is_null(rows.column("a"))).sort_by("node")
        known, n, raw = ours.column("node").to_numpy(), ours.column("n").to_numpy().astype(np.int64), ours.column("sketch").to_pylist()
        rows = rows.filter(pc.is_valid(rows.column("a")))
        a, b = rows.column("a").to_numpy(), rows.column("b").to_numpy()
        i, j = np.searchsorted(known, a), np.searchsorted(known, b)
        keep = (den + num) * distances(raw, i, j) <= (den - num) * (n[i] + n[j])
        return pa.table({"a": a[keep], "b": b[keep]})

    out, _ = written(members.unionByName(shown, allowMissingColumns=True).groupBy("pack").applyInArrow(lean(passed), "a long, b long"))
    for used in (fit_path, stars_path, path):
        drop(spark, used)
    return out


def _verified(pairs: DataFrame, nodes: DataFrame, texts, size: int, num: int, den: int, most: int = 4 << 20) -> DataFrame:
    """The pairs (a, b) of nodes that link: by sketches first, then exactly on whole texts. A task has some of the stars,
    the texts of about `most` bytes; a larger star is dealt to several tasks that each have its b."""
    spark = nodes.sparkSession
    one = nodes.select("node", "id", "mark", "size")
    left = one.select(F.col("node").alias("a"), *[F.col(c).alias(f"{c}_a") for c in one.columns[1:]])
    right = one.select(F.col("node").alias("b"), *[F.col(c).alias(f"{c}_b") for c in one.columns[1:]])
    near, near_path = written(_sketched(pairs, nodes, num, den).join(left, "a").join(right, "b"))
    stars, stars_path = written(
        near.groupBy("b").agg(F.ceil(F.sum("size_a") / most).alias("_cuts"), F.sum("size_a").alias("_bytes"), F.min("id_b").alias("id"), F.min("mark_b").alias("mark"))
    )
    packs = 1 + (stars.filter("_cuts <= 1").agg(F.sum("_bytes")).first()[0] or 0) // most
    part = F.pmod(F.xxhash64("a"), F.greatest("_cuts", F.lit(1)))
    pack = _packed(F.col("_cuts") <= 1, F.col("b"), packs, F.col("_part"))
    ours = near.select("a", "b", "id_a", "mark_a").join(stars.select("b", "_cuts"), "b").withColumn("_part", part).select(pack.alias("pack"), "b", F.col("a").alias("node"), F.col("id_a").alias("_id"), F.col("mark_a").alias("_mark"))
    theirs = stars.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("_cuts", F.lit(1)) - 1))).select(pack.alias("pack"), "b", F.col("b").alias("node"), F.col("id").alias("_id"), F.col("mark").alias("_mark"))
    asked = ours.union(theirs).withColumn("_id", F.coalesce("_id", F.lit(0)))
    shown = asked.join(texts(near.select("mark_a").union(stars.select("mark"))), ["_id", "_mark"]).select("pack", "b", "node", "text")

    def tested(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("b", "ascending"), ("node", "ascending")]).combine_chunks()
        b, node = rows.column("b").to_numpy(), rows.column("node").to_numpy()
        found, star, against = [], None, None
        for part in slices(rows.select(["text"]).combine_chunks().to_batches(max_chunksize=len(node))[0], "text", 4 << 20):
            for h in shingles(part.column("text"), size):
                i = len(found)
                if b[i] == node[i]:  # the smallest node of a star comes first
                    star, against = b[i], h
                    found.append(False)
                    continue
                if star != b[i]:
                    found.append(False)
                    continue
                common = int((against[np.minimum(np.searchsorted(against, h), len(against) - 1)] == h).sum())
                found.append(den * common >= num * (len(h) + len(against) - common))
        keep = np.array(found, bool)
        return pa.table({"a": node[keep], "b": b[keep]})

    links, _ = written(shown.groupBy("pack").applyInArrow(lean(tested), "a long, b long"))
    drop(spark, near_path)
    drop(spark, stars_path)
    return links


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, num: int = 85, den: int = 100, large: int = 4096, links: bool = False, block: int = 1024) -> DataFrame:
    """A row for each row of docs: node, id, mark, n_shingles, component_id (the smallest id reached), first (whether the
    node stands for its component: it has the smallest id, and of those the smallest number). With `links` also n_links, the
    number of other rows that the row links with; rows with an equal set count each."""
    with small_batches(docs.sparkSession):
        return tidied(docs.sparkSession, lambda: _joined(docs, key, text, size, num, den, large, links, block))[0]


def _joined(docs: DataFrame, key: str, text: str, size: int, num: int, den: int, large: int, links: bool, block: int) -> DataFrame:
    spark = docs.sparkSession
    kept = lambda df: written(df)[0]
    every, every_path = written(sets(docs, key, text, size, num, den))
    # equal sets are a class; the smallest node stands for it
    classes = kept(every.filter("n > 0").groupBy("fp1", "fp2", "n").agg(F.min("node").alias("b"), F.count("*").alias("_k")).filter("_k > 1"))
    again = kept(every.groupBy(F.coalesce("id", F.lit(0)).alias("_id"), F.col("mark").alias("_mark")).count().filter("count > 1").select("_id", "_mark"))
    repeated = None if again.isEmpty() else again
    texts = lambda wanted: _texts(docs, key, text, wanted, repeated)

    # a class is dealt once, though several tasks have named its blocks
    also = kept(every.filter("size(names) > 0").select("node", "fp1", "fp2", "n").join(classes, ["fp1", "fp2", "n"]).filter("node <> b").select("node"))
    perhaps, others = _split(every.filter("size(names) > 0").select("node", "names"), F.xxhash64("node"), also.select(F.xxhash64("node")))
    exploded = lambda df, turn: df.select("node", F.explode("names").alias("name")).filter(F.pmod("name", F.lit(TURNS)) == turn)
    by_name = Window.partitionBy("name")
    met, met_paths = None, []
    for turn in range(TURNS):  # buckets are apart by name: the shuffle files of one turn are gone before the next
        some = exploded(others, turn).union(exploded(perhaps, turn).join(also, "node", "left_anti"))
        some = some.withColumns({"hub": F.min("node").over(by_name), "many": F.count("*").over(by_name), "_all": F.bit_xor(F.xxhash64("node")).over(by_name)})
        # buckets with the same members are one (if two were taken for one, that would only add candidates)
        some = some.filter("many > 1").select(F.xxhash64("hub", "many", "_all").alias("name"), "node", "hub", "many").distinct()
        some, path = written(some)
        met, met_paths = some if met is None else met.union(some), [*met_paths, path]
    met = kept(met.distinct())
    for path in met_paths:
        drop(spark, path)
    who = met.select("node").distinct()
    faces = kept(_thinned(every.drop("names"), F.xxhash64("node"), who.select(F.xxhash64("node"))).join(who, "node", "left_semi"))
    base = kept(every.drop("names", "sketch"))
    drop(spark, every_path)
    tested = kept(met.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
    found = kept(components(_verified(tested, faces, texts, size, num, den)))

    # buckets of three and more that still hold several components: one round tests the nearest such row of each
    # row, which joins most of them, the other one whatever is left
    left = met.filter("many > 2").select("name", "hub", "node")
    for nearest in (True, False):
        placed = left.select("name", "hub", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        held = placed.groupBy("name").agg(F.min("component").alias("_x"), F.max("component").alias("_y"))
        # components only grow: buckets that hold one stay closed, and so do those without a pair that passes
        left = kept(placed.join(kept(held.filter("_x <> _y").select("name")), "name"))
        if left.isEmpty():
            break
        passed = kept(_compared(left, faces, num, den, nearest, large))
        rest = kept(passed.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"))
        if not rest.isEmpty():
            more = _verified(rest, faces, texts, size, num, den)
            found = kept(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)))
            tested = tested.union(rest)
        left = left.join(kept(passed.select("name").distinct()), "name", "left_semi")

    # every row goes to its class, the class to its component; what is joined to is written, so that large ones are split
    rep = base.join(classes.drop("_k"), ["fp1", "fp2", "n"], "left").withColumn("rep", F.coalesce("b", "node"))
    placed = rep.select("node", "id", "mark", "n", "size", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    rows = kept(placed.withColumns({"linked": F.col("component").isNotNull(), "component": F.coalesce("component", "rep")}))
    least = kept(rows.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("_null"), "id", "node")).alias("_m")))
    out = rows.join(least, "component").select(
        "node", "rep", "id", "mark", F.col("n").cast("long").alias("n_shingles"), F.col("_m.id").alias("component_id"), (F.col("node") == F.col("_m.node")).alias("first")
    )
    if links:
        weights = classes.select(F.col("b").alias("node"), "_k")
        members = rows.filter("linked and node = rep").select("node", "id", "mark", "size", "component")
        members = kept(members.join(weights, "node", "left").withColumn("weight", F.coalesce("_k", F.lit(1))).drop("_k"))
        sums = _counted(members, texts, size, num, den, block)
        n_links = (F.coalesce("links", F.lit(0)) + F.coalesce("_k", F.lit(1)) - 1).alias("n_links")
        counts = kept(weights.join(sums, "node", "full").select(F.col("node").alias("rep"), n_links))
        out = out.join(counts, "rep", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
    return out.drop("rep")


def _compared(rows: DataFrame, faces: DataFrame, num: int, den: int, nearest: bool, large: int, most: int = 6 << 20) -> DataFrame:
    """Pairs (a, b), a > b, of rows (name, hub, node, component) in a bucket (name) and different components whose sketches
    are near enough. A task takes many small buckets, those with the same hub together, as they have rows in common: a
    row's sketch comes to a task once. Of a larger bucket a task takes two parts."""
    spark = rows.sparkSession
    wide = rows.join(faces.select("node", F.length("sketch").alias("_w")), "node")
    sized, sized_path = written(wide.groupBy("name", "hub").agg(F.greatest(F.ceil(F.count("*") / large), F.ceil(F.sum("_w") / most)).alias("_cuts"), F.sum("_w").alias("_bytes")))
    small = sized.filter("_cuts = 1")
    hubs, hubs_path = written(small.groupBy("hub").agg(F.ceil(F.sum("_bytes") / most).alias("_subs"), F.sum("_bytes").alias("_all")))
    packs = 1 + (hubs.filter("_subs = 1").agg(F.sum("_all")).first()[0] or 0) // most
    sub = F.pmod(F.xxhash64("name"), F.col("_subs"))
    own = small.join(hubs, "hub").select("name", F.lit(1).cast("long").alias("_cuts"), _packed(F.col("_subs") == 1, F.col("hub"), packs, sub).alias("_pack"))
    dealt = sized.filter("_cuts > 1").select("name", "_cuts", F.lit(None).cast("long").alias("_pack")).union(own)
    dealt, dealt_path = written(dealt)
    parted = rows.join(dealt, "name").withColumn("part", F.pmod(F.xxhash64("node"), F.col("_cuts")))
    parted = parted.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_cuts") - 1)))
    low, high = F.least("part", "_other"), F.greatest("part", "_other")
    members, path = written(
        parted.select(F.coalesce("_pack", F.xxhash64("name", low, high)).alias("pack"), "name", low.alias("low"), high.alias("high"), "part", "node", "component")
    )
    shown = members.select("pack", "node").distinct().join(faces.select("node", "n", "sketch"), "node")
    both = members.unionByName(shown, allowMissingColumns=True)
    out, _ = written(both.groupBy("pack").applyInArrow(_across(num, den, nearest), "a long, b long, name long").distinct())
    for used in (sized_path, hubs_path, dealt_path, path):
        drop(spark, used)
    return out


def _counted(members: DataFrame, texts, size: int, num: int, den: int, block: int, most: int = 8 << 20) -> DataFrame:
    """(node, links): the weights of the other classes that each class (node, id, mark, size, component, weight) links with."""
    spark = members.sparkSession
    held, held_path = written(members.groupBy("component").agg(F.count("*").alias("_many"), F.sum("size").alias("_bytes"), F.sum("weight").alias("_all")).filter("_many > 1"))
    placed, path = written(members.join(held, "component"))
    of_two = placed.filter("_many = 2").select("node", (F.col("_all") - F.col("weight")).alias("links"))
    cuts = F.greatest(F.ceil(F.col("_many") / block), F.ceil(F.col("_bytes") / most))
    more = placed.filter("_many > 2").withColumn("_cuts", cuts).withColumn("_part", F.pmod(F.xxhash64("node"), F.col("_cuts")))
    other = more.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_cuts") - 1)))
    # many small components go to one call; of a large one, two blocks do
    packs = 1 + (more.filter("_cuts = 1").agg(F.sum("size")).first()[0] or 0) // most
    low, high = F.least("_part", "_other"), F.greatest("_part", "_other")
    dealt = other.select(
        "node", "weight", "component", "_part", F.coalesce("id", F.lit(0)).alias("_id"), F.col("mark").alias("_mark"), low.alias("low"), high.alias("high"),
        _packed(F.col("_cuts") == 1, F.col("component"), packs, low, high).alias("pack"),
    )
    shown = dealt.join(texts(more.select("mark")), ["_id", "_mark"]).select("pack", "component", "low", "high", "_part", "node", "weight", "text")
    counts, counts_path = written(shown.groupBy("pack").applyInArrow(_within(size, num, den), "node long, links long"))
    out, _ = written(counts.groupBy("node").agg(F.sum("links").alias("links")).union(of_two))
    for used in (held_path, path, counts_path):
        drop(spark, used)
    return out


def _within(size: int, num: int, den: int, columns: int = 4096):
    """The weights that each row of a block links with in the other block of the component, or in its own; several
    pairs of blocks a call."""

    def counted(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("component", "low", "high", "_part")]).combine_chunks()
        component, low, high, part, node, weight = (rows.column(c).to_numpy() for c in ("component", "low", "high", "_part", "node", "weight"))
        new = np.flatnonzero((component[1:] != component[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1
        nodes, links = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for start, stop in zip([0, *new.tolist()], [*new.tolist(), len(node)]):
            texts = rows.column("text").slice(start, stop - start).combine_chunks()
            held = list(shingles(texts, size))
            n = np.array([len(h) for h in held])
            _, place, often = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
            shared = often > 1  # others are in no intersection
            owner, place = np.repeat(np.arange(len(n)), n)[shared[place]], (np.cumsum(shared) - 1)[place[shared[place]]]
            order = np.argsort(place, kind="stable")
            owner, place = owner[order], place[order]
            # the first block against the second one, or a block against itself
            one = low[start] == high[start]
            cut = len(n) if one else int((part[start:stop] == low[start]).sum())
            left, right = slice(0, cut), slice(0 if one else cut, len(n))
            common = np.zeros((cut, len(n) - right.start), np.int64)
            for k in range(0, int(shared.sum()), columns):
                i, j = np.searchsorted(place, (k, k + columns))
                there = np.zeros((len(n), min(columns, int(shared.sum()) - k)), np.float32)
                there[owner[i:j], place[i:j] - k] = 1
                common += (there[left] @ there[right].T).astype(np.int64)
            linked = den * common >= num * (n[left, None] + n[None, right] - common)
            w = weight[start:stop]
            if one:
                np.fill_diagonal(linked, False)
                got = linked @ w
            else:
                got = np.concatenate([linked @ w[right], w[left] @ linked])
            nodes.append(node[start:stop])
            links.append(got.astype(np.int64))
        return pa.table({"node": np.concatenate(nodes), "links": np.concatenate(links)})

    return lean(counted)


def _across(num: int, den: int, nearest: bool):
    """Pairs a > b of rows of a bucket in different components whose sketches are near enough, or for each row
    the nearest such: of one part of the bucket (low = high) or of two; several buckets a call. The rows of buckets have a
    name; others give the sketches."""

    def near(rows: pa.Table) -> pa.Table:
        faces = rows.filter(pc.is_null(rows.column("name"))).sort_by("node")
        known, sizes = faces.column("node").to_numpy(), faces.column("n").to_numpy()
        raw = faces.column("sketch").to_pylist()
        rows = rows.filter(pc.is_valid(rows.column("name")))
        name, low, high, part, component, node = (rows.column(c).to_numpy() for c in ("name", "low", "high", "part", "component", "node"))
        order = np.lexsort((component, part, high, low, name))
        name, low, high, part, component, node = (x[order] for x in (name, low, high, part, component, node))
        at = np.searchsorted(known, node)
        none = np.empty(0, np.int64)
        left, right, where = [none], [none], [none]
        starts = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])).tolist()
        for start, stop in zip(starts, [*starts[1:], len(node)]):
            held = [raw[k] for k in at[start:stop].tolist()]
            size = min(map(len, held))
            narrow = np.stack([folded(x, size) for x in held]).view(np.uint64)
            group, n, first = component[start:stop], sizes[at[start:stop]], int((part[start:stop] == low[start]).sum())
            two = low[start] < high[start]
            # rows of the other part, or of one part those of the components after this one
            begins = np.full(first, first) if two else np.searchsorted(group, group[:first], "right")
            for i, begin in enumerate(begins.tolist()):
                if begin >= stop - start:
                    continue
                far = np.bitwise_count(narrow[begin:] ^ narrow[i]).sum(1, dtype=np.int64)
                j = np.flatnonzero(((den + num) * far <= (den - num) * (n[begin:] + n[i])) & (group[begin:] != group[i]))
                if len(j):
                    if nearest:
                        j = j[[far[j].argmin()]]
                    other, one = node[start + begin + j], node[start + i]
                    left.append(np.maximum(one, other))
                    right.append(np.minimum(one, other))
                    where.append(np.full(len(j), name[start]))
        return pa.table({"a": np.concatenate(left), "b": np.concatenate(right), "name": np.concatenate(where)})

    return lean(near)


def duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The id, n_shingles, n_links and component_id of every row of docs."""
    return join(docs, key, text, links=True, **options).select(F.col("id").alias(key), "n_shingles", "n_links", "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that stand for their components, with all their columns; rows without a set all do. Of rows that
    are equal in id and text, the one whose columns hash least is taken."""
    def standing() -> DataFrame:
        per_text = join(docs, key, text, **options).groupBy(F.col("id").alias("_near_id"), F.col("mark").alias("_near_mark"))
        found = per_text.agg(F.max("first").alias("_near_first"), (F.max("n_shingles") == 0).alias("_near_none"), (F.count("*") > 1).alias("_near_many"))
        return found.filter("_near_first").drop("_near_first")

    rows, _ = tidied(docs.sparkSession, standing)
    t = F.col(f"`{text}`").cast("string")
    same = F.col(f"`{key}`").cast("long").eqNullSafe(F.col("_near_id")) & F.xxhash64(t).eqNullSafe(F.col("_near_mark"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = docs.join(rows.filter("_near_none or not _near_many"), same, "left_semi").select(*columns)
    many = rows.filter("not _near_none and _near_many")
    if many.isEmpty():
        return kept
    ordered = Window.partitionBy("_near_id", "_near_mark").orderBy(F.xxhash64(*columns))
    one = docs.join(many, same).withColumn("_near_k", F.row_number().over(ordered)).filter("_near_k = 1").select(*columns)
    return kept.union(one)
