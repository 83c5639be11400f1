"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

A text's features are its words, their stems (the first letters, for each length of `STEMS`), neighbouring pairs and
pairs with one word between, and stems that several different words of the text begin with (a mark for each number of
`REPEATS`), each once, hashed to `2**bits` places. Words are lower-cased (A-Z) and lose ASCII punctuation at their ends.
The optimiser keeps a learning rate for each coordinate and an L1 term that leaves most weights at exactly 0, so the
model is a short sorted list of places and weights; a bitmap of the places (`2**bits` bits) spares most probes.

It learns in one executor task from a sample of labelled rows, in the order of their ids' hashes: `max_rows` rows at most,
and reading ends once they hold `max_bytes` of text. Texts of every length are in the sample and are read whole; scoring
covers every whole text.

Defined results: null and empty texts have the score of the bias alone; rows that share an id share the largest of its
labels; null labels teach nothing; without labelled rows every score is 0.5; very long texts are scored in a slice of
their own; columns named `score` or `predicted` are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, learned, local_file, ship, small_batches, without
from .text import coded, mix, slices, words

STEMS = (5, 7)
REPEATS = (2, 3)
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_APART = {1: np.uint64(0x9E3779B97F4A7C15), 2: np.uint64(0xC2B2AE3D27D4EB4F)}


def _digests(strings: pa.Array, seed: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in strings.to_pylist()), np.uint64, len(strings))


def features(texts: pa.Array, bits: int, wanted=None) -> tuple[np.ndarray, np.ndarray]:
    """The number of the text and the place of every feature, with repeats. `wanted` (places -> mask) leaves out others."""
    mask = np.uint64((1 << bits) - 1)
    flat, counts = words(texts)
    index, distinct = coded(flat)
    trimmed = pc.ascii_trim(distinct, characters=PUNCTUATION)
    digests = _digests(trimmed, 0)
    length = pc.utf8_length(trimmed).to_numpy(zero_copy_only=False).astype(np.int64) if len(trimmed) else np.empty(0, np.int64)
    keep = length[index] > 0 if len(index) else np.empty(0, bool)  # words of punctuation alone are none
    doc, at = np.repeat(np.arange(len(counts)), counts)[keep], index[keep]
    owners, places = [], []

    def add(owner: np.ndarray, place: np.ndarray) -> None:
        if wanted is not None:
            of = np.flatnonzero(wanted(place))
            owner, place = owner[of], place[of]
        owners.append(owner)
        places.append(place)

    def add_words(place: np.ndarray, valid: np.ndarray) -> None:
        """A place for each distinct word."""
        if wanted is not None:
            valid = valid & wanted(place)
        of = np.flatnonzero(valid[at])
        owners.append(doc[of])
        places.append(place[at[of]])

    add_words(mix(digests) & mask, length > 0)
    for size in STEMS:
        longer = length > size
        stem = mix(_digests(pc.utf8_slice_codeunits(trimmed, 0, size), size))
        add_words(stem & mask, longer)
        marks = [mix(stem + np.uint64(many)) & mask for many in REPEATS]
        asked = longer if wanted is None else longer & np.logical_or.reduce([wanted(m) for m in marks])
        of = np.flatnonzero(asked[at])
        if len(of):
            # each different word of a text once, then the texts' words by stem
            pair = np.unique(doc[of] * len(trimmed) + at[of])
            owner, word = pair // len(trimmed), pair % len(trimmed)
            order = np.lexsort((stem[word], owner))
            owner, word = owner[order], word[order]
            first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (stem[word][1:] != stem[word][:-1])]))
            several = np.diff(first, append=len(owner))
            for many, mark in zip(REPEATS, marks):
                there = first[several >= many]
                add(owner[there], mark[word[there]])
    h = digests[at]
    for step, salt in _APART.items():
        if len(h) > step:
            inside = doc[:-step] == doc[step:]
            add(doc[:-step][inside], mix(h[:-step][inside] * salt + h[step:][inside]) & mask)
    return np.concatenate(owners), np.concatenate(places).astype(np.int64)


class Ftrl:
    """FTRL-proximal with a rate for each coordinate; place 2**bits is the bias, without L1."""

    def __init__(self, bits: int, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((1 << bits) + 1, np.float32)
        self.n = np.zeros((1 << bits) + 1, np.float32)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: float) -> None:
        """One example; `at`: its distinct places and the bias."""
        w = self.weights(at)
        gradient = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w.sum()))))) - label
        square = gradient * gradient
        n = self.n[at]
        self.z[at] += gradient - (np.sqrt(n + square) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + square


def fit(rows: Iterator[tuple[pa.Array, list[int]]], bits: int = 22, alpha: float = 1.0, beta: float = 1.0, l1: float = 3.0, l2: float = 0.1, epochs: int = 4, seed: int = 7, kept: tuple[float, float] = (1.0, 1.0), max_bytes: int = 128 << 20) -> bytes:
    """The model from parts of texts and labels: places and weights that are not 0, the bias first. `kept`: the shares of
    label 0 and label 1 that the sample kept; the bias is moved back by their ratio."""
    model = Ftrl(bits, alpha, beta, l1, l2)
    bias = 1 << bits
    examples, labels, read = [], [], 0  # parts of a few flat arrays
    for texts, known in rows:
        batch = pa.RecordBatch.from_arrays([texts, pa.array(known, pa.int32())], ["t", "y"])
        for part in slices(batch, "t", 1 << 20):
            if read > max_bytes:
                break
            read += sum(x or 0 for x in pc.binary_length(part.column("t")).to_pylist())
            owner, place = features(part.column("t"), bits)
            both = np.unique((owner.astype(np.int64) << bits) | place)
            ends = np.searchsorted(both >> bits, np.arange(1, part.num_rows))
            examples += np.split((both & (bias - 1)).astype(np.int32), ends)
            labels += part.column("y").to_pylist()
    # a place that few examples have moves by less than 1 a visit: if it cannot reach L1, its weight stays 0 and it goes
    often = np.zeros(bias, np.int32)
    for x in examples:
        often[x] += 1
    reaches = often * epochs > l1
    for i, x in enumerate(examples):  # one by one: the parts go as their last example does
        examples[i] = x[reaches[x]]
    del often, reaches
    turn = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in turn.permutation(len(examples)):
            model.learn(np.append(examples[i], bias), float(labels[i]))
    touched, weights = [np.array([bias])], [model.weights(np.array([bias]))]
    weights[0] += math.log(kept[0] / kept[1]) if min(kept) > 0 else 0.0
    for start in range(0, bias, 1 << 18):  # few places at a time: most have no weight
        at = start + np.flatnonzero(model.n[start : min(start + (1 << 18), bias)])
        w = model.weights(at)
        touched.append(at[w != 0])
        weights.append(w[w != 0])
    return np.array([bits], "<i8").tobytes() + np.concatenate([*touched, *weights]).astype("<f8").tobytes()


class Weights:
    """Sorted places with their weights, a bitmap of the places, and the bias."""

    def __init__(self, data: bytes):
        self.bits = int(np.frombuffer(data[:8], "<i8")[0])
        both = np.frombuffer(data[8:], "<f8")
        at, w = both[: len(both) // 2].astype(np.int64), both[len(both) // 2 :]
        self.bias, self.places, self.weights = float(w[0]), at[1:], w[1:].copy()
        self.map = np.zeros(max(1, (1 << self.bits) // 8), np.uint8)
        np.bitwise_or.at(self.map, self.places >> 3, (1 << (self.places & 7)).astype(np.uint8))

    def known(self, places: np.ndarray) -> np.ndarray:
        return ((self.map[(places >> np.uint64(3)).astype(np.int64)] >> (places & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)

    def of(self, places: np.ndarray) -> np.ndarray:
        return self.weights[np.searchsorted(self.places, places)]


@lru_cache(maxsize=4)
def _weights(name: str) -> Weights:
    with open(local_file(name), "rb") as f:
        return Weights(f.read())


def scores(texts: pa.Array, model: Weights) -> np.ndarray:
    """The probability of label 1 for each text."""
    out = []
    batch = pa.RecordBatch.from_arrays([texts], ["t"])
    for part in slices(batch, "t", 1 << 20):
        owner, place = features(part.column(0), model.bits, model.known)  # few features have a weight
        pairs = np.unique((owner.astype(np.int64) << model.bits) | place)
        total = np.bincount(pairs >> model.bits, weights=model.of(pairs & ((1 << model.bits) - 1)), minlength=part.num_rows) + model.bias
        out.append(1 / (1 + np.exp(-np.clip(total, -35, 35))))
    return np.concatenate(out) if out else np.empty(0)


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, max_rows: int) -> tuple[DataFrame, tuple[float, float]]:
    """(text, label) of about `max_rows` labelled rows at most, half of each label as far as there are so many, in the order
    of the hashes of their ids; and the share of each label that was kept."""
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg((F.max(label) > 0).cast("int").alias("_label"))
    many = {r[0]: r[1] for r in known.groupBy("_label").count().collect()}  # two rows
    few = min(many.get(0, 0), many.get(1, 0), max_rows // 2)
    kept = tuple(min(1.0, (max_rows - few if many.get(k, 0) > few else few) / max(many.get(k, 0), 1)) for k in (0, 1))
    chosen = known.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < F.when(F.col("_label") == 1, int(kept[1] * (1 << 30))).otherwise(int(kept[0] * (1 << 30))))
    rows = (
        docs.select(key, F.col(text).alias("_text"))
        .join(F.broadcast(chosen), key)  # about max_rows rows: bounded above
        .filter(F.col("_text").isNotNull())
        .orderBy(F.xxhash64(key), key, "_text")
        .limit(max_rows)
    )
    return rows.select("_text", "_label"), kept


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = 16000, **options) -> bytes:
    """A model from a bounded sample of the labelled rows of `docs`; pass only rows that may teach."""
    rows, kept = sample(docs, labels, key, text, label, max_rows)

    def learn(batches: Iterator[pa.RecordBatch]) -> bytes:
        return fit(((b.column("_text"), b.column("_label").to_pylist()) for b in batches), kept=kept, **options)

    with small_batches(docs.sparkSession):
        return learned(rows, learn) or fit(iter(()), **options)


def score(df: DataFrame, model: bytes, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """Adds score and predicted (int) to every row."""
    name = ship(df.sparkSession, model, "toxicity", 256 << 20)

    @lean
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(scores(texts, _weights(name)))

    kept = without(df, {"score", "predicted"}, text)
    made = F.arrow_udf(scored, "double")(F.col(f"`{text}`").cast("string"))
    return kept.withColumn("score", made).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
