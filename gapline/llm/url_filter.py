"""URL filter: a sorted digest array.

The rules' strings are kept sorted by their 64-bit xxhash in one file: digests, string offsets, string bytes, values.
Executors memory-map it. A url probes the digests of its host suffixes and path prefixes by vectorised binary search;
a digest that fits counts only if the stored full string is equal, so collisions cannot decide.

Defined results: a null url, or one without `://`, has an empty host and path and takes the default verdict; a rule's
path must begin the url's path as written, so a url without a path does not fit `net/`. Of the rules that fit, the
longest string wins (ties: the smaller string). Empty tables give empty results, repeated rows are judged each, very
long urls are judged whole, and extra columns stay (columns of the output's names are replaced).
"""

from __future__ import annotations

import io
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import local_file, lower_ascii, ship, written

MOST_LENGTHS = 256
URL_PARTS = "://([^/?#]*)([^?#]*)"


def build(rules: dict[str, str], digest=xxhash.xxh64_intdigest) -> bytes:
    """The file of `{host + path: verdict}`. Each rule string has a host, then a path that begins with `/`."""
    keyed = sorted((digest(k.encode()), k) for k in rules)
    texts = [k.encode() for _, k in keyed]
    verdicts = sorted(set(rules.values()))
    arrays = {
        "digests": np.array([d for d, _ in keyed], np.uint64),
        "offsets": np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64),
        "verdicts": np.array([verdicts.index(rules[k]) for _, k in keyed], np.int64),
        "blob": np.frombuffer(b"".join(texts), np.uint8),
        "names": np.frombuffer("\n".join(verdicts).encode(), np.uint8),
        "path_lengths": np.array(sorted({len(k) - k.index("/") for k in rules}), np.int64),
        "labels": np.array([max((k[: k.index("/")].count(".") + 1 for k in rules), default=0)], np.int64),
    }
    out = io.BytesIO()
    out.write(np.array([len(arrays)], np.int64).tobytes())
    at = 8 + 24 * len(arrays)
    for name, a in arrays.items():
        out.write(name.encode().ljust(13, b" ") + a.dtype.str.encode().ljust(3) + np.int64(a.size).tobytes())
    for a in arrays.values():
        out.write(b"\0" * (-out.tell() % 8) + a.tobytes())
    return out.getvalue()


class DigestArray:
    """The memory-mapped file."""

    def __init__(self, path: str, digest=xxhash.xxh64_intdigest):
        self.digest = digest
        raw = np.memmap(path, np.uint8, "r")
        at = 8 + 24 * int(raw[:8].view(np.int64)[0])
        for i in range(8, at, 24):
            name, kind = bytes(raw[i : i + 13]).decode().strip(), bytes(raw[i + 13 : i + 16]).decode().strip()
            n = int(np.frombuffer(bytes(raw[i + 16 : i + 24]), np.int64)[0])
            at += -at % 8
            size = n * np.dtype(kind).itemsize
            setattr(self, name, raw[at : at + size].view(kind))
            at += size
        self.names_list = bytes(self.names).decode().split("\n")

    def text(self, i: int) -> bytes:
        return bytes(self.blob[self.offsets[i] : self.offsets[i + 1]])

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The place of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.digests) or not keys:
            return out
        wanted = np.fromiter((self.digest(k) for k in keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, wanted)
        left = np.flatnonzero((at < len(self.digests)) & (self.digests[np.minimum(at, len(self.digests) - 1)] == wanted))
        while len(left):  # a round for each string that shares a digest
            same = np.fromiter((self.text(at[i]) == keys[i] for i in left), bool, len(left))
            out[left[same]] = at[left[same]]
            left = left[~same]
            at[left] += 1
            left = left[(at[left] < len(self.digests)) & (self.digests[np.minimum(at[left], len(self.digests) - 1)] == wanted[left])]
        return out

    def judge(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """The place of the longest rule that fits each url, or -1."""
        keys, owner = [], []
        labels = int(self.labels[0])
        for i, (host, path) in enumerate(zip(hosts, paths)):
            if not path.startswith("/"):
                continue
            parts = host.rsplit(".", labels)[-labels:] if labels else []
            for k in range(len(parts)):
                suffix = ".".join(parts[k:])
                for n in self.path_lengths:
                    if n <= len(path):
                        keys.append((suffix + path[:n]).encode())
                        owner.append(i)
        best = np.full(len(hosts), -1, np.int64)
        found = self.find(keys)
        for j in np.flatnonzero(found >= 0):
            i, b = owner[j], best[owner[j]]
            if b < 0 or (-len(self.text(found[j])), self.text(found[j])) < (-len(self.text(b)), self.text(b)):
                best[i] = found[j]
        return best


@lru_cache(maxsize=4)
def _mapped(name: str) -> DigestArray:
    return DigestArray(local_file(name))


def filter_urls(df: DataFrame, rules: dict[str, str], url: str = "url", default: str = "allow", max_bytes: int = 1 << 30) -> DataFrame:
    """Adds host, path, rule and verdict. The file of the rules goes to every executor, so its size is checked against
    `max_bytes`; `filter_urls_by_join` takes rule sets of any size."""
    name = ship(df.sparkSession, build(rules), "urls", max_bytes)

    @F.pandas_udf("rule string, verdict string")
    def judged(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        array = _mapped(name)
        where, pair = pd.factorize(pd.MultiIndex.from_arrays([hosts, paths])) if len(hosts) else (np.empty(0, int), [])
        best = array.judge([p[0] for p in pair], [p[1] for p in pair])
        rule = np.array([array.text(b).decode() if b >= 0 else None for b in best] or [None], object)
        verdict = np.array([array.names_list[array.verdicts[b]] if b >= 0 else default for b in best] or [None], object)
        return pd.DataFrame({"rule": rule[where], "verdict": verdict[where]})

    parted = _parts(df, url)
    kept = [c for c in parted.columns if c.lower() not in ("rule", "verdict", "_judged")]
    return parted.select(*[F.col(f"`{c}`") for c in kept], judged("host", "path").alias("_judged")).select(
        *[F.col(f"`{c}`") for c in kept], "_judged.rule", "_judged.verdict"
    )


def _parts(df: DataFrame, url: str) -> DataFrame:
    u = F.col(f"`{url}`").cast("string")
    return df.withColumns(
        {
            "host": lower_ascii(F.coalesce(F.regexp_extract(u, URL_PARTS, 1), F.lit(""))),
            "path": F.coalesce(F.regexp_extract(u, URL_PARTS, 2), F.lit("")),
        }
    )


def filter_urls_by_join(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """The same for rules (rule string, verdict string) of any size: probes and rules are joined by digest and full string.
    The rules' most host labels and their paths' lengths (numbers, not rules) are collected and bound the probes."""
    # numbers of rows hold only while nothing is computed again
    numbered, _ = written(df.withColumn("_judged_row", F.monotonically_increasing_id()))
    parted = _parts(numbered, url)
    slash = F.instr("rule", "/")
    shape = rules.select((F.size(F.split(F.substring_index("rule", "/", 1), "\\.")).alias("labels")), (F.length("rule") - slash + 1).alias("path"))
    most = shape.agg(F.max("labels")).first()[0] or 1
    lengths = [r[0] for r in shape.select("path").distinct().orderBy("path").limit(MOST_LENGTHS + 1).collect()]
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"the rules' paths have more than {MOST_LENGTHS} lengths")
    labels = F.split("host", "\\.")
    tails = F.transform(
        F.sequence(F.greatest(F.size(labels) - most, F.lit(0)), F.size(labels) - 1),
        lambda k: F.array_join(F.slice(labels, k + 1, F.size(labels)), "."),
    )
    probes = parted.filter("startswith(path, '/')").select("_judged_row", "path", F.explode(tails).alias("_tail"))
    heads = F.array(*[F.when(F.length("path") >= n, F.concat("_tail", F.substring("path", 1, n))) for n in lengths]) if lengths else F.array().cast("array<string>")
    probes = probes.select("_judged_row", F.explode(heads).alias("rule")).filter("rule is not null").withColumn("_d", F.xxhash64("rule"))
    stored = rules.select(F.col("rule"), F.col("verdict")).withColumn("_d", F.xxhash64("rule"))
    best = probes.join(stored, ["_d", "rule"]).groupBy(F.col("_judged_row").alias("_judged_of")).agg(
        F.min_by(F.struct("rule", "verdict"), F.struct(-F.length("rule"), F.col("rule"))).alias("_j")
    )
    out = parted.join(best, F.col("_judged_of") == F.col("_judged_row"), "left")
    return out.withColumns({"rule": F.col("_j.rule"), "verdict": F.coalesce(F.col("_j.verdict"), F.lit(default))}).drop("_j", "_judged_row", "_judged_of")
