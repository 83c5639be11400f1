"""What both vector operators need: clean vectors, k-means and product codes, in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(embedding: Column) -> Column:
    """Whether a vector takes part: not null or empty, all components finite, not zero."""
    x = embedding.cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return x.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(x, lambda v: v != 0)


def commonest(vectors: DataFrame, most: int) -> list[tuple[int, int]]:
    """The `most` commonest lengths of the column x, with their numbers of rows."""
    return [tuple(r) for r in vectors.groupBy(F.size("x").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(most).collect()]


def bundled(parts: dict[int, bytes]) -> bytes:
    """Parts by number in one file."""
    head = np.array([len(parts), *[v for k, data in parts.items() for v in (k, len(data))]], "<i8")
    return head.tobytes() + b"".join(parts.values())


def unbundled(data: bytes) -> dict[int, bytes]:
    many = int(np.frombuffer(data, "<i8", 1)[0])
    head, at, out = np.frombuffer(data, "<i8", 2 * many, 8).tolist(), 8 + 16 * many, {}
    for k, n in zip(head[::2], head[1::2]):
        out[k] = data[at : at + n]
        at += n
    return out


def sample(vectors: DataFrame, n: int, max_rows: int) -> np.ndarray:
    """About `max_rows` of the n rows of (id, x) at most, by hash of their ids."""
    share = int(min(1.0, max_rows / max(n, 1)) * (1 << 30))
    rows = (
        vectors.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share)
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_rows)
        .toPandas()["x"]
    )
    return np.stack([np.asarray(r, np.float64) for r in rows]) if len(rows) else np.empty((0, 0))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """Centres of x: Lloyd's rounds from a random choice of rows; empty centres restart at the worst rows."""
    draw = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[draw.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near, far = nearest(x, centres)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
        if not full.all():
            centres[~full] = x[np.argsort(-far)[: (~full).sum()]]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and its squared distance."""
    norms = (centres * centres).sum(1)
    at, far = np.empty(len(x), np.int64), np.empty(len(x))
    for i in range(0, len(x), step):
        part = x[i : i + step]
        d = norms - 2 * part @ centres.T
        at[i : i + step] = d.argmin(1)
        far[i : i + step] = d[np.arange(len(part)), at[i : i + step]] + (part * part).sum(1)
    return at, far


def subspaces(width: int, parts: int) -> list[slice]:
    """`parts` runs of components, as even as can be."""
    edges = np.linspace(0, width, min(parts, width) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]
