"""Embedding near-dedup by product quantisation.

Vectors of a label link when their cosine is `threshold` or more. Unit vectors are put into inverted lists by the nearest
of some coarse centres, with the codes of the residual (`parts` subspaces, 256 centres each) and the length of the
code's error. A query's residual gives a table of distances for each subspace; the sum of looked-up entries is its
distance to a coded vector, which by the triangle inequality is at most the true one plus the error. So a candidate is
what the tables put within reach, and no link is lost; an exact cosine on the original vectors in double precision decides.

Probes suffice by geometry: of two vectors within distance r in different lists, one is within r / 2 of the plane between
their centres. So a vector visits the lists whose plane is that near, and each link is found in the list of one end at
least (and counted in one).

Equal vectors of a label are one class with a weight. Lists are cut into chunks of `chunk` rows, and tasks compare a chunk
of queries with a chunk of coded rows; a task gives sums for each row and the links of a spanning star of each group
that it finds, never all pairs.

Each length of vectors has an index of its own (the `max_widths` commonest; vectors of others are one list, all of which
is compared exactly). Vectors of different lengths never link.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows without label, link
with nothing; rows that share an id are vectors of their own; a component is named by the smallest id in it, null ids only
if there is no other; other columns play no part, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .components import components
from .quantisation import bundled, commonest, kmeans, nearest, sample, subspaces, unbundled, usable
from .shared import lean, local_file, ship, tidied, written

ROWS = "label string, width int, list int, resident boolean, node long, weight long, own int, visits array<int>, x array<{}>, codes binary, error double"
FOUND = "a long, b long, links long"


class Index:
    """Coarse centres (k, d) and codebooks (parts, 256, d / parts), for unit vectors."""

    def __init__(self, centres: np.ndarray, books: list[np.ndarray]):
        self.centres, self.books = centres, books
        self.spaces = subspaces(centres.shape[1], len(books)) if len(centres) else []
        self.between = np.sqrt(np.maximum(((centres[:, None] - centres) ** 2).sum(-1), 1e-18)) if len(centres) else np.empty((0, 0))

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, parts: int) -> Index:
        if not len(x):
            return cls(np.empty((0, 0)), [])
        centres = kmeans(x, lists)
        residual = x - centres[nearest(x, centres)[0]]
        return cls(centres, [kmeans(residual[:, s], 256, 6) for s in subspaces(x.shape[1], parts)])

    def dump(self) -> bytes:
        sizes = np.array([*self.centres.shape, len(self.books), *[len(b) for b in self.books]], "<i8")
        return np.int64(len(sizes)).tobytes() + sizes.tobytes() + self.centres.astype("<f8").tobytes() + b"".join(b.astype("<f8").tobytes() for b in self.books)

    @classmethod
    def load(cls, data: bytes) -> Index:
        n = int(np.frombuffer(data, "<i8", 1)[0])
        k, d, parts, *lengths = np.frombuffer(data, "<i8", n, 8).tolist()
        flat = np.frombuffer(data, "<f8", -1, 8 + 8 * n)
        at, books = k * d, []
        for s, length in zip(subspaces(d, parts) if parts else [], lengths):
            w = s.stop - s.start
            books.append(flat[at : at + length * w].reshape(length, w))
            at += length * w
        return cls(flat[: k * d].reshape(k, d), books)

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and length of the error of unit vectors."""
        own, _ = nearest(x, self.centres)
        residual = x - self.centres[own]
        if not self.books:
            return own, np.empty((len(x), 0), np.uint8), np.sqrt((residual**2).sum(1))
        codes = np.stack([nearest(residual[:, s], b)[0] for s, b in zip(self.spaces, self.books)], 1).astype(np.uint8)
        rebuilt = np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], 1)
        return own, codes, np.sqrt(((residual - rebuilt) ** 2).sum(1))

    def visits(self, x: np.ndarray, own: np.ndarray, reach: float) -> np.ndarray:
        """Which lists (n, k) each vector visits: those whose plane is within half the reach."""
        far = (self.centres**2).sum(1) - 2 * x @ self.centres.T
        margin = (far - far[np.arange(len(x)), own][:, None]) / (2 * self.between[own])
        near = margin <= reach / 2 + 1e-9
        near[np.arange(len(x)), own] = False
        return near

    def tables(self, x: np.ndarray, which: int) -> np.ndarray:
        """(n, parts, 256) squared distances of the residuals' parts to all codes."""
        residual = x - self.centres[which]
        out = np.full((len(x), len(self.books), 256), np.inf, np.float32)
        for m, (s, b) in enumerate(zip(self.spaces, self.books)):
            part = residual[:, s]
            out[:, m, : len(b)] = (part**2).sum(1)[:, None] - 2 * part @ b.T + (b**2).sum(1)
        return out


_INDEX: dict[str, dict[int, Index]] = {}


def _index(name: str, width: int) -> Index:
    """The index of a length; without one, all vectors are in one list, with codes of no parts that rule nothing out."""
    if name not in _INDEX:
        with open(local_file(name), "rb") as f:
            _INDEX[name] = {k: Index.load(v) for k, v in unbundled(f.read()).items()}
    return _INDEX[name].get(width) or Index(np.zeros((1, width)), [])


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of the same length as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def stars(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest number reached from each of 0..n-1 by the links a-b."""
    least = np.arange(n)
    while True:
        before = least
        low = np.minimum(least[a], least[b])
        least = least.copy()
        np.minimum.at(least, a, low)
        np.minimum.at(least, b, low)
        least = least[least]
        if np.array_equal(least, before):
            return least


def compare(index: Index, which: int, table: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (places in the table) of queries and residents, each counted in this list, and the nodes and weights."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    resident = table.column("resident").to_numpy(zero_copy_only=False)
    node, weight, own = (table.column(c).to_numpy() for c in ("node", "weight", "own"))
    x = matrix(table.column("x"))
    norms = np.sqrt((x * x).sum(1))
    r, q = np.flatnonzero(resident), np.flatnonzero(~resident)
    codes = np.stack([np.frombuffer(c, np.uint8) for c in table.column("codes").take(pa.array(r)).to_pylist()]) if len(r) else np.empty((0, 1), np.uint8)
    error = table.column("error").to_numpy()[r]
    goes = np.zeros((len(r), len(index.centres)), bool)
    for i, v in enumerate(table.column("visits").take(pa.array(r)).to_pylist()):
        goes[i, v] = True
    most = (reach + error + 1e-4) ** 2
    left, right = [], []
    for i in range(0, len(q), 256):
        of = q[i : i + 256]
        tables = index.tables(x[of] / norms[of][:, None], which)
        distance = np.zeros((len(of), len(r)), np.float32)
        for m in range(codes.shape[1]):
            distance += np.take(tables[:, m], codes[:, m], axis=1)
        i_q, i_r = np.nonzero(distance <= most)
        home = own[of][i_q] == which
        # in one list the smaller node asks; of two lists that are both visited the smaller one counts
        counts = np.where(home, node[of][i_q] < node[r][i_r], ~goes[i_r, own[of][i_q]] | (which < own[of][i_q]))
        a, b = of[i_q[counts]], r[i_r[counts]]
        for j in range(0, len(a), 1 << 16):
            s, t = a[j : j + (1 << 16)], b[j : j + (1 << 16)]
            near = np.einsum("ij,ij->i", x[s], x[t]) / (norms[s] * norms[t]) >= threshold
            left.append(s[near])
            right.append(t[near])
    return (np.concatenate(left) if left else q[:0]), (np.concatenate(right) if right else q[:0]), node, weight


def link(df: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = 0.93, parts: int = 16, max_rows: int = 20000, max_widths: int = 32, chunk: int = 4096) -> DataFrame:
    """id, n_links and component_id of every row. Links are the pairs with equal labels and a cosine of `threshold` or more.
    The index is fitted on samples of `max_rows` rows a length; its lists grow with the cube root of the rows."""
    return tidied(df.sparkSession, lambda: _linked(df, key, embedding, label, threshold, parts, max_rows, max_widths, chunk))[0]


def _linked(df: DataFrame, key: str, embedding: str, label: str, threshold: float, parts: int, max_rows: int, max_widths: int, chunk: int) -> DataFrame:
    spark = df.sparkSession
    # single precision travels as such; all arithmetic is double
    single = isinstance(df.schema[embedding].dataType, ArrayType) and isinstance(df.schema[embedding].dataType.elementType, FloatType)
    number = "float" if single else "double"
    x = F.col(f"`{embedding}`").cast(f"array<{number}>")
    base, _ = written(
        df.select(
            F.monotonically_increasing_id().alias("node"), F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("string").alias("label"),
            F.when(usable(F.col(f"`{embedding}`")), x).alias("x"),
        )
    )
    part = base.filter("x is not null and label is not null")
    classes, _ = written(part.groupBy("label", "x").agg(F.min("node").alias("node"), F.count("*").alias("weight")))
    fitted = {}
    for width, many in commonest(classes, max_widths):
        drawn = sample(classes.select(F.col("node").alias("id"), "x").filter(F.size("x") == width), many, max_rows)
        fitted[width] = Index.fit(drawn / np.sqrt((drawn**2).sum(1, keepdims=True)), int(np.clip(round(many ** (1 / 3)), 1, 4096)), parts).dump()
    name = ship(spark, bundled(fitted), "vectors", 512 << 20)
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))

    @lean
    def placed(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                lengths = pc.list_value_length(whole.column("x").slice(at, 2048)).to_numpy(zero_copy_only=False)
                for width in np.unique(lengths).tolist():
                    index, batch = _index(name, width), whole.slice(at, 2048).take(pa.array(np.flatnonzero(lengths == width)))
                    m = matrix(batch.column("x"))
                    unit = m / np.sqrt((m * m).sum(1, keepdims=True))
                    own, codes, error = index.code(unit)
                    near = index.visits(unit, own, reach)
                    row, where = np.nonzero(near)
                    many = len(own)
                    take = pa.array(np.concatenate([np.arange(many), np.arange(many), row]))
                    resident = np.arange(len(take)) < many
                    visits = pa.array([np.flatnonzero(v).astype(np.int32) for v in near] + [None] * (len(take) - many), pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("label").take(take), pa.array(np.full(len(take), width, np.int32)), pa.array(np.concatenate([own, own, where]).astype(np.int32)), pa.array(resident),
                            batch.column("node").take(take), batch.column("weight").take(take), pa.array(own[take.to_numpy()].astype(np.int32)), visits,
                            batch.column("x").take(take), pa.array([c.tobytes() for c in codes] + [None] * (len(take) - many), pa.binary()),
                            pa.array(np.concatenate([error, np.zeros(len(take) - many)])),
                        ],
                        ["label", "width", "list", "resident", "node", "weight", "own", "visits", "x", "codes", "error"],
                    )

    @lean
    def compared(table: pa.Table) -> pa.Table:
        which = table.column("list")[0].as_py()
        a, b, node, weight = compare(_index(name, table.column("width")[0].as_py()), which, table, threshold)
        sums = np.bincount(a, weights=weight[b], minlength=len(node)) + np.bincount(b, weights=weight[a], minlength=len(node))
        # a node may be there as query and as resident
        nodes, at = np.unique(node, return_inverse=True)
        least = stars(at[a], at[b], len(nodes))
        tied = np.flatnonzero(least != np.arange(len(nodes)))
        some = np.flatnonzero(sums > 0)
        return pa.table(
            {
                "a": pa.array(np.concatenate([nodes[tied], node[some]]), pa.int64()),
                "b": pa.array([*nodes[least[tied]].tolist(), *[None] * len(some)], pa.int64()),
                "links": pa.array([*[None] * len(tied), *sums[some].astype(np.int64).tolist()], pa.int64()),
            }
        )

    rows, _ = written(classes.mapInArrow(placed, ROWS.format(number)))
    # large lists are cut: every chunk of queries meets every chunk of residents
    counts = rows.groupBy("label", "width", "list").agg(
        F.ceil(F.count_if("resident") / chunk).cast("int").alias("_nr"), F.ceil(F.count_if(~F.col("resident")) / chunk).cast("int").alias("_nq")
    ).filter("_nr > 0 and _nq > 0")
    dealt = rows.join(counts, ["label", "width", "list"])
    own_part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.when(F.col("resident"), F.col("_nq")).otherwise(F.col("_nr")) - 1)))
    dealt = dealt.withColumns(
        {"_r": F.when(F.col("resident"), own_part("_nr")).otherwise(F.col("_other")), "_q": F.when(F.col("resident"), F.col("_other")).otherwise(own_part("_nq"))}
    ).drop("_other", "_nr", "_nq")
    found, _ = written(dealt.groupBy("label", "width", "list", "_r", "_q").applyInArrow(compared, FOUND))

    # links are between classes; their members join them at the end, on written tables, so that large classes are split
    of_class, _ = written(part.join(classes.select("label", "x", F.col("node").alias("rep"), "weight"), ["label", "x"]).select("node", "rep", "weight"))
    reached = components(found.filter("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    sums, _ = written(found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("_sum")).join(reached, "rep", "full"))
    linked = of_class.join(sums, "rep", "left").select("node", F.coalesce("component", "rep").alias("component"), (F.coalesce("_sum", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out, _ = written(base.select("node", "id").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node")))
    least, _ = written(out.groupBy("component").agg(F.min("id").alias("component_id")))
    return out.join(least, "component").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id")
