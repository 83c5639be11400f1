"""Approximate nearest neighbours for the largest inner product, by score-aware quantisation.

Vectors are coded in subspaces of `width` components with 16 centres each, two codes to a byte. Codes and centres minimise
an anisotropic loss: the residual's part along the vector, which moves large inner products, weighs `eta` times the
part across it. They are found by coordinate descent, one subspace at a time with the others' residuals fixed; centres
by the weighted least squares of the same loss. A query turns its products with all centres into one table of 8-bit
steps for each byte; a scan adds looked-up entries, and the best `rerank` rows of a chunk (and all that tie with the last)
are scored exactly on the original vectors in double precision.

The centres are fitted on a sample of `max_rows` rows for each of the `max_widths` commonest lengths; every row is coded
and scanned (rows of rarer lengths without codes, so that all are scored exactly). Queries and candidates have the same
length. Chunks of coded rows meet chunks of queries, so a task's memory is bounded whatever the data; each query gets the
best of every chunk, then of all.

Defined results: vectors that are null, empty, zero or hold null or non-finite components are neither queries nor
candidates; a row is never its own candidate, others are, also with the same id, and rows that share an id are queries of
their own; ties go to the smaller id, null ids last; with fewer candidates than asked for, all are returned; other columns
play no part, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .neardup_vectors import matrix
from .quantisation import bundled, commonest, kmeans, sample, unbundled, usable
from .shared import lean, local_file, ship, written

CODED = "node long, id long, x array<{}>, codes binary"
NEAR = "query long, vec_id long, score double, query_id long"


class Codes:
    """Centres (parts, 16, width); vectors are filled up with zeros to whole subspaces."""

    def __init__(self, books: np.ndarray, eta: float):
        self.books, self.eta = books, eta

    def parts(self, x: np.ndarray) -> np.ndarray:
        parts, _, width = self.books.shape
        return np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)

    def assign(self, x: np.ndarray, sweeps: int = 3) -> np.ndarray:
        """(n, parts) codes by coordinate descent."""
        v = self.parts(x)
        weight = (self.eta - 1) / (x * x).sum(1)
        products = np.einsum("npw,pkw->npk", v, self.books)
        norms, own = (self.books**2).sum(-1), (v * v).sum(-1)
        codes = (norms[None] - 2 * products).argmin(-1)
        # along[p]: the residual's product with the vector, by part
        along = own - np.take_along_axis(products, codes[..., None], 2)[..., 0]
        total = along.sum(1)
        for _ in range(sweeps):
            for p in range(v.shape[1]):
                rest = total - along[:, p]
                each = own[:, p, None] - products[:, p]
                loss = norms[p] - 2 * products[:, p] + weight[:, None] * (rest[:, None] + each) ** 2
                codes[:, p] = loss.argmin(1)
                along[:, p] = each[np.arange(len(v)), codes[:, p]]
                total = rest + along[:, p]
        return codes

    def refit(self, x: np.ndarray, codes: np.ndarray) -> None:
        """The best centres for the codes, subspace by subspace."""
        v = self.parts(x)
        weight = (self.eta - 1) / (x * x).sum(1)
        rebuilt = np.stack([self.books[p][codes[:, p]] for p in range(v.shape[1])], 1)
        along = ((v - rebuilt) * v).sum(-1)
        total = along.sum(1)
        width = v.shape[2]
        for p in range(v.shape[1]):
            part = v[:, p]
            outer = np.eye(width) + weight[:, None, None] * part[:, :, None] * part[:, None, :]
            aim = part + (weight * (total - along[:, p] + (part * part).sum(1)))[:, None] * part
            for k in range(16):
                of = codes[:, p] == k
                if of.any():
                    self.books[p, k] = np.linalg.solve(outer[of].sum(0), aim[of].sum(0))
            total -= along[:, p]
            along[:, p] = ((part - self.books[p][codes[:, p]]) * part).sum(1)
            total += along[:, p]

    @classmethod
    def fit(cls, x: np.ndarray, width: int, eta: float, rounds: int = 6) -> Codes:
        parts = -(-x.shape[1] // width)
        parts += parts % 2  # two to a byte
        out = cls(np.zeros((parts, 16, width)), eta)
        v = out.parts(x)
        for p in range(parts):
            centres = kmeans(v[:, p], 16, 8)
            out.books[p, : len(centres)] = centres
        for _ in range(rounds):
            out.refit(x, out.assign(x))
        return out

    def pack(self, x: np.ndarray) -> np.ndarray:
        """(n, parts / 2) bytes."""
        c = self.assign(x).astype(np.uint8)
        return (c[:, 0::2] << 4) | c[:, 1::2]

    def dump(self) -> bytes:
        return np.array([*self.books.shape], "<i8").tobytes() + np.float64(self.eta).tobytes() + self.books.astype("<f8").tobytes()

    @classmethod
    def load(cls, data: bytes) -> Codes:
        shape = np.frombuffer(data, "<i8", 3).tolist()
        return cls(np.frombuffer(data, "<f8", -1, 32).reshape(shape).copy(), float(np.frombuffer(data, "<f8", 1, 24)[0]))

    def scan(self, query: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Sums of table entries for the coded rows, (parts / 2, n) bytes; larger is nearer."""
        products = np.einsum("pw,pkw->pk", self.parts(query[None])[0], self.books)
        low = products.min(1, keepdims=True)
        step = max(float((products - low).max()), 1e-30) / 255
        table = np.rint((products - low) / step).astype(np.uint16)
        pairs = (table[0::2, :, None] + table[1::2, None, :]).reshape(-1, 256)
        total = np.zeros(columns.shape[1], np.uint32)
        for t, c in zip(pairs, columns):
            total += t[c]
        return total


_CODES: dict[str, dict[int, Codes]] = {}


def _codes(name: str, width: int) -> Codes | None:
    if name not in _CODES:
        with open(local_file(name), "rb") as f:
            _CODES[name] = {k: Codes.load(v) for k, v in unbundled(f.read()).items()}
    return _CODES[name].get(width)


def best(codes: Codes | None, queries: np.ndarray, q: np.ndarray, nodes: np.ndarray, ids: np.ndarray, x: np.ndarray, columns: np.ndarray, k: int, rerank: int):
    """The k best rows of the chunk for each query: the query's place, the row's place and exact scores. `ids` order ties."""
    out = []
    for i, (own, query) in enumerate(zip(queries, q)):
        at = np.arange(len(nodes))
        if codes is not None and len(nodes) > rerank + 1:
            total = codes.scan(query, columns)
            total[nodes == own] = 0
            at = np.flatnonzero(total >= np.partition(total, len(total) - rerank - 1)[len(total) - rerank - 1])
        at = at[nodes[at] != own]
        score = x[at] @ query
        order = np.lexsort((ids[at], -score))[:k]
        out.append((np.full(len(order), i), at[order], score[order]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def search(df: DataFrame, queries: Column, key: str = "vec_id", embedding: str = "embedding", k: int = 20, width: int = 2, threshold: float = 0.2, rerank: int = 400, max_rows: int = 10000, max_widths: int = 32, chunk: int = 16384, query_chunk: int = 2048) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest rows found of each row for which `queries` is true."""
    spark = df.sparkSession
    single = isinstance(df.schema[embedding].dataType, ArrayType) and isinstance(df.schema[embedding].dataType.elementType, FloatType)
    number = "float" if single else "double"
    x = F.col(f"`{embedding}`").cast(f"array<{number}>")
    kept = df.withColumn("_gapline_asks", F.coalesce(queries, F.lit(False))).filter(usable(F.col(f"`{embedding}`")))
    # numbers of rows hold only while nothing is computed again
    vectors, _ = written(kept.select(F.monotonically_increasing_id().alias("node"), F.col(f"`{key}`").cast("long").alias("id"), x.alias("x"), F.col("_gapline_asks").alias("asks")))
    fitted = {}
    for d, many in commonest(vectors, max_widths):
        # the weight of the parallel part for products above the threshold
        eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
        fitted[d] = Codes.fit(sample(vectors.filter(F.size("x") == d).select(F.col("node").alias("id"), "x"), many, max_rows), width, eta).dump()
    name = ship(spark, bundled(fitted), "codes", 256 << 20)

    @lean
    def coded(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                part = whole.slice(at, 4096)
                lengths = pc.list_value_length(part.column("x")).to_numpy(zero_copy_only=False)
                for d in np.unique(lengths).tolist():
                    batch, codes = part.take(pa.array(np.flatnonzero(lengths == d))), _codes(name, d)
                    packed = [c.tobytes() for c in codes.pack(matrix(batch.column("x")))] if codes else [b""] * batch.num_rows
                    yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("node", "id", "x")] + [pa.array(packed, pa.binary())], ["node", "id", "x", "codes"])

    rows, _ = written(vectors.select("node", "id", "x").mapInArrow(coded, CODED.format(number)))
    # chunks of each length: a row a length
    sizes = vectors.groupBy(F.size("x").alias("width")).agg(
        F.ceil(F.count("*") / chunk).cast("int").alias("n_r"), F.ceil(F.count_if("asks") / query_chunk).cast("int").alias("n_q")
    ).filter("n_q > 0")
    sizes, _ = written(sizes)
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    by_width = lambda t: t.withColumn("width", F.size("x")).join(sizes, "width")
    columns = ["width", "node", "id", "x", "codes"]
    asked = vectors.filter("asks").select("node", "id", "x", F.lit(None).cast("binary").alias("codes"))
    both = by_width(rows).select(*columns, part("n_r").alias("_r"), every("n_q").alias("_q")).unionByName(
        by_width(asked).select(*columns, every("n_r").alias("_r"), part("n_q").alias("_q"))
    )

    @lean
    def scanned(table: pa.Table) -> pa.Table:
        codes = _codes(name, table.column("width")[0].as_py())
        is_query = table.column("codes").is_null().to_numpy(zero_copy_only=False)
        node, m = table.column("node").to_numpy(), matrix(table.column("x"))
        ids = pc.fill_null(table.column("id"), np.iinfo(np.int64).max).to_numpy()
        bytes_of = table.column("codes").filter(pa.array(~is_query)).to_pylist()
        columns = np.ascontiguousarray(np.stack([np.frombuffer(b, np.uint8) for b in bytes_of]).T) if bytes_of else np.empty((0, 0), np.uint8)
        a, b, s = best(codes, node[is_query], m[is_query], node[~is_query], ids[~is_query], m[~is_query], columns, k, rerank)
        rows = pc.filter(table.column("id"), pa.array(~is_query)).take(pa.array(b))
        return pa.table({"query": pa.array(node[is_query][a], pa.int64()), "vec_id": rows, "score": pa.array(s, pa.float64()), "query_id": pc.filter(table.column("id"), pa.array(is_query)).take(pa.array(a))})

    near = both.groupBy("width", "_r", "_q").applyInArrow(scanned, NEAR)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
