"""Language ID: a bidirectional gated recurrent network over bytes.

The network reads the bytes of a whole text, with A-Z lower-cased, white space included, between blanks: `CONTEXT` before
it, and after it as many that its length becomes a multiple of 32, and `CONTEXT` more. Every byte gets probabilities of the languages from a forward and a backward state, and a document pools them:
the prediction has the largest mean log probability over all positions, and the score is the mean probability of that
language. To read long texts side by side they are cut into windows of `CORE` bytes; each state is warmed up on
the `CONTEXT` bytes before (or, backwards, after) its window, so words at a cut are read with their surroundings, and each
byte is labelled in one window only.

It is trained in numpy, by backpropagation through time with Adam, in one executor task. The sample has about `max_rows`
texts of each language, for the `max_languages` commonest ones, and reading ends once it holds `max_bytes`; each step
draws windows of any place of any sampled text, and half of them stand alone between blanks, as short texts do. One
more output stands for no learned language: it is taught with windows whose letters were swapped for others or whose bytes
were shuffled. It takes probability from texts in languages that were not learned, and is never predicted.
`train_on_all` goes on from there: every byte of all rows teaches, in shards whose networks are averaged.

Defined results: `und` with score 0 for texts that are null or have no letter, and for all if nothing could be learned;
rows with a null language teach nothing; ties go to the smaller language; repeated rows are judged each, with the same
result; very long texts are read whole, in a slice of their own; columns named `lang_pred` or `score` are replaced; an
empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, learned, local_file, settled, ship, without
from .text import slices

CORE = 256
CONTEXT = 16
BLANK = 0x20
UNKNOWN = "und"
NAMES = ("table", "inner", "out", "bias")


def read_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, A-Z lower-cased, and where each text starts (and the last ends)."""
    low = pc.ascii_lower(pc.fill_null(texts, ""))
    low = low.combine_chunks() if isinstance(low, pa.ChunkedArray) else low
    kind = np.int64 if pa.types.is_large_string(low.type) else np.int32
    offsets = np.frombuffer(low.buffers()[1], kind)[low.offset : low.offset + len(low) + 1].astype(np.int64) if len(low) else np.zeros(1, np.int64)
    return np.frombuffer(low.buffers()[2] or b"", np.uint8) if len(low) else np.empty(0, np.uint8), offsets


def windows(data: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray, core: int) -> np.ndarray:
    """(CONTEXT + core + CONTEXT, n) bytes around the places `first`; those outside of [begin, end) are blank."""
    at = first + np.arange(-CONTEXT, core + CONTEXT)[:, None]
    out = data[np.clip(at, 0, max(len(data) - 1, 0))] if len(data) else np.zeros(at.shape, np.uint8)
    out[(at < begin) | (at >= end)] = BLANK
    return out


class Network:
    """table: (2, 256, 3H) input weights of each byte with biases, inner: (2, H, 3H), out: (2, H, L + 1), bias: (L + 1);
    the last output stands for none of the L languages. The first 2H columns are the update and reset gates, the last H the new state."""

    def __init__(self, languages: list[str], hidden: int = 12, seed: int = 3):
        self.languages, self.h = languages, hidden
        draw = np.random.default_rng(seed)
        self.table = draw.normal(0, 0.3, (2, 256, 3 * hidden)).astype(np.float32)
        self.inner = draw.normal(0, hidden**-0.5, (2, hidden, 3 * hidden)).astype(np.float32)
        self.out = draw.normal(0, hidden**-0.5, (2, hidden, len(languages) + 1)).astype(np.float32)
        self.bias = np.zeros(len(languages) + 1, np.float32)

    def dump(self) -> bytes:
        head = json.dumps([self.languages, self.h]).encode()
        return len(head).to_bytes(4, "little") + head + b"".join(getattr(self, k).astype("<f4").tobytes() for k in NAMES)

    @classmethod
    def load(cls, data: bytes) -> Network:
        n = int.from_bytes(data[:4], "little")
        net = cls(*json.loads(data[4 : 4 + n]))
        at = 4 + n
        for k in NAMES:
            old = getattr(net, k)
            setattr(net, k, np.frombuffer(data, "<f4", old.size, at).reshape(old.shape).copy())
            at += 4 * old.size
        return net

    def label(self, x: np.ndarray) -> np.ndarray:
        """Log probabilities (core, L + 1, n) of the bytes between the contexts of x (CONTEXT + core + CONTEXT, n)."""
        steps, n = x.shape
        core, hidden = steps - 2 * CONTEXT, self.h
        scores = np.empty((core, len(self.bias), n), np.float32)
        scores[:] = self.bias[:, None]
        # sigmoid(u) = (1 + tanh(u / 2)) / 2: the halves are put into the weights
        half = np.repeat(np.array([0.5, 1], np.float32), (2 * hidden, hidden))
        given, gates = np.empty((n, 3 * hidden), np.float32), np.empty((2 * hidden, n), np.float32)
        new, reset = np.empty((hidden, n), np.float32), np.empty((hidden, n), np.float32)
        for way in (0, 1):
            table = self.table[way] * half
            to_gates = np.ascontiguousarray((self.inner[way, :, : 2 * hidden] / 2).T)
            to_new = np.ascontiguousarray((self.inner[way, :, 2 * hidden :] / 2).T)
            out = np.ascontiguousarray(self.out[way].T)
            h = np.zeros((hidden, n), np.float32)
            for t in range(core + CONTEXT) if way == 0 else range(steps - 1, CONTEXT - 1, -1):
                np.take(table, x[t], axis=0, out=given, mode="clip")
                seen = np.ascontiguousarray(given.T)
                np.matmul(to_gates, h, out=gates)
                gates += seen[: 2 * hidden]
                np.tanh(gates, out=gates)
                gates += 1
                np.multiply(gates[hidden:], h, out=reset)
                np.matmul(to_new, reset, out=new)
                new += seen[2 * hidden :]
                np.tanh(new, out=new)
                new -= h
                new *= gates[:hidden]
                new *= 0.5
                h += new
                if CONTEXT <= t < CONTEXT + core:
                    scores[t - CONTEXT] += out @ h
        scores -= scores.max(1, keepdims=True)
        return scores - np.log(np.exp(scores).sum(1, keepdims=True))

    def _states(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """What the bytes of x (T, n) make of both ways' states, a step of each at a time: states (T + 1, 2, H, n), gates
        (T, 2, 2H, n), reset states and new ones (T, 2, H, n). In step s the first way reads byte s and the second one byte
        T - 1 - s, in states[s]; they leave states[s + 1]."""
        steps, n = x.shape
        hidden, table = self.h, self.table.reshape(512, -1)
        to_gates, to_new = (np.ascontiguousarray(m.transpose(0, 2, 1)) for m in (self.inner[:, :, : 2 * hidden], self.inner[:, :, 2 * hidden :]))
        read = np.concatenate([x, x[::-1] + 256], 1)
        states = np.zeros((steps + 1, 2, hidden, n), table.dtype)
        gates = np.empty((steps, 2, 2 * hidden, n), table.dtype)
        reset, new = np.empty((2, steps, 2, hidden, n), table.dtype)
        given, seen = np.empty((2 * n, 3 * hidden), table.dtype), np.empty((2, 3 * hidden, n), table.dtype)
        for s in range(steps):
            np.take(table, read[s], axis=0, out=given, mode="clip")
            seen[...] = given.reshape(2, n, -1).transpose(0, 2, 1)
            before, after, g = states[s], states[s + 1], gates[s]
            np.matmul(to_gates, before, out=g)
            g += seen[:, : 2 * hidden]
            g *= 0.5
            np.tanh(g, out=g)
            g *= 0.5
            g += 0.5
            np.multiply(g[:, hidden:], before, out=reset[s])
            np.matmul(to_new, reset[s], out=new[s])
            new[s] += seen[:, 2 * hidden :]
            np.tanh(new[s], out=new[s])
            np.subtract(new[s], before, out=after)
            after *= g[:, :hidden]
            after += before
        return states, gates, reset, new

    def gradients(self, x: np.ndarray, y: np.ndarray, counted: np.ndarray, few: int = 8) -> tuple[float, dict[str, np.ndarray]]:
        """The mean loss over the bytes of x (T, n) with labels y (n), weighted by `counted` (T, n), and its gradients,
        through time."""
        steps, n = x.shape
        states, gates, reset, new = self._states(x)
        left = [states[1:, 0], states[:0:-1, 1]]  # by byte
        p = sum(self.out[way].T @ left[way] for way in (0, 1)) + self.bias[:, None]
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        many = max(float(counted.sum()), 1e-6)
        loss = -float((np.log(p[:, y, np.arange(n)] + 1e-9) * counted).sum() / many)
        p[:, y, np.arange(n)] -= 1
        p *= (counted / many).astype(p.dtype)[:, None]
        g = {k: np.zeros_like(getattr(self, k)) for k in NAMES}
        g["bias"] = p.sum((0, 2))
        hidden = self.h
        order = np.argsort(x.astype(np.uint8), axis=None, kind="stable")
        values = x.ravel()[order]
        firsts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        from_gates, from_new = self.inner[:, :, : 2 * hidden].copy(), self.inner[:, :, 2 * hidden :].copy()
        before = states[:-1]
        back = np.stack([self.out[0] @ p, (self.out[1] @ p)[::-1]], 1)
        moved = np.empty((steps, 2, 3 * hidden, n), p.dtype)
        carried, d_reset = np.zeros((2, 2, hidden, n), p.dtype)
        for start in range((steps - 1) // few * few, -1, -few):  # a few steps' factors stay in the processor's cache
            of = slice(start, min(start + few, steps))
            z, r, stay = gates[of, :, :hidden], gates[of, :, hidden:], 1 - gates[of, :, :hidden]
            by_new, by_z, by_r = z * (1 - new[of] * new[of]), (new[of] - before[of]) * z * stay, before[of] * r * (1 - r)
            for k in range(len(z) - 1, -1, -1):
                d, m = back[start + k], moved[start + k]
                d += carried
                np.multiply(d, by_new[k], out=m[:, 2 * hidden :])
                np.matmul(from_new, m[:, 2 * hidden :], out=d_reset)
                np.multiply(d, by_z[k], out=m[:, :hidden])
                np.multiply(d_reset, by_r[k], out=m[:, hidden : 2 * hidden])
                np.matmul(from_gates, m[:, : 2 * hidden], out=carried)
                d *= stay[k]
                carried += d
                d_reset *= r[k]
                carried += d_reset
        g["inner"][:, :, : 2 * hidden] = (before @ moved[:, :, : 2 * hidden].transpose(0, 1, 3, 2)).sum(0)
        g["inner"][:, :, 2 * hidden :] = (reset @ moved[:, :, 2 * hidden :].transpose(0, 1, 3, 2)).sum(0)
        for way in (0, 1):
            g["out"][way] = (left[way] @ p.transpose(0, 2, 1)).sum(0)
            by_byte = moved[:: 1 - 2 * way, way].transpose(1, 0, 2).reshape(3 * hidden, -1).take(order, axis=1)
            g["table"][way][values[firsts]] = np.add.reduceat(by_byte, firsts, axis=1).T
        return loss, g


def unlike(text: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Bytes that are in no language: of one text with its letters swapped for others, or shuffled (all but blanks)."""
    if draw.random() < 0.7:
        other = np.arange(256, dtype=np.uint8)
        for low, high in ((0x61, 0x7B), (0x80, 0xC0)):
            other[low:high] = low + draw.permutation(high - low)
        return other[text]
    out, of = text.copy(), np.flatnonzero(text != BLANK)
    out[of] = text[draw.permutation(of)]
    return out


class Adam:
    """Steps on a network's weights, by the moments of its gradients."""

    def __init__(self, net: Network):
        self.net, self.step = net, 0
        self.moments = {k: (np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))) for k in NAMES}

    def move(self, g: dict[str, np.ndarray], rate: float) -> None:
        self.step += 1
        for k in NAMES:
            m, v = self.moments[k]
            m += 0.1 * (g[k] - m)
            v += 0.01 * (g[k] * g[k] - v)
            getattr(self.net, k)[...] -= rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.99**self.step)) + 1e-8)


def fit(rows: Iterator[tuple[pa.Array, list[str]]], hidden: int = 12, steps: int = 240, batch: int = 192, core: int = 32, rate: float = 0.02, seed: int = 5, max_bytes: int = 64 << 20) -> bytes:
    """A trained network from parts of texts and their languages."""
    parts, lengths, languages, read = [], [], [], 0
    for texts, names in rows:
        for i, name in enumerate(names):
            if read > max_bytes:
                break
            data, offsets = read_bytes(texts.slice(i, 1))
            part = data[offsets[0] : offsets[1]]
            if len(part):
                parts.append(part.copy())
                lengths.append(len(part))
                languages.append(name)
                read += len(part)
    names = sorted(set(languages))
    net = Network(names, hidden)
    if not names:
        return net.dump()
    draw = np.random.default_rng(seed)
    data, stops = np.concatenate(parts), np.cumsum(lengths)
    starts, known = stops - lengths, np.array([names.index(x) for x in languages])
    of = [np.flatnonzero(known == k) for k in range(len(names))]
    adam = Adam(net)
    inside = np.arange(-CONTEXT, core + CONTEXT)[:, None]
    for step in range(1, steps + 1):
        y = draw.integers(0, len(names) + 1, batch)  # languages, then their texts, then places
        source = np.where(y < len(names), y, draw.integers(0, len(names), batch))
        row = np.array([of[k][draw.integers(0, len(of[k]))] for k in source])
        first = starts[row] + (draw.random(batch) * np.maximum(stops[row] - starts[row] - core // 2, 1)).astype(np.int64)
        length = np.minimum(core, stops[row] - first)
        alone = draw.random(batch) < 0.5
        length = np.where(alone, np.ceil(length * draw.random(batch)).astype(np.int64).clip(1), length)
        x = windows(data, np.where(alone, first, starts[row]), np.where(alone, first + length, stops[row]), first, core)
        for i in np.flatnonzero(y == len(names)):
            x[:, i] = unlike(x[:, i], draw)
        _, g = net.gradients(x.astype(np.intp), y, ((inside >= 0) & (inside < length)).astype(np.float32))
        adam.move(g, rate * min(1, step / 10) * (1 - 0.95 * step / steps))
    return net.dump()


def pieces(offsets: np.ndarray, core: int, alone: float, draw: np.random.Generator) -> tuple[np.ndarray, ...]:
    """Windows that have each byte of all texts in one of them: the text, the first byte, the length, and whether the window
    is read between blanks, as a short text is. A share `alone` of the windows is cut into such pieces of 32 bytes at most."""
    size = np.diff(offsets)
    many = -(-size // core)
    doc = np.repeat(np.arange(len(size)), many)
    first = offsets[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * core
    length = np.minimum(offsets[1:][doc] - first, core)
    cut = draw.random(len(doc)) < alone
    docs, firsts, lengths = [doc[~cut]], [first[~cut]], [length[~cut]]
    for k in np.flatnonzero(cut).tolist():
        ends = np.cumsum(draw.integers(1, 33, length[k]))
        ends = np.append(ends[ends < length[k]], length[k])
        docs.append(np.full(len(ends), doc[k]))
        firsts.append(first[k] + np.append(0, ends[:-1]))
        lengths.append(np.diff(ends, prepend=0))
    by_itself = np.arange(sum(map(len, docs))) >= len(docs[0])
    return np.concatenate(docs), np.concatenate(firsts), np.concatenate(lengths), by_itself


def refine(model: bytes, texts: pa.Array, names: list[str], weights: dict[str, float], seed: int, core: int = 224, batch: int = 1 << 15, alone: float = 1 / 32, unlikes: float = 1 / 32, rate: float = 0.004) -> Network:
    """The network after one more pass over every byte of all texts, in batches of about `batch` bytes; `weights`: of a
    language's bytes."""
    net, draw = Network.load(model), np.random.default_rng(seed)
    adam, none = Adam(net), len(net.languages)
    data, offsets = read_bytes(texts)
    doc, first, length, by_itself = pieces(offsets, core, alone, draw)
    y = np.array([net.languages.index(x) for x in names], np.int64)[doc]
    weight = np.array([weights[x] for x in net.languages])[y]
    begin, end = np.where(by_itself, first, offsets[:-1][doc]), np.where(by_itself, first + length, offsets[1:][doc])
    # windows of like lengths side by side, else in any order
    order = draw.permutation(len(doc))
    wide = -(-length // 32) * 32
    order = order[np.argsort(wide[order], kind="stable")]
    batches = [part[i : i + step] for part in np.split(order, np.flatnonzero(np.diff(wide[order])) + 1) if len(part) for step in [max(1, batch // int(wide[part[0]] + 2 * CONTEXT))] for i in range(0, len(part), step)]
    for step, k in enumerate(draw.permutation(len(batches)).tolist(), 1):
        of = batches[k]
        extra = of[draw.random(len(of)) < unlikes]
        both = np.concatenate([of, extra])
        x = windows(data, begin[both], end[both], first[both], int(wide[of[0]]))
        for i in range(len(of), len(both)):
            x[:, i] = unlike(x[:, i], draw)
        label = np.concatenate([y[of], np.full(len(extra), none)])
        share = np.concatenate([weight[of], np.full(len(extra), 1 / (unlikes * none))])
        inside = np.arange(-CONTEXT, int(wide[of[0]]) + CONTEXT)[:, None]
        _, g = net.gradients(x.astype(np.intp), label, ((inside >= 0) & (inside < length[both])) * share.astype(np.float32))
        adam.move(g, rate * min(1, step / 10) * (1 - 0.95 * step / len(batches)))
    return net


@lru_cache(maxsize=4)
def _network(name: str) -> Network:
    with open(local_file(name), "rb") as f:
        return Network.load(f.read())


def pooled(net: Network, texts: pa.Array, side: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of log probabilities and of probabilities over all bytes of each text (n, L + 1), and the bytes of each."""
    data, offsets = read_bytes(texts)
    size = np.diff(offsets)
    many = -(-size // CORE)
    doc = np.repeat(np.arange(len(size)), many)
    first = offsets[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * CORE
    length = np.minimum(offsets[1:][doc] - first, CORE)
    logs, plain = np.zeros((len(size), len(net.bias))), np.zeros((len(size), len(net.bias)))
    # windows of like lengths side by side
    order = np.argsort(length, kind="stable")
    steps = -(-length[order] // 32) * 32
    cuts = np.flatnonzero(np.diff(steps)) + 1
    for group in np.split(order, cuts):
        for i in range(0, len(group), side):
            of = group[i : i + side]
            core = int(-(-length[of[-1]] // 32) * 32)
            got = net.label(windows(data, offsets[:-1][doc[of]], offsets[1:][doc[of]], first[of], core).astype(np.intp))
            if length[of[0]] < core:
                got = np.where((np.arange(core)[:, None] < length[of])[:, None], got, -np.inf)
            there = np.where(np.isfinite(got), got, 0).sum(0, dtype=np.float64) if length[of[0]] < core else got.sum(0, dtype=np.float64)
            np.add.at(logs, doc[of], there.T)
            np.add.at(plain, doc[of], np.exp(got).sum(0, dtype=np.float64).T)
    return logs, plain, size.astype(float)


def predict(net: Network, texts: pa.Array) -> pa.StructArray:
    names, chosen = [], []
    lettered = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
    for part in slices(pa.RecordBatch.from_arrays([texts], ["t"]), "t", 4 << 20) if net.languages else ():
        logs, plain, n = pooled(net, part.column(0))
        best = logs[:, : len(net.languages)].argmax(1)
        names.append(np.array(net.languages, object)[best])
        chosen.append(plain[np.arange(len(best)), best] / np.maximum(n, 1))
    name = np.concatenate(names) if names else np.full(len(texts), UNKNOWN, object)
    score = np.concatenate(chosen) if chosen else np.zeros(len(texts))
    name, score = np.where(lettered, name, UNKNOWN), np.where(lettered, score, 0.0)
    return pa.StructArray.from_arrays([pa.array(name, pa.string()), pa.array(np.clip(score, 0, 1), pa.float64())], ["lang_pred", "score"])


def _sample(docs: DataFrame, key: str, text: str, language: str, max_rows: int, max_languages: int) -> tuple[DataFrame, int]:
    """(_key, _text, _name) of about `max_rows` rows of each of the commonest languages, by hash of their ids, and how many
    languages these are."""
    known = docs.filter(F.col(language).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"), F.col(language).alias("_name"))
    each = known.groupBy("_name").count().orderBy(F.desc("count"), "_name").limit(max_languages).collect()
    if not each:
        return known.limit(0), 0
    share = F.create_map(*[F.lit(x) for k, n in each for x in (k, int(min(1.0, max_rows / n) * (1 << 30)))])
    return known.filter(F.pmod(F.xxhash64("_key"), F.lit(1 << 30)) < share[F.col("_name")]), len(each)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang", max_rows: int = 500, max_languages: int = 100, **options) -> bytes:
    """A network from a bounded sample of the rows of `docs`; pass only rows that may teach."""

    def learn(batches: Iterator[pa.RecordBatch]) -> bytes:
        return fit(((b.column("_text"), b.column("_name").to_pylist()) for b in batches), **options)

    chosen, many = _sample(docs, key, text, language, max_rows, max_languages)
    ordered = chosen.orderBy(F.xxhash64("_key"), "_key", "_text", "_name").limit(2 * max_rows * max(many, 1)).select("_text", "_name")
    return learned(ordered, learn, Network([]).dump())


def train_on_all(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang", shard: int = 8 << 20, groups: int = 16, **options) -> bytes:
    """A network that every byte of all rows of `docs` in its languages taught; pass only rows that may teach. It starts
    from `train`; then each shard of about `shard` bytes (rows by the hash of their content) teaches a copy by a pass over all
    of its bytes, and the copies are averaged by bytes. Languages weigh alike."""
    model = train(docs, key, text, language, **options)
    names = Network.load(model).languages
    t = F.col(text).cast("string")
    known = docs.select(t.alias("_text"), F.col(language).alias("_name"), F.xxhash64(key, t, language).alias("_order")).filter(F.col("_name").isin(names) & (F.length("_text") > 0))
    size = {r[0]: r[1] for r in known.groupBy("_name").agg(F.sum(F.octet_length("_text"))).collect()}  # a row a language
    if not size:
        return model
    weights = {k: sum(size.values()) / (len(size) * size[k]) if k in size else 0.0 for k in names}
    shards = 1 + sum(size.values()) // shard
    file = ship(docs.sparkSession, model, "language", 64 << 20)

    def taught(rows: pa.Table) -> pa.Table:
        number = rows.column("_shard")[0].as_py()
        rows = rows.sort_by([("_order", "ascending"), ("_text", "ascending")])
        texts, of = rows.column("_text").combine_chunks(), rows.column("_name").to_pylist()
        del rows
        with open(local_file(file), "rb") as f, settled():
            net = refine(f.read(), texts, of, weights, number)
        return pa.table({"_shard": [number], "_bytes": [pc.sum(pc.binary_length(texts)).as_py()], "_net": [np.concatenate([getattr(net, k).ravel() for k in NAMES]).astype("<f8").tobytes()]})

    def added(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_shard")
        each = zip(rows.column("_bytes").to_pylist(), rows.column("_net"))
        return pa.table({"_shard": rows.column("_shard")[:1], "_net": [sum(n * np.frombuffer(x.as_py(), "<f8") for n, x in each).tobytes()]})

    dealt = known.withColumn("_shard", F.pmod(F.xxhash64("_order"), F.lit(shards)))
    nets = dealt.groupBy("_shard").applyInArrow(lean(taught), "_shard long, _bytes long, _net binary")
    sums = nets.groupBy(F.pmod("_shard", F.lit(groups))).applyInArrow(lean(added), "_shard long, _net binary").collect()  # `groups` rows
    mean = sum(np.frombuffer(r["_net"], "<f8") for r in sorted(sums, key=lambda r: r["_shard"])) / sum(size.values())
    net, at = Network.load(model), 0
    for k in NAMES:
        old = getattr(net, k)
        old[...] = mean[at : at + old.size].reshape(old.shape)
        at += old.size
    return net.dump()


def least_scores(docs: DataFrame, model: bytes, lost: float, text: str = "text", language: str = "lang", steps: int = 10_000) -> dict[str, float]:
    """`least_of` the rows of `docs`, which did not teach."""
    known = docs.select(F.col(text).alias("text"), F.col(language).alias("_name"))
    return least_of(identify(known, model), model, lost, "_name", steps)


def least_of(judged: DataFrame, model: bytes, lost: float, language: str = "lang", steps: int = 10_000) -> dict[str, float]:
    """For each learned language the largest multiple of 1 / `steps` that at most a share `lost` of all its rows in `judged`
    (with lang_pred and score) that are found to be in it score under; pass only rows that did not teach. It is never under
    `clearly_above_chance`, also for a language without such rows."""
    languages = Network.load(model).languages
    least = clearly_above_chance(len(languages))
    found: dict[str, list[tuple[int, int]]] = {}
    if languages:
        right = judged.filter(F.col(language).isin(languages) & (F.col("lang_pred") == F.col(language)))
        counts = right.groupBy("lang_pred", F.floor(F.col("score") * steps).alias("_step")).count()
        for name, at, many in counts.collect():  # at most `steps` + 1 rows a language, however many documents
            found.setdefault(name, []).append((at, many))
    out = {}
    for name in languages:
        under, bound, allowed = 0, 0, lost * sum(many for _, many in found.get(name, []))
        for at, many in sorted(found.get(name, [])):
            bound = at
            under += many
            if under > allowed:
                break
        out[name] = max(least, bound / steps)
    return out


def clearly_above_chance(languages: int) -> float:
    """One and a half times the score of guessing; with one or two languages 0.75, halfway from a coin to certainty."""
    return min(0.75, 1.5 / max(languages, 1))


def identify(df: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """Adds lang_pred and score to every row."""
    name = ship(df.sparkSession, model, "language", 64 << 20)

    @lean
    def predicted(texts: pa.Array) -> pa.Array:
        return predict(_network(name), texts)

    kept = without(df, {"lang_pred", "score", "_labelled"}, text)
    marked = kept.withColumn("_labelled", F.arrow_udf(predicted, "lang_pred string, score double")(F.col(f"`{text}`").cast("string")))
    return marked.select(*[F.col(f"`{c}`") for c in kept.columns if c not in ("lang_pred", "score")], "_labelled.lang_pred", "_labelled.score")
