"""Elias-Fano coded sequences and the n-gram trie made of them, in one memory-mapped file."""

from __future__ import annotations

import os

import numpy as np

MISS = 0xFFFF
_STEPS = MISS - 1


class Writer:
    """Arrays one after another, each with its kind and size before it."""

    def __init__(self) -> None:
        self.parts: list[bytes] = []

    def put(self, a: np.ndarray) -> None:
        data = np.ascontiguousarray(a).tobytes()
        self.parts.append(np.array([ord(a.dtype.kind), a.dtype.itemsize, a.size], "<i8").tobytes() + data + b"\0" * (-len(data) % 8))

    def dump(self) -> bytes:
        return b"".join(self.parts)


class Reader:
    def __init__(self, data: np.ndarray):
        self.data, self.at = data, 0

    def get(self) -> np.ndarray:
        kind, width, n = self.data[self.at : self.at + 24].view("<i8").tolist()
        start = self.at + 24
        self.at = start + n * width + -(n * width) % 8
        return self.data[start : start + n * width].view(np.dtype(f"<{chr(kind)}{width}"))


#: The place of each set bit of a byte, the highest bit first.
_PLACES = np.array([[*[i for i in range(8) if byte >> (7 - i) & 1], *[8] * 8][:8] for byte in range(256)], np.int64)
_BLOCK = 512  # bits of the unary part between two sampled counts
_CHUNK = 1 << 15  # places looked for at once


class EliasFano:
    """A sorted sequence below `universe`: the low bits of each value side by side, the high bits in unary (a one for each
    value, a zero after each group of equal high bits). Both stay as they lie in the file; the ones before every 512th bit
    are counted, and places are found by counting bits from there."""

    def __init__(self, read: Reader):
        self.n, self.width, self.groups = read.get().tolist()
        self.low = read.get()
        self.unary = read.get()
        self.ones = read.get()
        self.blocks = self.unary.view("<u8").reshape(-1, _BLOCK // 64)
        self.low_windows = np.lib.stride_tricks.sliding_window_view(self.low, 8)
        self.unary_windows = np.lib.stride_tricks.sliding_window_view(self.unary, 8)

    @staticmethod
    def write(out: Writer, values: np.ndarray, universe: int) -> None:
        values = values.astype(np.uint64)
        n = len(values)
        width = min(56, max(0, (universe // n).bit_length() - 1)) if n else 0
        groups = (universe >> width) + 1 if n else 1
        out.put(np.array([n, width, groups], "<i8"))
        low = np.zeros((n * width + 7) // 8 + 8, np.uint8)
        if width and n:
            step = 1 << 16
            bits = []
            for i in range(0, n, step):  # 2^16 * width bits are whole bytes
                part = values[i : i + step, None] >> np.arange(width - 1, -1, -1, dtype=np.uint64)
                bits.append(np.packbits((part & np.uint64(1)).astype(np.uint8).ravel()))
            packed = np.concatenate(bits)
            low[: len(packed)] = packed
        out.put(low)
        unary = np.zeros(((n + groups + 64) // _BLOCK + 1) * _BLOCK, np.uint8)  # 64 bits at least to read beyond the end
        unary[(values >> np.uint64(width)).astype(np.int64) + np.arange(n)] = 1
        out.put(np.packbits(unary))
        out.put(np.cumsum([0, *unary.reshape(-1, _BLOCK).sum(1)[:-1]]).astype("<i8"))

    def _place(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Where the k-th (from 0) one, or zero, of the unary part is."""
        before = self.ones if ones else np.arange(len(self.ones)) * _BLOCK - self.ones
        out = np.empty(len(k), np.int64)
        for i in range(0, len(k), _CHUNK):
            rest = k[i : i + _CHUNK]
            row = np.arange(len(rest))
            at = np.searchsorted(before, rest, "right") - 1
            rest = rest - before[at]
            found = at * _BLOCK
            words = self.blocks[at] if ones else ~self.blocks[at]
            for bits, parts in ((64, words), (8, None)):
                parts = words[:, None].view(np.uint8) if parts is None else parts
                sums = np.cumsum(np.bitwise_count(parts), axis=1, dtype=np.int16)
                part = (sums <= rest[:, None]).sum(1)
                rest = rest - np.where(part > 0, sums[row, part - 1], 0)
                found += part * bits
                words = parts[row, part]
            out[i : i + _CHUNK] = found + _PLACES[words, rest]
        return out

    def _first(self, group: np.ndarray) -> np.ndarray:
        """The first place of each group of equal high bits: the values before it."""
        return np.where(group > 0, self._place(np.maximum(group - 1, 0), False) - (group - 1), 0)

    def _run(self, group: np.ndarray, first: np.ndarray) -> np.ndarray:
        """How many values each group has: the ones that follow in the unary part."""
        bit = first + group
        word = np.ascontiguousarray(self.unary_windows[bit >> 3]).view(">u8").ravel().astype(np.uint64)
        rest = ~(word << (bit & 7).astype(np.uint64))
        for shift in (1, 2, 4, 8, 16, 32):
            rest |= rest >> np.uint64(shift)
        run = 64 - np.bitwise_count(rest).astype(np.int64)
        long = np.flatnonzero(run >= 57)  # the word's end may have come first
        run[long] = self._first(group[long] + 1) - first[long]
        return run

    def lows(self, at: np.ndarray) -> np.ndarray:
        """The low bits at the places."""
        if not self.width:
            return np.zeros(len(at), np.uint64)
        bit = at * self.width
        word = np.ascontiguousarray(self.low_windows[bit >> 3]).view(">u8").ravel().astype(np.uint64)
        return (word << (bit & 7).astype(np.uint64)) >> np.uint64(64 - self.width)

    def values(self, at: np.ndarray) -> np.ndarray:
        """The values at the places."""
        high = (self._place(at, True) - at).astype(np.uint64)
        return ((high << np.uint64(self.width)) | self.lows(at)).astype(np.int64)

    def successor(self, x: np.ndarray, start: np.ndarray | int, stop: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """The first place in [start, stop) whose value is not below x, and whether it is x."""
        high = x >> self.width
        inside = high < self.groups
        high = np.minimum(high, self.groups - 1)
        first = self._first(high)
        a = np.where(inside, np.clip(first, start, stop), stop)
        end = np.where(inside, np.clip(first + self._run(high, first), start, stop), stop)
        b = end.copy()
        wanted = x.astype(np.uint64) & np.uint64((1 << self.width) - 1)
        todo = np.flatnonzero(a < b)
        while len(todo):
            middle = (a[todo] + b[todo]) >> 1
            less = self.lows(middle) < wanted[todo]
            a[todo[less]] = middle[less] + 1
            b[todo[~less]] = middle[~less]
            todo = todo[a[todo] < b[todo]]
        found = a < end
        found[found] = self.lows(a[found]) == wanted[found]
        return a, found


class Trie:
    """n-grams, sorted. Each level holds the last words of its n-grams, made monotone by the number of the context that
    they follow (context * vocabulary + word), and pointers to where each n-gram's followers begin in the next level.
    Every n-gram has the log10 of a smoothed probability in 16 bits: of `least` (below 0) in equal steps."""

    def __init__(self, path: str):
        read = Reader(np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.empty(0, np.uint8))
        self.vocabulary, order = read.get().tolist()
        self.least = float(read.get()[0])
        self.levels, self.pointers, self.codes = [], [], []
        for k in range(order):
            self.levels.append(EliasFano(read))
            self.codes.append(read.get())
            if k < order - 1:
                self.pointers.append(EliasFano(read))

    @staticmethod
    def build(vocabulary: int, grams: list[np.ndarray], logs: list[np.ndarray]) -> bytes:
        """grams[k]: sorted distinct rows of k + 1 words, (n, k + 1), each one's context is a row of grams[k - 1]."""
        out = Writer()
        out.put(np.array([vocabulary, len(grams)], "<i8"))
        least = min([-1e-9, *(float(x.min()) for x in logs if len(x))])
        out.put(np.array([least], "<f8"))
        before = None
        for k, rows in enumerate(grams):
            if k == 0:
                context = np.zeros(len(rows), np.int64)
            else:
                new = (np.any(rows[1:, :-1] != rows[:-1, :-1], axis=1)) if len(rows) else np.empty(0, bool)
                groups = np.concatenate([[0], np.cumsum(new)]) if len(rows) else np.empty(0, np.int64)
                heads = rows[np.concatenate([[True], new])][:, :-1] if len(rows) else rows[:, :-1]
                place = _rank(before, heads)
                context = place[groups] if len(rows) else groups
                pointers = np.searchsorted(context, np.arange(len(before) + 1))
                EliasFano.write(out, pointers, len(rows) + 1)
            EliasFano.write(out, context * vocabulary + rows[:, -1], max(1, len(before) if k else 1) * vocabulary)
            out.put(np.rint(logs[k] / least * _STEPS).astype(np.uint16))
            before = rows
        return out.dump()

    def find(self, rows: np.ndarray) -> np.ndarray:
        """The code of each n-gram (n, k), MISS if it isn't there."""
        at, start, stop = np.zeros((3, len(rows)), np.int64)
        stop[:] = self.levels[0].n
        there = np.ones(len(rows), bool)
        for k in range(rows.shape[1]):
            # rows in order have equal contexts side by side, which are looked for once
            new = np.ones(len(rows), bool)
            new[1:] = np.any(rows[1:, : k + 1] != rows[:-1, : k + 1], axis=1)
            heads, run = np.flatnonzero(new), np.cumsum(new) - 1
            place, found = self.levels[k].successor(at[heads] * self.vocabulary + rows[heads, k], start[heads], stop[heads])
            found &= there[heads]
            place = np.where(found, place, 0)
            if k < rows.shape[1] - 1:
                pointers = self.pointers[k]
                start, stop = pointers.values(place)[run], pointers.values(np.minimum(place + 1, pointers.n - 1))[run]
            at, there = place[run], found[run]
        codes = self.codes[rows.shape[1] - 1]
        return np.where(there, codes[at], MISS).astype(np.uint16) if len(codes) else np.full(len(rows), MISS, np.uint16)

    def log10(self, codes: np.ndarray) -> np.ndarray:
        return codes * (self.least / _STEPS)


def _rank(sorted_rows: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The place of each head among sorted distinct rows."""
    both = np.concatenate([sorted_rows, heads])
    _, inverse = np.unique(both, axis=0, return_inverse=True) if both.shape[1] > 1 else np.unique(both[:, 0], return_inverse=True)
    inverse = inverse.ravel()
    place = np.full(inverse.max(initial=-1) + 1, -1, np.int64)
    place[inverse[: len(sorted_rows)]] = np.arange(len(sorted_rows))
    return place[inverse[len(sorted_rows) :]]

