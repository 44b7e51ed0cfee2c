"""Pieces of texts looked up as arrays: each distinct piece is learned once, all others cost a few array operations.

A piece's key is a polynomial in its bytes, each replaced by a random number: a difference of running sums, shifted to the start by
the inverse power. Longer pieces than SHORT bytes, which are few, are hashed one by one. Keys are 63 bits, in a table of open addresses.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

SHORT = 64
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_draw = np.random.default_rng(11)
_NUMBER = _draw.integers(1, 1 << 63, 256, np.uint64)
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)


class Lexicon:
    """Numbers of pieces. learn(pieces) is called with the bytes of new ones, in the order of their numbers; forget() when all numbers are void."""

    def __init__(self, learn: Callable[[list[bytes]], None], forget: Callable[[], None], most: int = 1 << 20):
        self.learn, self.forget, self.most = learn, forget, most
        self.shift = np.uint64(64 - max(4, (2 * most - 1).bit_length()))
        self._clear()
        self._grow(1 << 16)

    def _clear(self) -> None:
        size = 1 << (64 - int(self.shift))
        self.keys, self.numbers, self.n = np.zeros(size, np.uint64), np.zeros(size, np.int32), 0

    def _grow(self, n: int) -> None:
        ones = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
        ones[0][0] = ones[1][0] = 1
        self.power, self.back = (np.multiply.accumulate(x) for x in ones)

    def _hashed(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(data) >= len(self.power):
            self._grow(len(data) + (len(data) >> 2) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_NUMBER[data] * self.power[: len(data)], out=sums[1:])
        h = (sums[end] - sums[start]) * self.back[start]
        for i in np.flatnonzero(end - start > SHORT).tolist():
            h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
        h ^= h >> np.uint64(31)
        h *= _MIX
        return (h ^ (h >> np.uint64(29))) | np.uint64(1)

    def _found(self, h: np.ndarray) -> np.ndarray:
        out, left, slot = np.full(len(h), -1, np.int32), np.arange(len(h)), (h >> self.shift).astype(np.int64)
        while len(left):
            key = self.keys[slot]
            hit = key == h[left]
            out[left[hit]] = self.numbers[slot[hit]]
            on = ~hit & (key != 0)
            left, slot = left[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out

    def _put(self, h: np.ndarray, number: np.ndarray) -> None:
        slot = (h >> self.shift).astype(np.int64)
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]
            won = self.keys[slot] == h
            self.numbers[slot[won]] = number[won]
            h, number, slot = h[~won], number[~won], (slot[~won] + 1) & (len(self.keys) - 1)

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The numbers of the pieces data[start : end]."""
        h = self._hashed(data, start, end)
        out = self._found(h)
        missing = np.flatnonzero(out < 0)
        new, at = np.unique(h[missing], return_index=True)
        if self.n + len(new) > self.most and self.n:
            self._clear()
            self.forget()
            missing = np.arange(len(h))
            new, at = np.unique(h, return_index=True)
        if not len(new):
            return out
        at = missing[at]
        self.learn([data[s:e].tobytes() for s, e in zip(start[at].tolist(), end[at].tolist(), strict=True)])
        while 2 * (self.n + len(new)) > len(self.keys):  # one batch of more than most pieces
            self.shift -= np.uint64(1)
            assert not self.n
            self._clear()
        self._put(new, np.arange(self.n, self.n + len(new), dtype=np.int32))
        self.n += len(new)
        out[missing] = self._found(h[missing])
        return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings (null: empty) and the edges of its rows."""
    column = pa.concat_arrays([column.cast(pa.large_binary()).fill_null(b"")])
    edge = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[edge[0] : edge[-1]], edge - edge[0]


def runs(edge: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about most bytes, one at least."""
    s = 0
    while s < len(edge) - 1:
        e = max(s + 1, int(np.searchsorted(edge, edge[s] + most, "right")) - 1)
        yield s, e
        s = e


def words(data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of anything but ASCII white space; a row's edge ends a run."""
    space = SPACE[data]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    before[edge[:-1][edge[:-1] < len(data)]] = True
    after[edge[1:][edge[1:] > 0] - 1] = True
    return np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1


class Flat:
    """Growing arrays of numbers, one for each number of a Lexicon."""

    def __init__(self, kind: type):
        self.values, self.n = np.zeros(1 << 16, kind), 0

    def add(self, more: np.ndarray) -> None:
        while self.n + len(more) > len(self.values):
            self.values = np.concatenate((self.values, np.zeros_like(self.values)))
        self.values[self.n : self.n + len(more)] = more
        self.n += len(more)
