"""Exact substring removal with sparse suffix arrays, sorted deep-shallow.

A byte goes if a string of length bytes that covers it also starts earlier (smaller key, or same document and earlier start).

Every window of length bytes has an anchor: among its GRAM-byte grams the one with the smallest hash, the leftmost if equal.
The anchor depends on the window's bytes alone, so equal windows have equal grams as anchors, at the same offset. Successive windows with one
anchor form a superwindow, a piece of some 140 bytes. Grams so frequent that they would overload a bucket are ranked last when anchors are chosen, so
that they are anchors only of windows made of nothing else, which are equal and collapse.

Equal windows agree in half their length to the right of the anchor's start, or in the rest to its left. So hashes of these two contexts are
counted over all documents first (tally.py), and only a piece of which one is found twice goes on: pieces are dealt by their anchor's hash over
buckets, as compressed blocks, with equal pieces of a part sent once.

In a bucket, the suffixes that start at anchors, and the reversed prefixes that end there, are sorted: multikey quicksort, with
eight bytes as a character, to SHALLOW bytes, then blind tries for the groups that still agree. Order and common prefixes give
for each depth the classes of equal contexts; a window with offset o is its class of left contexts at depth o with its class of right contexts
at depth length - o, and all of a pair but the earliest window are covered.

Defined cases: null texts are empty; texts under length bytes lose nothing; a null key is later than all others; rows that share
a key are ordered by start alone (equal pieces of different texts at one key and start are ties: only one travels, and the others get
what is found for it); equal rows are handled once and given back as often as they came; very long texts yield more pieces, none larger; extra
input columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernelfield.llm.common import Scratch, lean, plain_text, table, trim
from kernelfield.llm.tally import Tally, parted

LENGTH, GRAM, SHALLOW = 100, 16, 32
SLOT_BITS = 22
_LAST = np.iinfo(np.int64).max
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hashes of the 16-byte grams that start at each position."""
    words = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,)).copy()
    h = (words[:-8] * _C[0]) ^ (words[8:] * _C[1])
    h ^= h >> np.uint64(29)
    h *= _C[2]
    return h ^ (h >> np.uint64(32))


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def anchors(raw: np.ndarray, hot: np.ndarray | None, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Superwindows of a text of at least length bytes: first window, last window, anchor, all as positions, and the hashes of all grams."""
    h = gram_hashes(raw)
    key = (h >> np.uint64(33)) << np.uint64(32)
    if hot is not None:
        key |= hot[_slots(h)].astype(np.uint64) << np.uint64(63)
    key |= np.arange(len(h), dtype=np.uint64)
    span, done = length - GRAM + 1, 1
    least = key
    while 2 * done <= span:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if done < span:
        least = np.minimum(least[: len(least) - (span - done)], least[span - done :])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    turn = np.flatnonzero(at[1:] != at[:-1]) + 1
    first = np.concatenate(([0], turn))
    return first, np.concatenate((turn - 1, [len(at) - 1])), at[first], h


def contexts(low: np.ndarray, high: np.ndarray, at: np.ndarray, h: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of contexts of superwindows: number and hash of those to the right of an anchor's start, and of those to its left.

    A window whose anchor is at offset o has half its bytes from there on if o <= length - half, else at least length - half bytes before.
    """
    half = length // 2

    def chained(begin: np.ndarray, size: int, seed: np.uint64) -> np.ndarray:
        out = np.full(len(begin), seed)
        for k in sorted({*range(0, max(1, size - GRAM + 1), GRAM), max(0, size - GRAM)}):
            out = (out ^ h[begin + k]) * _C[0]
            out ^= out >> np.uint64(31)
        return out * _C[2] ^ (out >> np.uint64(29))

    right, left = np.flatnonzero(at - high <= length - half), np.flatnonzero(at - low >= length - half)
    return right, chained(at[right], half, _C[0]), left, chained(at[left] - (length - half), length - half + GRAM, _C[1])


_HEAD = struct.Struct("<QQ")
_COLUMNS = (("doc", "<i8"), ("rid", "<i8"), ("low", "<u4"), ("size", "<u4"), ("off", "<u2"))


class Pieces:
    """Pieces of texts: the key and text hash of their row, first window, size in bytes, offset of the anchor, and the bytes."""

    def __init__(self, columns: dict, data: bytes):
        self.c, self.data = columns, data

    def packed(self, level: int = 1) -> bytes:
        n = len(self.c["doc"])
        head = b"".join(np.ascontiguousarray(np.diff(self.c[k], prepend=0) if k == "doc" else self.c[k], t).tobytes() for k, t in _COLUMNS)
        return _HEAD.pack(n, len(head)) + zstandard.ZstdCompressor(level=level).compress(head + self.data)

    @staticmethod
    def unpacked(blocks: list[bytes]) -> Pieces:
        columns, data = {k: [] for k, _ in _COLUMNS}, []
        for block in blocks:
            n, head = _HEAD.unpack_from(block)
            raw, at = zstandard.ZstdDecompressor().decompress(block[_HEAD.size :]), 0
            for k, t in _COLUMNS:
                part = np.frombuffer(raw, t, n, at)
                columns[k].append(np.cumsum(part) if k == "doc" else part)
                at += n * np.dtype(t).itemsize
            data.append(raw[head:])
        return Pieces({k: np.concatenate(v).astype(np.int64) for k, v in columns.items()}, b"".join(data))


def _digests(data: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """128-bit hashes of pieces, as two columns."""
    view, f = memoryview(data), xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([f(view[a:b]) for a, b in zip(start.tolist(), (start + size).tolist(), strict=True)]), np.uint64).reshape(-1, 2)


def _earliest(group: np.ndarray, doc: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows with group numbers: an order by group and position, and where in it groups begin."""
    order = np.lexsort((low, doc, group))
    g = group[order]
    return order, np.concatenate(([True], g[1:] != g[:-1]))


def _group_numbers(digest: np.ndarray) -> np.ndarray:
    order = np.lexsort((digest[:, 1], digest[:, 0]))
    d = digest[order]
    number = np.empty(len(d), np.int64)
    number[order] = np.cumsum(np.concatenate(([True], (d[1:] != d[:-1]).any(1)))) if len(d) else 0
    return number


class BlindTrie:
    """A Patricia trie that stores, of its strings, only depths and branching bytes; the strings are looked up at the leaves."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | int = 0  # a leaf is the number of its string, a node [depth, {byte: child}, some leaf below]
        for i in range(1, len(strings)):
            self._insert(i)

    @staticmethod
    def _byte(s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    def _insert(self, i: int) -> None:
        s, node = self.strings[i], self.root
        while not isinstance(node, int):  # blind: only branching bytes are compared
            node = node[1].get(self._byte(s, node[0]), node[2])
        t = self.strings[node]
        low, high = 0, min(len(s), len(t))
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if s[:mid] == t[:mid] else (low, mid - 1)
        above, node = None, self.root
        while not isinstance(node, int) and node[0] < low:
            above, node = node, node[1][self._byte(s, node[0])]
        if not isinstance(node, int) and node[0] == low:
            node[1][self._byte(s, low)] = i
            return
        some = node if isinstance(node, int) else node[2]
        new = [low, {self._byte(self.strings[some], low): node, self._byte(s, low): i}, some]
        if above is None:
            self.root = new
        else:
            above[1][self._byte(s, above[0])] = new

    def ordered(self) -> Iterator[tuple[int, int]]:
        """Number of each string in order, and the length it shares with the one before (-1: the first)."""
        stack: list[tuple] = [(self.root, -1)]
        while stack:
            node, shared = stack.pop()
            if isinstance(node, int):
                yield node, shared
                continue
            children = sorted(node[1].items())
            stack += [(c, node[0] if k else shared) for k, (_, c) in reversed(list(enumerate(children)))]


def multikey_quicksort(group: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of words (each a string of characters) within their groups, and numbers of the runs that are equal.

    All segments are partitioned at once: each takes the median of three of its characters at its depth as pivot, and falls into those
    below, equal and above; the equal ones go on at the next character, the others stay at theirs.
    """
    n, width = words.shape
    order = np.argsort(group, kind="stable")
    number, depth = group[order], np.zeros(n, np.int64)
    while n:
        begins = np.concatenate(([True], number[1:] != number[:-1]))
        start = np.flatnonzero(begins)
        size = np.diff(np.append(start, n))
        segment = np.cumsum(begins) - 1
        number = 3 * segment
        open_ = (size > 1) & (depth[start] < width)
        if not open_.any():
            break
        at = np.flatnonzero(open_[segment])
        own = (np.cumsum(open_) - 1)[segment[at]]
        first, size = start[open_], size[open_]
        character = lambda x: words[order[x], depth[x]]
        low, mid, high = (character(x) for x in (first, first + size // 2, first + size - 1))
        pivot = np.maximum(np.minimum(low, mid), np.minimum(np.maximum(low, mid), high))[own]
        c = character(at)
        side = (c >= pivot).astype(np.int64) + (c > pivot)
        base, place = np.cumsum(size) - size, np.zeros(len(at), np.int64)
        before = np.zeros(len(first), np.int64)
        for k in range(3):
            upto = np.cumsum(side == k)
            here = upto - np.concatenate(([0], upto))[base][own]
            place = np.where(side == k, before[own] + here - 1, place)
            before = before + np.add.reduceat((side == k).astype(np.int64), base)
        to = first[own] + place
        order[to], depth[to], number[to] = order[at], depth[at] + (side == 1), number[at] + side
    return order, number


def deep_shallow(group: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the strings data[start : start + size] within their groups. Returns the order and what each shares with the one before (0 at the first of a group)."""
    n, width = len(group), SHALLOW
    at = start[:, None] + np.arange(width)
    rows = np.where(np.arange(width) < size[:, None], data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)
    words = rows.view(">u8").astype(np.uint64)
    order, number = multikey_quicksort(group, words)
    short = np.minimum(size[order], width)
    shared = np.zeros(n, np.int64)
    if n > 1:
        a, b = rows[order[1:]], rows[order[:-1]]
        differ = a != b
        agree = np.where(differ.any(1), differ.argmax(1), width)
        shared[1:] = np.where(group[order[1:]] == group[order[:-1]], np.minimum(agree, np.minimum(short[1:], short[:-1])), 0)
    # blind tries: what still agrees
    edge = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1], [True]))) if n else np.zeros(1, int)
    raw = data.tobytes()
    for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if e - s < 2:
            continue
        own = order[s:e].tolist()
        held: dict[bytes, list[int]] = {}
        for i in own:
            held.setdefault(raw[start[i] : start[i] + size[i]], []).append(i)
        strings = list(held)
        place, first = s, True
        for leaf, common in BlindTrie(strings).ordered():
            for j, i in enumerate(held[strings[leaf]]):
                order[place] = i
                if not first:
                    shared[place] = len(strings[leaf]) if j else common
                place, first = place + 1, False
    return order, shared


def _ties(by: np.ndarray, lead: np.ndarray, doc: np.ndarray, low: np.ndarray, rid: np.ndarray) -> np.ndarray:
    """Pairs (lead, tie) of equal pieces at one key and start whose texts differ, each text once."""
    tied = (doc[by] == doc[lead]) & (low[by] == low[lead]) & (rid[by] != rid[lead])
    i, j = lead[tied], by[tied]
    once = np.unique(np.stack([i, rid[j]]), axis=1, return_index=True)[1]
    return np.stack([i[once], j[once]])


def _inherited(key: np.ndarray, tie_key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places at which the rows of key and those of tie_key (both n x k) are equal."""
    number = np.unique(np.concatenate([key, tie_key]), axis=0, return_inverse=True)[1].ravel()
    own, tie = number[: len(key)], number[len(key) :]
    order = np.argsort(tie, kind="stable")
    begin, end = np.searchsorted(tie[order], own), np.searchsorted(tie[order], own, "right")
    n = end - begin
    at = np.repeat(np.arange(len(own)), n)
    return at, order[np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)]


def covered(pieces: Pieces, length: int = LENGTH, ties: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """doc, rid, low, high: byte ranges of windows that also start earlier, from the pieces of a bucket. ties: doc, rid, low of pieces, and the rid of a tie of each."""
    c = pieces.c
    n = len(c["doc"])
    start = np.cumsum(c["size"]) - c["size"]
    data = np.frombuffer(pieces.data, np.uint8)
    out: list[tuple] = []
    tied = np.zeros((2, 0), np.int64)

    def emit(i: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        out.append((i, low, high))

    if n:
        words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
        a = start + c["off"]
        gram = (words[a] * _C[0]) ^ (words[a + 8] * _C[1])
        order = np.argsort(gram, kind="stable")
        g = gram[order]
        same = np.concatenate(([False], g[1:] == g[:-1]))
        some = order[same | np.concatenate((same[1:], [False]))]
        # equal pieces: all but the earliest are covered whole
        number = _group_numbers(_digests(pieces.data, start[some], c["size"][some]))
        by, begins = _earliest(number, c["doc"][some], c["low"][some])
        first = np.maximum.accumulate(np.where(begins, np.arange(len(by)), 0))
        ordered = some[by]
        later = (c["doc"][ordered] != c["doc"][ordered[first]]) | (c["low"][ordered] != c["low"][ordered[first]]) if len(by) else begins[:0]
        tied = _ties(ordered, ordered[first], c["doc"], c["low"], c["rid"]) if len(by) else tied
        i = ordered[later]
        emit(i, c["low"][i], c["low"][i] + c["size"][i])
        left = ordered[begins] if len(by) else ordered
        # of the others, those that share their anchor's gram
        uniq, group, counts = np.unique(gram[left], return_inverse=True, return_counts=True)
        left, group = left[counts[group] > 1], group[counts[group] > 1]
        if len(left):
            off, size, doc, low = (c[k][left] for k in ("off", "size", "doc", "low"))
            right_order, right = deep_shallow(group, data, start[left] + off, size - off)
            back = data[::-1]
            left_order, leftward = deep_shallow(group, back, len(data) - (start[left] + off), off)
            first_off, last_off = off, off - (size - length)  # offsets of the anchor in the first and the last window
            hits: list[tuple[np.ndarray, np.ndarray]] = []
            for o in range(int(first_off.max()) + 1):
                r = np.empty(len(left), np.int64)
                r[right_order] = np.cumsum(right < length - o)
                m = np.empty(len(left), np.int64)
                m[left_order] = np.cumsum((leftward < o) | (np.concatenate(([True], group[left_order][1:] != group[left_order][:-1]))))
                has = np.flatnonzero((first_off >= o) & (last_off <= o))
                if len(has) < 2:
                    continue
                number = r[has] * (len(left) + 1) + m[has]
                p = low[has] + off[has] - o
                by, begins = _earliest(number, doc[has], p)
                lead = by[np.maximum.accumulate(np.where(begins, np.arange(len(by)), 0))]
                later = (doc[has][by] != doc[has][lead]) | (p[by] != p[lead])
                hits.append((has[by[later]], p[by[later]]))
            if hits:
                who, p = np.concatenate([x for x, _ in hits]), np.concatenate([x for _, x in hits])
                by = np.lexsort((p, who))
                who, p = who[by], p[by]
                new = np.concatenate(([True], (who[1:] != who[:-1]) | (p[1:] != p[:-1] + 1)))
                s = np.flatnonzero(new)
                e = np.concatenate((s[1:], [len(p)])) - 1
                if len(p):
                    emit(left[who[s]], p[s], p[e] + length)
    i, low, high = (np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in range(3))
    # ties in the bucket get the ranges of their lead, then those that were not sent get the ranges of the piece sent for them
    at, t = _inherited(i[:, None], tied[0][:, None])
    i, low, high = np.concatenate((i, tied[1][t])), np.concatenate((low, low[at])), np.concatenate((high, high[at]))
    doc, rid = c["doc"][i], c["rid"][i]
    if ties is not None:
        at, t = _inherited(np.stack([doc, rid, c["low"][i]], 1), ties[:3].T)
        doc, rid, low, high = np.concatenate((doc, doc[at])), np.concatenate((rid, ties[3][t])), np.concatenate((low, low[at])), np.concatenate((high, high[at]))
    return {"doc": doc, "rid": rid, "low": low, "high": high}


def _sent(pending: list[tuple], buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """bucket, kind and data of a task's pieces: kind 0 the pieces, equal ones once, kind 1 the ranges of the later equal ones, kind 2 the ties (doc, rid, low of the piece sent, and the tie's rid)."""
    doc, rid, low, size, off, gram = (np.concatenate(x) for x in list(zip(*pending, strict=True))[:6])
    data = b"".join(x[6] for x in pending)
    start = np.cumsum(size) - size
    by, begins = _earliest(_group_numbers(_digests(data, start, size)), doc, low)
    lead = by[np.maximum.accumulate(np.where(begins, np.arange(len(by)), 0))]
    later = by[(doc[by] != doc[lead]) | (low[by] != low[lead])]
    if len(later):
        ranges = np.stack([doc[later], rid[later], low[later], low[later] + size[later]]).astype("<i8")
        yield int(gram[later[0]] % np.uint64(buckets)), 1, zstandard.ZstdCompressor(level=1).compress(ranges.tobytes())
    first, tie = _ties(by, lead, doc, low, rid)
    own = (gram[first] % np.uint64(buckets)).astype(np.int64)
    for k in np.unique(own).tolist():
        marks = np.stack([doc[first], rid[first], low[first], rid[tie]])[:, own == k].astype("<i8")
        yield k, 2, zstandard.ZstdCompressor(level=1).compress(marks.tobytes())
    kept = np.sort(by[begins])
    bucket = (gram[kept] % np.uint64(buckets)).astype(np.int64)
    order = kept[np.argsort(bucket, kind="stable")]
    edge = np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=buckets))))
    for k in np.flatnonzero(np.diff(edge)):
        own = order[edge[k] : edge[k + 1]]
        own = own[np.argsort(doc[own], kind="stable")]
        text = b"".join([data[s : s + n] for s, n in zip(start[own].tolist(), size[own].tolist(), strict=True)])
        yield int(k), 0, Pieces({"doc": doc[own], "rid": rid[own], "low": low[own], "size": size[own], "off": off[own]}, text).packed()


def _merged(ranges: np.ndarray) -> np.ndarray:
    """Maximal runs of ranges (low, high)."""
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    high = np.maximum.accumulate(ranges[:, 1])
    new = np.concatenate(([True], ranges[1:, 0] > high[:-1]))
    return np.stack([ranges[new, 0], high[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(high) - 1]))]], 1)


def _joined(ranges: np.ndarray) -> np.ndarray:
    """Rows doc, rid, low, high, with those of a text that touch made one."""
    ranges = ranges[:, np.lexsort((ranges[2], ranges[1], ranges[0]))]
    text = np.cumsum(np.concatenate((np.zeros(1, np.int64), (ranges[:2, 1:] != ranges[:2, :-1]).any(0)))) if ranges.shape[1] else np.zeros(0, np.int64)
    if not len(text):
        return ranges
    runs = _merged(np.stack([text << 32 | ranges[2], text << 32 | ranges[3]], 1))
    first = np.searchsorted(text, runs[:, 0] >> 32)
    return np.stack([ranges[0, first], ranges[1, first], runs[:, 0] & 0xFFFFFFFF, runs[:, 1] & 0xFFFFFFFF])


def frequent_slots(rows: DataFrame, buckets: int, length: int, scratch: Scratch) -> np.ndarray | None:
    """A bitmap of the hash slots whose grams would be anchors so often that a bucket would be uneven; it has 2^SLOT_BITS bits at any input, of which one in 20 is set at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for value in batch.column(0):
                raw = value.as_buffer()
                if raw.size >= length:
                    _, _, at, h = anchors(np.frombuffer(raw, np.uint8), None, length)
                    np.add.at(found, _slots(h[at]), 1)
        total = int(found.sum())
        some = np.flatnonzero(found >= max(4, total // (16 * buckets)))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int64()), pa.array(np.append(found[some], total), pa.int64())], ["slot", "n"])

    sums = scratch.written(rows.select("text").mapInArrow(lean(count), "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")), "slots")
    total = (sums.where("slot = -1").first() or (0, 0))[1]
    least = max(64, total // (8 * buckets), 20 * total >> SLOT_BITS)
    some = [r[0] for r in sums.where((F.col("slot") >= 0) & (F.col("n") > least)).collect()]
    if not some:
        return None
    hot = np.zeros(1 << SLOT_BITS, np.uint8)
    hot[some] = 1
    return np.packbits(hot)


def remove_repeats(docs: DataFrame, length: int = LENGTH, bucket_bytes: int = 4 << 20, flush_bytes: int = 16 << 20, part_bytes: int = 16 << 20, text: str = "text", key: str = "doc_id", texts: bool = False) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256; with texts also kept_text, the remaining bytes as binary."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    raw = plain_text(text).cast("binary")
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(key).cast("bigint"), F.lit(_LAST)).alias("doc"), F.xxhash64(raw).alias("rid"), raw.alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, parts = max(1, -(-total // bucket_bytes)), max(8, -(-total // part_bytes))
    hot = spark.sparkContext.broadcast(frequent_slots(rows, buckets, length, scratch))

    def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([pack.compress(x.as_buffer()) for x in batch.column(3)], pa.binary())], ["doc_id", "doc", "rid", "packed"])

    once = rows.mapInArrow(lean(squeezed), "doc_id bigint, doc bigint, rid bigint, packed binary").groupBy("doc_id", "doc", "rid").agg(F.first("packed").alias("packed"), F.count("*").alias("copies"))
    part = F.pmod(F.xxhash64("doc", "rid"), F.lit(parts)).alias("part")
    whole = scratch.table(parted(once.select("*", part), parts))

    def cut(found: pa.Table) -> Iterator[tuple]:
        """doc, rid, text, superwindows, their grams and contexts, of each row that has any."""
        bits, unpack = None if hot.value is None else np.unpackbits(hot.value), zstandard.ZstdDecompressor()
        for doc, rid, packed in zip(found["doc"].to_pylist(), found["rid"].to_pylist(), found["packed"], strict=True):
            value = unpack.decompress(packed.as_py())
            if len(value) >= length:
                low, high, at, h = anchors(np.frombuffer(value, np.uint8), bits, length)
                yield doc, rid, value, low, high, at, h[at], contexts(low, high, at, h, length)

    def in_order(windows: Iterable[tuple]) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *(x[-1][k] for x in windows for k in (1, 3))])

    def hashes(found: pa.Table) -> tuple[np.ndarray, None]:
        return in_order((x[-1],) for x in cut(found)), None

    def use(found: pa.Table, levels) -> pa.Table:
        windows = list(cut(found))
        level, upto = levels(in_order(windows)), 0
        pending, held, sent = [], 0, []
        for doc, rid, value, low, high, at, gram, (right, a, left, b) in windows:
            twice = np.zeros(len(low), bool)
            twice[right] = level[upto : upto + len(a)] > 0
            twice[left] |= level[upto + len(a) : upto + len(a) + len(b)] > 0
            upto += len(a) + len(b)
            low, high, at = low[twice], high[twice], at[twice]
            n = len(low)
            if not n:
                continue
            pieces = b"".join([value[a : b + length] for a, b in zip(low.tolist(), high.tolist(), strict=True)])
            pending.append((np.full(n, doc), np.full(n, rid), low, high - low + length, at - low, gram[twice], pieces))
            held += len(pieces)
            if held >= flush_bytes:
                sent += _sent(pending, buckets)
                pending, held = [], 0
        if pending:
            sent += _sent(pending, buckets)
        return pa.table([pa.array([x[0] for x in sent], pa.int64()), pa.array([x[1] for x in sent], pa.int32()), pa.array([x[2] for x in sent], pa.binary())], ["bucket", "kind", "data"])

    def solve(found: pa.Table) -> pa.Table:
        kinds, data = found["kind"].to_pylist(), found["data"].to_pylist()
        ranges, marks = ([np.frombuffer(zstandard.ZstdDecompressor().decompress(d), "<i8").reshape(4, -1) for k, d in zip(kinds, data, strict=True) if k == kind] for kind in (1, 2))
        blocks = [d for k, d in zip(kinds, data, strict=True) if k == 0]
        if blocks:
            got = covered(Pieces.unpacked(blocks), length, np.concatenate(marks, 1) if marks else None)
            ranges.append(np.stack([got["doc"], got["rid"], got["low"], got["high"]]))
        all_ = _joined(np.concatenate(ranges, 1)) if ranges else np.zeros((4, 0), np.int64)
        trim()
        return pa.table([pa.array(all_[k], pa.int64()) for k in range(4)], ["doc", "rid", "low", "high"])

    names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * texts + ["__copies"]

    def result(ranges: pa.Table, found: pa.Table) -> pa.Table:
        doc, rid, low, high = (ranges[k].to_numpy() for k in ("doc", "rid", "low", "high"))
        by = np.lexsort((low, rid, doc))
        doc, rid, spans = doc[by], rid[by], np.stack([low[by], high[by]], 1)
        edge = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (rid[1:] != rid[:-1]), [True]))) if len(by) else np.zeros(1, np.int64)
        own = {(int(doc[a]), int(rid[a])): spans[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)}
        out, unpack = [], zstandard.ZstdDecompressor()
        for d, r, packed in zip(found["doc"].to_pylist(), found["rid"].to_pylist(), found["packed"], strict=True):
            value = unpack.decompress(packed.as_py())
            runs = _merged(own[d, r]).tolist() if (d, r) in own else []
            kept, upto = [], 0
            for a, b in runs:
                kept.append(value[upto:a])
                upto = b
            rest = b"".join([*kept, value[upto:]])
            out.append((len(value), len(value) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), rest if texts else b""))
        arrays = [pa.array([x[k] for x in out], pa.int64()) for k in range(3)] + [pa.array([x[3] for x in out], pa.string())] + [pa.array([x[4] for x in out], pa.binary())] * texts
        done = pa.table([found["doc_id"], *arrays, found["copies"]], names)
        trim()
        return done

    pieces = Tally(total // 20).tell(whole, ["doc", "rid", "packed"], hashes, use, "bucket bigint, kind int, data binary")
    ranges = pieces.groupBy("bucket").applyInArrow(solve, "doc bigint, rid bigint, low bigint, high bigint").select("*", part)
    found = ranges.groupBy("part").cogroup(whole.select("part", "doc_id", "doc", "rid", "packed", "copies").groupBy("part")).applyInArrow(result, f"`{key}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept_text binary" * texts + ", __copies bigint")
    return found.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__copies").cast("int")))).drop("__copies", "__copy")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
w AS (SELECT doc_id, p, substr(hx, 2 * p + 1, 200) AS s FROM (SELECT doc_id, hx, unnest(range(0, greatest(length(hx) // 2 - 99, 0))) AS p FROM d)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS n FROM w) WHERE n > 1),
marked AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS begins FROM again),
numbered AS (SELECT doc_id, p, sum(begins) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM marked),
spans AS (SELECT doc_id, k, min(p) AS a, max(p) + 100 AS b FROM numbered GROUP BY doc_id, k),
cuts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM spans),
kept AS (SELECT c.doc_id, string_agg(substr(hx, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || substr(any_value(hx), 2 * max(b) + 1) AS rest, count(*) AS n, sum(b - a) AS gone FROM cuts c JOIN d ON d.doc_id = c.doc_id GROUP BY c.doc_id)
SELECT d.doc_id, CAST(length(hx) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(rest, hx))) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
