"""N-gram Jaccard join by token-combination prefixes, and the components of its links.

Tokens are 64-bit hashes of word shingles. Documents with equal sets are one class; classes link when
100 * intersection >= percent * union.

Order. Each token's level tells how many holders it has (tally.py): none but one, few (rare), more (frequent), very many. Sets
are ordered by that, then by hash, so a set's prefix is made of its rarest tokens.

Index. Of two linked sets let f be the first common token. It is within the first n - ceil(t n) + 1 tokens of both, and within
prefixes longer by k - 1 both hold f and the next k - 1 common tokens. So a pair is found by the single token f if f is rare, by
a pair of tokens that begins with f if f is frequent, and by a triple if it is very frequent. Larger k is for smaller sets (COMBINED), as a
prefix of l tokens has l over k combinations; since the sizes of linked sets are near each other, a set whose partners may lie
beyond such a limit is indexed in both ways.

1. All classes: holders are classes. A class without a shared token in its prefix links with nothing and is done; few others are left.
   Entries of rare tokens give all their pairs, those of others only a chain of neighbours, in some random order; the
   links among these join most of a large group of near copies.
2. What is left: holders are the components so far, so that a group of near copies no longer makes its own tokens frequent. One
   more chain is drawn, then every pair across components that shares an entry is a candidate. This step alone is complete:
   jaccard_links() starts with it and yields every link.

Candidates pass filters by size, place, and parities of the sets in about four bits a token, which refuse most pairs below the
threshold before anything is written. Candidates are then verified on the whole sets, rebuilt from the compressed texts. Entries of
tokens with more than 2^TILE holders are dealt as pairs of parts, so no task has to hold them all. Components are found by
alternating large and small stars on distributed tables.

Defined cases: null texts and texts without words have no shingles, are linked with nothing and are their own component, unless rows
share their id; a text of fewer words than a shingle is one shingle; rows with a null id take part, but give no component its name, which is
null if no member has an id; equal rows are one class; extra input columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernelfield.llm.common import WORD_SQL, Scratch, mapped, plain_text, table, trim, unused, written
from kernelfield.llm.tally import Tally, parted

WORDS, PERCENT = 5, 80
#: A token of at most 2^RARE holders is rare, of at most 2^FREQUENT frequent, of more very frequent.
RARE, FREQUENT = 3, 10
#: Tuples of k tokens are for sets of at most so many tokens.
COMBINED = {2: 400, 3: 64}
#: Entries of more than 2^TILE holders are dealt in parts of about that size.
TILE = 11
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]
_EDGES = "a bigint, b bigint"
_INDEX = "bucket bigint, data binary, cls bigint, n bigint, packed binary"


class Shingler:
    """Sorted distinct shingle hashes of texts.

    The hash of a word is a polynomial in its bytes, each replaced by a random number: a difference of running sums over the
    text, shifted to the text's start by the inverse power, so a whole text is hashed by array operations.
    """

    _draw = np.random.default_rng(5)
    _number = _draw.integers(1, 1 << 63, 256, np.uint64)
    _space = np.zeros(256, bool)
    _space[[32, *range(9, 14)]] = True
    _base, _inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)

    def __init__(self, words: int = WORDS):
        self.words = words
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        ones = np.full(n, self._base, np.uint64), np.full(n, self._inverse, np.uint64)
        ones[0][0] = ones[1][0] = 1
        self.power, self.back = (np.multiply.accumulate(x) for x in ones)

    def word_hashes(self, raw: bytes) -> np.ndarray:
        data = np.frombuffer(raw.lower(), np.uint8)  # of bytes, A to Z alone
        if len(data) > len(self.power):
            self._grow(2 * len(data))
        space = np.concatenate(([True], self._space[data], [True]))
        edge = np.flatnonzero(space[1:] != space[:-1])
        start, end = edge[::2], edge[1::2]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self._number[data] * self.power[: len(data)], dtype=np.uint64)))
        h = (sums[end] - sums[start]) * self.back[start]
        h ^= h >> np.uint64(31)
        h *= _MIX[1]
        return h ^ (h >> np.uint64(29))

    def __call__(self, raw: bytes) -> np.ndarray:
        h = self.word_hashes(raw)
        if not len(h):
            return np.zeros(0, np.uint64)
        k = min(self.words, len(h))
        code = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            code = (code ^ h[i : len(h) - k + 1 + i]) * _MIX[0]
            code ^= code >> np.uint64(32)
        code *= _MIX[1]
        code ^= code >> np.uint64(32)
        code.sort()
        return code[np.concatenate(([True], code[1:] != code[:-1]))]


def least_overlap(n, percent: int = PERCENT):
    """ceil(percent / 100 * n): what a set of n shares at least with any set that it links to."""
    return -(-percent * n // 100)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Of sorted sets."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _class_of(tokens: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes(), seed=len(tokens)) - (1 << 63)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[1]
    return x ^ (x >> np.uint64(29))


# index entries of one set


def _kind(level: np.ndarray, rare: int, frequent: int) -> np.ndarray:
    """0 unshared, 1 rare, 2 frequent, 3 very frequent: the number of tokens that are to be combined."""
    return np.where(level == 0, 0, np.where(level <= rare, 1, np.where(level <= frequent, 2, 3))).astype(np.uint8)


def _most(n: int, percent: int) -> int:
    """The longest combination for a set of n tokens."""
    return min(3 if n <= COMBINED[3] else 2 if n <= COMBINED[2] else 1, least_overlap(n, percent))


def lengths(n: int, percent: int) -> set[int]:
    """The lengths of combinations that a set of n tokens is indexed by: its own, and those of any partner."""
    low, high = least_overlap(n, percent), 100 * n // percent
    turns = [*range(1, 300 // percent + 2), *COMBINED.values(), *(x + 1 for x in COMBINED.values())]
    return {_most(m, percent) for m in (low, n, high, *turns) if low <= m <= high}


@cache
def _tuples(size: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(size), k)), np.int64).reshape(-1, k)


def entries(tokens: np.ndarray, level: np.ndarray, percent: int = PERCENT, rare: int = RARE, frequent: int = FREQUENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a set, with place (of k tokens: of the last, less k - 1) and level (the least of the tokens')."""
    n = len(tokens)
    kind = _kind(level, rare, frequent)
    order = np.lexsort((tokens, kind))
    tokens, level, kind = tokens[order], level[order], kind[order]
    length = n - least_overlap(n, percent) + 1
    keys, places, levels = [], [], []
    for first, k in {(c, min(c, m)) for m in lengths(n, percent) for c in (1, 2, 3)}:
        begin = int(np.searchsorted(kind, first))
        end = int(np.searchsorted(kind, first, "right"))
        stop = min(n, length + k - 1)
        if begin >= min(end, length):
            continue
        if k == 1:
            some = np.arange(begin, min(end, length))[:, None]
        else:
            some = begin + _tuples(stop - begin, k)
            some = some[some[:, 0] < min(end, length)]
        key = tokens[some[:, 0]]
        for i in range(1, k):
            key = _mixed(key * _MIX[0] + tokens[some[:, i]])
        keys.append(key)
        places.append(some[:, -1] - (k - 1))
        levels.append(level[some].min(1))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    return np.concatenate(keys), np.concatenate(places), np.concatenate(levels)


def _width(n: np.ndarray) -> np.ndarray:
    """log2 of the number of parities kept of a set of n."""
    return np.clip(np.ceil(np.log2(4 * np.maximum(n, 1))), 6, 20).astype(np.int64)


def parities(tokens: np.ndarray) -> np.ndarray:
    """Parities of a set over hash slots: two sets differ in at least as many elements as their parities do. Halves add up to the parities of half the slots."""
    slots = 1 << int(_width(np.array([len(tokens)]))[0])
    return np.packbits(np.bincount(((tokens * _MIX[1] >> np.uint64(40)) & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1, bitorder="little")


# blocks of entries


class Dealer:
    """Gathers entries of classes and packs them as a block for each bucket: keys in order as differences, each with place and the number of its class in the block's list; with signed also the classes' parities."""

    def __init__(self, buckets: int, signed: bool):
        self.buckets, self.signed, self.blocks = buckets, signed, []
        self._clear()

    def _clear(self) -> None:
        self.heads, self.keys, self.places, self.sizes, self.marks, self.held = [], [], [], [], [], 0

    def add(self, cls: int, n: int, comp: int, keys: np.ndarray, places: np.ndarray, mark: np.ndarray | None = None) -> None:
        self.heads.append((cls, n, comp))
        self.keys.append(keys)
        self.places.append(places)
        self.sizes.append(len(keys))
        self.marks.append(mark)
        self.held += len(keys)
        if self.held > 500_000:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        keys, places = np.concatenate(self.keys), np.concatenate(self.places).astype(np.uint32)
        who = np.repeat(np.arange(len(self.heads)), self.sizes)
        head = np.array(self.heads, np.int64)
        bucket = (keys * _MIX[1] >> np.uint64(20)) % np.uint64(self.buckets)
        order = np.lexsort((keys, bucket))
        edge = np.searchsorted(bucket[order], np.arange(self.buckets + 1, dtype=np.uint64))
        for k in np.flatnonzero(np.diff(edge)):
            own = order[edge[k] : edge[k + 1]]
            used, number = np.unique(who[own], return_inverse=True)
            parts = [np.array([len(used), len(own)], np.int64), head[used].T, np.diff(keys[own], prepend=np.uint64(0)), number.astype(np.uint32), places[own]]
            if self.signed:
                parts += [self.marks[i] for i in used]
            self.blocks.append((int(k), zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(p).tobytes() for p in parts))))
        self._clear()


class Entries:
    """The entries of a bucket: cls, n, comp by class; key, who (number of the class), place by entry."""

    def __init__(self, blocks: list[bytes], percent: int):
        heads, keys, who, place, marks, base = [], [], [], [], [], 0
        for block in blocks:
            raw = zstandard.ZstdDecompressor().decompress(block)
            c, m = (int(x) for x in np.frombuffer(raw, np.int64, 2))
            heads.append(np.frombuffer(raw, np.int64, 3 * c, 16).reshape(3, c))
            at = 16 + 24 * c
            keys.append(np.cumsum(np.frombuffer(raw, np.uint64, m, at), dtype=np.uint64))
            who.append(np.frombuffer(raw, np.uint32, m, at + 8 * m).astype(np.int64) + base)
            place.append(np.frombuffer(raw, np.uint32, m, at + 12 * m).astype(np.int64))
            marks.append(raw[at + 16 * m :])
            base += c
        self.percent = percent
        self.cls, self.n, self.comp = np.concatenate(heads, 1)
        self.key, self.who, self.place = np.concatenate(keys), np.concatenate(who), np.concatenate(place)
        raw = b"".join(marks)
        self.marks: dict[int, np.ndarray] | None = None
        if raw:
            self.width = _width(self.n)
            size = np.int64(1) << (self.width - 3)
            begin = np.cumsum(size) - size
            data = np.frombuffer(raw, np.uint8)
            self.row = np.zeros(len(self.n), np.int64)
            self.marks = {}
            for w in np.unique(self.width).tolist():
                own = np.flatnonzero(self.width == w)
                self.row[own] = np.arange(len(own))
                self.marks[w] = data[begin[own][:, None] + np.arange(1 << (w - 3))].view(np.uint64)

    def _far(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """What the sets of pairs differ in at least."""
        out = np.zeros(len(i), np.int64)
        swap = self.width[i] > self.width[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        for v, w in {(int(a), int(b)) for a, b in np.unique(np.stack([self.width[i], self.width[j]], 1), axis=0)}:
            own = np.flatnonzero((self.width[i] == v) & (self.width[j] == w))
            step = max(1, (1 << 25) >> (w - 3))
            for s in range(0, len(own), step):
                some = own[s : s + step]
                x, y = self.marks[v][self.row[i[some]]], self.marks[w][self.row[j[some]]]
                while y.shape[1] > x.shape[1]:
                    y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
                out[some] = np.bitwise_count(x ^ y).sum(1)
        return out

    def _fine(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Pairs (a, b) of classes, a < b, of the pairs of entries x, y that pass all filters."""
        i, j, n, place = self.who[x], self.who[y], self.n, self.place
        both = -(-self.percent * (n[i] + n[j]) // (100 + self.percent))
        fine = (self.comp[i] != self.comp[j]) & (100 * np.minimum(n[i], n[j]) >= self.percent * np.maximum(n[i], n[j])) & (np.minimum(n[i] - place[x], n[j] - place[y]) >= both)
        i, j, both = i[fine], j[fine], both[fine]
        once = np.unique(np.minimum(i, j) * len(n) + np.maximum(i, j), return_index=True)[1]
        i, j, both = i[once], j[once], both[once]
        if self.marks is not None and len(i):
            near = self._far(i, j) <= n[i] + n[j] - 2 * both
            i, j = i[near], j[near]
        a, b = self.cls[i], self.cls[j]
        return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)

    def chain(self, turn: int, few: int = 1 << RARE) -> np.ndarray:
        """Pairs of neighbours in an order of each entry's members, one of four random orders; all pairs where there are at most few members."""
        draw = _mixed((self.cls[self.who].astype(np.uint64) + (self.key & np.uint64(3)) * _MIX[1] + np.uint64(turn)) * _MIX[0])
        order = np.lexsort((draw, self.key))
        key = self.key[order]
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        members = np.repeat(np.diff(edge), np.diff(edge))
        found = [np.zeros((0, 2), np.int64)]
        for k in range(1, few):
            x = np.flatnonzero(key[k:] == key[:-k])
            x = x[(members[x] <= few) | (k == 1)]
            found.append(self._fine(order[x], order[x + k]))
        return np.unique(np.concatenate(found), axis=0)

    def pairs(self, step: int = 400_000) -> np.ndarray:
        """All pairs across components."""
        c = self.comp[self.who]
        order = np.lexsort((c, self.key))
        key, c = self.key[order], c[order]
        # the end of each entry's component in its group, and of its group
        last = np.concatenate((key[1:] != key[:-1], [True]))
        ends = np.flatnonzero(last) + 1
        turns = np.flatnonzero(last | np.concatenate((c[1:] != c[:-1], [True]))) + 1
        at = np.arange(len(key))
        end, after = ends[np.searchsorted(ends, at, "right")], turns[np.searchsorted(turns, at, "right")]
        count = end - after
        some = np.flatnonzero(count)
        upto = np.concatenate(([0], np.cumsum(count[some])))
        found, s = [np.zeros((0, 2), np.int64)], 0
        while s < len(some):
            e = max(s + 1, int(np.searchsorted(upto, upto[s] + step, "right")) - 1)
            x = np.repeat(some[s:e], count[some[s:e]])
            y = np.arange(len(x)) - np.repeat(upto[s:e] - upto[s], count[some[s:e]]) + np.repeat(after[some[s:e]], count[some[s:e]])
            found.append(self._fine(order[x], order[y]))
            s = e
        return np.unique(np.concatenate(found), axis=0)


def _met(blocks: DataFrame, percent: int, pairs: Callable[[Entries], np.ndarray]) -> DataFrame:
    """Candidates (a, b) of every bucket."""

    def candidates(found: pa.Table) -> pa.Table:
        out = pairs(Entries(found["data"].to_pylist(), percent))
        trim()
        return pa.table([pa.array(out[:, 0], pa.int64()), pa.array(out[:, 1], pa.int64())], ["a", "b"])

    return blocks.groupBy("bucket").applyInArrow(candidates, _EDGES).distinct()


# the join


def components(edges: DataFrame, scratch: Scratch | None = None, rows_per_file: int = 20_000) -> DataFrame:
    """node, comp (the least node reachable) for every node of edges (a, b) but the least ones themselves, by alternating large and small stars. The tables between are written in files of about rows_per_file rows."""
    keep = scratch.written if scratch else written
    pairs = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    parts = max(1, pairs.count() // rows_per_file)
    before = None
    while True:
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("of")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = keep(large.coalesce(parts), "large")
        own = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), "m")
        met = large.join(own, F.col("u") == F.col("of"))
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own.select(F.col("of").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        pairs = keep(small.coalesce(parts), "small")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        before = now


class Join:
    """A table of documents as classes: part, cls, n, first (the least id), packed (compressed text).

    With row, the name of a column of row numbers, also own: the least of (no id, id, text hash, row) of its rows.
    """

    def __init__(self, docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, percent: int = PERCENT, rare: int = RARE, frequent: int = FREQUENT, part_bytes: int = 8 << 20, row: str | None = None, tile: int = TILE):
        self.spark, self.words, self.percent, self.rare, self.frequent, self.tile = docs.sparkSession, words, percent, rare, frequent, tile
        self.scratch = Scratch(self.spark)
        own = [F.struct(F.col(key).isNull().alias("no_id"), F.col(key).cast("bigint").alias("id"), F.xxhash64(plain_text(text)).alias("salt"), F.col(row).cast("bigint").alias("row")).alias("own")] if row else []
        self.rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), plain_text(text).cast("binary").alias("raw"), *own)
        size = self.rows.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
        self.part_bytes, self.parts = part_bytes, max(8, -(-size // part_bytes))
        one = self._signed(True).where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("packed").alias("packed"), *([F.min("own").alias("own")] if row else []))
        self.classes = self.scratch.table(parted(one.withColumn("part", F.pmod(F.xxhash64("cls"), F.lit(self.parts))), self.parts))

    def _signed(self, packed: bool) -> DataFrame:
        words = self.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingles, pack = Shingler(words), zstandard.ZstdCompressor(level=3)
            for batch in (b.slice(s, 1024) for b in batches for s in range(0, b.num_rows, 1024)):
                out = []
                for value in batch.column(1):
                    raw = value.as_py()
                    t = shingles(raw)
                    out.append((_class_of(t), len(t), pack.compress(raw) if packed else b""))
                columns = list(zip(*out, strict=True)) if out else [[]] * 3
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(columns[k], pa.int64()) for k in range(2)], pa.array(columns[2], pa.binary()), *batch.columns[2:]], ["doc_id", "cls", "n", "packed", *batch.schema.names[2:]])

        return mapped(self.rows, run, "doc_id bigint, cls bigint, n bigint, packed binary" + (", own struct<no_id:boolean,id:bigint,salt:bigint,row:bigint>" if "own" in self.rows.columns else ""))

    def labels(self) -> DataFrame:
        """doc_id, cls, n of every row."""
        return self._signed(False).select("doc_id", "cls", "n")

    def _sets(self) -> Callable[[pa.Table], list[np.ndarray]]:
        words = self.words

        def sets(found: pa.Table) -> list[np.ndarray]:
            shingles, unpack = Shingler(words), zstandard.ZstdDecompressor()
            return [shingles(unpack.decompress(x.as_py())) for x in found["packed"]]

        return sets

    def first_index(self) -> tuple[DataFrame, DataFrame]:
        """bucket, data of the entries of single tokens, by classes; and cls, n, packed of the classes that have any."""
        percent, rare, frequent, tile, sets, buckets = self.percent, self.rare, self.frequent, self.tile, self._sets(), self.parts

        def use(found: pa.Table, levels: Callable) -> pa.Table:
            tokens = sets(found)
            n = np.array([len(t) for t in tokens])
            flat = np.concatenate(tokens)
            del tokens
            level = levels(flat)
            who = np.repeat(np.arange(len(n), dtype=np.int32), n)
            length = n - least_overlap(n, percent) + 1
            some = np.bincount(who[level == 0], minlength=len(n)) < length
            keep = some[who]
            flat, level, who = flat[keep], level[keep], who[keep]
            kind = _kind(level, rare, frequent)
            order = np.lexsort((flat, kind, who))
            flat, level, who, kind = flat[order], level[order], who[order], kind[order]
            size = np.where(some, n, 0)
            place = np.arange(len(flat)) - (np.cumsum(size) - size)[who]
            cls = found["cls"].to_numpy()
            keep = (place < length[who]) & (kind > 0)
            flat, level, who, place = flat[keep], level[keep], who[keep], place[keep]
            # any part of a frequent entry will do for a chain
            salts = np.uint64(1) << np.maximum(level.astype(np.int64) - tile, 0).astype(np.uint64)
            salt = _mixed(cls[who].astype(np.uint64) * _MIX[0]) & (salts - np.uint64(1))
            keys = np.where(salts > 1, _mixed(flat + salt * _MIX[0]), flat)
            dealer, edge = Dealer(buckets, False), np.searchsorted(who, np.arange(len(n) + 1))
            for i in np.flatnonzero(some).tolist():
                dealer.add(int(cls[i]), int(n[i]), int(cls[i]), keys[edge[i] : edge[i + 1]], place[edge[i] : edge[i + 1]])
            dealer.flush()
            own = found.select(["cls", "n", "packed"]).filter(pa.array(some, pa.bool_()))
            return _blocks(dealer, own)

        total = self.classes.agg(F.sum("n")).first()[0] or 0

        def hashes(found: pa.Table) -> tuple[np.ndarray, None]:
            return np.concatenate(sets(found)), None

        index = self.scratch.written(Tally(total).tell(self.classes, ["cls", "n", "packed"], hashes, use, _INDEX), "index")
        return index.where("bucket is not null").select("bucket", "data"), index.where("cls is not null").select("cls", "n", "packed")

    def full_index(self, active: DataFrame, comps: DataFrame | None) -> DataFrame:
        """bucket, data of all entries of active, with holders by component."""
        percent, rare, frequent, tile, sets = self.percent, self.rare, self.frequent, self.tile, self._sets()
        total = active.agg(F.sum("n")).first()[0] or 0
        parts = max(8, -(-8 * total // self.part_bytes))
        buckets = max(8, total >> 18)
        named = active.withColumn("comp", F.col("cls")) if comps is None else active.join(comps, F.col("cls") == F.col("node"), "left").select("cls", "n", F.coalesce("comp", "cls").alias("comp"), "packed")
        rows = self.scratch.table(parted(named.withColumn("part", F.pmod(F.xxhash64("cls"), F.lit(parts))), parts))

        def hashes(found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            tokens = sets(found)
            return np.concatenate(tokens), np.repeat(_mixed(found["comp"].to_numpy().astype(np.uint64) * _MIX[0]), [len(t) for t in tokens])

        def use(found: pa.Table, levels: Callable) -> pa.Table:
            tokens = sets(found)
            level = np.split(levels(np.concatenate(tokens)), np.cumsum([len(t) for t in tokens])[:-1])
            dealer = Dealer(buckets, True)
            for cls, comp, t, v in zip(found["cls"].to_pylist(), found["comp"].to_pylist(), tokens, level, strict=True):
                key, place, at = entries(t, v, percent, rare, frequent)
                if len(key):
                    dealer.add(cls, len(t), comp, *tiled(key, place, at, cls, tile), parities(t))
            dealer.flush()
            return _blocks(dealer, found.select(["cls", "n", "packed"]).slice(0, 0))

        return Tally(total, 16).tell(rows, ["cls", "n", "comp", "packed"], hashes, use, _INDEX).select("bucket", "data")

    def verified(self, edges: DataFrame, texts: DataFrame, chunks: int = 64) -> DataFrame:
        """The edges (a, b) whose sets link; texts has cls, packed. The text of a is sent once to each chunk of its partners, so that a hot a is dealt over tasks."""
        dealt = edges.withColumn("chunk", F.pmod(F.xxhash64("b"), F.lit(chunks)))
        texts = texts.select("cls", "packed")
        left = dealt.select("a", "chunk").distinct().join(texts, F.col("a") == F.col("cls")).select(F.col("a").alias("of"), F.col("chunk").alias("part"), F.col("packed").alias("x"))
        right = dealt.join(texts, F.col("b") == F.col("cls")).select("a", "b", "chunk", F.col("packed").alias("y"))
        words, percent = self.words, self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingles, unpack = Shingler(words), zstandard.ZstdDecompressor()
            last, x = None, None
            for batch in batches:
                a, fine = batch.column(0).to_pylist(), []
                for k in range(len(a)):
                    if a[k] != last:
                        last, x = a[k], shingles(unpack.decompress(batch.column(2)[k].as_py()))
                    fine.append(linked(x, shingles(unpack.decompress(batch.column(3)[k].as_py())), percent))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(fine, pa.bool_()))

        joined = right.join(left, (F.col("a") == F.col("of")) & (F.col("chunk") == F.col("part"))).select("a", "b", "x", "y")
        return mapped(joined, run, _EDGES)

    def links(self) -> DataFrame:
        """Every link (a, b) between classes, by the full index of all classes."""
        found = _met(self.full_index(self.classes.select("cls", "n", "packed"), None), self.percent, Entries.pairs)
        return self.verified(found, self.classes)

    def grouped(self, ahead: bool = True) -> DataFrame:
        """cls, first, c2 (a name of its component) of every class, and own if there is one. ahead: chains first, as step 1 tells; without, the full index does it all."""
        keep, percent = self.scratch.written, self.percent
        if not ahead:
            comps = components(keep(self.links(), "links"), self.scratch)
        else:
            blocks, active = self.first_index()
            tried = keep(_met(blocks, percent, lambda e: e.chain(0)), "pairs")
            comps = components(keep(self.verified(tried, active), "links"), self.scratch)
            for turn in (1, 2):
                pairs = _met(self.full_index(active, comps), percent, Entries.pairs if turn == 2 else lambda e: e.chain(1))
                fresh = keep(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
                tried = tried.unionByName(fresh)
                found = keep(self.verified(fresh, active), "links")
                comps = components(found.unionByName(comps.select(F.col("node").alias("a"), F.col("comp").alias("b"))), self.scratch)
        own = [c for c in self.classes.columns if c == "own"]
        final = self.classes.join(comps, F.col("cls") == F.col("node"), "left").select("cls", "first", F.coalesce("comp", "cls").alias("c2"), *own)
        final = written(final, "classes")
        self.scratch.clear()
        return final


def tiled(keys: np.ndarray, places: np.ndarray, level: np.ndarray, cls: int, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Entries that may have more than 2^tile members, as entries of pairs of parts: the class is in one part, and meets each."""
    big = level > tile
    if not big.any():
        return keys, places
    out, own = [(keys[~big], places[~big])], int(_mixed(np.array([cls]).astype(np.uint64) * _MIX[0])[0])
    for v in np.unique(level[big]).tolist():
        some = level == v
        parts = 1 << (v - tile)
        mine = own % parts
        for q in range(parts):
            met = np.array([1 + min(mine, q) * parts + max(mine, q)], np.uint64)
            out.append((_mixed(keys[some] + met * _MIX[0]), places[some]))
    return np.concatenate([k for k, _ in out]), np.concatenate([p for _, p in out])


def _blocks(dealer: Dealer, classes: pa.Table) -> pa.Table:
    """Rows of an index: the dealer's blocks, and classes."""
    n, m = len(dealer.blocks), classes.num_rows
    columns = [pa.array([k for k, _ in dealer.blocks] + [None] * m, pa.int64()), pa.array([b for _, b in dealer.blocks] + [None] * m, pa.binary())]
    none = pa.table([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], ["cls", "n", "packed"])
    rest = pa.concat_tables([none, classes.cast(none.schema)])
    return pa.table([*columns, *rest.columns], ["bucket", "data", "cls", "n", "packed"])


def jaccard_links(docs: DataFrame, **settings) -> tuple[DataFrame, DataFrame]:
    """Every link (a, b) between classes of equal sets, and doc_id, cls, n of every row of docs."""
    join = Join(docs, **settings)
    return join.links(), join.labels()


def jaccard_components(docs: DataFrame, ahead: bool = True, **settings) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of docs."""
    join = Join(docs, **settings)
    final = join.grouped(ahead)
    names = final.groupBy("c2").agg(F.min("first").alias("component_id")).withColumnRenamed("c2", "of")
    by_class = final.join(names, F.col("c2") == F.col("of")).select(F.col("cls").alias("of_cls"), "component_id", F.lit(True).alias("of_some"))
    # rows without shingles meet no class: their keys are spread, and differ in the flag
    some = F.col("n") > 0
    rows = join.labels().withColumn("some", some).withColumn("cls", F.when(some, F.col("cls")).otherwise(F.xxhash64("doc_id")))
    result = rows.join(by_class, (F.col("cls") == F.col("of_cls")) & (F.col("some") == F.col("of_some")), "left")
    return result.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("some"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: that of the least id, then text hash, then row number. Rows without words are groups by their id, and apart without one."""
    row, kept = unused("__row", docs), unused("__kept", docs)
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    best = Join(numbered, row=row).grouped().groupBy("c2").agg(F.min("own").alias("own")).select("own.row")
    bare = numbered.where(~plain_text("text").rlike(WORD_SQL)).select(F.col("doc_id").alias("id"), F.struct(F.xxhash64(plain_text("text")).alias("salt"), F.col(row).alias("row")).alias("own"))
    keep = best.unionByName(bare.where("id is null").select("own.row")).unionByName(bare.where("id is not null").groupBy("id").agg(F.min("own").alias("own")).select("own.row"))
    return numbered.join(keep.select(F.col("row").alias(kept)), F.col(row) == F.col(kept), "left_semi").drop(row)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(ws[i : i + 4], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM w UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.doc_id WHERE r.m < l.b)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.m) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN r ON r.doc_id = w.doc_id GROUP BY w.doc_id, n.n
"""
