"""In how many rows each of very many hashes is found, told back to where the hashes came from.

The rows lie in a table bucketed by a column part. Each part sends its distinct hashes, sorted, as differences, to the buckets
that own ranges of hashes; a bucket adds up and answers each part with one byte for each of its hashes, in the same order. So a
hash costs some two bytes on its way out and a fraction of one back, a frequent one costs one entry for each part, and nothing is
collected or broadcast. Hashes are shortened to some bits more than their number needs; two that then agree share a count.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from kernelfield.llm.common import trim

SENT = "part bigint, bucket bigint, data binary"


def parted(df: DataFrame, parts: int) -> DataFrame:
    """df as a table bucketed by its column part, so that groups by part need no shuffle."""
    name = f"kf_parts_{uuid.uuid4().hex}"
    df.repartition(parts, "part").write.bucketBy(parts, "part").format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def packed(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted numbers as differences, and their counts, by the place of bytes."""
    planes = np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    more = counts.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(np.concatenate((planes, more))).tobytes())


def unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8).reshape(12, -1)
    return np.cumsum(np.ascontiguousarray(planes[:8].T).view(np.uint64).ravel(), dtype=np.uint64), np.ascontiguousarray(planes[8:].T).view("<u4").ravel()


class Tally:
    """Levels of about total hashes: 0 for a hash found once, else the least k with 2^k at least its number.

    With holder_bits, hashes are counted by distinct holders (of which so many bits are looked at) instead of by rows.
    """

    def __init__(self, total: int, holder_bits: int = 0, per_bucket: int = 2 << 20):
        self.holder_bits = holder_bits
        self.bits = int(np.clip(np.ceil(np.log2(max(2, total))) + 7, 32, 64 - holder_bits))
        self.buckets = max(1, -(-total // per_bucket))
        self._inner = np.array([(k << self.bits) // self.buckets for k in range(1, self.buckets)], np.uint64)

    def _short(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - self.bits)

    def sent(self, part: int, hashes: np.ndarray, holders: np.ndarray | None = None) -> pa.Table:
        """What a part sends: a block for each bucket."""
        code = self._short(hashes)
        if self.holder_bits:
            code = code << np.uint64(self.holder_bits) | (holders.astype(np.uint64) & np.uint64((1 << self.holder_bits) - 1))
        code, n = np.unique(code, return_counts=True)
        edge = np.concatenate(([0], np.searchsorted(code >> np.uint64(self.holder_bits), self._inner), [len(code)]))
        some = [int(k) for k in np.flatnonzero(np.diff(edge))]
        blocks = [packed(code[edge[k] : edge[k + 1]], n[edge[k] : edge[k + 1]]) for k in some]
        return pa.table([pa.array([part] * len(some), pa.int64()), pa.array(some, pa.int64()), pa.array(blocks, pa.binary())], ["part", "bucket", "data"])

    def _counted(self, blocks: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """The levels of the hashes of blocks, for each block in its order."""
        code = np.concatenate([c for c, _ in blocks])
        if self.holder_bits:
            hashes = np.unique(code) >> np.uint64(self.holder_bits)
            edge = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1], [True])))
            distinct, n = hashes[edge[:-1]], np.diff(edge)
        else:
            distinct, number = np.unique(code, return_inverse=True)
            n = np.bincount(number, np.concatenate([k for _, k in blocks]))
        level, out = np.ceil(np.log2(n)).astype(np.uint8), []
        for c, _ in blocks:
            own = c >> np.uint64(self.holder_bits)
            own = own[np.concatenate((np.ones(min(1, len(own)), bool), own[1:] != own[:-1]))]
            out.append(level[np.searchsorted(distinct, own)])
        return out

    def answered(self, found: pa.Table, most: int = 1 << 18) -> pa.Table:
        """The levels of a bucket's hashes, for each part in its order. They are counted in ranges of about most hashes, as counting holds several copies."""
        blocks = [unpacked(x) for x in found["data"].to_pylist()]
        low, high = min(int(c[0]) for c, _ in blocks), max(int(c[-1]) for c, _ in blocks)
        turns = 1 + sum(len(c) for c, _ in blocks) // most
        inner = np.array([(low + (high - low) * k // turns) >> self.holder_bits << self.holder_bits for k in range(1, turns)], np.uint64)
        edge = [np.concatenate(([0], np.searchsorted(c, inner), [len(c)])) for c, _ in blocks]
        levels = []
        for t in range(turns):
            own = [(c[e[t] : e[t + 1]], n[e[t] : e[t + 1]]) for (c, n), e in zip(blocks, edge, strict=True)]
            if any(len(c) for c, _ in own):
                levels.append(self._counted(own))
        pack = zstandard.ZstdCompressor(level=1)
        out = [pack.compress(np.concatenate(x).tobytes()) for x in zip(*levels, strict=True)]
        answer = pa.table([found["part"], found["bucket"], pa.array(out, pa.binary())], ["part", "bucket", "data"])
        trim()
        return answer

    def levels(self, hashes: np.ndarray, answers: pa.Table) -> np.ndarray:
        """Of a part: the level of each of its hashes."""
        blocks = dict(zip(answers["bucket"].to_pylist(), answers["data"].to_pylist(), strict=True))
        level = np.concatenate([np.zeros(0, np.uint8), *[np.frombuffer(zstandard.ZstdDecompressor().decompress(blocks[k]), np.uint8) for k in sorted(blocks)]])
        distinct, number = np.unique(self._short(hashes), return_inverse=True)
        assert len(distinct) == len(level)
        return level[number]

    def tell(self, table: DataFrame, columns: list[str], hashes: Callable[[pa.Table], tuple[np.ndarray, np.ndarray | None]], use: Callable[[pa.Table, Callable[[np.ndarray], np.ndarray]], pa.Table], schema: str) -> DataFrame:
        """use(rows of a part, levels of hashes) for every part of table; hashes(rows of a part) gives its hashes, and their holders.

        columns, with part, are what is read of table; use() has to ask for the levels of the very hashes that hashes() gave.
        """
        rows = table.select("part", *columns)

        def send(found: pa.Table) -> pa.Table:
            out = self.sent(found["part"][0].as_py(), *hashes(found))
            trim()
            return out

        def finish(answers: pa.Table, found: pa.Table) -> pa.Table:
            out = use(found, lambda h: self.levels(h, answers))
            trim()
            return out

        def answer(found: pa.Table) -> pa.Table:
            return self.answered(found)

        answers = rows.groupBy("part").applyInArrow(send, SENT).groupBy("bucket").applyInArrow(answer, SENT)
        return answers.groupBy("part").cogroup(rows.groupBy("part")).applyInArrow(finish, schema)
