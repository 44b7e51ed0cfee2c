"""Packing token sequences: first-fit decreasing over a tournament tree, in randomised groups of documents.

Tokenising emits no ids, only pieces (start, length, checksum), so what is shuffled is small. A document longer than
the capacity is cut into full pieces, which take a sequence each, and a rest. The rests of a group of about
group_docs documents, drawn by a hash of key, text and place in the table, are packed by first-fit decreasing; the leftmost bin with room is
found by walking down a tournament tree of free capacities.

Defined cases: null and empty texts are the end id alone; ties in length go by key, then start; repeated rows are
packed once each; texts of any length are cut; extra input columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernelfield.llm.common import mapped, table
from kernelfield.llm.lexicon import SPACE, Flat, Lexicon, runs, text_bytes, words

CAPACITY = 2048
#: What a tokenizers file must say for runs between white space to be encoded by themselves.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_at_spaces(file: dict) -> bool:
    """Whether the tokenizer of this file drops white space and lets nothing reach across it."""
    normalizers = (file.get("normalizer") or {}).get("normalizers") or []
    steps = (file.get("pre_tokenizer") or {}).get("pretokenizers") or []
    return (
        [x["type"] for x in normalizers] == _NORMALIZERS
        and normalizers[1].get("pattern") == {"Regex": r"\s+"}
        and normalizers[1].get("content") == " "
        and [x["type"] for x in steps] == ["Split", "ByteLevel"]
        and (steps[0].get("pattern"), steps[0].get("behavior"), steps[0].get("invert")) == ({"Regex": _SPLIT}, "Removed", True)
        and (steps[1].get("add_prefix_space"), steps[1].get("use_regex")) == (False, False)
        and not any(len(x["content"]) > _SPECIAL or not x["content"].startswith("<|") or x["lstrip"] or x["rstrip"] or x["single_word"] or any(c.isspace() for c in x["content"]) for x in file.get("added_tokens") or [])
    )


_CLOSING = np.zeros(256, bool)
_CLOSING[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<|>"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Second bytes of the letters U+00C0 to U+00FF.
_LATIN = np.zeros(256, bool)
_LATIN[[c for c in range(0x80, 0xC0) if c not in (0x97, 0xB7)]] = True
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: No special string is longer.
_SPECIAL = 16


def pieces_of(data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in lower case, but for what may be a special string, and starts and ends in them of words; marks that close a word after a Latin letter, which the tokenizer always splits off, are pieces of their own."""
    lower = _LOWER[data]
    for at in np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)).tolist():
        lower[at : at + _SPECIAL] = data[at : at + _SPECIAL]
    start, end = words(data, edge)
    place = np.where(_CLOSING[data], -1, np.arange(len(data)))
    last = np.maximum.accumulate(place)[end - 1] if len(end) else end
    closed = (last >= start) & (last < end - 1)
    letter, before = data[last], data[np.maximum(last - 1, 0)]
    cut = last[closed & (_LETTER[letter] | (_LATIN[letter] & (before == 0xC3) & (last > start)))] + 1
    return lower, np.sort(np.concatenate((start, cut))), np.sort(np.concatenate((end, cut)))


class IdEncoder:
    """Ids of texts by a tokenizers file. If its pre-tokenizer drops white space, each distinct run of other characters is encoded once and looked up afterwards; else whole texts are encoded."""

    def __init__(self, path: str, most: int = 1 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            self.by_word = splits_at_spaces(json.load(f))
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.lexicon = Lexicon(self._learn, self._forget, most)
        self._forget()

    def _forget(self) -> None:
        self.sizes, self.starts, self.flat = Flat(np.int64), Flat(np.int64), Flat(np.uint32)

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes]) -> None:
        """Letters alone are one piece, whose last id alone ends a word: many are encoded as one text and told apart by that."""
        size, start = np.zeros(len(pieces), np.int64), np.full(len(pieces), -1, np.int64)
        texts, flat, n = [x.decode("utf-8", "replace") for x in pieces], [], 0
        plain = np.array([i for i, w in enumerate(texts) if w.isalpha() and "\u0250" > max(w)], np.int64)
        for part in np.split(plain, range(2000, len(plain), 2000)):
            ids = self._encoded([" ".join([texts[i] for i in part])])[0]
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(part) and len(stop) == len(part):
                size[part] = np.diff(stop, prepend=0)
                start[part] = n + stop - size[part]
                flat.append(ids)
                n += len(ids)
        odd = np.flatnonzero(start < 0)
        for part in np.split(odd, range(2000, len(odd), 2000)):
            ids = self._encoded([texts[i] for i in part])
            size[part] = [len(x) for x in ids]
            start[part] = n + np.cumsum(size[part]) - size[part]
            flat += ids
            n += int(size[part].sum())
        self.starts.add(self.flat.n + start)
        self.sizes.add(size)
        self.flat.add(np.concatenate([np.zeros(0, np.uint32), *flat]))

    def _looked_up(self, data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, and the edges of rows in them."""
        data, start, end = pieces_of(data, edge)
        number = self.lexicon.find(data, start, end)
        size = self.sizes.values[number]
        upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
        ids = self.flat.values[np.repeat(self.starts.values[number] - upto[:-1], size) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(start, edge)]

    def ids(self, data: np.ndarray, edge: np.ndarray, most: int = 1 << 17) -> Iterator[np.ndarray]:
        """The ids of each row; data are the bytes of rows, edge their edges. Rows are looked up in runs of about most bytes, longer ones in parts that end before white space."""
        for s, e in runs(edge, most):
            own, upto = data[edge[s] : edge[e]], edge[s : e + 1] - edge[s]
            if not self.by_word:
                yield from self._encoded([own[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)])
            elif len(own) <= 2 * most:
                ids, at = self._looked_up(own, upto)
                yield from (ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            else:
                spaces, parts, a = np.flatnonzero(SPACE[own]), [], 0
                while a < len(own):
                    k = int(np.searchsorted(spaces, a + most))
                    b = int(spaces[k]) if k < len(spaces) else len(own)
                    parts.append(self._looked_up(own[a:b], np.array([0, b - a]))[0])
                    a = b
                yield np.concatenate(parts)


@cache
def encoder(path: str) -> IdEncoder:
    """One a Python worker, so that what a task has learned serves the next."""
    return IdEncoder(path)


def first_fit_decreasing(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(bin, offset) of each length; lengths come in decreasing order. The tree holds the free capacity of each bin, an inner node the larger of its two."""
    leaves = 1
    while leaves < max(1, len(lengths)):
        leaves *= 2
    tree = [capacity] * (2 * leaves)
    out = []
    for n in lengths:
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < n:
                node += 1
        out.append((node - leaves, capacity - tree[node]))
        tree[node] -= n
        node //= 2
        while node:
            most = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == most:
                break
            tree[node] = most
            node //= 2
    return out


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pieces of at most capacity ids: key, start, length, ids_crc32, doc_tokens, and draw, a random number of the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)

        for batch in (b.slice(s, 2048) for b in batches for s in range(0, b.num_rows, 2048)):
            rows = []
            for k, draw, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), own.ids(*text_bytes(batch.column(1))), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for s in range(0, len(ids), capacity):
                    part = ids[s : s + capacity]
                    rows.append((k, s, len(part), zlib.crc32(part), len(ids), draw))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], [key, "start", "length", "ids_crc32", "doc_tokens", "draw"])

    draw = F.xxhash64(F.lit(2048), key, text, F.monotonically_increasing_id())  # rows of one key, and equal ones, are spread as well
    return mapped(docs.select(F.col(key).cast("bigint").alias(key), text, draw.alias("draw")), run, f"`{key}` bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, draw bigint")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, group_docs: int = 4096, text: str = "text", key: str = "doc_id") -> DataFrame:
    """pieces() with sequence_id and offset. Sequences of different groups differ in the upper bits of their id."""
    groups = max(1, -(-docs.count() // group_docs))
    cut = pieces(docs, tokenizer_path, end_id, capacity, text, key).withColumn("pack_group", F.pmod("draw", F.lit(groups))).drop("draw")

    def fill(found: pa.Table) -> pa.Table:
        rows = found.to_pydict()
        n, keys, starts, group = rows["length"], rows[key], rows["start"], rows["pack_group"][0]
        order = sorted(range(len(n)), key=lambda i: (-n[i], keys[i] is None, keys[i] or 0, starts[i]))
        seq, off = [0] * len(n), [0] * len(n)
        for i, (b, o) in zip(order, first_fit_decreasing([n[i] for i in order], capacity), strict=True):
            seq[i], off[i] = (group << 32) + b, o
        return found.drop_columns(["pack_group"]).append_column("sequence_id", pa.array(seq, pa.int64())).append_column("offset", pa.array(off, pa.int64()))

    return cut.groupBy("pack_group").applyInArrow(fill, f"`{key}` bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
