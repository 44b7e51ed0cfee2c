"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are cut at safe boundaries: byte-level pre-tokenisation always starts a new piece where white space begins, and between a
letter and the marks that close a word, so a text of any length is encoded in small pieces. Distinct pieces are encoded once, in
batches of about equal bytes, and their lengths looked up by array operations (lexicon.py), since words repeat. Texts with white space
beyond ASCII, which may join what ASCII white space divides, are cut at single blanks between other characters alone. A tokenizer
whose file tells of another pre-tokenizer encodes whole texts.

Defined cases: null and empty texts count 0 bytes and 0 tokens; special strings inside a text
count as the tokenizer's default treats them (one token); repeated rows give repeated results;
extra input columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kernelfield.llm.common import table
from kernelfield.llm.lexicon import Flat, Lexicon, runs, text_bytes, words

#: A blank here always begins a new piece of a byte-level pre-tokenizer.
SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Any character that may count as white space beside the six of ASCII.
_OTHER_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8b\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_CLOSING = np.zeros(256, bool)
_CLOSING[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<|>"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def segments(data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of pieces that make up the rows: white space with the word after it, marks that close a word after an ASCII letter, and white space at a row's end."""
    start, end = words(data, edge)
    row = np.searchsorted(edge, start, "right") - 1
    begin = np.maximum(np.concatenate((np.zeros(1, np.int64), end))[:-1], edge[row]) if len(start) else start
    place = np.where(_CLOSING[data], -1, np.arange(len(data)))
    last = np.maximum.accumulate(place)[end - 1] if len(end) else end
    cut = last[(last >= start) & (last < end - 1) & _LETTER[data[last]]] + 1
    upto = np.searchsorted(start, edge[1:])
    after = np.maximum(np.concatenate((np.zeros(1, np.int64), end))[upto], edge[:-1])
    rest = after < edge[1:]
    return np.sort(np.concatenate((begin, cut, after[rest]))), np.sort(np.concatenate((end, cut, edge[1:][rest])))


class LengthEncoder:
    """Token counts of texts by a tokenizers file."""

    def __init__(self, path: str, batch_bytes: int = 1 << 19, most: int = 1 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        step = file.get("pre_tokenizer") or {}
        special = file.get("added_tokens") or []
        self.by_piece = (
            file.get("normalizer") is None
            and (step.get("type"), step.get("add_prefix_space"), step.get("use_regex")) == ("ByteLevel", False, True)
            and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or not re.fullmatch(r"<\|\w+\|>", x["content"]) for x in special)
        )
        self.batch_bytes, self.lexicon = batch_bytes, Lexicon(self._learn, self._forget, most)
        self._forget()

    def _forget(self) -> None:
        self.sizes = Flat(np.int64)

    def _lengths(self, pieces: list[bytes]) -> list[int]:
        """Encodes pieces in batches balanced by bytes."""
        out: list[int] = []
        edge = np.concatenate((np.zeros(1, np.int64), np.cumsum([len(x) for x in pieces], dtype=np.int64)))
        for s, e in runs(edge, self.batch_bytes):
            out += [len(got.ids) for got in self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in pieces[s:e]], add_special_tokens=False)]
        return out

    def _learn(self, pieces: list[bytes]) -> None:
        self.sizes.add(np.array(self._lengths(pieces), np.int64))

    def counts(self, data: np.ndarray, edge: np.ndarray, most: int = 1 << 20) -> np.ndarray:
        """The token counts of rows; data are their bytes, edge their edges. Rows are looked up in runs of about most bytes."""
        out = np.zeros(len(edge) - 1, np.int64)
        for s, e in runs(edge, most):
            own, upto = data[edge[s] : edge[e]], edge[s : e + 1] - edge[s]
            raw = own.tobytes()
            if not self.by_piece:
                out[s:e] = self._lengths([raw[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)])
                continue
            begin, end = segments(own, upto)
            number = self.lexicon.find(own, begin, end)
            sizes = self.sizes.values[number]
            out[s:e] = np.diff(np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))[np.searchsorted(begin, upto)])
            for k in {int(np.searchsorted(upto, m.start(), "right")) - 1 for m in _OTHER_SPACE.finditer(raw)}:
                first, *rest = SAFE.split(raw[upto[k] : upto[k + 1]].decode("utf-8", "replace"))
                out[s + k] = sum(self._lengths([first.encode(), *[b" " + x.encode() for x in rest]]))
        return out


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of docs: key, n_bytes, n_tokens, over_limit (n_tokens > limit)."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = LengthEncoder(tokenizer_path)
        for batch in batches:
            data, edge = text_bytes(batch.column(1))
            n_tokens = encoder.counts(data, edge)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(edge), pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(n_tokens > limit, pa.bool_())], [key, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(lengths, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
