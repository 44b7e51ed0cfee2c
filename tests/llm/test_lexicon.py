"""Looked-up tokens against plain encoding, on texts made of awkward parts."""

import json
import random
import tracemalloc

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from kernelfield.llm import packing as PK
from kernelfield.llm import token_counts as TC
from kernelfield.llm.lexicon import Lexicon, text_bytes, words

PARTS = [*"abcXYZ  \t\n..,'!?0129éßİΣσ|<>÷×$%ÀÖ", "\xa0", " ", "\x1c", "\x85", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "don't", "'ll", "漢字", "é", "̸", "ﬁ", "😀", "‍", "\0", "end.", "the,,", "z" * 90]


def _texts(n=3000):
    r = random.Random(1)
    return ["".join(r.choices(PARTS, k=r.randint(0, 60))) for _ in range(n)] + [None, "", " ", "plain words, " * 3000]


@pytest.mark.parametrize("most, entries", [(1 << 20, 1 << 20), (3000, 2000)])
def test_ids(most, entries):
    encoder = PK.IdEncoder(P.path("word_bpe_49k.json"), entries)
    assert encoder.by_word
    texts = _texts()
    got = list(encoder.ids(*text_bytes(pa.array(texts)), most=most))
    assert [x.tolist() for x in got] == [e.ids for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_memory_of_ids():
    """What a look-up holds beside the lexicon goes by a run of rows, not by the batch."""
    r = random.Random(2)
    vocabulary = ["".join(r.choices("abcdefghij", k=6)) for _ in range(2000)]
    encoder, texts = PK.IdEncoder(P.path("word_bpe_49k.json")), text_bytes(pa.array([" ".join(r.choices(vocabulary, k=300)) for _ in range(1000)]))
    total = sum(map(len, encoder.ids(*texts)))
    tracemalloc.start()
    assert sum(map(len, encoder.ids(*texts))) == total
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(texts[0]) > 2_000_000 and peak < 16 << 20, peak


@pytest.mark.parametrize("most, entries", [(1 << 20, 1 << 20), (3000, 2000)])
def test_counts(most, entries):
    encoder = TC.LengthEncoder(P.path("byte_bpe_50k.json"), most=entries)
    assert encoder.by_piece
    texts = _texts()
    got = encoder.counts(*text_bytes(pa.array(texts)), most=most)
    assert got.tolist() == [len(e.ids) for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_another_tokenizer_encodes_whole_texts(tmp_path):
    texts = _texts(200)
    for kind, name, change in ((PK.IdEncoder, "word_bpe_49k.json", ("normalizer", None)), (TC.LengthEncoder, "byte_bpe_50k.json", ("normalizer", {"type": "Lowercase"}))):
        with open(P.path(name), encoding="utf-8") as f:
            file = json.load(f)
        file[change[0]] = change[1]
        (tmp_path / name).write_text(json.dumps(file), encoding="utf-8")
        encoder = kind(str(tmp_path / name))
        want = [e.ids for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        if kind is PK.IdEncoder:
            assert not encoder.by_word and [x.tolist() for x in encoder.ids(*text_bytes(pa.array(texts)))] == want
        else:
            assert not encoder.by_piece and encoder.counts(*text_bytes(pa.array(texts))).tolist() == [len(x) for x in want]


def test_numbers_stay_those_of_their_pieces():
    seen: list[bytes] = []
    lexicon = Lexicon(seen.extend, seen.clear, 50)
    r = random.Random(3)
    for _ in range(40):
        texts = [" ".join(r.choice("abcd") * r.randint(1, 90) for _ in range(r.randint(0, 30))) for _ in range(4)]
        data, edge = text_bytes(pa.array([None, *texts]))
        start, end = words(data, edge)
        number = lexicon.find(data, start, end)
        assert [seen[k] for k in number] == [data[s:e].tobytes() for s, e in zip(start, end, strict=True)] == "  ".join(texts).encode().split()
        assert len(set(seen)) == len(seen) and np.all(number >= 0)
