"""Levels of hashes, counted in ranges."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from kernelfield.llm.tally import Tally


def _sent(tally, parts, holders):
    tables = [tally.sent(p, h, holders[p] if holders else None) for p, h in enumerate(parts)]
    return pa.concat_tables(tables)


@pytest.mark.parametrize("bits", [0, 16])
def test_ranges(bits):
    """By any number of ranges, and by a plain count."""
    draw = np.random.default_rng(3)
    pool = draw.integers(0, 1 << 63, 400, np.uint64) * np.uint64(2)
    parts = [np.concatenate((draw.choice(pool, 700), pool[:1].repeat(40))) for _ in range(5)]
    holders = [draw.integers(0, 30, len(h), np.uint64) for h in parts] if bits else None
    tally = Tally(3700, bits)
    sent = _sent(tally, parts, holders)
    whole, ranged = tally.answered(sent), tally.answered(sent, most=50)
    assert whole.equals(ranged)
    rows = np.concatenate(parts) if not bits else np.unique(np.stack((np.concatenate(parts), np.concatenate(holders)), 1), axis=0)[:, 0]
    number = dict(zip(*(x.tolist() for x in np.unique(rows, return_counts=True)), strict=True))
    for p, h in enumerate(parts):
        got = tally.levels(h, ranged.filter(pa.array([x == p for x in ranged["part"].to_pylist()])))
        assert got.tolist() == [(number[x] - 1).bit_length() for x in h.tolist()]


def test_memory_of_a_bucket():
    """Of a bucket's hashes little more is held than themselves."""
    draw = np.random.default_rng(4)
    parts = [draw.integers(0, 1 << 63, 1 << 17, np.uint64) * np.uint64(2) for _ in range(12)]
    tally = Tally(12 << 17)
    sent = _sent(tally, parts, None)
    assert tally.buckets == 1
    tracemalloc.start()
    tally.answered(sent)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 * (12 << 17), peak
