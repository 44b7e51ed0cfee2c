"""Substring removal against brute force."""

import hashlib
import random

import numpy as np

from kernelfield.llm import suffix_dedup as S
from kernelfield.llm.common import Scratch


def brute(rows, length=100):
    first = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    order = lambda d: S._LAST if d is None else d
    for d, t in data:
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            if w not in first or (order(d), p) < first[w]:
                first[w] = (order(d), p)
    out = []
    for d, t in data:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < (order(d), p):
                gone[p : p + length] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((d, len(t), int(gone.sum()), int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if len(t) else 0, hashlib.sha256(kept).hexdigest()))
    return out


def key(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


def cases():
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdeé", k=r.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(60) for _ in range(4)]
    rows = [(i, " ".join(r.choice([text(r.randint(1, 40)), r.choice(shared)[r.randint(0, 30) : r.randint(150, 260)]]) for _ in range(r.randint(1, 5)))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(10)]
    rows += [(200, None), (201, ""), (202, "a" * 700), (203, "ab" * 400), (204, "\0" * 350 + text(20)), (205, "\0" * 150), (None, rows[3][1]), (206, "x" * 99), (3, rows[3][1]), (4, text(80) + rows[5][1])]
    rows += [(300, text(5000) + rows[7][1]), (301, shared[0] * 12)]
    return rows


def test_whole_texts_against_brute_force(spark):
    rows = cases()
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id bigint, text string, n_bytes int").repartition(5)
    for size in (4 << 20, 3000):
        assert key(tuple(r) for r in S.remove_repeats(docs, bucket_bytes=size, part_bytes=size, flush_bytes=size).collect()) == key(brute(rows))


def test_multikey_quicksort():
    r = np.random.default_rng(4)
    for n, width, most in ((0, 2, 3), (1, 1, 1), (500, 3, 3), (2000, 4, 2), (300, 2, 1000)):
        words, group = r.integers(0, most, (n, width)).astype(np.uint64), r.integers(0, 7, n)
        order, number = S.multikey_quicksort(group, words)
        rows = [(int(group[i]), *words[i].tolist()) for i in order]
        assert rows == sorted(rows) and sorted(order.tolist()) == list(range(n))
        assert [a == b for a, b in zip(number, number[1:], strict=False)] == [a == b for a, b in zip(rows, rows[1:], strict=False)]


def test_contexts_meet_in_equal_windows():
    """Of two equal windows one context at least has the same hash."""
    r = random.Random(8)
    for length in (100, 40):
        for _ in range(200):
            core = bytes(r.choices(b"abc ", k=length + r.randint(0, 30)))
            a, b = (np.frombuffer(bytes(r.choices(b"abc ", k=r.randint(0, 90))) + core + bytes(r.choices(b"abc ", k=r.randint(0, 90))), np.uint8) for _ in range(2))
            x, y = ({int(v) for k in (1, 3) for v in S.contexts(*S.anchors(t, None, length), length)[k]} for t in (a, b))
            assert x & y


def test_texts_that_open_alike_under_one_key(spark):
    """Null ids, and different texts under one id, tie at the start of a passage that an earlier document holds."""
    r = random.Random(9)
    text = lambda n: " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(n))
    a, b = text(55), text(55)
    rows = [(7, text(10) + a), *[(None, a + text(30)) for _ in range(4)], *[(20, a + text(20)) for _ in range(3)], *[(None, b + text(9)) for _ in range(3)], (None, text(5) + b), (30, text(3) + b[:200])]
    rows += [rows[1], rows[1], rows[6]]
    for seed, parts in ((1, 1), (2, 3), (3, 14)):
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
        for size in (4 << 20, 1000):
            assert key(tuple(x) for x in S.remove_repeats(docs, bucket_bytes=size).collect()) == key(brute(rows))


def test_frequent_grams(spark):
    r = random.Random(6)
    passage = "this passage stands in a great many documents, word for word, and is longer than the window of one hundred bytes. " * 2
    rows = [(i, " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(30)) + passage + str(r.random())) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    raw = docs.selectExpr("cast(text as binary) as text")
    assert S.frequent_slots(raw, 50, 100, Scratch(spark)) is not None
    assert key(tuple(r) for r in S.remove_repeats(docs, bucket_bytes=2000).collect()) == key(brute(rows))


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_blind_trie_orders():
    r = random.Random(1)
    strings = list({bytes(r.choices(b"ab\0", k=r.randint(0, 12))) for _ in range(300)})
    got = list(S.BlindTrie(strings).ordered())
    assert [strings[i] for i, _ in got] == sorted(strings)
    for (i, _), (j, n) in zip(got, got[1:], strict=False):
        a, b = strings[i], strings[j]
        assert n == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def test_documents(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert key(tuple(r) for r in S.op1_suffix_dedup(spark, d).collect()) == key(brute(rows))
