"""The corpus pipeline, stage by stage and as a whole."""

import random
import re
import zlib
from collections import Counter

import corpus_pipeline as P
import numpy as np
from pyspark.sql import functions as F

from kernelfield.llm import jaccard_join, language_id, secret_scan, source_mixing

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["language_id", "near_duplicates", "secret_scan", "source_mixing", "packing"]
    kept = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF).persist()
        kept[name] = out
        if name != "packing":
            assert out.columns == docs.columns
        docs = out
    ids = lambda n: {r[0] for r in kept[n].select("doc_id").distinct().collect()}
    assert ids("near_duplicates") < ids("language_id") and ids("secret_scan") == ids("near_duplicates") and ids("source_mixing") <= ids("secret_scan")
    assert kept["secret_scan"].where(F.col("text").rlike('AKIA[0-9A-Z]{16}|token = "[0-9a-f]{40}')).count() == 0
    words = {r[0]: r[1] for r in kept["source_mixing"].groupBy("doc_id").count().collect()}
    assert max(words.values()) <= 3
    packed = kept["packing"].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"))
    assert packed.join(kept["source_mixing"].groupBy("doc_id").count(), "doc_id").where("n <> t * count").count() == 0
    assert kept["packing"].groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_run(spark):
    assert P.run(spark, SF).count() > 100


def test_batches_are_bounded(spark, monkeypatch):
    """Of all texts that go to Python a small batch at a time, once each."""
    r = random.Random(5)
    words = ["".join(r.choices("abcdefghij", k=6)) for _ in range(2000)]
    rows = [(i, " ".join(r.choices(words, k=600)), "en", f"src{i % 2}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").coalesce(1).persist()
    assert docs.agg(F.sum(F.length("text"))).first()[0] > 8_000_000
    seen, plain = [], type(docs).mapInArrow

    def watched(df, func, schema, *rest, **more):
        def run(batches):
            def small():
                for b in batches:
                    assert b.nbytes < 5 << 19, b.nbytes
                    yield b

            yield from func(small())

        seen.append(df.columns)
        return plain(df, run, schema, *rest, **more)

    monkeypatch.setattr(type(docs), "mapInArrow", watched)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    for name, stage in P.STAGES:
        if name != "source_mixing":
            stage(spark, docs, SF).write.format("noop").mode("overwrite").save()
    assert len(seen) >= 4 and all(len({"text", "__text", "raw"} & set(c)) <= 1 for c in seen)


EXTRA = ["score", "lang_pred", "copies", "row", "__row", "__text", "size", "target", "component_id", "n_tokens", "length"]


def _awkward(spark):
    """Documents of the smallest table, with rows without id, text or source, repeated ids and rows, a very long text, and columns whose names stages use."""
    r = random.Random(4)
    prose = [x["text"] for x in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' and n_chars between 400 and 3000").orderBy("doc_id").select("text").limit(8).collect()]
    rows = [(9001, prose[0], "srcA"), (9001, prose[0], "srcA"), (9001, prose[1], "srcA"), (None, prose[2], "srcA"), (None, prose[2], "srcA"), (None, prose[3], None), (9002, prose[3] + " closing words", None), (9003, None, "srcB"), (9004, "", None), (9005, " \n ", "srcB"), (9006, "!!! 123", "srcB")]
    rows += [(9007, " ".join(r.sample(prose[4].split() * 400, 20_000)), "srcB"), (9008, 'the key is token = "' + "0123456789abcdef" * 2 + '01234567" and more words of prose follow here ' + prose[5], "srcB"), (-5, prose[6], "é"), (9009, prose[7].upper(), "é")]
    odd = spark.createDataFrame([(d, t, None, s, None if t is None else len(t)) for d, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("bigint").alias("n_chars")).unionByName(odd)
    return docs.withColumns({c: F.lit(i) for i, c in enumerate(EXTRA)}).repartition(5).persist()


def _rows(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]


def test_language_stage_by_hand(spark):
    docs = _awkward(spark)
    kept = dict(P.STAGES)["language_id"](spark, docs, SF)
    assert kept.columns == docs.columns
    model = language_id.fit(docs)
    want = Counter()
    for d, t, s in _rows(docs):
        if t and any(c.isalpha() for c in t):
            lang, score = model.predict([t])[0]
            want[d, t, s] += lang != "und" and score >= 0.3
    assert Counter(_rows(kept)) == +want and not any(t is None or not t.strip() for _, t, _ in want.elements())


def test_near_duplicate_stage_by_hand(spark):
    docs = _awkward(spark)
    kept = dict(P.STAGES)["near_duplicates"](spark, docs, SF)
    assert kept.columns == docs.columns
    shingles = jaccard_join.Shingler()
    rows = [(d, t, s, shingles((t or "").encode())) for d, t, s in _rows(docs)]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i], rows[j]
            if jaccard_join.linked(a[3], b[3]) or (not len(a[3]) and not len(b[3]) and a[0] is not None and a[0] == b[0]):
                group[find(i)] = find(j)
    members = {}
    for i, (d, t, s, _) in enumerate(rows):
        members.setdefault(find(i), []).append((d, t, s))
    left = Counter(_rows(kept))
    assert sum(left.values()) == len(members)
    for own in members.values():
        here = [x for x in own if left[x]]
        least = min((d is None, d or 0) for d, _, _ in own)
        assert here and sum(left[x] for x in set(own)) >= 1 and any((d is None, d or 0) == least for d, _, _ in here)


def test_secret_stage_by_hand(spark):
    docs = _awkward(spark)
    done = dict(P.STAGES)["secret_scan"](spark, docs, SF)
    assert done.columns == docs.columns
    forest, want = secret_scan.train(), Counter()
    for d, t, s in _rows(docs):
        spans = secret_scan.find([t], [s], forest)[0][1]
        want[d, t if not spans else "".join(t[a:b] + secret_scan.MARK for a, b in zip([0, *[e for _, e in spans]], [x for x, _ in spans], strict=False)) + t[spans[-1][1] :], s] += 1
    assert Counter(_rows(done)) == want
    assert any(secret_scan.MARK in (t or "") for d, t, _ in want if d == 9008)
    assert done.where("n_chars <> length(text)").join(docs.where("n_chars = length(text)").select("doc_id"), "doc_id", "left_semi").count() == 0


def test_mixing_stage_by_hand(spark):
    docs = _awkward(spark)
    mixed = dict(P.STAGES)["source_mixing"](spark, docs, SF)
    assert mixed.columns == docs.columns
    before, after = Counter(_rows(docs)), Counter(_rows(mixed))
    assert set(after) <= set(before) and all(after[x] <= 3 * before[x] for x in after)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = {r["source"]: r["target"] for r in source_mixing.mix(docs).join(docs.select(F.col("doc_id").alias("d"), "source").distinct(), F.col("doc_id").eqNullSafe(F.col("d"))).where("source is not null and source <> 'srcA'").select("source", "target").distinct().collect()}
    for source, target in want.items():
        taken = sum(n * size(t) for (_, t, s), n in after.items() if s == source)
        largest = max(size(t) for (_, t, s) in before if s == source)
        if len([1 for _, _, s in before if s == source]) > 3 and target > 0:
            assert abs(taken - target) <= largest
    again = Counter(_rows(dict(P.STAGES)["source_mixing"](spark, docs.repartition(3), SF)))
    assert again == after


def test_packing_stage_by_hand(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = _awkward(spark)
    pieces = dict(P.STAGES)["packing"](spark, docs, SF)
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for d, t, _ in _rows(docs):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.update((d, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)) for s in range(0, len(ids), 2048))
    got = pieces.collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        ends = [o + n for o, n in sorted(own)]
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id is null")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
    assert P.STAGES[-1][1](spark, docs, SF).count() == 0
