"""Language identification: string kernels with Nystroem landmarks and one-versus-rest kernel ridge regression.

The kernel of two texts is the number of byte n-grams of 1 to MAX_N bytes present in both, over the geometric mean of their own
numbers. N-grams are told apart by BUCKETS hash values, so for very long texts it is an approximation from above. Landmarks are
labelled texts; K(x, landmarks) K(landmarks)^(-1/2) are the features, on which a ridge regression per language is fitted to +1 and -1. As the
kernel is linear in the presence vector, landmarks, whitening and regression fold into one matrix of the landmarks' n-grams x languages, and
a batch of texts, as sparse rows of presence, is scored by one product with it.

Every labelled language is learned. Fitted on at most per_language labelled rows of each, fewer where there are many
languages (max_rows in all, but one of each at least), drawn by a hash of key and text, texts over long_bytes last, repeated rows once, and of these as
many as max_bytes shared by the languages hold, one at least; every row is scored on its whole text.

Defined cases: a text that is null or has no letter is 'und' with score 0; so is every text if there are no labelled
rows; null languages are not learned from; equal scores go to the language first by code point; repeated rows give repeated
results; extra input columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kernelfield.llm.common import mapped, table, unused

MAX_N, BUCKETS = 4, 1 << 20
_LETTER = re.compile(r"[^\W\d_]")
_PRIMES = (0, 0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)


def buckets(text: str) -> np.ndarray:
    """The hashed n-grams of a text, repeats included."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    found, code = [], np.zeros(len(raw), np.uint32)
    for n in range(1, MAX_N + 1):
        if len(raw) < n:
            break
        code = (code[: len(raw) - n + 1] << np.uint32(8)) | raw[n - 1 :]
        h = code * np.uint32(_PRIMES[n])
        found.append((h ^ (h >> np.uint32(15))) * np.uint32(_PRIMES[2]) >> np.uint32(32 - BUCKETS.bit_length() + 1))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


class Presence:
    """Sparse rows of presence: the distinct n-grams of texts. Repeats are told by the last place at which a bucket was seen."""

    def __init__(self):
        self.last = np.zeros(BUCKETS, np.int32)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of each text, one after the other, and their number."""
        out = []
        for text in texts:
            h = buckets(text)
            at = np.arange(len(h), dtype=np.int32)
            self.last[h] = at
            out.append(h[self.last[h] == at])
        return np.concatenate([np.zeros(0, np.uint32), *out]), np.array([len(x) for x in out], np.int64)


def _summed(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of successive rows, size of them each."""
    out, some = np.zeros((len(size), rows.shape[1])), size > 0
    if some.any():
        out[some] = np.add.reduceat(rows, (np.cumsum(size) - size)[some], 0, dtype=np.float64)
    return out


def kernel(texts: list[str], marks: list[str]) -> np.ndarray:
    """The kernel of each text with each landmark."""
    presence = Presence()
    found, size = presence(marks)
    grams, number = np.unique(found, return_inverse=True)
    dense = np.zeros((len(grams) + 1, len(marks)), np.uint8)
    dense[number, np.repeat(np.arange(len(marks)), size)] = 1
    place = np.full(BUCKETS, len(grams), np.int64)
    place[grams] = np.arange(len(grams))
    out = np.zeros((len(texts), len(marks)))
    for row, text in zip(out, texts, strict=True):
        h, n = presence([text])
        row[:] = dense[place[h]].sum(0, dtype=np.int64) / np.sqrt(np.maximum(1, n[0]) * np.maximum(1, size))
    return out


class Model:
    """languages; place of an n-gram in weights (the last row, of zeros, for those that no landmark has); weights and bias by language."""

    def __init__(self, languages: list[str], place: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.languages, self.place, self.weights, self.bias = languages, place, weights, bias

    @staticmethod
    def fit(texts: list[str], langs: list[str], landmarks: int = 40, ridge: float = 1e-2) -> Model | None:
        """landmarks: for each language, the first of its texts."""
        languages = sorted(set(langs))
        if not languages:
            return None
        chosen, taken = [], dict.fromkeys(languages, 0)
        for i, x in enumerate(langs):
            if taken[x] < landmarks:
                taken[x] += 1
                chosen.append(i)
        marks = [texts[i] for i in chosen]
        with_marks = kernel(texts, marks)
        values, vectors = np.linalg.eigh(with_marks[chosen])
        root = vectors * np.where(values > 1e-6, 1 / np.sqrt(np.maximum(values, 1e-6)), 0) @ vectors.T
        features = with_marks @ root
        target = np.where(np.array(langs)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
        # balance: each language has the same weight
        number = Counter(langs)
        weight = 1 / np.array([number[x] for x in langs], float)[:, None]
        mean_x, mean_y = (features * weight).sum(0) / weight.sum(), (target * weight).sum(0) / weight.sum()
        x, y = features - mean_x, target - mean_y
        beta = np.linalg.solve(x.T @ (weight * x) + ridge * weight.sum() / len(x) * np.eye(x.shape[1]), x.T @ (weight * y))
        # a text's scores are the sum over its n-grams of what the landmarks that have them give
        each = root @ beta
        found, size = Presence()(marks)
        grams, at = np.unique(found, return_inverse=True)
        weights = np.zeros((len(grams) + 1, len(languages)))
        np.add.at(weights, at, np.repeat(each / np.sqrt(np.maximum(1, size))[:, None], size, 0))
        place = np.full(BUCKETS, len(grams), np.int32)
        place[grams] = np.arange(len(grams))
        return Model(languages, place, weights.astype(np.float32), mean_y - mean_x @ beta)

    def values(self, texts: list[str], presence: Presence) -> np.ndarray:
        """What each text's regressions give, by language."""
        found, size = presence(texts)
        return _summed(self.weights[self.place[found]], size) / np.sqrt(np.maximum(1, size))[:, None] + self.bias

    def predict(self, texts: list[str], presence: Presence | None = None) -> list[tuple[str, float]]:
        values = self.values(texts, presence or Presence())
        best = values.argmax(1)
        score = np.clip((values[np.arange(len(best)), best] + 1) / 2, 0, 1)
        return [(self.languages[b], float(s)) for b, s in zip(best, score, strict=True)]


def held_out(key: str = "doc_id"):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 300, max_rows: int = 19_200, max_landmarks: int = 2_560, max_bytes: int = 64 << 20, long_bytes: int = 1 << 17) -> Model | None:
    """Fits on a bounded sample of the labelled rows that are not held out: of each language the texts of the least hashes."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}") & ~F.coalesce(held_out(key), F.lit(False)))
    order = F.struct((F.octet_length(text) > long_bytes).alias("long"), F.xxhash64(F.lit("order"), key, text).alias("h"))
    rows = labelled.select(F.col(lang).alias("__lang"), order.alias("__o"), F.octet_length(text).alias("__size"), F.col(text).alias("__text"))
    languages = rows.select("__lang").distinct().count()
    if not languages:
        return None
    each = max(1, min(per_language, max_rows // languages))
    by_order = Window.partitionBy("__lang").orderBy("__o")
    drawn = rows.select("__lang", "__o", "__size").distinct().withColumn("n", F.row_number().over(by_order)).where(F.col("n") <= each)
    drawn = drawn.withColumn("held", F.sum("__size").over(by_order)).where((F.col("n") == 1) | (F.col("held") <= max_bytes // languages))
    last = drawn.groupBy("__lang").agg(F.max("__o").alias("__last")).withColumnRenamed("__lang", "__of")
    found = rows.join(F.broadcast(last), (F.col("__lang") == F.col("__of")) & (F.col("__o") <= F.col("__last"))).groupBy("__lang", "__o").agg(F.min("__text").alias("__text")).collect()
    found = sorted(found, key=lambda r: (r[1], r[0], r[2]))
    return Model.fit([r[2] for r in found], [r[0] for r in found], landmarks=max(1, min(40, max_landmarks // languages)))


def identify(docs: DataFrame, model: Model | None, text: str = "text", key: str = "doc_id", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The key (or the columns of keep) with lang_pred and score, or under other names."""
    kept = keep or [key]
    at = kept.index(text) if text in kept else len(kept)  # a text that is kept travels once
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in kept) + f", `{names[0]}` string, `{names[1]}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, presence = shared.value, Presence()
        for batch in (b.slice(s, 256) for b in batches for s in range(0, b.num_rows, 256)):
            texts = batch.column(at).to_pylist()
            got: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
            some = [i for i, t in enumerate(texts) if fitted and t and _LETTER.search(t)]
            held, part = 0, []
            for k, i in enumerate(some):
                part.append(i)
                held += len(texts[i])
                if held >= 1 << 16 or k == len(some) - 1:
                    for j, r in zip(part, fitted.predict([texts[j] for j in part], presence), strict=True):
                        got[j] = r
                    held, part = 0, []
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], [*kept, *names])

    return mapped(docs.select(*kept, *([] if text in kept else [F.col(text).alias(unused("__text", docs))])), run, schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.3) -> DataFrame:
    """Keeps the documents whose predicted language is known with a score of at least 0.3."""
    lang, score = unused("lang_pred", docs), unused("score", docs)
    found = identify(docs, fit(docs), keep=docs.columns, names=(lang, score))
    return found.where((F.col(lang) != "und") & (F.col(score) >= least)).drop(lang, score)
