"""Exact top-k search by inner product: a Voronoi kNN join.

Vectors x get one more component, sqrt(M^2 - |x|^2) with M the largest norm, and queries a 0 there, so that the largest product is the least
distance. Data are grouped by the nearest of some pivots, which are rows themselves, about half the root of their number; a cell of more
than block_rows rows is divided into rings by distance from its pivot. Of each ring the least and the largest distance, the largest norm
and the number of rows are summaries, from which a query q with pivot p has an upper bound for its products:
(|q|^2 + M^2 - gap^2) / 2, where gap is what the distance from q to p is off the ring, and also q.p + |q| largest, and |q| times the norm.

First every query is solved in one ring, the innermost of the cell whose pivot gives the best product, of those of more than k rows; its k-th score there is a lower bound. Then it is copied
only to rings whose upper bound reaches that, and solved there by matrix products; the partial lists are merged by query. A ring of many rows (copies of
one vector cannot be told apart by distance) is dealt over blocks of about block_rows, so a hot one is no single task.

Defined cases: components are floor(scale * x); vectors null, or with null or non-finite components, take no part; rows without id are no
queries, but candidates, last among equal scores; shorter vectors count as filled up with zeros; rows that share an id are rows of their own,
each a candidate for the other; ties go to the smaller id; fewer than k candidates give fewer rows; extra input columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kernelfield.llm.common import table, written

_FOUND = "query bigint, query_id bigint, vec_id bigint, score bigint"
_RINGS = 16
_NONE = np.iinfo(np.int64).max


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    edge, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    size = np.diff(edge)
    flat = flat[edge[0] : edge[-1]]
    if (size == width).all():
        return flat.astype(float).reshape(len(size), width)
    out = np.zeros((len(size), width))
    out[np.arange(width) < size[:, None]] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact: floats while no sum can pass 2^53, else 64-bit integers."""
    most = (np.abs(a).max(initial=0) + 1) * (np.abs(b).max(initial=0) + 1) * max(1, a.shape[1])
    return (a @ b.T).astype(np.int64) if most < 2**53 else a.astype(np.int64) @ b.astype(np.int64).T


def quantised(vectors: DataFrame, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """row (a number), vec_id and v, the whole-numbered components, for the rows that take part."""
    x = F.col(vector)
    fine = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    return vectors.where(x.isNotNull() & fine).select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("bigint").alias("vec_id"), whole.alias("v"))


class VoronoiJoin:
    """Vectors in cells, rings and blocks, and the ways of queries to them."""

    def __init__(self, vectors: DataFrame, k: int = 5, pivots: int | None = None, block_rows: int = 4096, scale: int = 256, key: str = "vec_id", vector: str = "embedding", most_pivots: int = 4096):
        self.spark, self.k, self.block_rows = vectors.sparkSession, k, block_rows
        rows = written(quantised(vectors, scale, key, vector), "vectors")
        square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
        self.n, self.width, most = rows.agg(F.count("*"), F.max(F.size("v")), F.max(square)).first()
        if not self.n:
            return
        self.top = float(most) * (1 + 1e-12)  # M^2
        pivots = pivots or max(8, min(most_pivots, math.isqrt(self.n) // 2))
        chosen = rows.select("v", F.xxhash64(F.lit("pivot"), "vec_id", "v").alias("h")).distinct().orderBy("h", "v").limit(pivots).collect()
        centre = np.zeros((len(chosen), self.width))
        for line, r in zip(centre, chosen, strict=True):
            line[: len(r[0])] = r[0]
        self.centre = self.spark.sparkContext.broadcast(centre)
        self.cells = written(self._placed(rows), "cells")
        self._summarise()

    def _placed(self, rows: DataFrame) -> DataFrame:
        centre, width, top = self.centre, self.width, self.top

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = centre.value
            rest = np.sqrt(np.maximum(top - (c * c).sum(1), 0))
            for batch in (b.slice(s, 2048) for b in batches for s in range(0, b.num_rows, 2048)):
                x = _matrix(batch.column(2), width)
                square = (x * x).sum(1)
                raised = np.sqrt(np.maximum(top - square, 0))
                d2 = np.maximum(square[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T, 0) + (raised[:, None] - rest[None, :]) ** 2
                cell = d2.argmin(1)
                # a distance is off by the rounding of the squares that it is made of
                far = np.sqrt(d2[np.arange(len(cell)), cell])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far), pa.array(np.sqrt(square))], ["row", "vec_id", "v", "cell", "far", "norm"])

        return rows.mapInArrow(nearest, "row bigint, vec_id bigint, v array<bigint>, cell int, far double, norm double")

    def _summarise(self) -> None:
        """Rings of the cells, in order: cell, least and largest distance, largest norm, rows, blocks and the first of these."""
        cells = len(self.centre.value)
        edges = np.full((cells, _RINGS - 1), np.inf)
        parts = [i / _RINGS for i in range(1, _RINGS)]
        for cell, n, cuts in self.cells.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("far", parts, 1000)).where(F.col("n") > self.block_rows).collect():
            rings = min(_RINGS, -(-n // self.block_rows))
            edges[cell, : rings - 1] = [cuts[round(_RINGS * i / rings) - 1] for i in range(1, rings)]
        self.edges = self.spark.sparkContext.broadcast(edges)
        found = sorted(tuple(r) for r in self._ringed(self.cells).groupBy("cell", "ring").agg(F.min("far"), F.max("far"), F.max("norm"), F.count("*")).collect())
        self.ring_cell, ring, self.low, self.high, self.norm, self.rows = (np.array([r[i] for r in found]) for i in range(6))
        self.blocks = -(-self.rows // self.block_rows)
        self.first = np.cumsum(self.blocks) - self.blocks
        self.number = np.full((cells, _RINGS), -1)
        self.number[self.ring_cell, ring] = np.arange(len(ring))

    def _ringed(self, rows: DataFrame) -> DataFrame:
        """cell, ring, far, norm."""
        edges = self.edges

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, far = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                ring = (far[:, None] > edges.value[cell]).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ring, pa.int32()), batch.column(1), batch.column(2)], ["cell", "ring", "far", "norm"])

        return rows.select("cell", "far", "norm").mapInArrow(run, "cell int, ring int, far double, norm double")

    def data(self) -> DataFrame:
        """block, row, vec_id, v of every row."""
        shared = self.spark.sparkContext.broadcast((self.edges.value, self.number, self.blocks, self.first))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            edges, number, blocks, first = shared.value
            for batch in batches:
                cell, far, draw = (batch.column(i).to_numpy() for i in (3, 4, 5))
                ring = number[cell, (far[:, None] > edges[cell]).sum(1)]
                yield pa.RecordBatch.from_arrays([pa.array(first[ring] + draw % blocks[ring], pa.int64()), *batch.columns[:3]], ["block", "row", "vec_id", "v"])

        rows = self.cells.select("row", "vec_id", "v", "cell", "far", F.pmod(F.xxhash64("row"), F.lit(1 << 40)).alias("draw"))
        return rows.mapInArrow(run, "block bigint, row bigint, vec_id bigint, v array<bigint>")

    def routes(self, queries: DataFrame, home: bool) -> DataFrame:
        """block, query, query_id, q: where queries (row, vec_id, v, least, the score that counts) go; home: to one block each, else to the others that may hold a score of least."""
        shared = self.spark.sparkContext.broadcast((self.centre.value, self.ring_cell, self.low, self.high, self.norm, self.rows, self.blocks, self.first))
        width, top, k = self.width, self.top, self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centre, cell, low, high, longest, rows, blocks, first = shared.value
            for batch in (b.slice(s, 512) for b in batches for s in range(0, b.num_rows, 512)):
                q = _matrix(batch.column(2), width)
                norm = np.sqrt((q * q).sum(1))[:, None]
                product = (q @ centre.T)[:, cell]
                far = np.sqrt(np.maximum(norm**2 + top - 2 * product, 0))
                slack = 1e-6 * np.sqrt(norm**2 + top) + 1e-6 * high[None, :]
                gap = np.maximum(0, np.maximum(far - high[None, :], low[None, :] - far) - slack)
                bound = np.minimum(np.minimum((norm**2 + top - gap**2) / 2, product + norm * (high[None, :] + slack)), norm * longest[None, :])
                bound = bound + 1e-6 * np.abs(bound) + 1
                best = np.where(rows[None, :] > k, product, product - 4 * (np.abs(product).max(initial=0) + 1)).argmax(1)
                own = first[best] + batch.column(0).to_numpy() % blocks[best]
                if home:
                    at, block = np.arange(len(q)), own
                else:
                    at, ring = np.nonzero(bound >= batch.column(3).to_numpy()[:, None])
                    times = blocks[ring]
                    at = np.repeat(at, times)
                    block = np.repeat(first[ring], times) + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                    at, block = at[block != own[at]], block[block != own[at]]
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), *(batch.column(i).take(pa.array(at)) for i in range(3))], ["block", "query", "query_id", "q"])

        return queries.select("row", "vec_id", "v", "least").mapInArrow(run, "block bigint, query bigint, query_id bigint, q array<bigint>")

    def solved(self, routes: DataFrame, data: DataFrame) -> DataFrame:
        """query, query_id, vec_id, score: the k best of every block for the queries sent there."""
        width, k = self.width, self.k

        def solve(ask: pa.Table, have: pa.Table) -> pa.Table:
            found = [np.zeros((0, 4), np.int64)]
            ids = have["vec_id"].fill_null(_NONE).to_numpy()  # after all others
            by_id = np.lexsort((have["row"].to_numpy(), ids))
            ids, rows, x = ids[by_id], have["row"].to_numpy()[by_id], _matrix(have["v"], width)[by_id]
            by_row = np.argsort(rows)
            for s in range(0, ask.num_rows if have.num_rows else 0, 256):
                part = ask.slice(s, 256)
                asked, names = part["query"].to_numpy(), part["query_id"].to_numpy()
                score = _products(_matrix(part["q"], width), x)
                at = by_row[np.minimum(np.searchsorted(rows, asked, sorter=by_row), len(rows) - 1)]
                own = np.flatnonzero(rows[at] == asked)
                score[own, at[own]] = np.iinfo(np.int64).min  # lower than any product
                edge = np.partition(score, -k, 1)[:, -k] if score.shape[1] > k else score.min(1)
                q, c = np.nonzero((score >= edge[:, None]) & (score > np.iinfo(np.int64).min))
                order = np.lexsort((c, -score[q, c], q))
                q, c = q[order], c[order]
                first = np.searchsorted(q, q)
                best = np.arange(len(q)) - first < k
                q, c = q[best], c[best]
                found.append(np.stack([asked[q], names[q], ids[c], score[q, c]], 1))
            out = np.concatenate(found)
            return pa.table([pa.array(out[:, 0]), pa.array(out[:, 1]), pa.array(out[:, 2], mask=out[:, 2] == _NONE), pa.array(out[:, 3])], ["query", "query_id", "vec_id", "score"])

        return routes.groupBy("block").cogroup(data.groupBy("block")).applyInArrow(solve, _FOUND)

    def search(self, every: int) -> DataFrame:
        """query_id, rank, vec_id, score of the rows whose id is divisible by every."""
        data = self.data()
        queries = self.cells.where(F.col("vec_id") % every == 0).select("row", "vec_id", "v")
        first = written(self.solved(self.routes(queries.withColumn("least", F.lit(0.0)), True), data), "near")
        best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
        reached = first.groupBy("query").agg(F.count("*").alias("met"), F.min("score").cast("double").alias("score")).where(F.col("met") >= self.k)
        self.asked = queries.join(reached, F.col("row") == F.col("query"), "left").select("row", "vec_id", "v", F.coalesce("score", F.lit(-math.inf)).alias("least"))
        rest = self.solved(self.routes(self.asked, False), data)
        return first.unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= self.k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, every: int = 50, **settings) -> DataFrame:
    """query_id, rank, vec_id, score. Queries: rows whose id is divisible by every; candidates: all other rows."""
    join = VoronoiJoin(vectors, **settings)
    if not join.n:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    return join.search(every)


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row AS query, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.row <> c.row),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
