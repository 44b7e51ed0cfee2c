"""Sums over contacts of the kernel along their branches, by node.

A contact meets some thirty nodes and takes ten samples of the kernel for each, so pairs are never rows: each worker takes contacts in
blocks, finds the nodes near them, and adds up by node. Only the sums of a worker leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernelfield.functions.kernels import Kernel
from kernelfield.operators.grid import AXES, Lattice

#: Contacts of a block and candidates of a run; bytes of sums of one step and phase up to which they are kept between runs, and of all that are kept.
ROWS, CELLS, ONE, KEPT = 4096, 1 << 16, 1 << 25, 1 << 26
_NO_PHASE = -(2**31)


def _intervals(points: np.ndarray, grid: Lattice, c: float) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the nodes that may be within c along each axis; what rounding could lose is far below a millionth of the spacing."""
    first, last = np.zeros(points.shape, np.int64), np.zeros(points.shape, np.int64)
    points = np.nan_to_num(points)
    for k, (o, h, n) in enumerate(zip(grid.origin, grid.spacing, grid.counts, strict=True)):
        if n > 1:
            first[:, k] = np.clip(np.ceil((points[:, k] - c - o) / h - 1e-6), 0, n)
            last[:, k] = np.clip(np.floor((points[:, k] + c - o) / h + 1e-6), -1, n - 1)
    return first, last


def near(points: np.ndarray, branch: np.ndarray, grid: Lattice, c: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of a point and a node within c, in runs: row of the point, node, squared length of r (node minus point) and r * branch; by the same arithmetic as neighbours.match."""
    first, last = _intervals(points, grid, c)
    whole = np.isfinite(points).all(1) & (first <= last).all(1)
    width = np.where(whole, (last - first).max(1) + 1, 0)
    # a run has points with equally wide intervals, and no more than CELLS candidates
    for widest in np.flatnonzero(np.bincount(width, minlength=1)).tolist():
        if widest == 0:
            continue
        rows = np.flatnonzero(width == widest)
        nx, ny, nz = (min(widest, m) for m in grid.counts)
        step = max(1, CELLS // (nx * ny * nz))
        for at in range(0, len(rows), step):
            row = rows[at : at + step]
            n, some = len(row), first[row]
            index = [some[:, k, None] + np.arange(m) for k, m in enumerate((nx, ny, nz))]
            r = [(grid.origin[k] + index[k] * grid.spacing[k]) - points[row, k, None] for k in range(3)]
            for k in range(3):
                r[k][index[k] > last[row, k, None]] = np.inf
            flat = lambda x, y, z, n=n: ((x[:, :, None] + y[:, None, :]).reshape(n, -1, 1) + z[:, None, :]).ravel()
            square = flat(*(x * x for x in r))
            met = square <= c * c * (1 + 1e-9)
            inside = np.flatnonzero(met)
            square = square[inside]
            product = flat(*(np.where(np.isinf(x), 0.0, x) * branch[row, k, None] for k, x in enumerate(r)))[inside]
            _, my, mz = grid.counts
            owner = np.repeat(np.arange(n), np.count_nonzero(met.reshape(n, -1), 1))
            place = inside - owner * (nx * ny * nz)
            offset = flat(*(np.arange(m)[None] * by for m, by in ((nx, my * mz), (ny, mz), (nz, 1))), 1)
            node = ((some[:, 0] * my + some[:, 1]) * mz + some[:, 2])[owner] + offset[place]
            if len(square) and np.sqrt(square.max()) > c:
                exact = np.sqrt(square) <= c
                owner, node, square, product = owner[exact], node[exact], square[exact], product[exact]
            yield row[owner], node, square, product


def along(kernel: Kernel, square: np.ndarray, product: np.ndarray, length: np.ndarray, n: int = 10) -> np.ndarray:
    """For each pair the integral of the kernel along r + s * branch, s from 0 to 1, by the trapezoid rule. length: squared.

    |r + s b|^2 is a parabola in s: its values at equal steps come by adding differences, and those by adding the second difference.
    """
    total = 0.5 * kernel.of(np.sqrt(square))
    h = 1.0 / (n - 1)
    bend = length * (2.0 * h * h)
    rise, d, root = product * (2.0 * h), square.copy(), np.empty(len(square))
    rise += 0.5 * bend
    with np.errstate(invalid="ignore"):  # what rounding makes less than 0 is at 0
        for i in range(1, n):
            d += rise
            rise += bend
            w = kernel.of(np.sqrt(d, out=root))
            if i == n - 1:
                w *= 0.5
            total += w
    total *= h
    return total


class _Sums:
    """Sums by step, phase and node, of width values of a pair."""

    def __init__(self, size: int, width: int):
        self.size, self.width, self.kept = size, width, size * (width + 3) * 8 <= ONE
        self.clear()

    def clear(self) -> None:
        self.slots: dict[int, int] = {}
        self.sums = (np.zeros(0, np.int64), np.full(0, -np.inf), np.zeros((0, self.width)), np.zeros((0, self.width), bool))

    def add(self, group: np.ndarray, row: np.ndarray, node: np.ndarray, wint: np.ndarray, counted: np.ndarray, values: list[np.ndarray], valid: list) -> None:
        """group: of each contact its step and phase as one number."""
        found, own = np.unique(group, return_inverse=True)
        slots = np.array([self.slots.setdefault(g, len(self.slots)) for g in found.tolist()], np.int64)
        key = node if len(self.slots) == 1 else slots[own][row] * self.size + node
        n = len(self.slots) * self.size
        if self.kept:
            new = n - len(self.sums[0])
            self.sums = tuple(np.concatenate((x, np.full((new, *x.shape[1:]), empty, x.dtype))) for x, empty in zip(self.sums, (0, -np.inf, 0, False), strict=True)) if new else self.sums
        place, at = (slice(None), key) if self.kept and n <= 8 * len(key) else np.unique(key, return_inverse=True)
        n = n if isinstance(place, slice) else len(place)
        count, most = np.bincount(at, minlength=n), np.full(n, -np.inf)
        where = slice(None) if counted.all() else counted[row]
        np.maximum.at(most, at[where], wint[where])
        sums, some = np.zeros((n, self.width)), np.zeros((n, self.width), bool)
        for k, (v, ok) in enumerate(zip(values, valid, strict=True)):
            sums[:, k] = np.bincount(at, wint * v[row], n)
            some[:, k] = count > 0 if ok is None else np.bincount(at, ok[row], n) > 0
        if self.kept:
            self.sums[0][place] += count
            self.sums[1][place] = np.maximum(self.sums[1][place], most)
            self.sums[2][place] += sums
            self.sums[3][place] |= some
        else:
            self.places, self.sums = place, (count, most, sums, some)

    def full(self) -> bool:
        return not self.kept or len(self.sums[0]) * (self.width + 3) * 8 > KEPT

    def rows(self) -> Iterator[pa.RecordBatch]:
        """What is kept, and then nothing is."""
        count, most, sums, some = self.sums
        hit = np.flatnonzero(count)
        place = hit if self.kept else self.places[hit] if len(hit) else hit
        step, phase = np.divmod(np.array(list(self.slots), np.int64)[place // self.size], 1 << 32)
        phase += _NO_PHASE
        columns = [pa.array(step.astype(np.int32)), pa.array(place % self.size), pa.array(phase.astype(np.int32), mask=phase == _NO_PHASE), pa.array(count[hit].astype(np.int64)), pa.array(most[hit], mask=np.isneginf(most[hit]))]
        columns += [pa.array(np.ascontiguousarray(sums[hit, k]), mask=~some[hit, k]) for k in range(self.width)]
        self.clear()
        yield pa.RecordBatch.from_arrays(columns, ["t", "node", "phase", "n_pairs", "largest", *[f"s{k}" for k in range(self.width)]])


def _block(sums: _Sums, block: pa.RecordBatch, grid: Lattice, kernel: Kernel) -> Iterator[pa.RecordBatch]:
    column = lambda i: block.column(i).to_numpy(zero_copy_only=False)
    group = column(0).astype(np.int64) * (1 << 32) + (column(1).astype(np.int64) - _NO_PHASE)
    points, branch = (np.stack([column(i) for i in at], 1).astype(float) for at in (range(3, 6), range(6, 9)))
    values = [block.column(i) for i in range(9, 9 + sums.width)]
    valid = [None if v.null_count == 0 else v.is_valid().to_numpy(zero_copy_only=False).astype(float) for v in values]
    values = [v.fill_null(0.0).to_numpy(zero_copy_only=False) for v in values]
    length, whole = (branch * branch).sum(1), column(2)
    known = whole & np.isfinite(length)
    for row, node, square, product in near(points, branch, grid, kernel.c):
        if len(row):
            wint = along(kernel, square, product, length[row])
            if kernel.mode == "table" and not known.all():
                wint[~known[row]] = kernel.beyond
            sums.add(group, row, node, wint, whole | (kernel.mode == "table"), values, valid)
            if sums.full():
                yield from sums.rows()


def line_sums(directed: DataFrame, grid: Lattice, kernel: Kernel, values: dict[str, Column], phased: bool) -> DataFrame:
    """t, node, phase, n_pairs, largest (weight) and, for each value, the sum over pairs of line weight * value; phases as in aggregate.grouped. A sum without any value that is not null is null.

    A branch with a null has no weight in exact mode; in table mode it has the last entry, as least() passes over nulls.
    """
    names, places, branch = list(values), list(AXES), [f"b{a}" for a in AXES]
    whole = F.col("bx").isNotNull() & F.col("by").isNotNull() & F.col("bz").isNotNull()
    known = whole if kernel.mode == "exact" else F.lit(True)
    phase = F.coalesce(F.col("phase").cast("int"), F.lit(_NO_PHASE)) if phased else F.lit(0)
    rows = directed.where(F.col("t").isNotNull()).select(
        F.col("t").cast("int").alias("t"), phase.alias("phase"), whole.alias("whole"), *[F.col(a).cast("double").alias(a) for a in places], *[F.coalesce(F.col(b).cast("double"), F.lit(0.0)).alias(b) for b in branch], *[F.when(known, v.cast("double")).alias(f"s{i}") for i, v in enumerate(values.values())]
    )
    width = len(names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(grid.size, width)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                yield from _block(sums, batch.slice(at, ROWS), grid, kernel)
        yield from sums.rows()

    parts = rows.mapInArrow(add, ", ".join(["t int, node bigint, phase int, n_pairs bigint, largest double", *[f"s{k} double" for k in range(width)]]))
    aggs = [F.sum("n_pairs").alias("n_pairs"), F.max("largest").alias("largest"), *[F.sum(f"s{k}").alias(name) for k, name in enumerate(names)]]
    if not phased:
        return parts.groupBy("t", "node").agg(*aggs).withColumn("phase", F.lit(0))
    sets = parts.groupingSets([["t", "node", "phase"], ["t", "node"]], "t", "node", "phase").agg(F.grouping("phase").alias("__bulk"), *aggs)
    return sets.withColumn("phase", F.when(F.col("__bulk") == 1, 0).otherwise(F.col("phase")).cast("int")).drop("__bulk")
