"""Regular lattices of one to three axes."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = "xyz"
VALID = {1: ("x", "y", "z"), 2: ("xy", "xz", "yz"), 3: ("xyz",)}


@dataclass(frozen=True)
class Lattice:
    """Nodes origin + i * spacing; a collapsed axis has one node. node = (ix * ny + iy) * nz + iz."""

    origin: tuple[float, float, float]
    spacing: tuple[float, float, float]
    counts: tuple[int, int, int]

    @property
    def size(self) -> int:
        return self.counts[0] * self.counts[1] * self.counts[2]

    @property
    def axes(self) -> str:
        return "".join(a for a, n in zip(AXES, self.counts, strict=True) if n > 1)

    def _columns(self):
        node, (_, ny, nz) = F.col("node"), self.counts
        index = {"ix": F.floor(node / F.lit(ny * nz)), "iy": F.floor(node / F.lit(nz)) % F.lit(ny), "iz": node % F.lit(nz)}
        places = {a: F.lit(o) + F.col(f"i{a}") * F.lit(h) for a, o, h in zip(AXES, self.origin, self.spacing, strict=True)}
        return {k: v.cast("int") for k, v in index.items()}, places

    def frame(self, spark: SparkSession) -> DataFrame:
        """node, ix, iy, iz, x, y, z."""
        index, places = self._columns()
        return spark.range(self.size).withColumnRenamed("id", "node").withColumns(index).withColumns(places)

    def over(self, keys: DataFrame) -> DataFrame:
        """The rows of keys, each with all nodes. Nodes are a distributed range; keys are a row for each step and phase, and so broadcast."""
        index, _ = self._columns()
        nodes = keys.sparkSession.range(self.size).withColumnRenamed("id", "node").withColumns(index)
        return nodes.crossJoin(F.broadcast(keys))

    def point(self, axis: str, i: int) -> float:
        k = AXES.index(axis)
        return self.origin[k] + i * self.spacing[k]


def automatic_range(bounds, c: float, largest: float) -> list[tuple[float, float]]:
    """The bounds of the particles shrunk by 2.5 c and half the largest diameter."""
    delta = 2.5 * c + 0.5 * largest
    return [(low + delta, high - delta) for low, high in bounds]


def lattice(axes: str, ranges: dict[str, tuple[float, float]], c: float, transects: dict[str, float] | None = None, scaling: float = 2.0) -> Lattice:
    """A lattice of ceil(scaling * extent / c) + 1 nodes along each of axes; the other axes are collapsed at their transects."""
    if axes not in VALID.get(len(axes), ()):
        raise ValueError(f"axes must be one of {', '.join(x for v in VALID.values() for x in v)}")
    if not c > 0:
        raise ValueError("c must be positive")
    origin, spacing, counts = [], [], []
    for a in AXES:
        if a in axes:
            low, high = ranges.get(a) or (None, None)
            if low is None or high is None:
                raise ValueError(f"axis {a}: a range is needed")
            if high < low:
                raise ValueError(f"axis {a}: the range ends before it starts")
            n = math.ceil(scaling * (high - low) / c) + 1
            if n <= 1:
                raise ValueError(f"axis {a}: the range holds one node only")
            origin.append(float(low))
            spacing.append((high - low) / (n - 1))
            counts.append(n)
        else:
            if (transects or {}).get(a) is None:
                raise ValueError(f"axis {a}: a transect is needed")
            origin.append(float(transects[a]))
            spacing.append(0.0)
            counts.append(1)
    return Lattice(tuple(origin), tuple(spacing), tuple(counts))


def generate(bounds, c: float, largest: float, axes: str = "xyz", automatic: bool = True, custom: dict | None = None, transects: dict | None = None) -> Lattice:
    """A lattice over the shrunk bounds of the particles, with transects at mid-range, or over custom ranges."""
    if largest <= 0:
        raise ValueError("the largest diameter must be positive")
    if len(bounds) != 3 or any(high < low for low, high in bounds):
        raise ValueError("bounds are three pairs (low, high)")
    if automatic:
        shrunk = dict(zip(AXES, automatic_range(bounds, c, largest), strict=True))
        return lattice(axes, {a: shrunk[a] for a in axes}, c, {a: low + 0.5 * (high - low) for a, (low, high) in shrunk.items() if a not in axes})
    return lattice(axes, custom or {}, c, transects)
