"""Post-averaging: integrated and binned profiles, means over time."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernelfield.operators.grid import AXES, Lattice


def area_factor(grid: Lattice, axis: str) -> float:
    """Product of spacing over extent along the other axes that are not collapsed."""
    if axis not in AXES:
        raise ValueError("the profile axis is x, y or z")
    return math.prod(1.0 / (n - 1) for a, n in zip(AXES, grid.counts, strict=True) if a != axis and n > 1)


def integrated(fields: DataFrame, grid: Lattice, names: list[str], axis: str = "y", mean: bool = False) -> DataFrame:
    """t, phase, coord and for each of names the sum over the nodes at that coordinate times the area factor (mean: their mean). Nulls do not count."""
    factor = F.lit(area_factor(grid, axis))
    k = AXES.index(axis)
    sums = [(F.avg(n) if mean else F.coalesce(F.sum(n), F.lit(0.0)) * factor).alias(n) for n in names]
    out = fields.groupBy("t", "phase", f"i{axis}").agg(*sums)
    return out.select("t", "phase", (F.lit(grid.origin[k]) + F.col(f"i{axis}") * F.lit(grid.spacing[k])).alias("coord"), *names)


def binned(fields: DataFrame, name: str, centre: float, tolerance: float, bins: int = 30, across: str = "x", along: str = "y") -> DataFrame:
    """bin (from 1), coord and value: means over equal bins of the nodes near centre. The largest coordinate is in no bin."""
    near = fields.where(F.abs(F.col(across) - F.lit(centre)) < F.lit(tolerance)).select(F.col(along).alias("a"), F.col(name).alias("v"))
    ends = near.agg(F.min("a").alias("low"), F.max("a").alias("high"))
    h = (F.col("high") - F.col("low")) / F.lit(float(bins))
    placed = near.join(F.broadcast(ends)).where("a < high").withColumn("bin", F.floor((F.col("a") - F.col("low")) / h).cast("int") + 1)  # one row
    return placed.groupBy("bin").agg(F.avg("a").alias("coord"), F.avg("v").alias("value"))


def time_mean(fields: DataFrame, names: list[str], first: int | None = None, last: int | None = None, log: bool = False) -> DataFrame:
    """node, phase and the mean of each of names over the steps from first to last; with log its decimal logarithm (null if not positive)."""
    rows = fields
    if first is not None:
        rows = rows.where(F.col("t") >= first)
    if last is not None:
        rows = rows.where(F.col("t") <= last)
    out = rows.groupBy("node", "phase").agg(*[F.avg(n).alias(n) for n in names])
    return out.withColumns({n: F.when(F.col(n) > 0, F.log10(F.col(n))) for n in names}) if log else out


def magnitude(x: str, y: str, z: str):
    return F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y) + F.col(z) * F.col(z))
