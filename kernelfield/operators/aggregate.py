"""Weighted sums by node, for the bulk (phase 0) and, if wanted, for each phase (from 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernelfield.functions.tensors import AXES, PAIRS
from kernelfield.operators.grid import Lattice


def grouped(pairs: DataFrame, sums: dict[str, Column], phased: bool) -> DataFrame:
    """t, node, phase, n_pairs and the sums. Phase and bulk come from one pass by grouping sets."""
    aggs = [F.count("*").alias("n_pairs"), *[F.sum(v).alias(k) for k, v in sums.items()]]
    if not phased:
        return pairs.groupBy("t", "node").agg(*aggs).withColumn("phase", F.lit(0))
    sets = pairs.groupingSets([["t", "node", "phase"], ["t", "node"]], "t", "node", "phase").agg(F.grouping("phase").alias("__bulk"), *aggs)
    return sets.withColumn("phase", F.when(F.col("__bulk") == 1, 0).otherwise(F.col("phase")).cast("int")).drop("__bulk")


def scalar_sums(weight: Column, values: dict[str, Column], scale: Column | None = None) -> dict[str, Column]:
    """Sum of w * value [* scale] for each name."""
    return {k: weight * v if scale is None else weight * v * scale for k, v in values.items()}


def vector_sums(name: str, weight: Column, vector: tuple[Column, Column, Column], scale: Column | None = None) -> dict[str, Column]:
    return scalar_sums(weight, {f"{name}_{a}": v for a, v in zip(AXES, vector, strict=True)}, scale)


def tensor_sums(name: str, weight: Column, a: tuple[Column, Column, Column], b: tuple[Column, Column, Column], scale: Column | None = None) -> dict[str, Column]:
    """Sums of w [* scale] * a (x) b."""
    at = dict(zip(AXES, a, strict=True)), dict(zip(AXES, b, strict=True))
    w = weight if scale is None else weight * scale
    return {f"{name}_{p}": w * at[0][p[0]] * at[1][p[1]] for p in PAIRS}


def completed(sums: DataFrame, grid: Lattice, keys: DataFrame) -> DataFrame:
    """keys (t, phase) with every node; a node that no point reaches has sums of 0, one whose sums are null keeps them."""
    names = [c for c in sums.columns if c not in ("t", "node", "phase", "n_pairs", "largest")]
    whole = grid.over(keys).join(sums, ["t", "node", "phase"], "left")
    filled = [F.when(F.col("n_pairs").isNull(), F.lit(0.0)).otherwise(F.col(c)).alias(c) for c in names]
    return whole.select("t", "node", "phase", "ix", "iy", "iz", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), *filled)


def steps(particles: DataFrame, phases: int = 0) -> DataFrame:
    """The keys of a result: each t with phase 0, and with phases 1..phases."""
    return particles.select("t").distinct().withColumn("phase", F.explode(F.sequence(F.lit(0), F.lit(phases))))


def guarded(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a, b))
