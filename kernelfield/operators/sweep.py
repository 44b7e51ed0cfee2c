"""Fields at the nodes of a small lattice for many cutoffs in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernelfield.functions import tensors as T
from kernelfield.functions.kernels import CUTOFF_RATIO, Kernel, with_line_weight, with_weights
from kernelfield.operators.grid import AXES, Lattice
from kernelfield.operators.neighbours import match


def centred_lattice(centre: tuple[float, float, float], spacing: float) -> Lattice:
    """3 x 3 x 3 nodes; node 13 is the centre."""
    return Lattice(tuple(x - spacing for x in centre), (spacing,) * 3, (3, 3, 3))


def _weights(pairs: DataFrame, kernels: list[Kernel], mode: str, line: bool) -> DataFrame:
    """pairs for each cutoff that reaches them: c and wt. The constants of a kernel come as columns, so one expression serves all."""
    names = list(kernels[0].constants)
    many = pairs.withColumn("__k", F.explode(F.array(*[F.struct(*[F.lit(k.constants[n]).alias(n) for n in names]) for k in kernels])))
    many = many.select(*pairs.columns, *[F.col(f"__k.{n}").alias(n if n == "c" else f"__{n}") for n in names]).where(F.col("dist") <= F.col("c"))
    k = {n: F.col(n if n == "c" else f"__{n}") for n in names}
    if line:
        r, b = (tuple(F.col(f"{x}{a}") for a in AXES) for x in ("r", "b"))
        many = with_line_weight(many, kernels[0].name, mode, k, r, b, "wt")
    else:
        many = with_weights(many, kernels[0].name, mode, k, {"wt": F.col("dist")})
    return many.drop(*[f"__{n}" for n in names])


def sweep(particles: DataFrame, centre: tuple[float, float, float], diameter: float, multiples: list[float], kernel: str = "Lucy", directed: DataFrame | None = None, sensitivity: int = 1000, mode: str = "table", base: float | None = None) -> DataFrame:
    """t, w, c, node, rho, phi, p_x..z and, with contacts, c_ab. The nodes stay at the spacing of the base cutoff."""
    kernels = [Kernel(kernel, CUTOFF_RATIO[kernel] * m * diameter, mode, sensitivity) for m in multiples]
    grid = centred_lattice(centre, CUTOFF_RATIO[kernel] * 0.75 * diameter if base is None else base)
    widest = max(k.c for k in kernels)
    near = _weights(match(particles, grid, widest), kernels, mode, False)
    w, m = F.col("wt"), F.col("mass")
    sums = near.groupBy("t", "c", "node").agg(F.sum(w * m).alias("rho"), F.sum(w * F.col("volume")).alias("phi"), *[F.sum(w * F.col(f"v{a}") * m).alias(f"p_{a}") for a in AXES])
    names = ["rho", "phi", *[f"p_{a}" for a in AXES]]
    rows = grid.over(particles.select("t").distinct().withColumn("c", F.explode(F.array(*[F.lit(k.c) for k in kernels])))).join(sums, ["t", "c", "node"], "left")
    if directed is not None:
        touched = _weights(match(directed, grid, widest), kernels, mode, True)
        stress = touched.groupBy("t", "c", "node").agg(*[F.sum(F.col("wt") * F.col(f"f{p[0]}") * F.col(f"b{p[1]}")).alias(f"c_{p}") for p in T.PAIRS])
        rows, names = rows.join(stress, ["t", "c", "node"], "left"), [*names, *[f"c_{p}" for p in T.PAIRS]]
    return rows.select("t", (F.col("c") / F.lit(CUTOFF_RATIO[kernel])).alias("w"), "c", "node", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])
