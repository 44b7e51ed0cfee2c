"""Velocity gradients: finite differences on the lattice, and least squares on the particles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kernelfield.functions import tensors as T
from kernelfield.operators.aggregate import grouped
from kernelfield.operators.grid import AXES, Lattice


def finite_differences(fields: DataFrame, grid: Lattice, vector: str = "v", name: str = "g") -> DataFrame:
    """fields with <name>_ab, the derivative of component a along b: central inside, one-sided at the ends, chosen by index.

    fields must hold every node. Collapsed axes have derivative 0; a null neighbour gives null.
    """
    out = fields
    for k, b in enumerate(AXES):
        n, h = grid.counts[k], grid.spacing[k]
        if n == 1:
            out = out.withColumns({f"{name}_{a}{b}": F.lit(0.0) for a in AXES})
            continue
        line = Window.partitionBy("t", "phase", *[f"i{x}" for x in AXES if x != b]).orderBy(f"i{b}")
        added = {}
        for a in AXES:
            v = F.col(f"{vector}_{a}")
            before, after = F.lag(v).over(line), F.lead(v).over(line)
            i = F.col(f"i{b}")
            added[f"{name}_{a}{b}"] = F.when(i == 0, (after - v) / F.lit(h)).when(i == n - 1, (v - before) / F.lit(h)).otherwise((after - before) / F.lit(2 * h))
        out = out.withColumns(added)
    return out


def least_squares(pairs: DataFrame, nodes: DataFrame, mode: str = "corrected") -> DataFrame:
    """t, node, g_ab from A = sum m w r (x) r and B = sum m w (V - v) (x) r, with nodes (t, node, v_x, v_y, v_z).

    corrected: G = B A^-1, 0 if A is singular relative to its size. reference: A^-1 B, 0 if |det A| <= 1e-8.
    """
    if mode not in ("corrected", "reference"):
        raise ValueError("mode is 'corrected' or 'reference'")
    near = pairs.join(nodes.select("t", "node", *[F.col(f"v_{a}").alias(f"n_{a}") for a in AXES]), ["t", "node"])
    mw = F.col("mass") * F.col("w")
    sums = {f"a_{a}{b}": mw * F.col(f"r{a}") * F.col(f"r{b}") for i, a in enumerate(AXES) for b in AXES[i:]}
    sums |= {f"b_{a}{b}": mw * (F.col(f"n_{a}") - F.col(f"v{a}")) * F.col(f"r{b}") for a in AXES for b in AXES}
    found = grouped(near, sums, False)
    full = {a + b: F.col(f"a_{min(a, b)}{max(a, b)}") for a in AXES for b in AXES}
    det = T.determinant(full)
    size = T.trace(full) / F.lit(3.0)
    singular = F.abs(det) <= (F.lit(1e-8) if mode == "reference" else F.lit(1e-12) * size * size * size)
    inverse = {k: F.try_divide(v, F.col("det")) for k, v in T.adjugate(full).items()}
    b = T.columns("b")
    solved = T.product(b, inverse) if mode == "corrected" else T.product(inverse, b)
    valid = F.col("b_xx").isNotNull()
    out = found.withColumn("det", det).withColumn("singular", singular)
    return out.select("t", "node", *[F.when(valid & F.col("singular"), F.lit(0.0)).otherwise(v).alias(f"g_{k}") for k, v in solved.items()])
