"""Algebra of 3x3 tensors held in columns <name>_xx ... <name>_zz."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = "xyz"
PAIRS = [a + b for a in AXES for b in AXES]

Tensor = dict[str, Column]


def columns(name: str, axes: str = AXES) -> Tensor:
    return {a + b: F.col(f"{name}_{a}{b}") for a in axes for b in axes}


def named(tensor: Tensor, name: str) -> list[Column]:
    return [v.alias(f"{name}_{k}") for k, v in tensor.items()]


def block(tensor: Tensor, axes: str) -> Tensor:
    return {k: v for k, v in tensor.items() if k[0] in axes and k[1] in axes}


def axes_of(tensor: Tensor) -> str:
    return "".join(dict.fromkeys(k[0] for k in tensor))


def trace(tensor: Tensor) -> Column:
    first, *rest = [tensor[a + a] for a in axes_of(tensor)]
    for x in rest:
        first = first + x
    return first


def symmetric(tensor: Tensor) -> Tensor:
    return {k: F.lit(0.5) * (v + tensor[k[1] + k[0]]) for k, v in tensor.items()}


def deviator(tensor: Tensor) -> Tensor:
    mean = trace(tensor) / F.lit(float(len(axes_of(tensor))))
    return {k: v - mean if k[0] == k[1] else v for k, v in tensor.items()}


def magnitude(tensor: Tensor, factor: float) -> Column:
    """sqrt(factor * (squares of the diagonal + 2 * squares above it))."""
    axes = axes_of(tensor)
    diagonal = sum((tensor[a + a] * tensor[a + a] for a in axes[1:]), tensor[axes[0] * 2] * tensor[axes[0] * 2])
    above = sum((tensor[a + b] * tensor[a + b] for i, a in enumerate(axes) for b in axes[i + 1 :]), F.lit(0.0))
    return F.sqrt(F.lit(factor) * (diagonal + F.lit(2.0) * above))


def pressure(tensor: Tensor) -> Column:
    return trace(tensor) / F.lit(float(len(axes_of(tensor))))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def determinant(t: Tensor) -> Column:
    return (
        t["xx"] * (t["yy"] * t["zz"] - t["yz"] * t["zy"])
        - t["xy"] * (t["yx"] * t["zz"] - t["yz"] * t["zx"])
        + t["xz"] * (t["yx"] * t["zy"] - t["yy"] * t["zx"])
    )


def adjugate(t: Tensor) -> Tensor:
    out = {}
    for i, a in enumerate(AXES):
        for j, b in enumerate(AXES):
            r = [x for k, x in enumerate(AXES) if k != j]
            c = [x for k, x in enumerate(AXES) if k != i]
            minor = t[r[0] + c[0]] * t[r[1] + c[1]] - t[r[0] + c[1]] * t[r[1] + c[0]]
            out[a + b] = minor if (i + j) % 2 == 0 else -minor
    return out


def product(s: Tensor, t: Tensor) -> Tensor:
    return {a + b: s[a + "x"] * t["x" + b] + s[a + "y"] * t["y" + b] + s[a + "z"] * t["z" + b] for a in AXES for b in AXES}
