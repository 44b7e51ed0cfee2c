"""Smoothing kernels as column expressions.

A kernel is zero beyond its cutoff c. In table mode the weight is that of a lookup table with entries at s, 2s, ..., probed by
floor(r / s): the kernel at the right edge of r's bin, the last entry for all beyond. In exact mode it is the kernel at r.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cutoff as a multiple of the half width w.
CUTOFF_RATIO = {"Lucy": 2.0, "Gaussian": 3.0, "HeavySide": 1.0}


def half_width(diameter: float, multiple: float = 0.75) -> float:
    return multiple * diameter


def cutoff(w: float, kernel: str, ratio: float | None = None) -> float:
    if kernel not in CUTOFF_RATIO:
        raise ValueError(f"unknown kernel {kernel!r}: choose from {', '.join(CUTOFF_RATIO)}")
    return w * (CUTOFF_RATIO[kernel] if ratio is None else ratio)


def figure_position(x: float) -> float:
    """The power of ten of x's first significant figure; 0 for 0."""
    return 0.0 if x == 0 else 10.0 ** math.floor(math.log10(abs(x)))


@dataclass(frozen=True)
class Kernel:
    """name: Lucy, Gaussian or HeavySide; c: cutoff; mode: table or exact; sensitivity: table entries in the first figure of c."""

    name: str
    c: float
    mode: str = "table"
    sensitivity: int = 1000

    def __post_init__(self):
        if self.name not in CUTOFF_RATIO:
            raise ValueError(f"unknown kernel {self.name!r}: choose from {', '.join(CUTOFF_RATIO)}")
        if self.mode not in ("table", "exact"):
            raise ValueError("mode is 'table' or 'exact'")
        if not self.c > 0:
            raise ValueError("the cutoff is positive")

    @property
    def step(self) -> float:
        return figure_position(self.c) / self.sensitivity

    @property
    def entries(self) -> int:
        return len(np.arange(self.step, self.c + self.step, self.step))

    @property
    def norm(self) -> float:
        """The factor before the kernel's shape."""
        if self.name == "Lucy":
            return 105.0 / (16.0 * math.pi * self.c**3)
        if self.name == "HeavySide":
            return 1.0 / (4.0 / 3.0 * math.pi * self.c**3)
        w = self.c / 3.0
        whole = 2.0 * math.sqrt(2.0) * w**3 * math.pi**1.5 * math.erf(self.c * math.sqrt(2.0) / (2.0 * w))
        return 1.0 / (whole - 4.0 * self.c * w**2 * math.pi * math.exp(-(self.c**2) / (2.0 * w**2)))

    @cached_property
    def constants(self) -> dict[str, float]:
        """What the weight depends on besides the distance."""
        return {"c": self.c, "norm": self.norm, "step": self.step, "inverse": 1.0 / self.step, "last": float(self.entries - 1)}

    @property
    def literals(self) -> dict[str, Column]:
        return {k: F.lit(v) for k, v in self.constants.items()}

    def at(self, r: Column) -> Column:
        """The kernel at distance r."""
        return shape(self.name, r, self.literals)

    def weight(self, r: Column) -> Column:
        return weight(self.name, self.mode, r, self.literals)

    @cached_property
    def _table(self) -> np.ndarray:
        return self._shape((self.step + np.arange(self.entries) * self.step) / self.c)

    def _shape(self, u: np.ndarray) -> np.ndarray:
        """What _profile is for columns."""
        if self.name == "Lucy":
            return np.where(u > 1.0, 0.0, self.norm * (1.0 + u * u * (u * (8.0 - 3.0 * u) - 6.0)))
        if self.name == "HeavySide":
            return np.where(u < 1.0, self.norm, 0.0)
        return np.where(u > 1.0, 0.0, self.norm * np.exp(-4.5 * u * u))

    @property
    def beyond(self) -> float:
        """The table's last entry."""
        return float(self._table[-1])

    def of(self, r: np.ndarray) -> np.ndarray:
        """The weight at distances in an array, which is used up; what is no number counts as 0, as roots of rounded zeros do."""
        if self.mode == "exact":
            return self._shape(np.nan_to_num(r, copy=False) / self.c)
        r *= self.constants["inverse"]
        return self._table.take(r.astype(np.intp), mode="clip")


def _profile(name: str, u: Column, norm: Column) -> Column:
    """A kernel at u cutoffs from its centre."""
    if name == "Lucy":
        return F.when(u > 1.0, F.lit(0.0)).otherwise(norm * (F.lit(1.0) + u * u * (u * (F.lit(8.0) - F.lit(3.0) * u) - F.lit(6.0))))
    if name == "HeavySide":
        return F.when(u < 1.0, norm).otherwise(F.lit(0.0))
    return F.when(u > 1.0, F.lit(0.0)).otherwise(norm * F.exp(F.lit(-4.5) * u * u))


def _probed(mode: str, r: Column, k: dict[str, Column]) -> Column:
    """The distance at which the kernel is taken."""
    return r if mode == "exact" else k["step"] + F.least(F.floor(r * k["inverse"]).cast("double"), k["last"]) * k["step"]


def shape(name: str, r: Column, k: dict[str, Column]) -> Column:
    """A kernel at distance r, its constants as columns."""
    return _profile(name, r / k["c"], k["norm"])


def weight(name: str, mode: str, r: Column, k: dict[str, Column]) -> Column:
    return shape(name, _probed(mode, r, k), k)


def with_weights(rows: DataFrame, name: str, mode: str, k: dict[str, Column], distances: dict[str, Column]) -> DataFrame:
    """rows with the weight at each distance. Distances in cutoffs are columns of their own, so that nothing is evaluated twice."""
    rows = rows.withColumns({f"__r_{n}": r for n, r in distances.items()})
    rows = rows.withColumns({f"__u_{n}": _probed(mode, F.col(f"__r_{n}"), k) / k["c"] for n in distances})
    return rows.withColumns({n: _profile(name, F.col(f"__u_{n}"), k["norm"]) for n in distances}).drop(*[f"__{x}_{n}" for n in distances for x in "ru"])


def line_nodes(n: int = 10) -> list[float]:
    """n equal steps from 0 to 1."""
    return [float(x) for x in np.linspace(0.0, 1.0, n)]


def trapezoid(values: list[Column], low: float = 0.0, high: float = 1.0) -> Column:
    ds = (high - low) / (len(values) - 1)
    total = (values[0] + values[-1]) * F.lit(0.5)
    for v in values[1:-1]:
        total = total + v
    return total * F.lit(ds)


def with_line_weight(rows: DataFrame, name: str, mode: str, k: dict[str, Column], r: tuple[Column, Column, Column], branch: tuple[Column, Column, Column], out: str, n: int = 10) -> DataFrame:
    """rows with the integral of the kernel along r + s * branch, s from 0 to 1."""
    distances = {}
    for i, s in enumerate(line_nodes(n)):
        d = [a + F.lit(s) * b for a, b in zip(r, branch, strict=True)]
        distances[f"__w{i}"] = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    weighted = with_weights(rows, name, mode, k, distances)
    return weighted.withColumn(out, trapezoid([F.col(c) for c in distances])).drop(*distances)
