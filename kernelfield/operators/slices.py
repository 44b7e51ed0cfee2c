"""Granular temperature in horizontal bands: two weightings over sub-planes of each band."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernelfield.operators.aggregate import guarded
from kernelfield.operators.grid import AXES


@dataclass(frozen=True)
class Bands:
    """Bands of height dy, the first centred at low, up to the one that reaches beyond high. Each has 2n + 1 evenly spaced sub-planes from its lower to its upper edge.

    So all sub-planes are at multiples of dy / 2n above the lowest edge, and a height finds its own by division; the last of a band
    and the first of the next are at one height.
    """

    low: float
    high: float
    dy: float
    n: int = 5

    @property
    def count(self) -> int:
        return max(0, math.ceil((self.high - self.low) / self.dy + 1.5) - 1)

    @property
    def planes(self) -> int:
        """In a band."""
        return 2 * self.n + 1

    def centre(self, k):
        """Height of band k, from 0; of numbers or columns."""
        return self.low + k * self.dy

    def plane(self, k, m):
        """Height of sub-plane m, from 1, of band k."""
        return self.centre(k) - self.dy / 2 + (m - 1) * self.dy / (2 * self.n)

    def nearest(self, y: Column) -> Column:
        """k * planes + m - 1 of the sub-plane nearest to y, the first of equally near ones."""
        per, last = 2 * self.n, 2 * self.n * self.count
        step = F.least(F.lit(last), F.greatest(F.lit(0), F.ceil(((y - F.lit(self.low)) / F.lit(self.dy) + F.lit(0.5)) * F.lit(float(per)) - F.lit(0.5)).cast("int")))
        band = F.greatest(F.ceil(step / F.lit(float(per))).cast("int") - 1, F.lit(0))
        return step + band


def window_weight(m: int, n: int) -> float:
    """Cosine window over sub-planes m = 1 .. 2n + 1."""
    return 0.5 * (1.0 + math.cos(math.pi * (m - (n + 1)) / n))


def band_temperature(particles: DataFrame, low: float, high: float, dy: float, n: int = 5) -> DataFrame:
    """t, k, z, t_kamrin_a, t_lammps_a.

    A particle belongs to the sub-planes whose half-step neighbourhood its extent meets, found as an index interval of bands; its
    fluctuation is against the mean velocity of the sub-plane nearest to its centre, the first of equally near ones. Sub-planes without
    particles count as 0 in a band's means.
    """
    bands_ = Bands(low, high, dy, n)
    count = bands_.planes
    half = dy / (2 * n) / 2
    y, r = F.col("y"), F.col("diameter") / F.lit(2.0)
    first = F.greatest(F.lit(0), F.floor((y - r - F.lit(half + low + dy / 2)) / F.lit(dy)).cast("int") - 1)
    last = F.least(F.lit(bands_.count - 1), F.ceil((y + r + F.lit(half - low + dy / 2)) / F.lit(dy)).cast("int") + 1)
    base = particles.select("t", "id", "y", "vx", "vy", "vz", "density", "mass", r.alias("r"), first.alias("k0"), last.alias("k1"), bands_.nearest(y).alias("near"))
    spread = base.where("k0 <= k1").withColumn("k", F.explode(F.sequence("k0", "k1"))).withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(count))))
    at = spread.withColumn("plane", F.col("k") * count + F.col("m") - 1).withColumn("zp", bands_.plane(F.col("k"), F.col("m")))
    met = at.where((F.col("y") + F.col("r") >= F.col("zp") - F.lit(half)) & (F.col("y") - F.col("r") <= F.col("zp") + F.lit(half)))
    dist = F.abs(F.col("zp") - F.col("y"))
    met = met.withColumn("ar", F.lit(math.pi) * F.greatest(F.col("r") * F.col("r") - dist * dist, F.lit(0.0)) * F.col("density"))
    velocity = met.groupBy("t", "plane").agg(F.sum("ar").alias("a"), *[F.sum(F.col("ar") * F.col(f"v{x}")).alias(f"s{x}") for x in AXES])
    velocity = velocity.select("t", F.col("plane").alias("near"), *[guarded(F.col(f"s{x}"), F.col("a")).alias(f"u{x}") for x in AXES])
    off = met.join(velocity, ["t", "near"], "left").withColumns({f"o{x}": F.col(f"v{x}") - F.coalesce(F.col(f"u{x}"), F.lit(0.0)) for x in AXES})
    per_plane = off.groupBy("t", "k", "m").agg(
        F.sum("ar").alias("a"),
        *[F.sum(F.col("ar") * F.col(f"o{x}") * F.col(f"o{x}")).alias(f"s{x}") for x in AXES],
        F.sum(F.col("mass") * (F.col("ox") * F.col("ox") + F.col("oy") * F.col("oy") + F.col("oz") * F.col("oz"))).alias("energy"),
        F.count("*").alias("n"),
        F.avg("mass").alias("mean_mass"),
    )
    weights = [window_weight(m, n) for m in range(1, count + 1)]
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), F.col("m"))
    lammps = (F.sum(F.col("energy") / (F.lit(3.0) * F.col("n") * F.col("mean_mass"))) / F.lit(float(count))).alias("lammps")
    bands = per_plane.groupBy("t", "k").agg(*[(F.sum(w * guarded(F.col(f"s{x}"), F.col("a"))) / F.lit(sum(weights))).alias(f"kamrin_{x}") for x in AXES], lammps)
    every = particles.select("t").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(bands_.count - 1))))
    z = bands_.centre(F.col("k"))
    out = every.join(bands, ["t", "k"], "left")
    return out.select("t", "k", z.alias("z"), *[F.coalesce(f"kamrin_{x}", F.lit(0.0)).alias(f"t_kamrin_{x}") for x in AXES], *[F.coalesce("lammps", F.lit(0.0)).alias(f"t_lammps_{x}") for x in AXES])
