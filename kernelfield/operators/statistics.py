"""Particle sizes: moments, mass median, phases."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kernelfield.operators.grid import AXES


def particle_bounds(particles: DataFrame) -> DataFrame:
    """axis, low, high."""
    one = particles.agg(*[f(a).alias(f"{a}_{f.__name__}") for a in AXES for f in (F.min, F.max)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"{a}_min").alias("low"), F.col(f"{a}_max").alias("high")) for a in AXES])).alias("s")).select("s.*")


def size_statistics(particles: DataFrame) -> DataFrame:
    """dmax, d43, d32, drms."""
    d = F.col("diameter")
    power = lambda k: F.sum(d * d if k == 2 else d * d * d if k == 3 else d * d * d * d)
    return particles.agg(F.max(d).alias("dmax"), (power(4) / power(3)).alias("d43"), (power(3) / power(2)).alias("d32"), F.sqrt(power(2) / F.count(d)).alias("drms"))


def mass_median(particles: DataFrame, buckets: int = 1024, few: int = 10_000) -> DataFrame:
    """d50: where the mass of particles in order of diameter (then mass, id) crosses one half, interpolated between the two particles.

    Only the bucket of diameters that holds the crossing matters, what lies before it counts by its sums; it is divided again until it
    has few particles, which are ordered, or one diameter, of which only the first particle is of interest.
    """
    p = particles.select("diameter", "mass", "id").where("diameter is not null")
    d = F.col("diameter")
    low, high, total = p.agg(F.min(d), F.max(d), F.sum("mass")).first()
    before, prior, found = 0.0, None, None

    def between(share: float, diameter: float, s0: float) -> float:
        return diameter if prior is None else prior + (0.5 - s0) * (diameter - prior) / (share - s0)

    while total is not None:
        own = p.where((d >= F.lit(low)) & (d <= F.lit(high)))
        if low == high:
            share = (before + own.agg(F.min("mass")).first()[0]) / total
            found = between(share, low, before / total) if share >= 0.5 else low
            break
        at = F.least(F.lit(buckets - 1), F.floor((d - F.lit(low)) / F.lit(high - low) * buckets).cast("int"))
        rows = own.groupBy(at.alias("b")).agg(F.sum("mass").alias("m"), F.count("*").alias("n"), F.min(d).alias("low"), F.max(d).alias("high")).orderBy("b").collect()  # at most buckets rows
        for r in rows:
            if before + r["m"] >= 0.5 * total * (1 - 1e-12) or r is rows[-1]:
                break
            before, prior = before + r["m"], r["high"]
        low, high = r["low"], r["high"]
        if r["n"] <= few:
            for x in p.where((d >= F.lit(low)) & (d <= F.lit(high))).orderBy("diameter", "mass", "id").collect():
                s0, before = before / total, before + x["mass"]
                found = between(before / total, x["diameter"], s0)
                if before / total >= 0.5:
                    break
                prior = x["diameter"]
            break
    return particles.sparkSession.createDataFrame([(found,)] if found is not None else [], "d50 double")


def distinct_phases(particles: DataFrame, most: int = 1000) -> DataFrame:
    """phase (from 1), diameter, density, n: one phase for each pair of diameter and density; an error if there are more than most, as with sizes that vary without steps."""
    pairs = particles.groupBy("diameter", "density").agg(F.count("*").alias("n"))
    if pairs.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} pairs of diameter and density: find phases by clustering")
    return pairs.withColumn("phase", F.row_number().over(Window.orderBy("diameter", "density"))).select("phase", "diameter", "density", "n")


def with_distinct_phase(particles: DataFrame) -> DataFrame:
    return particles.drop("phase").join(distinct_phases(particles).drop("n"), ["diameter", "density"])


def _silhouette(points: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette by Euclidean distance."""
    if len(set(labels.tolist())) < 2:
        return -1.0
    distance = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(2))
    groups = {k: labels == k for k in set(labels.tolist())}
    out = []
    for i, k in enumerate(labels.tolist()):
        own = groups[k].sum()
        if own < 2:
            out.append(0.0)
            continue
        a = distance[i, groups[k]].sum() / (own - 1)
        b = min(distance[i, g].mean() for c, g in groups.items() if c != k)
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out))


def kmeans_phases(particles: DataFrame, most: int = 6, seed: int = 200, starts: int = 100, sample: int = 1000) -> DataFrame:
    """id, phase (from 1, by diameter then density), diameter and density of its centre.

    The number of clusters, from 2 to most - 1, is the one with the best silhouette among those where the curve of silhouettes bends
    down, or of all if it bends down nowhere. Silhouettes are taken on at most sample rows, drawn by a hash; on these the final centres
    are sought from starts seeded starts, and then moved to the means of all rows.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import MinMaxScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    raw = VectorAssembler(inputCols=["diameter", "density"], outputCol="raw").transform(particles.select("id", "diameter", "density"))
    scaler = MinMaxScaler(inputCol="raw", outputCol="features").fit(raw)
    data = scaler.transform(raw).select("id", "features").persist()
    low, high = scaler.originalMin.toArray(), scaler.originalMax.toArray()
    some = data.orderBy(F.xxhash64("id")).limit(sample).persist()
    scores = []
    for k in range(2, most):
        rows = KMeans(k=k, seed=seed).fit(data).transform(some).select(vector_to_array("features").alias("f"), "prediction").collect()
        scores.append(_silhouette(np.array([r[0] for r in rows]), np.array([r[1] for r in rows])))
    k = best_count(dict(zip(range(2, most), scores, strict=True)))
    points = np.array([r[0].toArray() for r in some.select("features").collect()])
    centres = _refined(data, _best_start(points, k, starts, seed))
    data.unpersist()
    some.unpersist()
    centres = sorted([float(c[i] * (high[i] - low[i]) + low[i]) for i in range(2)] for c in centres)
    scaled = [tuple((c[i] - low[i]) / (high[i] - low[i] or 1.0) for i in range(2)) for c in centres]
    at = _nearest([(F.col(n) - F.lit(float(low[i]))) / F.lit(float(high[i] - low[i] or 1.0)) for i, n in enumerate(("diameter", "density"))], scaled)
    row = F.array(*[F.struct(F.lit(i + 1).alias("phase"), F.lit(c[0]).alias("diameter"), F.lit(c[1]).alias("density")) for i, c in enumerate(centres)])
    return particles.select("id", row[at].alias("s")).select("id", "s.*")


def best_count(scores: dict[int, float]) -> int:
    """The number of clusters with the highest score among those whose slope is falling, or of all if it falls nowhere; the least of equals."""
    counts = sorted(scores)

    def slopes(values: list[float]) -> list[float]:
        """One-sided at the ends, over two steps in between."""
        last = len(values) - 1
        return [(values[min(i + 1, last)] - values[max(i - 1, 0)]) / max(1, min(i + 1, last) - max(i - 1, 0)) for i in range(len(values))]

    falling = [k for k, bend in zip(counts, slopes(slopes([scores[k] for k in counts])), strict=True) if bend < 0]
    return max(falling or counts, key=lambda k: (scores[k], -k))


def _best_start(points: np.ndarray, k: int, starts: int, seed: int, turns: int = 30) -> np.ndarray:
    """Of many seeded starts on a sample, each improved for some turns, the centres with the least squared distance."""
    draw, best = np.random.default_rng(seed), (np.inf, points[:k])
    for _ in range(starts):
        centres = points[draw.integers(len(points))][None]
        while len(centres) < k:
            far = ((points[:, None] - centres[None]) ** 2).sum(2).min(1)
            share = far / far.sum() if far.sum() > 0 else np.full(len(points), 1 / len(points))
            centres = np.concatenate((centres, points[draw.choice(len(points), p=share)][None]))
        for _ in range(turns):
            square = ((points[:, None] - centres[None]) ** 2).sum(2)
            own = square.argmin(1)
            moved = np.array([points[own == i].mean(0) if (own == i).any() else centres[i] for i in range(k)])
            if np.allclose(moved, centres):
                break
            centres = moved
        cost = float(((points[:, None] - centres[None]) ** 2).sum(2).min(1).sum())
        if cost < best[0] - 1e-12:
            best = (cost, centres)
    return best[1]


def _nearest(x: list[Column], centres: list) -> Column:
    """Number of the nearest centre."""
    return F.array_min(F.array(*[F.struct(sum(((a - F.lit(float(b))) * (a - F.lit(float(b))) for a, b in zip(x, c, strict=True)), F.lit(0.0)).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]))["i"]


def _refined(data: DataFrame, centres: np.ndarray, turns: int = 20, least: float = 1e-6) -> np.ndarray:
    """Centres moved to the means of all rows nearest to them, until they rest."""
    from pyspark.ml.functions import vector_to_array

    rows = data.select(vector_to_array("features").alias("f"))
    for _ in range(turns):
        near = rows.groupBy(_nearest([F.col("f")[0], F.col("f")[1]], centres.tolist()).alias("i")).agg(F.avg(F.col("f")[0]).alias("a"), F.avg(F.col("f")[1]).alias("b")).collect()
        moved = centres.copy()
        for r in near:
            moved[r["i"]] = r["a"], r["b"]
        rest = float(np.abs(moved - centres).max()) < least
        centres = moved
        if rest:
            break
    return centres
