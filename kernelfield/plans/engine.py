"""The engine: from snapshots and a configuration to fields of all steps in one plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernelfield.functions.kernels import Kernel, cutoff, half_width
from kernelfield.operators import contacts as C
from kernelfield.operators import grid as G
from kernelfield.operators import statistics as S
from kernelfield.operators.fields import Fields
from kernelfield.operators.slices import band_temperature
from kernelfield.operators.sweep import sweep
from kernelfield.sources import sinks


@dataclass(frozen=True)
class Config:
    """What to compute; defaults suit a three-dimensional bulk run."""

    fields: tuple[str, ...] = ("volume_fraction", "density_mixture", "velocity")
    kernel: str = "Lucy"
    kernel_mode: str = "table"
    sensitivity: int = 1000
    width_multiple: float = 0.75
    cutoff_ratio: float | None = None
    resolution: str | float = "d43"  # or d50, d32, drms, dmax, or a diameter
    axes: str = "xyz"
    automatic_grid: bool = True
    ranges: dict = field(default_factory=dict)
    transects: dict = field(default_factory=dict)
    periodic: tuple[bool, bool, bool] = (False, False, False)
    phase_by: str = "none"  # or distinct, kmeans, given
    most_phases: int = 6
    gradient_method: str = "finite_difference"
    lsq_mode: str = "corrected"
    slices: bool = False


class CoarseGrainer:
    """Stages: sample, statistics, phases, resolution, grid, fields. Each runs when first needed; those that the driver needs as numbers are small aggregates of the first step."""

    def __init__(self, spark: SparkSession, particles: DataFrame, contacts: DataFrame | None, config: Config):
        if config.phase_by not in ("none", "distinct", "kmeans", "given"):
            raise ValueError("phase_by is none, distinct, kmeans or given")
        self.spark, self.raw, self.contacts, self.config = spark, particles, contacts, config
        self._cache: dict = {}

    def _once(self, name: str, make):
        if name not in self._cache:
            self._cache[name] = make()
        return self._cache[name]

    @property
    def sample(self) -> DataFrame:
        """The first step."""
        t0 = self._once("t0", lambda: self.raw.agg(F.min("t")).first()[0])
        if t0 is None:
            raise ValueError("there are no particles")
        return self.raw.where(F.col("t") == t0)

    @property
    def statistics(self) -> dict[str, float]:
        """dmax, d43, d32, drms, d50."""

        def make():
            moments = S.size_statistics(self.sample).first().asDict()
            return moments | {"d50": S.mass_median(self.sample).first()[0]}

        return self._once("statistics", make)

    @property
    def bounds(self) -> list[tuple[float, float]]:
        return self._once("bounds", lambda: [(r[1], r[2]) for r in sorted(S.particle_bounds(self.sample).collect())])

    @property
    def clustered(self) -> DataFrame:
        """Phases by clustering, which both the phase table and the particles take."""
        return self._once("clustered", lambda: S.kmeans_phases(self.sample, self.config.most_phases))

    @property
    def phase_table(self) -> DataFrame | None:
        """phase, diameter, density; None for a bulk run."""

        def make():
            if self.config.phase_by == "none":
                return None
            if self.config.phase_by == "kmeans":
                return self.clustered.groupBy("phase").agg(F.first("diameter").alias("diameter"), F.first("density").alias("density"))
            if self.config.phase_by == "given":
                return self.sample.groupBy("phase").agg(F.avg("diameter").alias("diameter"), F.avg("density").alias("density"))
            return S.distinct_phases(self.sample).drop("n")

        return self._once("phase_table", make)

    @property
    def particles(self) -> DataFrame:
        """With phase, by id from the first step, and coordination if the files have none."""

        def make():
            p = self.raw
            if self.config.phase_by == "none":
                p = p.withColumn("phase", F.lit(1))
            elif self.config.phase_by == "kmeans":
                p = p.drop("phase").join(self.clustered.select("id", "phase"), "id")
            elif self.config.phase_by == "distinct":
                p = p.drop("phase").join(S.with_distinct_phase(self.sample).select("id", "phase"), "id")
            if "coordination" not in p.columns and self.contacts is not None:
                p = p.join(C.coordination(self.unique_contacts, p), ["t", "id"])
            return p

        return self._once("particles", make)

    @property
    def unique_contacts(self) -> DataFrame:
        return self._once("unique", lambda: C.deduplicated(self.contacts))

    @property
    def directed(self) -> DataFrame | None:
        return None if self.contacts is None else self._once("directed", lambda: C.mapped(self.unique_contacts, self.particles, self.config.periodic))

    @property
    def c(self) -> float:
        k = self.config
        diameter = self.statistics[k.resolution] if isinstance(k.resolution, str) else k.resolution
        return cutoff(half_width(diameter, k.width_multiple), k.kernel, k.cutoff_ratio)

    @property
    def grid(self) -> G.Lattice:
        k = self.config
        return self._once("grid", lambda: G.generate(self.bounds, self.c, self.statistics["dmax"], k.axes, k.automatic_grid, k.ranges, k.transects))

    def fields(self) -> Fields:
        k = self.config
        table = self.phase_table
        phases = 0 if table is None else self._once("phases", table.count)
        phases = 0 if phases < 2 else phases
        return Fields(self.particles, self.grid, Kernel(k.kernel, self.c, k.kernel_mode, k.sensitivity), self.directed, phases, table if phases else None, k.gradient_method, k.lsq_mode)

    def run(self) -> DataFrame:
        """The fields of the configuration at every node, phase and step."""
        return self.fields().table(self.config.fields)

    def slices(self, n: int = 5) -> DataFrame:
        """Band temperatures over the y range of the grid, in bands of its y spacing."""
        g = self.grid
        if g.counts[1] < 2:
            raise ValueError("slices need a grid along y")
        return band_temperature(self.particles, g.point("y", 0), g.point("y", g.counts[1] - 1), g.spacing[1], n)

    def sweep(self, multiples: list[float], centre: tuple[float, float, float]) -> DataFrame:
        """Bulk fields around centre in the first step for many widths, as multiples of d43."""
        t0 = self.sample
        return sweep(t0, centre, self.statistics["d43"], multiples, self.config.kernel, self.directed.join(t0.select("t").distinct(), "t", "left_semi") if self.directed is not None else None, self.config.sensitivity, self.config.kernel_mode)

    def write(self, path: str, images: str | None = None) -> sinks.Cube:
        """The grid, the phases, the fields of every step and, if configured, the bands below path; with images also an image file for each step in that folder."""
        fields = self.fields()
        cube = sinks.Cube(path)
        cube.write_grid(self.grid.frame(self.spark))
        if fields.phase_table is not None:
            bulk = self.spark.range(1).select(F.lit(0).alias("phase"), F.lit(None).cast("double").alias("diameter"), F.lit(None).cast("double").alias("density"))
            cube.write_phases(bulk.unionByName(fields.phase_table.select(F.col("phase").cast("int").alias("phase"), "diameter", "density")))
        cube.write_steps(fields.table(self.config.fields))
        if self.config.slices and self.grid.counts[1] > 1:
            self.slices().write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("t").parquet(f"{path}/slices")
        if images is not None:
            self.write_images(cube.read(self.spark), images)
        return cube

    def write_images(self, done: DataFrame, folder: str) -> list[str]:
        """An image file for each step of fields that are done, below a folder that the executors share."""
        names = [n for n, kind in done.dtypes if kind == "double" and n not in G.AXES]
        phases = self.fields().phases
        return sinks.write_images(done, self.grid, names, phases, f"{folder}/CG_{self.config.kernel}_{'Polydisperse' if phases else 'Monodisperse'}_{{t}}.vti")
