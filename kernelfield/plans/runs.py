"""From a configuration file to results: reads the snapshots it names, computes what it asks for and writes it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from kernelfield.operators.fields import needs_contacts
from kernelfield.plans.engine import CoarseGrainer
from kernelfield.sources import config, files, snapshots, vtk
from kernelfield.sources.sinks import Cube

ENDINGS = ("vtp", "vtk", "vtm")


@dataclass(frozen=True)
class Results:
    """The engine of a run, and what was written: the cube, and paths of images."""

    engine: CoarseGrainer
    cube: Cube | None
    images: list[str]


def step_files(cfg: config.Run, which: str) -> list[str]:
    """The file of each step, with the first of ENDINGS that there is."""
    found = []
    for t in cfg.steps:
        names = [cfg.file(which, t, e) for e in ENDINGS]
        there = next((x for x in names if files.exists(x)), None)
        if there is None:
            raise FileNotFoundError(f"step {t} of {which}: none of {', '.join(names)}")
        found.append(there)
    if not found:
        raise ValueError("the configuration has no steps")
    return found


def snapshot(spark: SparkSession, paths: list[str], association: str = "point") -> DataFrame:
    return spark.read.format("kf_vtk").option("paths", "\n".join(paths)).option("association", association).load()


def inputs(spark: SparkSession, cfg: config.Run) -> tuple[DataFrame, DataFrame | None]:
    """Particles of the steps, and contacts if a field needs them; contacts are points, or cells that hold both ids in one array."""
    vtk.register(spark)
    particles = snapshots.particles(snapshot(spark, step_files(cfg, "particles")), cfg.keys)
    if not needs_contacts(cfg.engine.fields, cfg.keys.get("Coordination_Number") is not None):
        return particles, None
    paths, first = step_files(cfg, "contacts"), cfg.keys.get("Particle_i_ID")
    points = snapshot(spark, paths)
    if first in points.columns:
        return particles, snapshots.contacts(points, cfg.keys)
    return particles, snapshots.contacts(snapshot(spark, paths, "cell"), cfg.keys, "cell")


def run(spark: SparkSession, ini: str, **changes) -> Results:
    """Reads, computes and writes below output_path what the configuration asks for; changes override fields of the engine's part."""
    cfg = config.load(ini, **changes)
    engine = CoarseGrainer(spark, *inputs(spark, cfg), cfg.engine)
    out = cfg.output_path.rstrip("/")
    cube = engine.write(f"{out}/cube") if cfg.cube else None
    images = engine.write_images(cube.read(spark) if cube else engine.run(), f"{out}/images") if cfg.images else []
    return Results(engine, cube, images)
