"""Snapshots written by the executors as blocks."""

from pathlib import Path

import pytest
from pyspark.sql import DataFrame

from kernelfield.plans import catalogue, fixtures, runs
from kernelfield.sources import vtk

SF = "/root/testdata/sf0.001"


def test_steps_in_blocks_read_back(spark, tmp_path):
    p = fixtures.particles(spark, SF, 3)
    paths = vtk.write_steps(p, f"{tmp_path}/snap_", {"Number": ["id"], "Speed": ["vx", "vy", "vz"], "Mass": ["mass"]}, compressed=(2,), block=30)
    assert [Path(x).name for x in paths] == ["snap_0000.vtm", "snap_0001.vtm", "snap_0002.vtm"]
    assert all(len(vtk.blocks_of(x)) > 2 for x in paths)
    assert "compressor" in Path(vtk.blocks_of(paths[2])[0]).read_text() and "compressor" not in Path(vtk.blocks_of(paths[1])[0]).read_text()
    vtk.register(spark)
    got = sorted((r["t"], r["Number"], *r["points"], *r["Speed"], r["Mass"]) for r in runs.snapshot(spark, paths).collect())
    want = sorted((r["t"], r["id"], *[r[k] for k in ("x", "y", "z", "vx", "vy", "vz", "mass")]) for r in p.collect())
    assert len(got) == len(want) and all(g == pytest.approx(w, rel=1e-15) for g, w in zip(got, want, strict=True))


def test_no_particle_comes_to_the_driver(spark, monkeypatch):
    def refused(self):
        raise AssertionError("particles on the driver")

    monkeypatch.setattr(DataFrame, "toPandas", refused)
    monkeypatch.setattr(type(spark.range(1)), "toPandas", refused)
    assert catalogue.QUERIES["run_from_files"](spark, SF).count() == 2 * 1331
