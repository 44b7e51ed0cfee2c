"""Files, configurations, sinks and the stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kernelfield.functions.kernels import Kernel
from kernelfield.operators.fields import Fields
from kernelfield.operators.grid import Lattice
from kernelfield.plans import fixtures, runs
from kernelfield.plans.engine import CoarseGrainer, Config
from kernelfield.sources import config, sinks, snapshots, vtk
from kernelfield.streaming.snapshots import stream_fields

KEYS = {"Global_ID": "pid", "Particle_Velocity": "Velocity", "Particle_Diameter": None, "Particle_Radius": "Radius", "Particle_Density": "Density", "Particle_Volume": "Volume", "Particle_Mass": "Mass", "Coordination_Number": None}


def _arrays(n=5):
    r = np.random.default_rng(1)
    return r.random((n, 3)), {"pid": np.arange(n)[::-1].copy(), "Velocity": r.random((n, 3)), "Radius": r.random(n), "Density": np.full(n, 2500.0), "Volume": r.random(n), "Mass": r.random(n)}


@pytest.mark.parametrize("compressed", [False, True])
def test_vtp_round_trip(spark, tmp_path, compressed):
    points, arrays = _arrays()
    for t in (150, 151):
        vtk.write_vtp(str(tmp_path / f"DES_{t:04d}.vtp"), points, arrays, compressed=compressed)
    vtk.register(spark)
    raw = spark.read.format("kf_vtk").option("path", str(tmp_path / "DES_*.vtp")).load()
    rows = snapshots.particles(raw, KEYS).orderBy("t", "id").collect()
    assert [r["t"] for r in rows] == [150] * 5 + [151] * 5
    assert np.allclose([r["diameter"] for r in rows[:5]], 2 * arrays["Radius"][::-1])
    assert np.allclose([[r["x"], r["vy"]] for r in rows[:5]], np.stack([points[::-1, 0], arrays["Velocity"][::-1, 1]], 1))


def test_legacy_and_multi_block(spark, tmp_path):
    text = "# vtk DataFile Version 3.0\nt\nASCII\nDATASET UNSTRUCTURED_GRID\nPOINTS 2 float\n0 0 0\n1 2 3\nCELLS 1 3\n2 0 1\nCELL_TYPES 1\n3\nCELL_DATA 1\nFIELD f 2\ncontact_ids 2 1 int\n7 9\ntotal_force 3 1 double\n1 2 3\nPOINT_DATA 2\nSCALARS id int\nLOOKUP_TABLE default\n7\n9\nVECTORS v float\n1 0 0\n0 1 0\n"
    (tmp_path / "c_0030.vtk").write_text(text)
    (tmp_path / "all.vtm").write_text('<?xml version="1.0"?><VTKFile type="vtkMultiBlockDataSet"><vtkMultiBlockDataSet><DataSet index="0" file="c_0030.vtk"/><Block index="1"><DataSet index="0" file="c_0030.vtk"/></Block></vtkMultiBlockDataSet></VTKFile>')
    vtk.register(spark)
    cells = spark.read.format("kf_vtk").option("path", str(tmp_path / "c_0030.vtk")).option("association", "cell").load()
    got = snapshots.contacts(cells, {"Particle_i_ID": "contact_ids", "Force_ij": "total_force", "Contact_ij": None}, "cell").first()
    assert (got["t"], got["i"], got["j"], got["fz"]) == (30, 7, 9, 3.0)
    points = spark.read.format("kf_vtk").option("path", str(tmp_path / "all.vtm")).load()
    assert points.count() == 4 and points.agg(F.sum("id")).first()[0] == 32
    binary = b"# vtk DataFile Version 3.0\nt\nBINARY\nDATASET POLYDATA\nPOINTS 1 double\n" + np.array([1, 2, 3], ">f8").tobytes() + b"\nPOINT_DATA 1\nSCALARS m double 1\nLOOKUP_TABLE default\n" + np.array([4], ">f8").tobytes() + b"\n"
    (tmp_path / "b.vtk").write_bytes(binary)
    assert vtk.read(str(tmp_path / "b.vtk"))["m"].tolist() == [4]


def test_names_that_are_missing(spark, tmp_path):
    points, arrays = _arrays()
    vtk.write_vtp(str(tmp_path / "p_1.vtp"), points, arrays)
    vtk.register(spark)
    raw = spark.read.format("kf_vtk").option("path", str(tmp_path / "p_1.vtp")).load()
    with pytest.raises(ValueError, match="there are"):
        snapshots.particles(raw, KEYS | {"Particle_Mass": "Weight"})
    with pytest.raises(ValueError):
        snapshots.particles(raw, KEYS | {"Particle_Radius": None})
    (tmp_path / "x.vtp").write_text("no")
    with pytest.raises(ValueError):
        vtk.file_type(str(tmp_path / "x.vtp"))
    with pytest.raises(FileNotFoundError):
        vtk.file_type(str(tmp_path / "none.vtp"))


def test_blocks_merge(spark):
    a, b = spark.range(2).toDF("id"), spark.range(3).withColumn("w", F.lit(1))
    assert snapshots.merged([a, b]).where("w is null").count() == 2


INI = """[paths]
particles_path = P_
contacts_path = C_
output_path = out/
[timesteps]
t0 = 150
tf = 152
dt = 1
[smoothing_function]
type = Gaussian
[flags]
partialignore = yes
[key_mapping]
Global_ID = pid
Particle_Radius = None
[grid_info]
grid_dimension = 2
grid_axes = xy
automatic_grid = False
x_min = 0.1
x_max = 0.5
y_min = 0
y_max = 0.2
z_min = None
z_max = None
x_transect = None
y_transect = None
z_transect = 0.0
x_axis_periodic = True
y_axis_periodic = False
z_axis_periodic = False
[fields_to_export]
velocity = True
pressure = no
[output_options]
h5_output = 1
vkthdf_output = False
"""


def test_configuration(tmp_path):
    (tmp_path / "c.ini").write_text(INI)
    run = config.load(str(tmp_path / "c.ini"), resolution="d50")
    assert run.steps == (150, 151, 152) and run.keys == {"Global_ID": "pid", "Particle_Radius": None} and run.file("particles", 150) == "P_0150.vtp"
    e = run.engine
    assert e.fields == ("velocity",) and e.kernel == "Gaussian" and e.axes == "xy" and e.ranges == {"x": (0.1, 0.5), "y": (0.0, 0.2)} and e.transects == {"z": 0.0}
    assert e.periodic == (True, False, False) and e.phase_by == "none" and e.slices and e.resolution == "d50"
    with pytest.raises(FileNotFoundError):
        config.load(str(tmp_path / "none.ini"))


def test_images(spark, tmp_path):
    grid = Lattice((0.0, 0.0, 0.0), (0.1, 0.1, 0.0), (4, 3, 1))
    f = Fields(fixtures.particles(spark, "/root/testdata/sf0.001"), grid, Kernel("Lucy", 0.3))
    rows = f.table(["density_mixture", "velocity"])
    arrays = sinks.image_arrays(rows.toPandas(), grid, ["density_mixture", "velocity_x", "velocity_y", "velocity_z"])
    assert arrays["velocity"].shape == (4, 3, 1, 3)
    thick, more = sinks.thickened(grid, arrays)
    assert thick.counts == (4, 3, 2) and more["density_mixture"].shape == (4, 3, 2)
    sinks.write_vti(str(tmp_path / "a.vti"), grid, arrays)
    assert 'WholeExtent="0 3 0 2 0 1"' in (tmp_path / "a.vti").read_text()
    found = sinks.image_doubts(Lattice((0, 0, 0), (1, 20, 1), (5, 5, 600)), {"velocity": arrays["velocity"]})
    assert {(x.about, x.where, x.grave) for x in found} == {("spacing", "xy", True), ("spacing", "yz", True), ("counts", "xz", True), ("counts", "yz", True), ("shape", "velocity", True), ("orientation", "xy", False)}
    assert not sinks.image_doubts(grid, arrays) and sinks.kind_of(arrays["velocity"].reshape(-1, 3)) == "vector"
    assert sinks.dimensions_of(sinks.extent_of((4, 3, 2))) == (4, 3, 2) and sinks.cell_dimensions((4, 3, 1)) == (3, 2, 1) and sinks.cell_extent((0, 3, 0, 2, 0, 0)) == (0, 2, 0, 1, 0, 0)


def test_columns_by_phase(spark):
    rows = spark.createDataFrame([(0, 1, p, float(p), 5.0) for p in range(3)], "t int, node bigint, phase int, rho double, d43 double")
    assert sinks.by_phase(rows, ["rho", "d43"], 2, ("d43",)).first().asDict() == {"t": 0, "node": 1, "rho_bulk": 0.0, "rho_phase1": 1.0, "rho_phase2": 2.0, "d43": 5.0}


def test_steps_are_replaced(spark, tmp_path):
    cube = sinks.Cube(str(tmp_path / "cube"))
    rows = spark.createDataFrame([(t, n, 0, float(t)) for t in range(3) for n in range(2)], "t int, node bigint, phase int, v double")
    cube.write_steps(rows)
    cube.write_steps(rows.where("t = 1").withColumn("v", F.lit(9.0)))
    assert {(r["t"], r["v"]) for r in cube.read(spark).collect()} == {(0, 0.0), (1, 9.0), (2, 2.0)}
    cube.write_phases(spark.createDataFrame([(0, None, None), (1, 0.1, 2500.0)], "phase int, diameter double, density double"))
    assert {r["label"] for r in spark.read.parquet(f"{cube.path}/phases").collect()} == {"Bulk", "Phase_[0.1 2500.0]"}


def test_stream_equals_batch(spark, tmp_path):
    p = fixtures.particles(spark, "/root/testdata/sf0.001", 3)
    for t in range(3):
        p.where(F.col("t") == t).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    make = lambda df: Fields(df, fixtures.LATTICE, Kernel("Lucy", 0.2)).table(["density_mixture"])
    cube = sinks.Cube(str(tmp_path / "out"))
    schema = ", ".join(f"{n} {k}" for n, k in p.dtypes)
    stream_fields(spark, str(tmp_path / "in"), schema, make, cube, str(tmp_path / "cp")).awaitTermination(120)
    total = lambda df: sorted((r[0], r[1], round(r[2], 6)) for r in df.groupBy("t").agg(F.count("*"), F.sum("density_mixture")).collect())
    assert total(cube.read(spark)) == total(make(p))


def test_run_from_files(spark, tmp_path):
    """An INI over vtp files of particles and contacts, against the engine on the tables."""
    sf = "/root/testdata/sf0.001"
    p, c = fixtures.particles(spark, sf), fixtures.contacts(spark, sf, points=True)
    rows, touch = p.toPandas(), c.where("i <> j").limit(400).toPandas().sort_values("row_idx")
    ini = fixtures.INI.replace("{folder}", str(tmp_path)).replace("t0 = 1\ntf = 3\ndt = 2", "t0 = 0\ntf = 0\ndt = 1").replace("velocity = False", "velocity = True\ncontact_tensor = True\ncoordination_number = True")
    ini = ini.replace("vkthdf_output = False", "vkthdf_output = True").replace("granular_temperature_slices = False", "granular_temperature_slices = True").replace("Coordination_Number = None", "Coordination_Number = None\nParticle_i_ID = First\nParticle_j_ID = Second\nForce_ij = Push\nContact_ij = None")
    (tmp_path / "run.ini").write_text(ini)
    with pytest.raises(FileNotFoundError, match="step 0 of particles"):
        runs.run(spark, str(tmp_path / "run.ini"))
    vtk.write_vtp(str(tmp_path / "snap_0000.vtp"), rows[["x", "y", "z"]].to_numpy(), {"Number": rows["id"].to_numpy(), "Speed": rows[["vx", "vy", "vz"]].to_numpy(), **{n.title(): rows[n].to_numpy() for n in ("diameter", "density", "volume", "mass")}})
    push, points = touch[["fx", "fy", "fz"]].to_numpy(), touch[["cx", "cy", "cz"]].to_numpy()
    vtk.write_vtp(str(tmp_path / "none_0000.vtp"), points, {"First": touch["i"].to_numpy(), "Second": touch["j"].to_numpy(), "Push": push})
    done = runs.run(spark, str(tmp_path / "run.ini"), width_multiple=8.0)
    table = spark.createDataFrame(touch.assign(row_idx=range(len(touch)))[["t", "row_idx", "i", "j", "fx", "fy", "fz"]])
    ranges = {a: (0.0, 1.0) for a in "xyz"}
    want = CoarseGrainer(spark, p.drop("phase"), table, Config(fields=done.engine.config.fields, automatic_grid=False, ranges=ranges, width_multiple=8.0, slices=True)).run()
    names = [n for n, k in want.dtypes if k == "double"]
    assert {"velocity_x", "coordination_number"} < set(names) and any(n.startswith("contact_tensor") for n in names)
    left, right = (f.orderBy("node").toPandas() for f in (done.cube.read(spark), want))
    assert len(left) == done.engine.grid.size and np.allclose(left[names].to_numpy(float), right[names].to_numpy(float), equal_nan=True)
    assert [x.rsplit("/", 1)[-1] for x in done.images] == ["CG_Lucy_Monodisperse_0000.vti"] and 'Name="velocity"' in open(done.images[0]).read()
    assert spark.read.parquet(str(tmp_path / "results" / "cube" / "slices")).count() > 0
