"""The registered queries against their SQL, unit values, invariants."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kernelfield.functions import kernels as K
from kernelfield.operators import contacts as C
from kernelfield.operators import grid as G
from kernelfield.operators import neighbours as N
from kernelfield.operators import profiles as P
from kernelfield.operators import slices as L
from kernelfield.operators import statistics as S
from kernelfield.operators.fields import Fields, closure
from kernelfield.plans import catalogue, fixtures
from kernelfield.plans.engine import CoarseGrainer, Config

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("part", "lineitem", "supplier"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _same(got, want):
    """Equal but for rounding: rows are lined up by their columns that are not floats, then by the floats."""
    names = sorted(got.columns)
    assert names == sorted(want.columns) and len(got) == len(want)
    floats = [n for n in names if str(got[n].dtype).startswith("float") or str(want[n].dtype).startswith("float")]
    keys = [n for n in names if n not in floats]
    order = lambda f: f[names].sort_values(keys + floats).reset_index(drop=True)
    a, b = order(got), order(want)
    for n in keys:
        assert a[n].astype(str).tolist() == b[n].astype(str).tolist(), n
    for n in floats:
        assert np.allclose(a[n].astype(float), b[n].astype(float), rtol=1e-4, atol=1e-6, equal_nan=True), n


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_against_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(catalogue.ORACLES[name]).df()
    _same(got, want)


def _particles(spark, rows):
    """rows: id, x, y, z, vx, vy, vz, diameter, density."""
    df = spark.createDataFrame([tuple(map(float, r[1:])) + (r[0],) for r in rows], "x double, y double, z double, vx double, vy double, vz double, diameter double, density double, id bigint")
    volume = math.pi / 6 * F.pow("diameter", F.lit(3.0))
    return df.select(F.lit(0).alias("t"), "id", *[c for c in df.columns if c != "id"], volume.alias("volume"), (volume * F.col("density")).alias("mass"), F.lit(1).alias("phase"))


def test_unit_values():
    assert K.figure_position(523) == 100 and K.figure_position(0.0042) == 0.001 and K.figure_position(0) == 0
    assert K.line_nodes(5) == [0, 0.25, 0.5, 0.75, 1]
    assert K.cutoff(K.half_width(0.4), "Lucy") == pytest.approx(0.6)
    assert K.Kernel("Lucy", 0.2).entries == 2000
    with pytest.raises(ValueError):
        K.cutoff(1, "Cubic")
    with pytest.raises(ValueError):
        K.Kernel("Lucy", 0)


def test_kernels_integrate_to_one(spark):
    for name in K.CUTOFF_RATIO:
        k = K.Kernel(name, 0.3, "exact")
        n = 3000
        r = spark.range(n).select(((F.col("id") + 0.5) * (0.3 / n)).alias("r"))
        total = r.select(F.sum(4 * math.pi * F.col("r") * F.col("r") * k.weight(F.col("r")) * (0.3 / n))).first()[0]
        assert total == pytest.approx(1, abs=2e-3)


def test_table_rule_for_one_particle_at_a_node(spark):
    one = _particles(spark, [(1, 0.5, 0.5, 0.5, 0, 0, 0, 0.1, 2500)])
    grid = G.Lattice((0.5, 0.5, 0.5), (0.1, 0.0, 0.0), (2, 1, 1))
    k = K.Kernel("Lucy", 0.2)
    rho = Fields(one, grid, k).base.where("node = 0").first()["rho"]
    u = k.step / 0.2
    mass = 2500 * math.pi / 6 * 0.1**3
    assert rho == pytest.approx(mass * k.norm * (1 - 6 * u**2 + 8 * u**3 - 3 * u**4), rel=1e-12)


def test_grid_golden():
    g = G.generate([(0, 1), (0, 1), (0, 1)], 0.1, 0.05, "xy")
    assert g.origin[0] == pytest.approx(0.275) and g.counts[0] in (10, 11) and g.counts[2] == 1 and g.origin[2] == pytest.approx(0.5)
    for bad in ({"axes": "xq"}, {"axes": "x", "ranges": {"x": (0, 1)}}, {"axes": "xyz", "ranges": {"x": (1, 0), "y": (0, 1), "z": (0, 1)}}):
        with pytest.raises(ValueError):
            G.lattice(bad["axes"], bad.get("ranges", {}), 0.2)
    with pytest.raises(ValueError):
        G.generate([(0, 1), (1, 0), (0, 1)], 0.1, 0.05)


def test_match_needs_no_shuffle(spark):
    plan = N.match(fixtures.particles(spark, SF), fixtures.LATTICE, 0.2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("BroadcastExchange", "").replace("BroadcastNestedLoopJoin", "")


def test_match_on_collapsed_axes_equals_brute_force(spark):
    p = fixtures.particles(spark, SF)
    grid = G.lattice("xz", {"x": (0.2, 0.8), "z": (0.1, 0.9)}, 0.2, {"y": 0.4})
    got = {(r[0], r[1]) for r in N.match(p, grid, 0.2).select("id", "node").collect()}
    nodes = {r[0]: np.array(r[1:]) for r in grid.frame(spark).select("node", "x", "y", "z").collect()}
    want = {(r[0], n) for r in p.select("id", "x", "y", "z").collect() for n, q in nodes.items() if np.linalg.norm(q - np.array(r[1:])) <= 0.2}
    assert got == want


def test_median_by_hand(spark):
    rows = [(1, 0.1, 1.0), (2, 0.2, 2.0), (3, 0.3, 3.0), (4, 0.4, 4.0)]
    df = spark.createDataFrame(rows, "id bigint, diameter double, mass double")
    assert S.mass_median(df).first()[0] == pytest.approx(0.2 + (0.5 - 0.3) / 0.3 * 0.1)
    assert S.mass_median(df.where("id = 4")).first()[0] == 0.4
    same = spark.createDataFrame([(i, 0.5, 1.0) for i in range(5)], "id bigint, diameter double, mass double")
    assert S.mass_median(same).first()[0] == 0.5


def test_contacts_by_hand(spark):
    raw = spark.createDataFrame([(0, k, i, j, 1.0, 0.0, 0.0) for k, (i, j) in enumerate([(1, 2), (2, 1), (1, 2), (3, 4), (5, 6), (4, 3), (7, 8)])], "t int, row_idx bigint, i bigint, j bigint, fx double, fy double, fz double")
    assert sorted(r[0] for r in C.deduplicated(raw).select("row_idx").collect()) == [0, 3, 4, 6]
    p = _particles(spark, [(1, 0.05, 0, 0, 0, 0, 0, 0.1, 1), (2, 0.95, 0, 0, 0, 0, 0, 0.1, 1), (3, 0, 0, 0, 0, 0, 0, 0.1, 1), (4, 1, 0, 0, 0, 0, 0, 0.1, 1)])
    one = C.mapped(raw.where("row_idx = 0"), p, (True, False, False)).orderBy("side").collect()
    assert [r["dx"] for r in one] == pytest.approx([0.1, -0.1]) and [r["fx"] for r in one] == [1, -1] and one[0]["bx"] == pytest.approx(0.05)
    turned = raw.where("row_idx = 0").select("t", "row_idx", F.col("j").alias("i"), F.col("i").alias("j"), *[(-F.col(f"f{a}")).alias(f"f{a}") for a in "xyz"])
    key = lambda rows: sorted((r["id"], r["fx"], r["bx"]) for r in rows)
    assert key(C.mapped(turned, p).collect()) == key(C.mapped(raw.where("row_idx = 0"), p).collect())
    assert {r["id"]: r["coordination"] for r in C.coordination(raw.where("row_idx in (0, 3)"), p).collect()} == {1: 1, 2: 1, 3: 1, 4: 1}
    assert C.mapped(raw.where("row_idx = 6"), p).count() == 0
    none = C.coordination(raw.where("false"), p)
    assert none.agg(F.sum("coordination")).first()[0] == 0 and C.without_rattlers(none).count() == 0


def _cloud(spark, velocity, n=9):
    at = np.linspace(0.02, 0.98, n)
    rows = [(i, x, y, z, *velocity(np.array([x, y, z])), 0.1, 2500) for i, (x, y, z) in enumerate((a, b, c) for a in at for b in at for c in at)]
    return _particles(spark, rows)


def test_uniform_flow_has_no_fluctuation(spark):
    p = _cloud(spark, lambda r: (1.0, -2.0, 0.5))
    grid = G.lattice("xyz", {a: (0.3, 0.7) for a in "xyz"}, 0.25)
    f = Fields(p, grid, K.Kernel("Lucy", 0.25))
    v = f.velocity.where("rho > 0").select("v_x", "v_y", "v_z").toPandas().to_numpy()
    assert np.allclose(v, [1, -2, 0.5])
    kq = f.kinetic_and_fluctuation.toPandas()
    assert abs(kq[[c for c in kq.columns if c[:2] in ("k_", "q_")]].to_numpy()).max() < 1e-9


def test_affine_flow_is_recovered_by_corrected_least_squares(spark):
    g = np.array([[0.5, -1, 0.2], [0, 0.3, 2], [1, 0, -0.8]])
    p = _cloud(spark, lambda r: g @ r)
    grid = G.lattice("xyz", {a: (0.3, 0.7) for a in "xyz"}, 0.25)
    f = Fields(p, grid, K.Kernel("Lucy", 0.25, "exact"), gradient_method="least_squares")
    # the velocity at a node is the weighted mean, so G r is recovered up to the offset of that mean
    got = f.gradient.select(*[f"g_{a}{b}" for a in "xyz" for b in "xyz"]).toPandas().to_numpy().reshape(-1, 3, 3)
    assert np.allclose(got, g, atol=0.05)


def test_bulk_is_the_sum_of_phases(spark):
    p = fixtures.particles(spark, SF)
    f = Fields(p, fixtures.LATTICE, K.Kernel("Gaussian", 0.2), phases=3)
    both = f.base.groupBy("node").agg(F.sum(F.when(F.col("phase") == 0, F.col("rho"))).alias("a"), F.sum(F.when(F.col("phase") > 0, F.col("rho"))).alias("b"))
    assert both.where("abs(a - b) > 1e-9").count() == 0


def test_empty_nodes_and_contactless_steps(spark):
    p = _particles(spark, [(1, 0, 0, 0, 1, 0, 0, 0.1, 2500)])
    grid = G.Lattice((0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (3, 3, 3))
    empty = spark.createDataFrame([], "t int, row_idx bigint, i bigint, j bigint, fx double, fy double, fz double")
    f = Fields(p, grid, K.Kernel("Lucy", 0.5), C.mapped(empty, p))
    rows = {r["node"]: r for r in f.velocity.collect()}
    assert len(rows) == 27 and rows[26]["rho"] == 0 and rows[26]["v_x"] is None and rows[0]["v_x"] == pytest.approx(1)
    assert f.contact.agg(F.sum("c_xx")).first()[0] == 0


def test_closure():
    assert closure(["inertial_number"]) >= {"velocity", "contact_tensor", "d32", "density_particle"}
    assert "velocity_gradient" not in closure(["kinetic_tensor"])
    with pytest.raises(ValueError):
        closure(["colour"])


def test_engine_runs_end_to_end(spark):
    p, c = fixtures.particles(spark, SF, 2), fixtures.contacts(spark, SF)
    config = Config(fields=("density_mixture", "velocity", "pressure", "granular_temperature", "coordination_number"), automatic_grid=False, ranges={a: (0.2, 0.8) for a in "xyz"}, width_multiple=5.0, phase_by="distinct", periodic=(True, False, False))
    engine = CoarseGrainer(spark, p, c, config)
    out = engine.run()
    assert out.count() == engine.grid.size * 4 * 2
    assert out.where("phase = 0 and density_mixture > 0").count() > 0
    assert engine.slices().count() == 2 * L.Bands(0.2, 0.8, engine.grid.spacing[1]).count
    swept = engine.sweep([0.75, 2.0, 5.0], (0.5, 0.5, 0.5))
    assert swept.count() == 27 * 3
    with pytest.raises(ValueError):
        CoarseGrainer(spark, p, c, Config(phase_by="colour"))


def test_profiles(spark):
    assert P.area_factor(fixtures.LATTICE, "y") == pytest.approx(0.01)
    assert P.area_factor(G.lattice("y", {"y": (0, 1)}, 0.2, {"x": 0, "z": 0}), "y") == 1
    with pytest.raises(ValueError):
        P.area_factor(fixtures.LATTICE, "w")


def test_engine_writes_all_outputs(spark, tmp_path):
    p, c = fixtures.particles(spark, SF, 2), fixtures.contacts(spark, SF)
    config = Config(fields=("density_mixture", "velocity"), automatic_grid=False, axes="xy", ranges={a: (0.2, 0.8) for a in "xy"}, transects={"z": 0.5}, width_multiple=8.0, phase_by="given", slices=True)
    engine = CoarseGrainer(spark, p, c, config)
    cube = engine.write(str(tmp_path / "out"), str(tmp_path / "img"))
    assert cube.read_with_places(spark).count() == engine.grid.size * 4 * 2
    assert cube.slice(spark, "x", 0).count() == engine.grid.counts[1] * 4 * 2
    assert {r["label"] for r in spark.read.parquet(str(tmp_path / "out" / "phases")).select("label").collect()} >= {"Bulk"}
    assert spark.read.parquet(str(tmp_path / "out" / "slices")).count() > 0
    images = sorted((tmp_path / "img").iterdir())
    assert [x.name for x in images] == ["CG_Lucy_Polydisperse_0000.vti", "CG_Lucy_Polydisperse_0001.vti"]
    assert all(f'Name="{n}"' in images[0].read_text() for n in ("density_mixture_bulk", "density_mixture_phase3", "velocity_bulk", "velocity_phase1"))


def test_bands(spark):
    """Sub-planes by index, against their heights written out."""
    b = L.Bands(0.1, 0.95, 0.1, 3)
    heights = [b.plane(k, m) for k in range(b.count) for m in range(1, b.planes + 1)]
    assert b.centre(b.count - 1) + 0.05 >= 0.95 and b.planes == 7 and heights[0] == pytest.approx(0.05) and heights[6] == pytest.approx(heights[7])
    ys = [-1.0, 0.0501, 0.149, 0.1523, 0.5, 0.777, 0.9999, 3.0]
    got = [r[0] for r in spark.createDataFrame([(y,) for y in ys], "y double").select(b.nearest(F.col("y"))).collect()]
    for y, i in zip(ys, got, strict=True):
        near = min(abs(y - z) for z in heights)
        assert abs(y - heights[i]) == pytest.approx(near) and i == next(j for j, z in enumerate(heights) if abs(y - z) <= near + 1e-9)


def test_many_sizes_are_no_phases(spark):
    rows = spark.range(50).select(F.col("id").cast("double").alias("diameter"), F.lit(1.0).alias("density"))
    assert S.distinct_phases(rows).count() == 50
    with pytest.raises(ValueError, match="clustering"):
        S.distinct_phases(rows, 49)


def test_count_of_clusters():
    assert S.best_count({2: 0.5, 3: 0.9, 4: 0.6, 5: 0.55}) == 3 and S.best_count({2: 0.9, 3: 0.5, 4: 0.4, 5: 0.4}) in (2, 3, 4, 5) and S.best_count({2: 0.3}) == 2
    scores = {2: 0.4, 3: 0.8, 4: 0.7, 5: 0.75, 6: 0.2}
    bend = np.gradient(np.gradient(list(scores.values())))
    assert S.best_count(scores) == max((k for k, b in zip(scores, bend, strict=True) if b < 0), key=scores.get)
