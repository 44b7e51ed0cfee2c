"""Sums of line weights in blocks, against pairs as rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kernelfield.functions.kernels import Kernel, with_line_weight
from kernelfield.operators import aggregate as A
from kernelfield.operators import contacts as C
from kernelfield.operators import grid as G
from kernelfield.operators import lines as L
from kernelfield.operators.fields import Fields
from kernelfield.operators.neighbours import match
from kernelfield.plans import fixtures

SF = "/root/testdata/sf0.001"
BOX = fixtures.LATTICE
PLANE = G.lattice("xz", {"x": (0.2, 0.8), "z": (0.1, 0.9)}, 0.2, {"y": 0.4})


def _directed(spark, n=400):
    """Contacts of two steps and phases, some on nodes, beyond the lattice, or with nulls."""
    r = np.random.default_rng(5)
    rows = [(int(i % 2), int(i % 3) + 1 if i % 50 else None, *map(float, r.random(3) * 1.4 - 0.2), *map(float, r.random(6) - 0.5)) for i in range(n)]
    rows[0] = (0, 1, 0.0, 0.1, 0.2, *rows[0][5:])
    rows[1] = (1, 2, *rows[1][2:5], None, *rows[1][6:])
    rows[2] = (0, 2, *rows[2][2:8], None, *rows[2][9:])
    rows[3] = (0, 2, None, *rows[3][3:])
    return spark.createDataFrame(rows, "t int, phase int, x double, y double, z double, bx double, by double, bz double, fx double, fy double, fz double")


def _table(df, names):
    return {(r["t"], r["node"], r["phase"]): [r[n] for n in names] for r in df.collect()}


@pytest.mark.parametrize("grid", [BOX, PLANE], ids=["box", "plane"])
@pytest.mark.parametrize("kernel", [Kernel("Lucy", 0.2), Kernel("Gaussian", 0.3), Kernel("HeavySide", 0.2), Kernel("Lucy", 0.25, "exact")], ids=lambda k: f"{k.name}-{k.mode}")
def test_line_sums_equal_sums_of_pairs(spark, grid, kernel):
    rows = _directed(spark)
    r, b = (tuple(F.col(f"{k}{a}") for a in "xyz") for k in "rb")
    pairs = with_line_weight(match(rows, grid, kernel.c), kernel.name, kernel.mode, kernel.literals, r, b, "wint")
    values = {"one": F.lit(1.0), "fx": F.col("fx"), "fy": F.col("fy") * F.col("bz")}
    want = _table(A.grouped(pairs, {k: F.col("wint") * v for k, v in values.items()}, True), ["n_pairs", *values])
    got = _table(L.line_sums(rows, grid, kernel, values, True), ["n_pairs", *values])
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert [x is None for x in got[k]] == [x is None for x in v] and [x for x in got[k] if x is not None] == pytest.approx([x for x in v if x is not None], rel=1e-9, abs=1e-9), k
    most = {r["node"]: r["m"] for r in pairs.groupBy("node").agg(F.max("wint").alias("m")).collect()}
    bulk = L.line_sums(rows, grid, kernel, {}, False).groupBy("node").agg(F.max("largest").alias("m")).collect()
    assert {r["node"]: pytest.approx(r["m"], abs=1e-9) for r in bulk} == most


def test_sums_of_a_large_lattice_leave_at_once(monkeypatch):
    """What is not kept between runs is the same in sum."""
    r = np.random.default_rng(1)
    block = pa.record_batch({"t": np.zeros(300, np.int32), "phase": np.arange(300, dtype=np.int32) % 2, "whole": np.ones(300, bool), **{c: r.random(300) for c in ("x", "y", "z", "bx", "by", "bz", "s0")}})

    def total():
        sums, found = L._Sums(BOX.size, 1), {}
        for rows in [*L._block(sums, block, BOX, Kernel("Lucy", 0.2)), *sums.rows()]:
            for x in rows.to_pylist():
                key = x["phase"], x["node"]
                found[key] = found.get(key, 0) + x["s0"]
        return found

    kept = total()
    monkeypatch.setattr(L, "CELLS", 1 << 10)
    monkeypatch.setattr(L, "ONE", 0)
    at_once = total()
    assert kept.keys() == at_once.keys() and all(kept[k] == pytest.approx(at_once[k]) for k in kept)
    monkeypatch.setattr(L, "ONE", 1 << 25)
    monkeypatch.setattr(L, "KEPT", 0)
    assert total().keys() == kept.keys()


def test_pairs_of_contacts_are_no_rows(spark):
    p = fixtures.particles(spark, SF)
    f = Fields(p, BOX, Kernel("Lucy", 0.2), C.mapped(C.deduplicated(fixtures.contacts(spark, SF)), p))
    for rows in (f.contact, f.fabric, f.contact_weights):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "explode(sequence" not in plan


def test_contacts_are_dealt_three_times(spark):
    """For their numbers, by the smaller id and by the larger one; besides, rows of orders are counted and particles are dealt for each side."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = C.mapped(C.deduplicated(fixtures.contacts(spark, SF)), fixtures.particles(spark, SF))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 6
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_table_of_many_fields_takes_contacts_once(spark):
    """Its plan reads sums that are there, for the contact tensor, the fabric, and what follows from stress."""
    p = fixtures.particles(spark, SF)
    f = Fields(p, BOX, Kernel("Lucy", 0.2), C.mapped(C.deduplicated(fixtures.contacts(spark, SF)), p))
    rows = f.table(["contact_tensor", "fabric_tensor", "pressure", "frictional_coefficient"])
    assert "MapInArrow" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_particles_are_dealt_before_they_meet_nodes(spark):
    """One small file of particles is one task, but its pairs are not."""
    p = fixtures.particles(spark, SF)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert p.rdd.getNumPartitions() < n and Fields(p, BOX, Kernel("Lucy", 0.2)).pairs.rdd.getNumPartitions() == n
