"""Particles and contacts derived from the part and lineitem tables by SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kernelfield.operators.grid import Lattice

LATTICE = Lattice((0.0, 0.0, 0.0), (0.1, 0.1, 0.1), (11, 11, 11))
CUTOFF = 0.2

PARTICLES = """
SELECT t, id, x, y, z, vx, vy, vz, phase, diameter, density,
       pi()/6*diameter*diameter*diameter AS volume,
       density*(pi()/6*diameter*diameter*diameter) AS mass
FROM (SELECT s.t AS t, p_partkey AS id,
        CAST((p_partkey*7919    + 17*s.t) % 1009 AS DOUBLE)/CAST(1009 AS DOUBLE) AS x,
        CAST((p_partkey*104729  + 17*s.t) % 1013 AS DOUBLE)/CAST(1013 AS DOUBLE) AS y,
        CAST((p_partkey*1299709 + 17*s.t) % 1019 AS DOUBLE)/CAST(1019 AS DOUBLE) AS z,
        CAST((p_partkey*31) % 201 - 100 AS DOUBLE)/CAST(100 AS DOUBLE) AS vx,
        CAST((p_partkey*37) % 199 -  99 AS DOUBLE)/CAST(100 AS DOUBLE) AS vy,
        CAST((p_partkey*41) % 197 -  98 AS DOUBLE)/CAST(100 AS DOUBLE) AS vz,
        p_size % 3 + 1 AS phase,
        CAST(2 + p_size % 3 AS DOUBLE)/CAST(200 AS DOUBLE) AS diameter,
        CAST(2500 + 250*(p_size % 3) AS DOUBLE) AS density
      FROM {part} CROSS JOIN (VALUES {steps}) AS s(t)) q
"""
#: Contacts are numbered in this order; Spark does so in runs of ORDERS orders.
ORDER, ORDERS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"], 4096
NUMBER = f"row_number() OVER (ORDER BY {','.join(ORDER)})"
CONTACTS = """
SELECT 0 AS t,
       {number} AS row_idx,
       l_partkey AS i, (l_partkey + l_suppkey*13 + l_linenumber) % n.n AS j,
       CAST(l_quantity-25 AS DOUBLE)/10 AS fx, CAST(l_discount AS DOUBLE)*100-5 AS fy, CAST(l_extendedprice-50000 AS DOUBLE)/10000 AS fz
FROM {lineitem} CROSS JOIN (SELECT count(*) AS n FROM {part}) n
""".replace("{number}", NUMBER)


def particles(spark: SparkSession, sf_dir: str, steps: int = 1) -> DataFrame:
    rows = ", ".join(f"({t})" for t in range(steps))
    return spark.sql(PARTICLES.replace("{steps}", rows), part=spark.read.parquet(f"{sf_dir}/part.parquet")).withColumn("phase", F.col("phase").cast("int"))


def contacts(spark: SparkSession, sf_dir: str, points: bool = False) -> DataFrame:
    """points: with contact points half-way between the centres."""
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("run", F.expr(f"l_orderkey div {ORDERS}"))
    # rows are numbered within runs of orders, and the rows before a run are counted: no task sorts them all
    sizes = lineitem.groupBy("run").agg(F.count("*").alias("size"))
    before = sizes.select("run", (F.sum("size").over(Window.orderBy("run")) - F.col("size")).alias("before"))
    within = F.row_number().over(Window.partitionBy("run").orderBy(*ORDER))
    numbered = lineitem.withColumn("within", within).join(F.broadcast(before), "run").withColumn("row_idx", F.col("before") + F.col("within"))
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = spark.sql(CONTACTS.replace(NUMBER, "row_idx"), lineitem=numbered, part=part)
    # a step that is a column, as in files: a literal would be folded out of the keys by which contacts are dealt, and they would be dealt twice more
    rows = rows.withColumn("t", F.expr("CAST(row_idx % 1 AS INT)"))
    if not points:
        return rows
    p = particles(spark, sf_dir)
    side = lambda s: p.select("t", F.col("id").alias(s), *[F.col(a).alias(f"{s}{a}") for a in "xyz"])
    both = rows.join(side("i"), ["t", "i"]).join(side("j"), ["t", "j"])
    return both.withColumns({f"c{a}": (F.col(f"i{a}") + F.col(f"j{a}")) / F.lit(2.0) for a in "xyz"}).drop(*[f"{s}{a}" for s in "ij" for a in "xyz"])


def particles_sql(steps: int = 1) -> str:
    return PARTICLES.replace("{steps}", ", ".join(f"({t})" for t in range(steps))).replace("{part}", "part")


def contacts_sql() -> str:
    return CONTACTS.replace("{lineitem}", "lineitem").replace("{part}", "part")


#: Two of four snapshot files, on the lattice of the other fixtures.
INI = """[paths]
particles_path = {folder}/snap_
contacts_path = {folder}/none_
output_path = {folder}/results/
[timesteps]
t0 = 1
tf = 3
dt = 2
[smoothing_function]
type = Lucy
[flags]
partialignore = True
[key_mapping]
Global_ID = Number
Particle_Velocity = Speed
Particle_Diameter = Diameter
Particle_Density = Density
Particle_Volume = Volume
Particle_Mass = Mass
Particle_Radius = None
Coordination_Number = None
[grid_info]
grid_dimension = 3
grid_axes = xyz
automatic_grid = False
x_min = 0
x_max = 1
y_min = 0
y_max = 1
z_min = 0
z_max = 1
x_transect = None
y_transect = None
z_transect = None
x_axis_periodic = False
y_axis_periodic = False
z_axis_periodic = False
[fields_to_export]
volume_fraction = True
density_mixture = True
velocity = False
granular_temperature_slices = False
[output_options]
h5_output = True
vkthdf_output = False
"""
