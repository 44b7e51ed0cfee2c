"""Logical particle and contact tables from files with arrays of any name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernelfield.operators.grid import AXES


def _pick(df: DataFrame, keys: dict[str, str | None], logical: str, needed: bool = False) -> str | None:
    name = keys.get(logical)
    if name is None:
        if needed:
            raise ValueError(f"{logical} has no array")
        return None
    if name not in df.columns:
        raise ValueError(f"{logical}: there is no array {name!r}; there are {', '.join(df.columns)}")
    return name


def _parts(df: DataFrame, name: str, as_: str) -> list:
    """x, y, z of an array column or a struct column."""
    kind = df.schema[name].dataType.typeName()
    get = (lambda i, a: F.col(name)[i]) if kind == "array" else (lambda i, a: F.col(name)[a])
    return [get(i, a).cast("double").alias(f"{as_}{a}") for i, a in enumerate(AXES)]


def particles(df: DataFrame, keys: dict[str, str | None], position: str = "points", float32: bool = False) -> DataFrame:
    """t, id, x, y, z, vx, vy, vz, diameter, density, volume, mass [, coordination] from a table with t.

    keys maps Global_ID, Particle_Velocity, Particle_Diameter or Particle_Radius, Particle_Density, Particle_Volume, Particle_Mass,
    Coordination_Number to columns, or to None where there is none. float32 rounds inputs to single precision.
    """
    ident = _pick(df, keys, "Global_ID", True)
    size = _pick(df, keys, "Particle_Diameter")
    diameter = F.col(size) if size else None
    if diameter is None:
        radius = _pick(df, keys, "Particle_Radius")
        if radius is None:
            raise ValueError("Particle_Diameter or Particle_Radius is needed")
        diameter = F.col(radius) * 2
    cols = [F.col("t").cast("int").alias("t"), F.col(ident).cast("bigint").alias("id"), *_parts(df, position, "")]
    velocity = _pick(df, keys, "Particle_Velocity")
    cols += _parts(df, velocity, "v") if velocity else [F.lit(0.0).alias(f"v{a}") for a in AXES]
    cols.append(diameter.cast("double").alias("diameter"))
    for logical, name in (("Particle_Density", "density"), ("Particle_Volume", "volume"), ("Particle_Mass", "mass")):
        cols.append(F.col(_pick(df, keys, logical, True)).cast("double").alias(name))
    number = _pick(df, keys, "Coordination_Number")
    if number:
        cols.append(F.col(number).cast("bigint").alias("coordination"))
    out = df.select(*cols)
    return single_precision(out) if float32 else out


def contacts(df: DataFrame, keys: dict[str, str | None], layout: str = "point", order: str = "row_idx", float32: bool = False) -> DataFrame:
    """t, row_idx, i, j, fx, fy, fz [, cx, cy, cz]. layout 'cell': both ids are one array column, named by Particle_i_ID."""
    if layout not in ("point", "cell"):
        raise ValueError("layout is 'point' or 'cell'")
    first = _pick(df, keys, "Particle_i_ID", True)
    i, j = (F.col(first)[0], F.col(first)[1]) if layout == "cell" else (F.col(first), F.col(_pick(df, keys, "Particle_j_ID", True)))
    cols = [F.col("t").cast("int").alias("t"), F.col(order).cast("bigint").alias("row_idx"), i.cast("bigint").alias("i"), j.cast("bigint").alias("j"), *_parts(df, _pick(df, keys, "Force_ij", True), "f")]
    point = _pick(df, keys, "Contact_ij")
    if point:
        cols += _parts(df, point, "c")
    out = df.select(*cols)
    return single_precision(out) if float32 else out


def single_precision(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("float").cast("double").alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def merged(blocks: list[DataFrame]) -> DataFrame:
    """Blocks of one data set as one table; columns that a block lacks are null."""
    if not blocks:
        raise ValueError("there are no blocks")
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return out
