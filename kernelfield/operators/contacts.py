"""Preparation of contacts: deduplication, mapping to particles in both directions, branch vectors, coordination numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kernelfield.operators.grid import AXES


def deduplicated(contacts: DataFrame) -> DataFrame:
    """Of each unordered pair of a step the contact that comes first in the file (row_idx), with lo and hi, the ids in order.

    Rows are dealt by t and lo alone, so that mapped() finds the particle lo of each contact without dealing them again.
    """
    dealt = contacts.withColumns({"lo": F.least("i", "j"), "hi": F.greatest("i", "j")}).repartition("t", "lo")
    pair = Window.partitionBy("t", "lo", "hi").orderBy("row_idx")
    return dealt.withColumn("__n", F.row_number().over(pair)).where(F.col("__n") == 1).drop("__n")


def bounds(particles: DataFrame) -> DataFrame:
    """Per step x_min, x_max, ..., of the particle centres."""
    return particles.groupBy("t").agg(*[f(a).alias(f"{a}_{name}") for a in AXES for name, f in (("min", F.min), ("max", F.max))])


def minimum_image(d: Column, length: Column, periodic: bool) -> Column:
    return d - length * F.rint(F.try_divide(d, length)) if periodic else d


def mapped(contacts: DataFrame, particles: DataFrame, periodic: tuple[bool, bool, bool] = (False, False, False), point: dict[str, Column] | None = None) -> DataFrame:
    """Both directions of each contact, from the particle named first in that direction.

    t, cid, side, id, x, y, z (centre), fx..fz (force, reversed for side 1), bx..bz (branch vector), dx..dz (centre to centre), volume,
    phase. The branch goes from the centre to the contact point if contacts have one (cx..cz), else it is the part of the
    centre-to-centre vector that the diameters give. Periodic axes use the minimum image with the step's extent of centres as length.
    Contacts with a particle that is missing drop out. point gives contact points from the columns of both particles (i_x, j_x, ...).
    """
    kept = ["x", "y", "z", "diameter", "volume", "phase"]
    side = lambda s: particles.select(F.col("t").alias("t"), F.col("id").alias(s), *[F.col(k).alias(f"{s}_{k}") for k in kept])
    if "lo" not in contacts.columns:
        contacts = contacts.withColumns({"lo": F.least("i", "j"), "hi": F.greatest("i", "j")})
    # the smaller id first: contacts may be dealt by it already
    both = contacts.where(F.col("i").isNotNull() & F.col("j").isNotNull()).join(side("lo"), ["t", "lo"])
    # in as many parts as there may be: a contact meets many nodes, and small inputs would be merged into a few parts
    both = both.repartition(int(contacts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "t", "hi").join(side("hi"), ["t", "hi"])
    first = F.col("i") == F.col("lo")
    joined = both.withColumns({f"{s}_{k}": F.when(first, F.col(f"{a}_{k}")).otherwise(F.col(f"{b}_{k}")) for s, a, b in (("i", "lo", "hi"), ("j", "hi", "lo")) for k in kept})
    if point is not None:
        joined = joined.withColumns({f"c{a}": v for a, v in point.items()})
    has_point = "cx" in joined.columns
    if any(periodic):
        extent = bounds(particles).select("t", *[(F.col(f"{a}_max") - F.col(f"{a}_min")).alias(f"l{a}") for a in AXES])
        joined = joined.join(extent, "t")
    else:
        joined = joined.withColumns({f"l{a}": F.lit(0.0) for a in AXES})

    def one(a: str, b: str, sign: float) -> Column:
        fields = [F.lit(0 if sign > 0 else 1).alias("side"), F.col(a).alias("id"), F.col(f"{a}_volume").alias("volume"), F.col(f"{a}_phase").alias("phase")]
        for k, axis in enumerate(AXES):
            d = minimum_image(F.col(f"{a}_{axis}") - F.col(f"{b}_{axis}"), F.col(f"l{axis}"), periodic[k])
            branch = F.col(f"{a}_{axis}") - F.col(f"c{axis}") if has_point else d * F.col(f"{a}_diameter") / (F.col(f"{a}_diameter") + F.col(f"{b}_diameter"))
            fields += [F.col(f"{a}_{axis}").alias(axis), (F.lit(sign) * F.col(f"f{axis}")).alias(f"f{axis}"), branch.alias(f"b{axis}"), d.alias(f"d{axis}")]
        return F.struct(*fields)

    return joined.select("t", F.col("row_idx").alias("cid"), F.explode(F.array(one("i", "j", 1.0), one("j", "i", -1.0))).alias("s")).select("t", "cid", "s.*")


def coordination(contacts: DataFrame, particles: DataFrame) -> DataFrame:
    """t, id, coordination: contacts that touch each particle, 0 if none."""
    touched = contacts.select("t", F.explode(F.array("i", "j")).alias("id")).groupBy("t", "id").agg(F.count("*").alias("n"))
    return particles.select("t", "id").join(touched, ["t", "id"], "left").select("t", "id", F.coalesce("n", F.lit(0)).cast("bigint").alias("coordination"))


def without_rattlers(coordinated: DataFrame) -> DataFrame:
    """Particles with more than one contact."""
    return coordinated.where(F.col("coordination") > 1)


def mean_contact_diameter(directed: DataFrame, particles: DataFrame) -> DataFrame:
    """Per step the mean diameter over both sides of all contacts."""
    return directed.join(particles.select("t", "id", "diameter"), ["t", "id"]).groupBy("t").agg(F.avg("diameter").alias("mean_diameter"))
