"""Continuum fields of particles and contacts on a lattice, and which fields need which."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernelfield.functions import tensors as T
from kernelfield.functions.kernels import Kernel, with_weights
from kernelfield.operators import aggregate as A
from kernelfield.operators.gradient import finite_differences, least_squares
from kernelfield.operators.grid import AXES, Lattice
from kernelfield.operators.lines import line_sums
from kernelfield.operators.neighbours import match

#: What each field is computed from.
NEEDS = {
    "density_particle": ("volume_fraction", "density_mixture"),
    "velocity": ("momentum_density", "density_mixture"),
    "velocity_gradient": ("velocity",),
    "shear_rate_tensor": ("velocity_gradient",),
    "kinetic_tensor": ("velocity",),
    "fluctuation_tensor": ("velocity", "velocity_gradient"),
    "total_stress_tensor": ("kinetic_tensor", "contact_tensor"),
    "pressure": ("total_stress_tensor",),
    "inertial_number": ("shear_rate_tensor", "pressure", "density_particle", "d43", "d32"),
    "frictional_coefficient": ("total_stress_tensor", "pressure"),
    "granular_temperature": ("fluctuation_tensor", "density_mixture"),
}
FIELDS = (
    "volume_fraction density_mixture density_particle momentum_density velocity velocity_gradient kinetic_tensor contact_tensor total_stress_tensor pressure granular_temperature "
    "shear_rate_tensor inertial_number frictional_coefficient d43 d32 coordination_number coordination_number_without_rattlers fabric_tensor fluctuation_tensor"
).split()


def closure(wanted) -> set[str]:
    """The fields wanted and all that they need."""
    found: set[str] = set()
    todo = list(wanted)
    while todo:
        name = todo.pop()
        if name not in FIELDS:
            raise ValueError(f"unknown field {name!r}")
        if name not in found:
            found.add(name)
            todo += NEEDS.get(name, ())
    return found


def needs_contacts(wanted, counted: bool) -> bool:
    """Whether any field wanted comes from contacts; counted: particles bring their number of contacts."""
    every = closure(wanted)
    return bool(every & {"contact_tensor", "fabric_tensor", "coordination_number_without_rattlers"}) or "coordination_number" in every and not counted


def settled(rows: DataFrame) -> DataFrame:
    """rows, computed and kept now. A plan that holds a step in Python twice gives each its own columns, so that it would not find what persist() alone keeps, and compute it for every reader."""
    session, kept = rows.sparkSession, rows.persist()
    return DataFrame(session._jsparkSession.createDataFrame(kept._jdf.toJavaRDD(), kept._jdf.schema()), session)


@dataclass(frozen=True)
class Fields:
    """Lazy field tables: each property is a DataFrame keyed by t, node, phase (0: bulk).

    particles: t, id, x, y, z, vx, vy, vz, diameter, density, volume, mass, phase (from 1) [, coordination];
    directed: mapped contacts; phases: phase, diameter, density, for polydisperse inertial numbers.
    """

    particles: DataFrame
    grid: Lattice
    kernel: Kernel
    directed: DataFrame | None = None
    phases: int = 0
    phase_table: DataFrame | None = None
    gradient_method: str = "finite_difference"
    lsq_mode: str = "corrected"

    @property
    def keys(self) -> DataFrame:
        return A.steps(self.particles, self.phases)

    @property
    def bulk_keys(self) -> DataFrame:
        return A.steps(self.particles)

    @cached_property
    def pairs(self) -> DataFrame:
        k = self.kernel
        # a particle meets many nodes: files of few bytes must not be read by a few tasks alone
        n = int(self.particles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return with_weights(match(self.particles.repartition(n, "id"), self.grid, k.c), k.name, k.mode, k.literals, {"w": F.col("dist")})

    def _line_sums(self, values: dict, phased: bool) -> DataFrame:
        return line_sums(self.directed, self.grid, self.kernel, values, phased)

    @cached_property
    def contact_weights(self) -> DataFrame:
        """t, node, n_pairs, total and largest line weight of the nodes that contacts reach."""
        return self._line_sums({"total": F.lit(1.0)}, False)

    @cached_property
    def base(self) -> DataFrame:
        """rho, phi, p_x..z, d43, d32 and, if particles have it, coordination_number."""
        w, m, d = F.col("w"), F.col("mass"), F.col("diameter")
        sums = A.scalar_sums(w, {"rho": m, "phi": F.col("volume"), "s2": d * d, "s3": d * d * d, "s4": d * d * d * d, "sw": F.lit(1.0)})
        sums |= A.vector_sums("p", w, tuple(F.col(f"v{a}") for a in AXES), m)
        if "coordination" in self.particles.columns:
            sums["scn"] = w * F.col("coordination")
        whole = A.completed(A.grouped(self.pairs, sums, self.phases > 0), self.grid, self.keys)
        out = whole.withColumns({"d43": A.guarded(F.col("s4"), F.col("s3")), "d32": A.guarded(F.col("s3"), F.col("s2"))})
        if "scn" in sums:
            out = out.withColumn("coordination_number", A.guarded(F.col("scn"), F.col("sw")))
        return out.drop("s2", "s3", "s4", "sw", "scn")

    @cached_property
    def velocity(self) -> DataFrame:
        """base with density_particle and v_x..z, null where the density is 0."""
        v = {f"v_{a}": T.ratio(F.col(f"p_{a}"), F.col("rho")) for a in AXES}
        return self.base.withColumns(v | {"density_particle": T.ratio(F.col("rho"), F.col("phi"))})

    @cached_property
    def gradient(self) -> DataFrame:
        """t, node, v_a and g_ab of the bulk."""
        bulk = self.velocity.where("phase = 0").select("t", "node", "phase", "ix", "iy", "iz", *[f"v_{a}" for a in AXES])
        if self.gradient_method == "finite_difference":
            return finite_differences(bulk, self.grid).drop("phase")
        if self.gradient_method != "least_squares":
            raise ValueError("the gradient method is 'finite_difference' or 'least_squares'")
        solved = least_squares(self.pairs, bulk, self.lsq_mode)
        rows = bulk.drop("phase").join(solved.withColumn("met", F.lit(True)), ["t", "node"], "left")
        return rows.withColumns({f"g_{p}": F.when(F.col("met").isNull(), F.lit(0.0)).otherwise(F.col(f"g_{p}")) for p in T.PAIRS}).drop("met")

    def _second_pass(self, sums: dict, nodes: DataFrame) -> DataFrame:
        near = self.pairs.select("t", "node", "phase", "mass", "w", *[f"v{a}" for a in AXES], *[f"r{a}" for a in AXES]).join(nodes.drop("ix", "iy", "iz"), ["t", "node"])
        return A.completed(A.grouped(near, sums, self.phases > 0), self.grid, self.keys)

    @cached_property
    def kinetic(self) -> DataFrame:
        """k_ab = sum m w v' (x) v', v' against the bulk velocity of the node."""
        nodes = self.velocity.where("phase = 0").select("t", "node", *[f"v_{a}" for a in AXES])
        off = tuple(F.col(f"v{a}") - F.col(f"v_{a}") for a in AXES)
        return self._second_pass(A.tensor_sums("k", F.col("mass"), off, off, F.col("w")), nodes)

    @cached_property
    def kinetic_and_fluctuation(self) -> DataFrame:
        """k_ab, and q_ab with velocities against the bulk velocity carried to the particle by the gradient."""
        off = {a: F.col(f"v{a}") - F.col(f"v_{a}") for a in AXES}
        carried = {a: F.col(f"v{a}") - (F.col(f"v_{a}") - F.col(f"g_{a}x") * F.col("rx") - F.col(f"g_{a}y") * F.col("ry") - F.col(f"g_{a}z") * F.col("rz")) for a in AXES}
        sums = A.tensor_sums("k", F.col("mass"), tuple(off.values()), tuple(off.values()), F.col("w"))
        sums |= A.tensor_sums("q", F.col("mass"), tuple(carried.values()), tuple(carried.values()), F.col("w"))
        return self._second_pass(sums, self.gradient)

    @cached_property
    def contact(self) -> DataFrame:
        """c_ab = sum wint F (x) branch."""
        sums = self.__dict__.get("contact_and_fabric")
        sums = self._line_sums(self._contact_values, self.phases > 0) if sums is None else sums.drop(*self._fabric_values)
        return A.completed(sums, self.grid, self.keys)

    @property
    def _contact_values(self) -> dict:
        return {f"c_{p}": F.col(f"f{p[0]}") * F.col(f"b{p[1]}") for p in T.PAIRS}

    @property
    def _fabric_values(self) -> dict:
        length = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))
        unit = {a: T.ratio(F.col(f"d{a}"), length) for a in AXES}
        return {f"fab_{p}": F.col("volume") * unit[p[0]] * unit[p[1]] for p in T.PAIRS}

    @cached_property
    def contact_and_fabric(self) -> DataFrame:
        """The sums of both in one pass over contacts; contact and fabric take them from here if it is there first."""
        return self._line_sums(self._contact_values | self._fabric_values, self.phases > 0)

    @cached_property
    def fabric(self) -> DataFrame:
        """fab_ab = sum wint volume l (x) l of the bulk, l the direction from centre to centre."""
        sums = self.__dict__.get("contact_and_fabric")
        sums = self._line_sums(self._fabric_values, False) if sums is None else sums.where("phase = 0").drop(*self._contact_values)
        return A.completed(sums, self.grid, self.bulk_keys)

    @cached_property
    def stress(self) -> DataFrame:
        """s_ab = kinetic + contact, with its magnitude, deviators, theirs, and pressures."""
        both = self._kinetic_source().select("t", "node", "phase", *[f"k_{p}" for p in T.PAIRS]).join(self.contact.select("t", "node", "phase", *[f"c_{p}" for p in T.PAIRS]), ["t", "node", "phase"])
        total = both.select("t", "node", "phase", *[(F.col(f"k_{p}") + F.col(f"c_{p}")).alias(f"s_{p}") for p in T.PAIRS])
        s = T.columns("s")
        xy = T.block(s, "xy")
        deviators = total.withColumns({f"sdev_{k}": v for k, v in T.deviator(s).items()} | {f"sdevxy_{k}": v for k, v in T.deviator(xy).items()})
        return deviators.withColumns(
            {
                "s_mag": T.magnitude(s, 0.5),
                "sdev_mag": T.magnitude(T.columns("sdev"), 0.5),
                "sdevxy_mag": T.magnitude(T.columns("sdevxy", "xy"), 0.5),
                "pressure_xyz": T.pressure(s),
                "pressure_xy": T.pressure(xy),
                **{f"pressure_{a}": F.col(f"s_{a}{a}") for a in AXES},
            }
        )

    def _kinetic_source(self) -> DataFrame:
        return self.__dict__.get("kinetic_and_fluctuation", self.kinetic)

    @cached_property
    def temperature(self) -> DataFrame:
        """granular_temperature_xyz, _x, _y, _z; 0 where the density is 0."""
        rows = self.kinetic_and_fluctuation.join(self.base.select("t", "node", "phase", "rho"), ["t", "node", "phase"])
        q, rho = T.columns("q"), F.col("rho")
        one = {"granular_temperature_xyz": A.guarded(T.trace(q), F.lit(3.0) * rho)} | {f"granular_temperature_{a}": A.guarded(q[a + a], rho) for a in AXES}
        return rows.select("t", "node", "phase", *[v.alias(k) for k, v in one.items()])

    @cached_property
    def shear(self) -> DataFrame:
        """e_ab, the shear rate of the bulk, its xy block, deviators (edev, edevxy) and magnitudes."""
        g = T.columns("g")
        rows = self.gradient.select("t", "node", *T.named(T.symmetric(g), "e"))
        e = T.columns("e")
        xy = T.block(e, "xy")
        dev = rows.withColumns({f"edev_{k}": v for k, v in T.deviator(e).items()} | {f"edevxy_{k}": v for k, v in T.deviator(xy).items()})
        return dev.withColumns(
            {
                "shear_rate_xy_mag": T.magnitude(xy, 2.0),
                "shear_rate_xyz_mag": T.magnitude(e, 2.0),
                "shear_rate_xy_dev_mag": T.magnitude(T.columns("edevxy", "xy"), 2.0),
                "shear_rate_xyz_dev_mag": T.magnitude(T.columns("edev"), 2.0),
            }
        )

    @cached_property
    def inertial(self) -> DataFrame:
        """inertial_number_Sxy_<pressure>_<diameter>: shear * d * sqrt(density) / sqrt |p|, 0 where p is 0. The bulk takes d and density from the fields, a phase from its own."""
        rows = self.stress.select("t", "node", "phase", "pressure_xyz", "pressure_xy", "pressure_y").join(self.velocity.select("t", "node", "phase", "d43", "d32", "density_particle"), ["t", "node", "phase"])
        rows = rows.join(self.shear.select("t", "node", "shear_rate_xy_mag"), ["t", "node"])
        if self.phases:
            rows = rows.join(self.phase_table.select("phase", F.col("diameter").alias("pd"), F.col("density").alias("pr")), "phase", "left")
        else:
            rows = rows.withColumns({"pd": F.lit(None).cast("double"), "pr": F.lit(None).cast("double")})
        own = F.col("phase") == 0
        out = []
        for size in ("d43", "d32"):
            d, density = F.when(own, F.col(size)).otherwise(F.col("pd")), F.when(own, F.col("density_particle")).otherwise(F.col("pr"))
            for p in ("xyz", "xy", "y"):
                root = F.sqrt(F.abs(F.col(f"pressure_{p}")))
                out.append(A.guarded(F.col("shear_rate_xy_mag") * d * F.sqrt(density), root).alias(f"inertial_number_Sxy_P{p}_{size}"))
        return rows.select("t", "node", "phase", *out)

    @cached_property
    def friction(self) -> DataFrame:
        """frictional_coefficient_<Dxy|Dxyz|01>_<pressure>; null where the pressure is 0."""
        over = {"Dxy": F.col("sdevxy_mag"), "Dxyz": F.col("sdev_mag"), "01": F.col("s_xy")}
        return self.stress.select("t", "node", "phase", *[T.ratio(v, F.col(f"pressure_{p}")).alias(f"frictional_coefficient_{k}_P{p}") for k, v in over.items() for p in ("xyz", "xy", "y")])

    def table(self, wanted) -> DataFrame:
        """One wide table of the fields wanted, with node coordinates."""
        need, wanted = closure(wanted), list(dict.fromkeys(wanted))
        if "coordination" in self.particles.columns and self.directed is not None:
            # counted from contacts: every pass over particles would deal and count all contacts again
            self.particles.persist()
        if "contact_tensor" in need and (len(need & {"contact_tensor", "fabric_tensor", "pressure", "frictional_coefficient", "inertial_number"}) > 1):
            self.__dict__["contact_and_fabric"] = settled(self.contact_and_fabric if "fabric_tensor" in need else self._line_sums(self._contact_values, self.phases > 0))
        # tables of nodes are small beside the pairs they are made of: those with several readers are kept
        for name, readers in (("velocity", 3), ("kinetic_and_fluctuation", 2 if "fluctuation_tensor" in need and "kinetic_tensor" in need else 1), ("contact", len(need & {"contact_tensor", "pressure", "frictional_coefficient", "inertial_number"})), ("stress", len(need & {"pressure", "frictional_coefficient", "inertial_number"}))):
            if readers > 1 and (name != "velocity" or len(need) > 4):
                self.__dict__[name] = getattr(self, name).persist()
        key = ["t", "node", "phase"]
        parts: list[tuple[DataFrame, list]] = []
        simple = {"volume_fraction": [F.col("phi").alias("volume_fraction")], "density_mixture": [F.col("rho").alias("density_mixture")], "density_particle": ["density_particle"], "momentum_density": [F.col(f"p_{a}").alias(f"momentum_density_{a}") for a in AXES], "velocity": [F.col(f"v_{a}").alias(f"velocity_{a}") for a in AXES], "d43": ["d43"], "d32": ["d32"], "coordination_number": ["coordination_number"]}
        some = [c for f in wanted for c in simple.get(f, [])]
        if "coordination_number_without_rattlers" in wanted:
            some.append(F.lit(None).cast("double").alias("coordination_number_without_rattlers"))
        base = self.velocity.select(*key, "ix", "iy", "iz", *some)
        if "velocity_gradient" in wanted:
            parts.append((self.gradient.select("t", "node", *[F.col(f"g_{p}").alias(f"velocity_gradient_{p}") for p in T.PAIRS]), key[:2]))
        if "fluctuation_tensor" in need and ("kinetic_tensor" in wanted or "fluctuation_tensor" in wanted):
            names = [(k, n) for k, n in (("k", "kinetic_tensor"), ("q", "fluctuation_tensor")) if n in wanted]
            parts.append((self.kinetic_and_fluctuation.select(*key, *[F.col(f"{k}_{p}").alias(f"{n}_{p}") for k, n in names for p in T.PAIRS]), key))
        elif "kinetic_tensor" in wanted:
            parts.append((self.kinetic.select(*key, *[F.col(f"k_{p}").alias(f"kinetic_tensor_{p}") for p in T.PAIRS]), key))
        if "contact_tensor" in wanted:
            parts.append((self.contact.select(*key, *[F.col(f"c_{p}").alias(f"contact_tensor_{p}") for p in T.PAIRS]), key))
        if "fabric_tensor" in wanted:
            parts.append((self.fabric.select("t", "node", *[F.col(f"fab_{p}").alias(f"fabric_tensor_{p}") for p in T.PAIRS]), key[:2]))
        if "total_stress_tensor" in wanted or "pressure" in wanted:
            cols = []
            if "total_stress_tensor" in wanted:
                cols += [F.col(f"s_{p}").alias(f"total_stress_tensor_xyz_{p}") for p in T.PAIRS] + [F.col(f"sdev_{p}").alias(f"total_stress_tensor_xyz_dev_{p}") for p in T.PAIRS] + [F.col(f"sdevxy_{p}").alias(f"total_stress_tensor_xy_dev_{p}") for p in ("xx", "xy", "yx", "yy")]
                cols += [F.col("s_mag").alias("total_stress_tensor_xyz_mag"), F.col("sdev_mag").alias("total_stress_tensor_xyz_dev_mag"), F.col("sdevxy_mag").alias("total_stress_tensor_xy_dev_mag")]
            if "pressure" in wanted:
                cols += [f"pressure_{x}" for x in ("xyz", "xy", "x", "y", "z")]
            parts.append((self.stress.select(*key, *cols), key))
        if "granular_temperature" in wanted:
            parts.append((self.temperature, key))
        if "shear_rate_tensor" in wanted:
            cols = [F.col(f"e_{p}").alias(f"shear_rate_tensor_xy_{p}") for p in ("xx", "xy", "yx", "yy")] + [F.col(f"edevxy_{p}").alias(f"shear_rate_tensor_xy_dev_{p}") for p in ("xx", "xy", "yx", "yy")]
            cols += [F.col("shear_rate_xy_mag").alias("shear_rate_tensor_xy_mag"), F.col("shear_rate_xy_dev_mag").alias("shear_rate_tensor_xy_dev_mag")]
            if len(self.grid.axes) == 3:
                cols += [F.col(f"e_{p}").alias(f"shear_rate_tensor_xyz_{p}") for p in T.PAIRS] + [F.col(f"edev_{p}").alias(f"shear_rate_tensor_xyz_dev_{p}") for p in T.PAIRS]
                cols += [F.col("shear_rate_xyz_mag").alias("shear_rate_tensor_xyz_mag"), F.col("shear_rate_xyz_dev_mag").alias("shear_rate_tensor_xyz_dev_mag")]
            parts.append((self.shear.select("t", "node", *cols), key[:2]))
        if "inertial_number" in wanted:
            parts.append((self.inertial, key))
        if "frictional_coefficient" in wanted:
            parts.append((self.friction, key))
        for part, on in parts:
            base = base.join(part, on)
        _, places = self.grid._columns()
        return base.withColumns(places)


def bulk_fabric(directed: DataFrame) -> DataFrame:
    """Per step the mean of l (x) l - 1/3 over directed contacts."""
    length = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))
    rows = directed.withColumn("len", length).withColumns({f"l{a}": T.ratio(F.col(f"d{a}"), F.col("len")) for a in AXES})
    return rows.groupBy("t").agg(*[(F.avg(F.col(f"l{p[0]}") * F.col(f"l{p[1]}")) - F.lit(1.0 / 3.0 if p[0] == p[1] else 0.0)).alias(f"fabric_{p}") for p in T.PAIRS])
