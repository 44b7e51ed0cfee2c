"""DuckDB SQL for the registered queries: joins by brute force, written apart from the engine's plans."""

from __future__ import annotations

import math

from kernelfield.functions.kernels import Kernel
from kernelfield.plans import fixtures as X

AXES = "xyz"
PAIRS = [a + b for a in AXES for b in AXES]


def lit(x: float) -> str:
    """A double in Spark and DuckDB."""
    r = repr(float(x))
    return r if "e" in r else f"{r}e0"


def rnd(sql: str, name: str, digits: int = 9) -> str:
    return f"round({sql}, {digits}) + 0e0 AS {name}"


def gaussian_norm(c: float, n: int = 200_000) -> float:
    """One over the integral of the Gaussian of width c / 3 over a ball of radius c, by Simpson's rule."""
    w, h = c / 3.0, c / n
    return 1.0 / sum(h / 3.0 * (1 if i in (0, n) else 4 if i % 2 else 2) * 4.0 * math.pi * (i * h) ** 2 * math.exp(-((i * h) ** 2) / (2.0 * w * w)) for i in range(n + 1))


def kernel_at(k: Kernel, r: str) -> str:
    c = lit(k.c)
    if k.name == "Lucy":
        u = f"(({r}) / {c})"
        return f"CASE WHEN ({r}) > {c} THEN 0e0 ELSE 105e0/(16e0*pi()*power({c},3)) * (-3e0*{u}*{u}*{u}*{u} + 8e0*{u}*{u}*{u} - 6e0*{u}*{u} + 1e0) END"
    if k.name == "HeavySide":
        return f"CASE WHEN ({r}) < {c} THEN 1e0/(4e0/3e0*pi()*power({c},3)) ELSE 0e0 END"
    return f"CASE WHEN ({r}) > {c} THEN 0e0 ELSE {lit(gaussian_norm(k.c))} * exp(-(({r})*({r})) / (2e0*({c}/3e0)*({c}/3e0))) END"


def quantised(k: Kernel, r: str) -> str:
    """A thousand entries to the first figure of the cutoff, the first of them one step from 0."""
    step = f"(power(10, floor(log10({lit(k.c)})))/1000e0)"
    return f"({step} + least(floor(({r}) * (1e0/{step})), round({lit(k.c)}/{step}) - 1e0) * {step})"


def kernel(k: Kernel, r: str) -> str:
    return kernel_at(k, r if k.mode == "exact" else quantised(k, r))


LUCY = Kernel("Lucy", X.CUTOFF)


def particles(steps: int = 1) -> str:
    return f"p AS MATERIALIZED ({X.particles_sql(steps)})"


def grid(lattice=X.LATTICE) -> str:
    nx, ny, nz = lattice.counts
    places = ", ".join(f"{lit(o)} + i{a} * {lit(h)} AS g{a}" for a, o, h in zip(AXES, lattice.origin, lattice.spacing, strict=True))
    return f"g AS MATERIALIZED (SELECT (ix*{ny}+iy)*{nz}+iz AS node, ix, iy, iz, {places} FROM range({nx}) a(ix), range({ny}) b(iy), range({nz}) d(iz))"


def pairs(k: Kernel = LUCY, source: str = "p", name: str = "pairs", weight: bool = True) -> str:
    inner = f"SELECT s.*, node, ix, iy, iz, gx - s.x AS rx, gy - s.y AS ry, gz - s.z AS rz FROM {source} s CROSS JOIN g WHERE (gx-s.x)*(gx-s.x)+(gy-s.y)*(gy-s.y)+(gz-s.z)*(gz-s.z) <= {lit(k.c * k.c * 1.001)}"
    w = f", {kernel(k, 'dist')} AS w" if weight else ""
    return f"{name} AS MATERIALIZED (SELECT *{w} FROM (SELECT *, sqrt(rx*rx+ry*ry+rz*rz) AS dist FROM ({inner})) WHERE dist <= {lit(k.c)})"


def keys(phased: bool) -> str:
    phase = "range(4)" if phased else "range(1)"
    return f"keys AS MATERIALIZED (SELECT t, phase, g.* FROM (SELECT DISTINCT t FROM p), {phase} f(phase), g)"


def sums(name: str, source: str, items: dict[str, str], phased: bool = False) -> str:
    """Sums by node, with zeros for nodes without pairs only."""
    cols = ", ".join(f"sum({v}) AS {k}" for k, v in items.items())
    if phased:
        raw = f"SELECT t, node, CASE WHEN grouping(phase) = 1 THEN 0 ELSE phase END AS phase, count(*) AS n_pairs, {cols} FROM {source} GROUP BY GROUPING SETS ((t, node, phase), (t, node))"
    else:
        raw = f"SELECT t, node, 0 AS phase, count(*) AS n_pairs, {cols} FROM {source} GROUP BY t, node"
    filled = ", ".join(f"CASE WHEN n_pairs IS NULL THEN 0e0 ELSE {k} END AS {k}" for k in items)
    return f"{name} AS MATERIALIZED (SELECT k.t, k.node, k.phase, k.ix, k.iy, k.iz, coalesce(n_pairs, 0) AS n_pairs, {filled} FROM keys k LEFT JOIN ({raw}) q ON q.t = k.t AND q.node = k.node AND q.phase = k.phase)"


def base(phased: bool = False, extra: dict[str, str] | None = None, lattice=X.LATTICE, k: Kernel = LUCY) -> list[str]:
    items = {"rho": "w*mass", "phi": "w*volume", "px": "w*vx*mass", "py": "w*vy*mass", "pz": "w*vz*mass", "s2": "w*diameter*diameter", "s3": "w*diameter*diameter*diameter", "s4": "w*diameter*diameter*diameter*diameter", **(extra or {})}
    return [particles(), grid(lattice), keys(phased), pairs(k), sums("b", "pairs", items, phased)]


VELOCITY = "v AS MATERIALIZED (SELECT *, px/nullif(rho,0) AS vx, py/nullif(rho,0) AS vy, pz/nullif(rho,0) AS vz, rho/nullif(phi,0) AS dp, CASE WHEN s3=0 THEN 0 ELSE s4/s3 END AS d43, CASE WHEN s2=0 THEN 0 ELSE s3/s2 END AS d32 FROM b)"


def gradient(h: float = 0.1, n: int = 11, axes: str = AXES) -> str:
    cols = []
    for a in AXES:
        for b in AXES:
            v = f"v{a}"
            if b not in axes:
                cols.append(f"0e0 AS g{a}{b}")
                continue
            cols.append(f"CASE WHEN i{b} = 0 THEN (lead({v}) OVER w{b} - {v}) / {lit(h)} WHEN i{b} = {n - 1} THEN ({v} - lag({v}) OVER w{b}) / {lit(h)} ELSE (lead({v}) OVER w{b} - lag({v}) OVER w{b}) / {lit(2 * h)} END AS g{a}{b}")
    windows = ", ".join(f"w{b} AS (PARTITION BY t, {', '.join(f'i{x}' for x in AXES if x != b)} ORDER BY i{b})" for b in AXES)
    return f"gr AS MATERIALIZED (SELECT t, node, vx AS gvx, vy AS gvy, vz AS gvz, {', '.join(cols)} FROM v WHERE phase = 0 WINDOW {windows})"


def second(phased: bool = False) -> list[str]:
    off = {a: f"(v{a} - gv{a})" for a in AXES}
    car = {a: f"(v{a} - (gv{a} - g{a}x*rx - g{a}y*ry - g{a}z*rz))" for a in AXES}
    items = {f"k{p}": f"mass*w*{off[p[0]]}*{off[p[1]]}" for p in PAIRS} | {f"q{p}": f"mass*w*{car[p[0]]}*{car[p[1]]}" for p in PAIRS}
    return ["near AS MATERIALIZED (SELECT pairs.*, gvx, gvy, gvz, " + ", ".join(f"g{p}" for p in PAIRS) + " FROM pairs JOIN gr USING (t, node))", sums("kq", "near", items, phased)]


def contacts(periodic: bool = True, points: bool = False) -> list[str]:
    """c: deduplicated; d: both directions."""
    dedup = f"c0 AS MATERIALIZED ({X.contacts_sql()}), c AS MATERIALIZED (SELECT * FROM c0 QUALIFY row_number() OVER (PARTITION BY t, least(i,j), greatest(i,j) ORDER BY row_idx) = 1)"
    lengths = "l AS (SELECT t, " + ", ".join(f"max({a})-min({a}) AS l{a}" for a in AXES) + " FROM p GROUP BY t)"
    parts = []
    for side, a, b, sign in ((0, "a", "b", ""), (1, "b", "a", "-1e0*")):
        d = {x: f"({a}.{x}-{b}.{x})" for x in AXES}
        if periodic:
            d = {x: f"({v} - l{x}*round_even({v}/nullif(l{x},0), 0))" for x, v in d.items()}
        if points:
            br = {x: f"({a}.{x} - (a.{x}+b.{x})/2e0)" for x in AXES}
        else:
            br = {x: f"({v}*{a}.diameter/({a}.diameter+{b}.diameter))" for x, v in d.items()}
        cols = ", ".join(f"{a}.{x} AS {x}, {sign}c.f{x} AS f{x}, {br[x]} AS br{x}, {d[x]} AS d{x}" for x in AXES)
        parts.append(f"SELECT c.t, c.row_idx AS cid, {side} AS side, {a}.id AS id, {a}.volume AS volume, {a}.phase AS phase, {a}.diameter AS diameter, {cols} FROM c JOIN p a ON a.t=c.t AND a.id=c.i JOIN p b ON b.t=c.t AND b.id=c.j JOIN l ON l.t=c.t")
    return [dedup, lengths, "d AS MATERIALIZED (" + " UNION ALL ".join(parts) + ")"]


def contact_pairs(k: Kernel = LUCY) -> list[str]:
    s = [i * (1.0 / 9.0) for i in range(9)] + [1.0]
    samples = [kernel(k, f"sqrt((rx+{lit(x)}*brx)*(rx+{lit(x)}*brx)+(ry+{lit(x)}*bry)*(ry+{lit(x)}*bry)+(rz+{lit(x)}*brz)*(rz+{lit(x)}*brz))") for x in s]
    inner = " + ".join(f"({x})" for x in samples[1:-1])
    wint = f"((({samples[0]}) + ({samples[-1]})) * 0.5e0 + {inner}) * {lit(1.0 / (len(s) - 1))}"
    return [pairs(k, "d", "cp0", False), f"cp AS MATERIALIZED (SELECT *, {wint} AS wint FROM cp0)"]


def contact_sums(phased: bool = False) -> str:
    return sums("ct", "cp", {f"c{p}": f"wint*f{p[0]}*br{p[1]}" for p in PAIRS}, phased)


def query(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def mag(t: dict[str, str], axes: str, factor: float) -> str:
    diagonal = " + ".join(f"({t[a + a]})*({t[a + a]})" for a in axes)
    above = " + ".join(f"({t[a + b]})*({t[a + b]})" for i, a in enumerate(axes) for b in axes[i + 1 :])
    return f"sqrt({lit(factor)} * ({diagonal} + 2e0 * ({above})))"


def dev(t: dict[str, str], axes: str) -> dict[str, str]:
    tr = "(" + " + ".join(f"({t[a + a]})" for a in axes) + f") / {lit(len(axes))}"
    return {a + b: f"(({t[a + b]}) - ({tr}))" if a == b else f"({t[a + b]})" for a in axes for b in axes}


def stress(phased: bool = False) -> list[str]:
    """st: total stress s_ab with magnitudes and pressures."""
    chain = [*base(phased), VELOCITY, gradient(), *second(phased), *contacts(), *contact_pairs(), contact_sums(phased)]
    total = "s0 AS MATERIALIZED (SELECT t, node, phase, " + ", ".join(f"k{p} + c{p} AS s{p}" for p in PAIRS) + " FROM kq JOIN ct USING (t, node, phase))"
    s = {p: f"s{p}" for p in PAIRS}
    cols = [f"{mag(s, 'xyz', 0.5)} AS smag", f"{mag(dev(s, 'xyz'), 'xyz', 0.5)} AS sdev", f"{mag(dev(s, 'xy'), 'xy', 0.5)} AS sdevxy", "(sxx+syy+szz)/3e0 AS pxyz", "(sxx+syy)/2e0 AS pxy", "sxx AS p_x", "syy AS p_y", "szz AS p_z"]
    return [*chain, total, f"st AS MATERIALIZED (SELECT *, {', '.join(cols)} FROM s0)"]


def shear() -> str:
    e = {a + b: f"0.5e0 * (g{a}{b} + g{b}{a})" for a in AXES for b in AXES}
    inner = ", ".join(f"{v} AS e{p}" for p, v in e.items())
    t = {p: f"e{p}" for p in PAIRS}
    cols = [f"{mag(t, 'xy', 2.0)} AS mxy", f"{mag(t, 'xyz', 2.0)} AS mxyz", f"{mag(dev(t, 'xy'), 'xy', 2.0)} AS dxy", f"{mag(dev(t, 'xyz'), 'xyz', 2.0)} AS dxyz"]
    return f"sh AS MATERIALIZED (SELECT *, {', '.join(cols)} FROM (SELECT t, node, {inner} FROM gr))"


def lsq(mode: str) -> list[str]:
    a = ", ".join(f"sum(mass*w*r{x}*r{y}) AS a{x}{y}" for x in AXES for y in AXES)
    b = ", ".join(f"sum(mass*w*(nv{x}-v{x})*r{y}) AS b{x}{y}" for x in AXES for y in AXES)
    near = "ln AS MATERIALIZED (SELECT pairs.*, q.nvx, q.nvy, q.nvz FROM pairs JOIN (SELECT t, node, vx AS nvx, vy AS nvy, vz AS nvz FROM v WHERE phase = 0) q USING (t, node))"
    raw = f"ls AS MATERIALIZED (SELECT t, node, {a}, {b} FROM ln GROUP BY t, node)"
    det = "axx*(ayy*azz-ayz*azy) - axy*(ayx*azz-ayz*azx) + axz*(ayx*azy-ayy*azx)"
    inv = {}
    for i, x in enumerate(AXES):
        for j, y in enumerate(AXES):
            r, c = [q for k, q in enumerate(AXES) if k != j], [q for k, q in enumerate(AXES) if k != i]
            minor = f"(a{r[0]}{c[0]}*a{r[1]}{c[1]} - a{r[0]}{c[1]}*a{r[1]}{c[0]})"
            inv[x + y] = f"({'' if (i + j) % 2 == 0 else '-'}{minor}/nullif(det,0))"
    product = (lambda x, y: " + ".join(f"b{x}{k}*{inv[k + y]}" for k in AXES)) if mode == "corrected" else (lambda x, y: " + ".join(f"{inv[x + k]}*b{k}{y}" for k in AXES))
    edge = "1e-8" if mode == "reference" else "1e-12*pow((axx+ayy+azz)/3e0, 3)"
    cols = ", ".join(f"CASE WHEN q.node IS NULL THEN 0e0 WHEN bxx IS NOT NULL AND abs(det) <= {edge} THEN 0e0 ELSE {product(x, y)} END AS g{x}{y}" for x in AXES for y in AXES)
    return [near, raw, f"lg AS (SELECT k.t, k.node, {cols} FROM keys k LEFT JOIN (SELECT *, {det} AS det FROM ls) q ON q.t=k.t AND q.node=k.node)"]


def bands(low: float, high: float, dy: float, n: int = 5) -> str:
    count = 2 * n + 1
    planes = (
        f"pl AS MATERIALIZED (SELECT k*{count} + m - 1 AS i, k, m, {lit(low)} + k*{lit(dy)} - {lit(dy)}/2e0 + (m-1)*{lit(dy)}/{lit(2 * n)} AS zp, {lit(low)} + k*{lit(dy)} AS zk, (1e0 + cos(pi()*(m - {n + 1})/{lit(n)}))/2e0 AS wm"
        f" FROM range(1000000) AS a(k), range(1, {count + 1}) AS b(m) WHERE {lit(low)} + k*{lit(dy)} + {lit(dy)}/2e0 < {lit(high)} + {lit(dy)})"
    )
    half = lit(dy / (2 * n) / 2)
    ctes = [
        particles(),
        planes,
        "near AS MATERIALIZED (SELECT id, arg_min(i, struct_pack(d := abs(y - zp), i := i)) AS ni FROM p CROSS JOIN pl GROUP BY id)",
        f"met AS MATERIALIZED (SELECT p.*, pl.i, k, m, wm, {lit(3.141592653589793)} * greatest((diameter/2e0)*(diameter/2e0) - abs(zp-y)*abs(zp-y), 0e0) * density AS ar FROM p JOIN pl ON y + diameter/2e0 >= zp - {half} AND y - diameter/2e0 <= zp + {half})",
        "vel AS MATERIALIZED (SELECT i, " + ", ".join(f"CASE WHEN sum(ar)=0 THEN 0e0 ELSE sum(ar*v{a})/sum(ar) END AS u{a}" for a in AXES) + " FROM met GROUP BY i)",
        "o AS MATERIALIZED (SELECT met.*, " + ", ".join(f"v{a} - coalesce(u{a}, 0e0) AS o{a}" for a in AXES) + " FROM met JOIN near USING (id) LEFT JOIN vel ON vel.i = near.ni)",
        "pp AS MATERIALIZED (SELECT i, " + ", ".join(f"CASE WHEN sum(ar)=0 THEN 0e0 ELSE sum(ar*o{a}*o{a})/sum(ar) END AS tn{a}" for a in AXES) + ", sum(mass*(ox*ox+oy*oy+oz*oz))/(3e0*count(*)*avg(mass)) AS tl FROM o GROUP BY i)",
    ]
    cols = ", ".join(rnd(f"sum(wm*coalesce(tn{a},0e0))/sum(wm)", f"t_kamrin_{a}") for a in AXES) + ", " + ", ".join(rnd(f"sum(coalesce(tl,0e0))/{lit(2 * n + 1)}", f"t_lammps_{a}") for a in AXES)
    return query(ctes, f"SELECT 0 AS t, CAST(k AS INTEGER) AS k, round(zk, 9) + 0e0 AS z, {cols} FROM pl LEFT JOIN pp USING (i) GROUP BY k, zk")
