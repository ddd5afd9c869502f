"""Measures of pairs, angles and torsions in every frame, and with periodic images, held against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitframe.functions.vectors import Box
from orbitframe.operators import blocks, neighbors, timeseries, topology
from orbitframe.plans import views as V

_QUERIES, _SQL = {}, {}
ORTHO = Box(*V.BOX)
BY = ("frame_index",)
_MET = "coords p join coords q on q.frame_index = p.frame_index and p.atom_index < q.atom_index"
_D2 = "(p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2"


def query(sql: str):
    def add(f):
        _QUERIES[f"frames_{f.__name__}"] = f
        _SQL[f"frames_{f.__name__}"] = f"{V.SQL} {sql}"
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _six(df, *columns):
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in columns})


def _close(pairs):
    return pairs.withColumn("distance", V.six("distance"))


def _image(v: str, size: float) -> str:
    return f"(({v}) - {size} * round(({v}) / {size}))"


def _images(*steps: str) -> str:
    return ", ".join(f"{_image(f'{b}.{c} - {a}.{c}', s)} as {n}{c}" for n, a, b in steps for c, s in zip("xyz", V.BOX))


@query(f"select p.frame_index, p.atom_index as i, q.atom_index as j, round(sqrt({_D2}), 6) + 0.0 as distance from {_MET} where {_D2} <= 0.64 and {_D2} > 0.01")
def pairs(spark, d):
    return _close(neighbors.self_pairs_within(V.coords(spark, d), 0.8, BY, lower=0.1))


@query(f"select p.frame_index, count(*) as n, round(sum(sqrt({_D2})), 4) as total from {_MET} group by 1")
def distance_arrays(spark, d):
    return blocks.distance_totals(V.coords(spark, d), BY).select("frame_index", "n", F.round("total", 4).alias("total"))


@query(f", h as (select p.frame_index, p.atom_index as i, q.atom_index as j, {_images(('d', 'p', 'q'))} from {_MET}) select frame_index, i, j, round(sqrt(dx ** 2 + dy ** 2 + dz ** 2), 6) + 0.0 as distance from h where dx ** 2 + dy ** 2 + dz ** 2 <= 0.49")
def periodic_pairs(spark, d):
    return _close(neighbors.self_pairs_within(V.coords(spark, d), 0.7, BY, ORTHO))


def _cell_sql(box: Box, cutoff: float) -> str:
    """Distances to the nearest image: every step along the second and third vector within reach, and the best one along the first."""
    v = box.vectors()
    reach = "(select * from (select unnest(range(-5, 6)) as sj), (select unnest(range(-5, 6)) as sk))"
    x, y, z = (f"q.x - p.x + sj * {v[1][0]!r} + sk * {v[2][0]!r}", f"q.y - p.y + sj * {v[1][1]!r} + sk * {v[2][1]!r}", f"q.z - p.z + sk * {v[2][2]!r}")
    return f", h as (select p.frame_index, p.atom_index as i, q.atom_index as j, {x} as dx, {y} as dy, {z} as dz from {_MET} cross join {reach}), g as (select frame_index, i, j, min((dx - {v[0][0]!r} * round(dx / {v[0][0]!r})) ** 2 + dy ** 2 + dz ** 2) as d2 from h where dy ** 2 + dz ** 2 <= {cutoff**2!r} group by 1, 2, 3) select frame_index, i, j, round(sqrt(d2), 6) + 0.0 as distance from g where d2 <= {cutoff**2!r}"


@query(_cell_sql(Box(*V.TILTED), 0.7))
def tilted_pairs(spark, d):
    return _close(neighbors.self_pairs_within(V.coords(spark, d), 0.7, BY, Box(*V.TILTED)))


@query(_cell_sql(Box(*V.ELONGATED), 0.7))
def elongated_pairs(spark, d):
    return _close(neighbors.self_pairs_within(V.coords(spark, d), 0.7, BY, Box(*V.ELONGATED)))


@query(_cell_sql(Box(*V.NEEDLE), 0.45))
def needle_pairs(spark, d):
    return _close(neighbors.self_pairs_within(V.coords(spark, d), 0.45, BY, Box(*V.NEEDLE)))


@query(f", b as (select p.frame_index, p.atom_index as i, q.atom_index as j from {_MET} where {_D2} <= 1) select frame_index, atom_index, count(*) as n from (select frame_index, i as atom_index from b union all select frame_index, j from b) group by 1, 2")
def contact_counts(spark, d):
    return blocks.contact_counts(V.coords(spark, d), 1.0, BY)


@query(f", b as (select p.frame_index, p.atom_index as i, q.atom_index as j from {_MET} where {_D2} <= 1), c as (select frame_index, i, j from b union all select frame_index, j, i from b) select frame_index, i as atom_index, cast(1 + j // 32768 as bigint) as bucket, count(*) as n, cast(min(j) as bigint) as first from c group by all")
def contact_bitmaps(spark, d):
    return neighbors.contact_buckets(V.coords(spark, d), 1.0, BY)


@query("select p.frame_index, q.atom_index, min(p.atom_index) as center from coords p join coords q using (frame_index) join atoms a on a.atom_index = p.atom_index where a.resid in (2, 9) and (p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2 <= 2.25 group by 1, 2")
def neighbors_of_residues(spark, d):
    every = V.coords(spark, d).join(V.atoms(spark, d).select("atom_index", "resid"), "atom_index")
    return neighbors.neighbors(every, every.where("resid in (2, 9)"), 1.5, BY).select("frame_index", "atom_index", "center")


@query(", g as (select p.frame_index, cast(floor(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2) / 0.25) as bigint) as bin from coords p join coords q using (frame_index) where (p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2 < 2.25), b as (select unnest(range(0, 6)) as bin), f as (select distinct frame_index from coords) select f.frame_index, b.bin, count(g.bin) as n from f, b left join g on g.bin = b.bin and g.frame_index = f.frame_index group by 1, 2")
def radial_counts(spark, d):
    coords = V.coords(spark, d)
    return neighbors.radial_counts(coords, coords, 0.25, 1.5, BY).select("frame_index", "bin", "n")


_AT = "join coords {0} on {0}.atom_index = {1} and {0}.frame_index = p.frame_index"
_COS = "(ax * bx + ay * by_ + az * bz) / (sqrt(ax ** 2 + ay ** 2 + az ** 2) * sqrt(bx ** 2 + by_ ** 2 + bz ** 2))"
_TRIPLES = "t as (select f.b as first, f.a as center, l.b as last from edges f join edges l on f.a = l.a and f.b < l.b)"


def _angles(steps: str) -> str:
    return f", {_TRIPLES}, v as (select p.frame_index, first, center, last, {steps} from t join coords p on p.atom_index = first {_AT.format('c', 'center')} {_AT.format('q', 'last')}) select frame_index, first, center, last, round(acos(greatest(-1, least(1, {_COS}))), 6) + 0.0 as angle from v"


@query(_angles("p.x - c.x as ax, p.y - c.y as ay, p.z - c.z as az, q.x - c.x as bx, q.y - c.y as by_, q.z - c.z as bz"))
def angles(spark, d):
    return _six(topology.angles(V.bonds(spark, d), V.coords(spark, d), BY), "angle")


@query(_angles(_images(("a", "c", "p"), ("b", "c", "q")).replace("as by", "as by_")))
def periodic_angles(spark, d):
    return _six(topology.angles(V.bonds(spark, d), V.coords(spark, d), BY, ORTHO), "angle")


_QUADS = "t as (select e.b as first, m.a as second, m.b as third, g.b as last from edges m join edges e on e.a = m.a and e.b <> m.b join edges g on g.a = m.b and g.b <> m.a where m.a < m.b)"


def _torsions(steps: str) -> str:
    """Torsions by the angle of the planes' normals; first = last has a sign that rounding decides, so its size is compared."""
    return f""", {_QUADS}, v as (select p.frame_index, first, second, third, last, {steps} from t join coords p on p.atom_index = first {_AT.format('b', 'second')} {_AT.format('c', 'third')} {_AT.format('q', 'last')}),
n as (select *, ay * bz - az * by_ as px, az * bx - ax * bz as py, ax * by_ - ay * bx as pz, by_ * cz - bz * cy as qx, bz * cx - bx * cz as qy, bx * cy - by_ * cx as qz from v),
w as (select *, acos(greatest(-1, least(1, (px * qx + py * qy + pz * qz) / (sqrt(px ** 2 + py ** 2 + pz ** 2) * sqrt(qx ** 2 + qy ** 2 + qz ** 2))))) as a, ax * qx + ay * qy + az * qz as s from n)
select frame_index, first, second, third, last, round(abs(a), 5) + 0.0 as size, case when first <> last then s <= 0 end as positive from w"""


def _signed(found):
    sign = F.when(F.col("first") != F.col("last"), F.col("dihedral") >= 0)
    return found.select("frame_index", "first", "second", "third", "last", (F.round(F.abs("dihedral"), 5) + F.lit(0.0)).alias("size"), sign.alias("positive"))


@query(_torsions("b.x - p.x as ax, b.y - p.y as ay, b.z - p.z as az, c.x - b.x as bx, c.y - b.y as by_, c.z - b.z as bz, q.x - c.x as cx, q.y - c.y as cy, q.z - c.z as cz"))
def torsions(spark, d):
    return _signed(topology.dihedrals(V.bonds(spark, d), V.coords(spark, d), BY))


@query(_torsions(_images(("a", "p", "b"), ("b", "b", "c"), ("c", "c", "q")).replace("as by", "as by_")))
def periodic_torsions(spark, d):
    return _signed(topology.dihedrals(V.bonds(spark, d), V.coords(spark, d), BY, ORTHO))


@query(", o as (select s.frame, s.id, tau from states s, (select unnest(range(0, 4)) as tau) where s.frame % 2 = 0 and s.frame + tau <= (select max(frame) from states)), p as (select o.frame, o.tau, o.id, count(t.id) as k from o left join states t on t.id = o.id and t.frame between o.frame and o.frame + o.tau group by 1, 2, 3), f as (select frame, tau, avg(case when k = tau + 1 then 1.0::double else 0.0::double end) as share from p group by 1, 2) select tau, round(avg(share), 6) + 0.0 as survival from f group by 1")
def survival_by_steps(spark, d):
    got = timeseries.survival(V.states(spark, d), 3, step=2)
    return _six(got.select(F.col("tau").cast("long").alias("tau"), "survival"), "survival")
