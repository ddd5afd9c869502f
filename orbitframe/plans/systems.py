"""Queries of whole systems: topologies and frames paired by id, groups taken together, residues and fragments at any shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitframe.functions import chemistry, units
from orbitframe.functions.vectors import cell_vectors, cell_volume, lattice_angles
from orbitframe.operators import neighbors, selection_text, topology
from orbitframe.plans import views as V
from orbitframe.universe import Universe

_QUERIES, _SQL = {}, {}


def query(sql: str):
    def add(f):
        _QUERIES[f"system_{f.__name__}"] = f
        _SQL[f"system_{f.__name__}"] = f"{V.SQL} {sql}"
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ids run against the atoms' order in the topology and are sorted in the frames, as a dump has them
_ID = "1000000007 - 3 * atom_index"


@query(f", c as (select frame_index, {_ID} as id, x, y, z from coords), a as (select {_ID} as id, atom_index, mass from atoms) select frame_index, atom_index, id, mass, round(x, 6) + 0.0 as x, round(y, 6) + 0.0 as y, round(z, 6) + 0.0 as z from c join a using (id)")
def paired_by_id(spark, d):
    atoms = V.atoms(spark, d).withColumn("id", F.expr(_ID))
    coords = V.coords(spark, d)
    last = coords.agg(F.max("atom_index").alias("last"))  # one row
    frames = coords.withColumn("id", F.expr(_ID)).join(F.broadcast(last)).withColumn("atom_index", F.col("last") - F.col("atom_index")).drop("last")
    u = Universe.from_topology(atoms, frames, ids=True)
    held = u.coords.join(u.atoms.select("atom_index", "id", "mass"), "atom_index")
    return held.select("frame_index", "atom_index", "id", "mass", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in "xyz"))


@query("select atom_index from placed where (name = 'CA' or resid % 7 = 0) and (name in ('CA', 'N'))")
def groups_together(spark, d):
    u = Universe(V.atoms(spark, d), V.coords(spark, d), V.bonds(spark, d))
    named = {"alphas": u.atoms.where("name = 'CA'").select("atom_index"), "sevenths": u.atoms.where("resid % 7 = 0").select("atom_index")}
    odd = u.atoms.where("resid % 2 = 1").select("atom_index")
    return u.select("global (group alphas or name N)", among=odd, groups=named).select("atom_index")


@query(", f as (select atom_index, resid, resname, case when resid is distinct from lag(resid) over w or resname is distinct from lag(resname) over w or atom_index <> lag(atom_index) over w + 1 then 1 else 0 end as new from atoms where atom_index % 50 <> 7 window w as (order by atom_index)), g as (select *, sum(new) over (order by atom_index) as r from f) select cast(r - min(r) over () as bigint) as residue_index, resid, resname, min(atom_index) as first_atom, count(*) as n_atoms from g group by r, resid, resname")
def residues_of_one_segment(spark, d):
    atoms = V.atoms(spark, d).withColumn("segid", F.lit("A")).where("atom_index % 50 <> 7")
    return topology.residue_table(atoms).select("residue_index", "resid", "resname", "first_atom", "n_atoms")


@query("select atom_index, case when atom_index % 3 = 1 then atom_index else 0 end as fragment from atoms")
def one_giant_fragment(spark, d):
    """Atoms 3, 6, 9 ... are bonded to atom 0, atoms 2, 5, 8 ... to the one two before; the others stand alone."""
    i = V.atoms(spark, d).select("atom_index")
    star = i.where("atom_index % 3 = 0 and atom_index > 0").select(F.lit(0).cast("long").alias("atom1"), F.col("atom_index").alias("atom2"))
    arms = i.where("atom_index % 3 = 2").select(F.col("atom_index").alias("atom1"), (F.col("atom_index") - 2).alias("atom2"))
    return topology.fragments(V.atoms(spark, d), star.union(arms))


# cells of the points' own sizes: one a frame
_CELLS = ", s as (select frame_index, max(x) - min(x) as a, max(y) - min(y) as b, max(z) - min(z) as c, 60.0::double + frame_index as alpha, 80.0::double as beta, 70.0::double as gamma from coords group by 1)"
_VOLUME = "a * b * c * sqrt(1 + 2 * cos(radians(alpha)) * cos(radians(beta)) * cos(radians(gamma)) - cos(radians(alpha)) ** 2 - cos(radians(beta)) ** 2 - cos(radians(gamma)) ** 2)"
_NAMES = ("a", "b", "c", "alpha", "beta", "gamma")


def _cells(spark, d):
    sizes = V.coords(spark, d).groupBy("frame_index").agg(*((F.max(c) - F.min(c)).alias(n) for n, c in zip("abc", "xyz")))
    return sizes.withColumns({"alpha": F.lit(60.0) + F.col("frame_index"), "beta": F.lit(80.0), "gamma": F.lit(70.0)})


@query(f"{_CELLS} select frame_index, round({_VOLUME}, 5) + 0.0 as volume from s")
def cell_volumes(spark, d):
    return _cells(spark, d).select("frame_index", (F.round(cell_volume(*map(F.col, _NAMES)), 5) + F.lit(0.0)).alias("volume"))


@query(f"{_CELLS} select frame_index, {', '.join(f'round({c}, 6) + 0.0 as {c}' for c in _NAMES)} from s")
def cells_by_their_vectors(spark, d):
    held = _cells(spark, d).select("frame_index", lattice_angles(*cell_vectors(*map(F.col, _NAMES))).alias("p"))
    return held.select("frame_index", *((F.round(F.col("p")[k], 6) + F.lit(0.0)).alias(c) for k, c in enumerate(_NAMES)))


@query("select atom_index, case element when 'N' then 14.007::double when 'C' then 12.011::double else 15.999::double end as mass, case segid when 'S0' then null else 1.008::double end as other from atoms")
def element_masses(spark, d):
    other = F.when(F.col("segid") == "S0", F.lit("QQ")).otherwise(F.lit("h"))
    return V.atoms(spark, d).select("atom_index", chemistry.element_mass(F.lower("element")).alias("mass"), chemistry.element_mass(other).alias("other"))


@query("select frame_index, atom_index, round(x * 4.184, 6) + 0.0 as energy, round(y * 8.314462159e-3, 9) + 0.0 as heat, round(z * 6.02214129e23 / 1e23, 5) + 0.0 as moles from coords")
def scaled_by_constants(spark, d):
    by = lambda c, name, digits, over=1.0: (F.round(F.col(c) * F.lit(units.constant(name)) / over, digits) + F.lit(0.0))
    return V.coords(spark, d).select("frame_index", "atom_index", by("x", "calorie", 6).alias("energy"), by("y", "Boltzmann_constant", 9).alias("heat"), by("z", "N_Avogadro", 5, 1e23).alias("moles"))


@query(", s as (select unnest([atom1, atom2]) as atom_index, unnest([0, 1]) as k, atom1 % 7 as o, atom1, atom2 from bonds), f as (select atom_index, min({'o': o, 'a': atom1, 'b': atom2, 'k': k}) as first from s group by 1) select cast(row_number() over (order by first) - 1 as bigint) as place, atom_index from f")
def unique_atoms(spark, d):
    """Atoms of bonds as they are first seen, bonds by their first atom modulo seven."""
    bonds = V.bonds(spark, d).withColumn("o", F.col("atom1") % 7)
    return topology.unique_atoms(bonds, ("atom1", "atom2"), ("o", "atom1", "atom2"))


# atoms of nucleotides under names that such residues have
_NUCLEOTIDE = ("P", "O5'", "C1'", "N9", "C4'")


@query(", n as (select atom_index, ['P', 'O5''', 'C1''', 'N9', 'C4'''][atom_index % 5 + 1] as name from atoms where resname in ('ADE', 'GUA')) select atom_index, name in ('P', 'O5''') as backbone, name in ('C1''', 'C4''') as sugar, name = 'N9' as base from n")
def nucleotide_parts(spark, d):
    name = F.get(F.array(*map(F.lit, _NUCLEOTIDE)), (F.col("atom_index") % 5).cast("int"))
    atoms = V.placed_atoms(spark, d).withColumn("name", name)
    part = lambda text: selection_text.select(atoms, text).select("atom_index", F.lit(True).alias(text))
    held = part("nucleic").select("atom_index")
    for text, column in (("nucleicbackbone", "backbone"), ("nucleicsugar", "sugar"), ("nucleicbase", "base")):
        held = held.join(part(text).withColumnRenamed(text, column), "atom_index", "left").withColumn(column, F.coalesce(column, F.lit(False)))
    return held


@query("select atom_index, name, resid, round(x, 6) + 0.0 as x from atoms join coords using (atom_index) where frame_index = 3 and resid = 8")
def atoms_of_a_residue(spark, d):
    u = Universe(V.atoms(spark, d), V.coords(spark, d), V.bonds(spark, d))
    return u.residue_atoms(7, frame=3).select("atom_index", "name", "resid", (F.round("x", 6) + F.lit(0.0)).alias("x"))


@query("select atom_index, segid from atoms where segid = 'S1'")
def atoms_of_a_segment(spark, d):
    return Universe(V.atoms(spark, d), V.coords(spark, d)).segment_atoms(1).select("atom_index", "segid")


@query("select distinct p.frame_index, unnest([p.atom_index, q.atom_index]) as atom_index from coords p join coords q on q.frame_index = p.frame_index and p.atom_index < q.atom_index where (p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2 <= 0.16")
def atoms_in_pairs(spark, d):
    return neighbors.paired_atoms(neighbors.self_pairs_within(V.coords(spark, d), 0.4, ("frame_index",)), ("frame_index",))
