"""Bond graphs and the residue hierarchy: joins, windows and label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitframe.functions.vectors import Box, Vec, angle, dihedral, vec
from orbitframe.operators.numbering import numbered
from orbitframe.sources.checkpoints import ensure_checkpoints

RESIDUE = ("resid", "resname", "segid", "insertion_code")


def residues(atoms: DataFrame) -> DataFrame:
    """atoms with ``residue_start`` and ``residue_index``: a new residue wherever an atom's number does not follow that of the
    atom before, or (resid, resname, segid, insertion code) differ; residues are numbered by their first atoms.

    Atoms are dealt into ranges of their numbers. Each range is looked through by itself, with the last atom of the range
    before it; starts and counts of earlier ranges, a row a range, are added by a join. No label decides where an atom
    goes, so one segment may hold all of them. Nulls equal nulls; an empty table gives an empty result.
    """
    ensure_checkpoints(atoms.sparkSession)
    dealt = atoms.repartitionByRange("atom_index").withColumn("_range", F.spark_partition_id()).checkpoint()
    order, ranges = Window.partitionBy("_range").orderBy("atom_index"), Window.orderBy("_range")  # a row a range
    own = F.struct(F.col("atom_index").alias("i"), *RESIDUE)
    ends = dealt.groupBy("_range").agg(F.max_by(own, "atom_index").alias("_end")).select("_range", F.lag("_end").over(ranges).alias("_end"))
    met = dealt.join(ends, "_range").withColumn("_before", F.coalesce(F.lag(own).over(order), F.col("_end")))
    same = F.col("atom_index") == F.col("_before.i") + 1
    for k in RESIDUE:
        same = same & F.col(k).eqNullSafe(F.col(f"_before.{k}"))
    met = met.withColumn("_start", F.when(F.coalesce(same, F.lit(False)), None).otherwise(F.col("atom_index"))).drop("_before", "_end")
    earlier = ranges.rowsBetween(Window.unboundedPreceding, -1)
    sums = met.groupBy("_range").agg(F.max("_start").alias("_last"), F.count("_start").alias("_n"))
    carried = sums.select("_range", F.max("_last").over(earlier).alias("_last"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    found = met.join(carried, "_range").withColumns({"residue_start": F.coalesce(F.max("_start").over(upto), F.col("_last")), "residue_index": F.col("_n") + F.count("_start").over(upto) - 1})
    return found.drop("_range", "_start", "_last", "_n")


def residue_table(atoms: DataFrame) -> DataFrame:
    """(residue_index, resid, resname, segid, first_atom, n_atoms)."""
    held = residues(atoms)
    return held.groupBy("residue_index", "resid", "resname", "segid").agg(F.min("atom_index").alias("first_atom"), F.count("*").alias("n_atoms"))


def segment_table(atoms: DataFrame) -> DataFrame:
    """(segment_index, segid, n_atoms) in order of first atoms; a name that comes again is the same segment."""
    found = atoms.groupBy("segid").agg(F.min("atom_index").alias("first_atom"), F.count("*").alias("n_atoms"))
    return numbered(found, "first_atom", "segment_index").select("segment_index", "segid", "n_atoms")


def unique_bonds(bonds: DataFrame) -> DataFrame:
    """Undirected edges once each, as (atom1 < atom2)."""
    return bonds.select(F.least("atom1", "atom2").alias("atom1"), F.greatest("atom1", "atom2").alias("atom2")).where("atom1 <> atom2").distinct()


def add_bonds(bonds: DataFrame, new: DataFrame) -> DataFrame:
    """bonds with more of them, each undirected edge once; a bond of an atom with itself is left out."""
    return unique_bonds(bonds.select("atom1", "atom2").union(new.select("atom1", "atom2")))


def bonds_of(bonds: DataFrame, atom: int) -> DataFrame:
    """Bonds that contain an atom."""
    return bonds.where((F.col("atom1") == atom) | (F.col("atom2") == atom))


def residue_atoms(atoms: DataFrame, residue_index: int) -> DataFrame:
    """Atoms of a residue, by its number in the order of first atoms."""
    return residues(atoms).where(F.col("residue_index") == residue_index).select(atoms.columns)


def group_atoms(atoms: DataFrame, *columns: str) -> DataFrame:
    """(*columns, first_atom, n_atoms, atoms): atom numbers by any attributes, null being a value of its own."""
    grouped = atoms.groupBy(*columns).agg(F.min("atom_index").alias("first_atom"), F.count("*").alias("n_atoms"), F.sort_array(F.collect_list("atom_index")).alias("atoms"))
    return grouped


def update_positions(places: DataFrame, new: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """places with x, y, z replaced by those of ``new``; atoms without a new place, and places without an atom, are errors."""
    keys = [*by, "atom_index"]
    other = new.select(*(F.col(k).alias(f"_{k}") for k in keys), *(F.col(c).alias(f"_{c}") for c in "xyz"))
    met = places.join(other, [places[k] == other[f"_{k}"] for k in keys], "full")
    fine = F.col("atom_index").isNotNull() & F.col("_atom_index").isNotNull()
    put = {c: F.when(fine, F.col(f"_{c}")).otherwise(F.raise_error(F.lit("one new place for each atom is needed")).cast("double")) for c in "xyz"}
    return met.withColumns(put).select(places.columns)


def unique_atoms(groups: DataFrame, members: tuple[str, ...], order: tuple[str, ...] | None = None) -> DataFrame:
    """(place, atom_index): every atom of bonds, angles or other groups once, in the order they are first seen.

    Groups come in the order of ``order``, by default of their members; sorted by atom_index the result is the sorted
    list. Null members are passed over.
    """
    order = order or members
    key = F.struct(*order)
    seen = groups.select(F.posexplode(F.array(*members)).alias("_k", "atom_index"), key.alias("_key")).where("atom_index is not null")
    first = seen.groupBy("atom_index").agg(F.min(F.struct("_key", "_k")).alias("_first"))
    return numbered(first, "_first", "place").select("place", "atom_index")


def edges(bonds: DataFrame) -> DataFrame:
    """Both directions (a, b) of every bond, once."""
    return bonds.select(F.col("atom1").alias("a"), F.col("atom2").alias("b")).union(bonds.select("atom2", "atom1")).distinct()


def adjacency(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """(atom_index, neighbors): sorted partners of every atom, possibly none; bonds to missing atoms are left out."""
    known = atoms.select(F.col("atom_index").alias("b"))
    lists = edges(bonds).join(known, "b", "left_semi").groupBy("a").agg(F.sort_array(F.collect_list("b")).alias("neighbors"))
    return atoms.select("atom_index").join(lists, F.col("atom_index") == F.col("a"), "left").select("atom_index", F.coalesce("neighbors", F.array().cast("array<long>")).alias("neighbors"))


def _at(places: DataFrame, key: str, suffix: str, by: tuple[str, ...]) -> DataFrame:
    return places.select(*by, F.col("atom_index").alias(key), *(F.col(c).alias(c + suffix) for c in "xyz"))


def _step(a: str, b: str, box: Box | None) -> Vec:
    """From one place to another, to the nearest image if there is a box."""
    d = vec(suffix=b) - vec(suffix=a)
    return box.nearest(d) if box else d


def bond_lengths(bonds: DataFrame, places: DataFrame, by: tuple[str, ...] = (), box: Box | None = None) -> DataFrame:
    """(*by, atom1, atom2, length)."""
    met = _at(places, "atom1", "1", by).join(bonds.select("atom1", "atom2"), "atom1").join(_at(places, "atom2", "2", by), [*by, "atom2"])
    return met.select(*by, "atom1", "atom2", _step("1", "2", box).norm().alias("length"))


def angle_triples(bonds: DataFrame) -> DataFrame:
    """(first, center, last) with first < last for every pair of partners of an atom."""
    e = edges(bonds)
    left, right = e.select(F.col("a").alias("center"), F.col("b").alias("first")), e.select(F.col("a").alias("center"), F.col("b").alias("last"))
    return left.join(right, "center").where("first < last")


def angles(bonds: DataFrame, places: DataFrame, by: tuple[str, ...] = (), box: Box | None = None) -> DataFrame:
    """(*by, first, center, last, angle) in radians."""
    met = angle_triples(bonds).join(_at(places, "center", "2", by), "center").join(_at(places, "first", "1", by), [*by, "first"]).join(_at(places, "last", "3", by), [*by, "last"])
    return met.select(*by, "first", "center", "last", angle(_step("2", "1", box), _step("2", "3", box)).alias("angle"))


def dihedral_quads(bonds: DataFrame) -> DataFrame:
    """(first, second, third, last) around every bond second < third; first and last may be one atom in a ring of three."""
    e = edges(bonds)
    middle = unique_bonds(bonds).select(F.col("atom1").alias("second"), F.col("atom2").alias("third"))
    left, right = e.select(F.col("a").alias("second"), F.col("b").alias("first")), e.select(F.col("a").alias("third"), F.col("b").alias("last"))
    return middle.join(left, "second").where("first <> third").join(right, "third").where("last <> second")


def dihedrals(bonds: DataFrame, places: DataFrame, by: tuple[str, ...] = (), box: Box | None = None) -> DataFrame:
    """(*by, first, second, third, last, dihedral) in radians, cis at 0."""
    met = dihedral_quads(bonds).join(_at(places, "second", "2", by), "second")
    for key, suffix in (("first", "1"), ("third", "3"), ("last", "4")):
        met = met.join(_at(places, key, suffix, by), [*by, key])
    return met.select(*by, "first", "second", "third", "last", dihedral(*(_step(a, b, box) for a, b in ("12", "23", "34"))).alias("dihedral"))


#: A key with more rows than this is split before it is joined.
HUB = 1_000_000


def _with_least(pairs: DataFrame, hub: int) -> DataFrame:
    """(key, other, least): pairs with the smallest ``other`` of their key.

    The rows of a key beyond ``hub`` are dealt into parts, as many as the largest key needs; the least of each part
    meets the least of its key, a row a part, and then its part's rows.
    """
    most = pairs.groupBy("key").count().agg(F.max("count")).first()[0] or 0
    parts = -(-most // hub)
    if parts <= 1:
        return pairs.join(pairs.groupBy("key").agg(F.min("other").alias("least")), "key")
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("other"), F.lit(parts)))
    by_part = dealt.groupBy("key", "part").agg(F.min("other").alias("least"))
    by_key = by_part.groupBy("key").agg(F.min("least").alias("least"))
    return dealt.join(by_part.select("key", "part").join(by_key, "key"), ["key", "part"]).select("key", "other", "least")


def contract_stars(links: DataFrame, hub: int = HUB) -> DataFrame:
    """(high, low): every linked number with the smallest one of its component, which itself has no row.

    Large and small stars alternate: first every number hands its larger neighbours to its smallest neighbour, then its
    smaller ones and itself. Links only move downwards until each component is one star.
    """
    ensure_checkpoints(links.sparkSession)
    stars = links.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).where("high > low").distinct().checkpoint()
    while True:
        both = stars.select(F.col("high").alias("key"), F.col("low").alias("other")).union(stars.select("low", "high"))
        large = _with_least(both, hub).where("other > key").select(F.col("other").alias("high"), F.least("key", "least").alias("low")).distinct().checkpoint()
        down = _with_least(large.select(F.col("high").alias("key"), F.col("low").alias("other")), hub)
        small = down.select(F.col("key").alias("high"), F.col("least").alias("low")).union(down.where("other > least").select("other", "least"))
        stars = small.distinct().checkpoint()
        middle = stars.join(stars.select(F.col("high").alias("low")), "low", "left_semi").take(1)
        if not middle and not stars.groupBy("high").count().where("count > 1").take(1):
            return stars


def fragments(atoms: DataFrame, bonds: DataFrame, hub: int = HUB) -> DataFrame:
    """(atom_index, fragment): connected atoms by the smallest atom_index among them; bonds to missing atoms are left out.

    Components come from ``contract_stars``; checkpoints cut the lineage. Atoms without bonds are fragments of their own.
    """
    known = atoms.select(F.col("atom_index").alias("k"))
    e = unique_bonds(bonds).select(F.col("atom1").alias("a"), F.col("atom2").alias("b"))
    e = e.join(known, F.col("a") == F.col("k"), "left_semi").join(known, F.col("b") == F.col("k"), "left_semi")
    stars = contract_stars(e, hub).withColumnsRenamed({"high": "atom_index", "low": "fragment"})
    return atoms.select("atom_index").join(stars, "atom_index", "left").select("atom_index", F.coalesce("fragment", "atom_index").alias("fragment"))
