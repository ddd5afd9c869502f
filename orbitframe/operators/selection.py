"""Atom selection as Columns and semi-joins.

Predicates on one atom are Columns; predicates on other atoms (around, same, byres, bonded) take the inner selection
as a Column and return the selected ``atom_index`` values as a DataFrame, to be combined by semi- and anti-joins.
"""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitframe.functions import chemistry as C
from orbitframe.functions.vectors import Vec, vec
from orbitframe.operators.neighbors import pairs_within

TOLERANCE = 1e-6


def matches(column: str, *patterns: str) -> Column:
    """Whether a label equals a literal or fits a glob (* ? [abc] [!x]); null labels never do. Literals alone push down."""
    if not patterns:
        raise ValueError("a selection by label needs a value")
    literal = [p for p in patterns if not set("*?[") & set(p)]
    globs = [p for p in patterns if set("*?[") & set(p)]
    c = F.col(column)
    out = c.isin(*literal) if literal else F.lit(False)
    for p in globs:
        body = re.sub(r"\(\?s:(.*)\)\\[zZ]$", r"\1", fnmatch.translate(p.replace("[^", "[!")))
        out = out | c.rlike(f"^(?s:{body})$")
    return F.coalesce(out, F.lit(False))


def within(column: str, *ranges: int | tuple[int, int], offset: int = 0) -> Column:
    """Membership in inclusive ranges; descending ranges are errors. ``offset`` 1 selects by one-based number."""
    out = F.lit(False)
    for r in ranges:
        low, high = (r, r) if isinstance(r, int) else r
        if low > high:
            raise ValueError(f"descending range {low}:{high}")
        out = out | (F.col(column) + offset).between(low, high)
    return out


def compare(column: str, op: str, value: float, absolute: bool = False) -> Column:
    """A coordinate comparison; == and != hold within 1e-6."""
    c = F.abs(F.col(column)) if absolute else F.col(column)
    tests = {"<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value, "==": F.abs(c - value) <= TOLERANCE, "!=": F.abs(c - value) > TOLERANCE}
    return tests[op]


def protein() -> Column:
    return F.col("resname").isin(*C.PROTEIN)


def backbone() -> Column:
    return protein() & F.col("name").isin(*C.BACKBONE)


def water() -> Column:
    return F.col("resname").isin(*C.WATER)


def nucleic() -> Column:
    return F.col("resname").isin(*C.NUCLEIC)


def nucleic_backbone() -> Column:
    return nucleic() & F.col("name").isin(*C.NUCLEIC_BACKBONE)


def nucleic_base() -> Column:
    return nucleic() & F.col("name").isin(*C.BASE)


def nucleic_sugar() -> Column:
    return nucleic() & F.col("name").isin(*C.SUGAR)


def atom(segid: str, resid: int, name: str) -> Column:
    return (F.col("segid") == segid) & (F.col("resid") == resid) & (F.col("name") == name)


def point(x: float, y: float, z: float, radius: float) -> Column:
    """Strictly within ``radius`` of a point."""
    return (vec() - Vec(F.lit(x), F.lit(y), F.lit(z))).norm_squared() < radius * radius


def around(atoms: DataFrame, radius: float, inner: Column, others: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Atoms outside ``inner`` strictly within ``radius`` of an atom of it, without periodic images, frame by frame of ``by``.

    Where ``inner`` is to be taken of other rows than the atoms', these are ``others``, and all atoms count as outside.
    """
    outside = atoms if others is not None else atoms.where(~inner)
    near = pairs_within(outside, (atoms if others is None else others).where(inner), radius, by, strict=True)
    return near.select(*by, F.col("i").alias("atom_index")).distinct()


def same(atoms: DataFrame, attribute: str, inner: Column, others: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Atoms that share an attribute with an atom of ``inner`` (of ``others``, if given); null equals null; numbers agree within 1e-6.

    ``residue`` stands for (resid, segid, insertion_code). Numbers meet in cells of twice the tolerance.
    """
    chosen = (atoms if others is None else others).where(inner)
    frame = [F.col(c).alias(f"_{c}") for c in by]
    if attribute in ("x", "y", "z", "mass", "charge"):
        width = 2 * TOLERANCE
        c = F.floor(F.col(attribute) / width)
        left = atoms.select(*by, "atom_index", F.col(attribute).alias("v"), c.alias("cell"))
        right = chosen.select(*frame, F.col(attribute).alias("w"), F.explode(F.array(c - 1, c, c + 1)).alias("cell")).distinct()
        on = [left[k] == right[f"_{k}"] for k in by] + [left.cell == right.cell, F.abs(left.v - right.w) <= TOLERANCE]
        return left.join(right, on, "left_semi").select(*by, "atom_index")
    keys = ["resid", "segid", "insertion_code"] if attribute == "residue" else [attribute]
    ref = chosen.select(*frame, *(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    on = [atoms[k] == ref[f"_{k}"] for k in by] + [atoms[k].eqNullSafe(ref[f"_{k}"]) for k in keys]
    return atoms.join(ref, on, "left_semi").select(*by, "atom_index")


def by_residue(atoms: DataFrame, inner: Column) -> DataFrame:
    """All atoms of residues (resid, segid, insertion_code) that an atom of ``inner`` is in; null equals null in each of the three."""
    return same(atoms, "residue", inner)


def bonded(atoms: DataFrame, bonds: DataFrame, inner: Column, others: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Atoms with a bond partner in ``inner`` (of ``others``, if given); none without bonds.

    Bonds may stand in either order and more than once; those with a null end, or an end that is no atom, join nothing.
    """
    ends = bonds.select(F.col("atom1").alias("a"), F.col("atom2").alias("b"))
    both = ends.union(ends.select("b", "a"))
    chosen = (atoms if others is None else others).where(inner).select(*by, F.col("atom_index").alias("b"))
    hit = chosen.join(both, "b").select(*by, F.col("a").alias("atom_index"))
    return atoms.join(hit, [*by, "atom_index"], "left_semi").select(*by, "atom_index")


def group(atoms: DataFrame, groups: dict[str, DataFrame], name: str) -> DataFrame:
    """Atoms of a named group of atom_index values; unknown names are errors before anything runs.

    Values that are null, repeated or no atom's change nothing; an empty group selects nothing.
    """
    if name not in groups:
        raise ValueError(f"unknown group {name!r}")
    return atoms.join(groups[name], "atom_index", "left_semi").select("atom_index")


def select(atoms: DataFrame, *chosen: Column | DataFrame) -> DataFrame:
    """Atoms that meet all selections, Columns or sets of atom_index values."""
    for c in chosen:
        atoms = atoms.where(c) if isinstance(c, Column) else atoms.join(c.select("atom_index").distinct(), "atom_index", "left_semi")
    return atoms
