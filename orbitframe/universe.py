"""Atoms, bonds and frames of one system, held together."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitframe.functions import chemistry
from orbitframe.operators import selection, selection_text, topology
from orbitframe.sources import sections


@dataclass(frozen=True)
class Universe:
    """DataFrames of a system: atoms (atom_index ...), coords (frame_index, atom_index, x, y, z), bonds (atom1, atom2), boxes (frame_index, a ... gamma)."""

    atoms: DataFrame
    coords: DataFrame
    bonds: DataFrame | None = None
    boxes: DataFrame | None = None

    @classmethod
    def from_structure(cls, rows: DataFrame, bonds: DataFrame | None = None) -> Universe:
        """A system of one structure's rows (atom_index, name, x, y, z and what else there is).

        Missing columns are filled: resid 1, resname UNK, the chain or SYSTEM as segid, charge 0; the element is
        inferred from the type, else from the name, and the mass from the element (0 if unknown).
        """
        has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
        element = F.coalesce(has("element"), chemistry.infer_element(F.coalesce(has("atom_type"), has("name"), F.lit(""))))
        known = {"resid": F.coalesce(has("resid").cast("int"), F.lit(1)), "resname": F.coalesce(has("resname"), F.lit("UNK")), "segid": F.coalesce(has("segid"), has("chain_id"), F.lit("SYSTEM")), "chain_id": F.coalesce(has("chain_id"), F.lit("")), "charge": F.coalesce(has("charge").cast("double"), F.lit(0.0)), "element": element, "atom_type": has("atom_type"), "insertion_code": has("insertion_code"), "name": F.coalesce(F.nullif(has("name"), F.lit("")), F.lit("X"))}
        atoms = rows.withColumns(known).withColumn("mass", F.coalesce(has("mass").cast("double"), chemistry.element_mass(F.col("element"), rounded=True), F.lit(0.0)))
        coords = rows.select(F.lit(0).alias("frame_index"), "atom_index", *"xyz")
        return cls(atoms.drop(*"xyz"), coords, bonds)

    @classmethod
    def from_coordinates(cls, coords: DataFrame) -> Universe:
        """A system of a coordinate file's frames: the atoms of frame 0, named X where it has no names; other frames must hold as many."""
        first = cls.from_structure(coords.where("frame_index = 0").drop("frame_index"))
        places = sections.attach(first.atoms.select("atom_index"), coords.select("frame_index", "atom_index", *"xyz"))
        return replace(first, coords=places.select("frame_index", "atom_index", *"xyz"))

    @classmethod
    def from_topology(cls, atoms: DataFrame, coords: DataFrame, bonds: DataFrame | None = None, ids: bool = False) -> Universe:
        """A topology with the frames of a trajectory; each must hold its number of atoms and, with ``ids``, its ids."""
        met = sections.attach(atoms.select("atom_index", *(["id"] if ids else [])), coords, ids)
        return cls(atoms, met.select("frame_index", "atom_index", *"xyz"), bonds)

    def frame(self, index: int) -> DataFrame:
        """Atoms with their places in a frame; negative indices count from the last frame."""
        if index >= 0:
            chosen = self.coords.where(F.col("frame_index") == index)
        else:
            last = self.coords.agg((F.max("frame_index") + 1 + index).alias("frame_index"))  # one row
            chosen = self.coords.join(F.broadcast(last), "frame_index")
        return self.atoms.join(chosen.drop("frame_index"), "atom_index")

    def select(self, *chosen: Column | DataFrame | str, frame: int = 0, groups: Mapping[str, DataFrame] | None = None, among: DataFrame | None = None) -> DataFrame:
        """Atoms of a frame that meet all selections: Columns, sets of atom_index values, or texts.

        ``among`` holds the atom_index values of a group to select from; ``global`` in a text then means all atoms. Where
        groups are named too, a text that begins with ``global`` selects from these groups taken together.
        """
        everything = self.frame(frame)
        atoms = everything if among is None else everything.join(among, "atom_index", "left_semi")
        for c in chosen:
            if not isinstance(c, str):
                atoms = selection.select(atoms, c)
                continue
            whole = everything
            if among is not None and groups and selection_text.parse(c)[0] == "global":
                named = reduce(DataFrame.union, (g.select("atom_index") for g in groups.values()))
                whole = everything.join(named, "atom_index", "left_semi")
            atoms = selection_text.select(atoms, c, self.bonds, groups, whole)
        return atoms

    def bonded_to(self, inner: Column) -> DataFrame:
        if self.bonds is None:
            return self.atoms.limit(0).select("atom_index")
        return selection.bonded(self.atoms, self.bonds, inner)

    def residues(self) -> DataFrame:
        return topology.residue_table(self.atoms)

    def segments(self) -> DataFrame:
        return topology.segment_table(self.atoms)

    def residue_atoms(self, index: int, frame: int | None = None) -> DataFrame:
        """Atoms of a residue, by its number in the order of first atoms; with their places if a frame is named."""
        atoms = topology.residue_atoms(self.atoms, index)
        return atoms if frame is None else atoms.join(self.frame(frame).select("atom_index", *"xyz"), "atom_index")

    def segment_atoms(self, index: int) -> DataFrame:
        """Atoms of a segment, by its number in the order of first atoms."""
        chosen = self.segments().where(F.col("segment_index") == index).select(F.col("segid").alias("_segid"))  # at most one row
        return self.atoms.join(chosen, F.col("segid").eqNullSafe(F.col("_segid")), "left_semi")

    def with_frames(self, coords: DataFrame) -> Universe:
        """The system with more frames, numbered on from the last one."""
        last = self.coords.agg(F.coalesce(F.max("frame_index"), F.lit(-1)).alias("_last"))  # one row
        new = coords.join(F.broadcast(last)).withColumn("frame_index", (F.col("frame_index") + F.col("_last") + 1).cast("int")).drop("_last")
        return replace(self, coords=self.coords.unionByName(new))
