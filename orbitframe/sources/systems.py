"""Whole systems from files and to files: atoms, bonds, cells and frames of one path or of a topology and its trajectory.

Kinds are told by the end of a path's name unless they are named. Lengths stay in the unit of their format.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitframe.sources import amber, gamess, gromacs, sections, structures, trajectory
from orbitframe.sources.sink import Section, write_sections
from orbitframe.universe import Universe

CELL = structures.CELL
_SUFFIXES = {"pdb": "pdb", "ent": "pdb", "xpdb": "pdb", "pdbqt": "pdbqt", "pqr": "pqr", "gro": "gro", "xyz": "xyz", "mol2": "mol2", "psf": "psf", "crd": "crd", "card": "crd", "prmtop": "prmtop", "parm7": "prmtop", "inpcrd": "inpcrd", "restrt": "inpcrd", "rst7": "inpcrd", "itp": "itp", "top": "itp", "data": "data", "dump": "dump", "lammpstrj": "dump", "mdcrd": "mdcrd", "trj": "mdcrd", "trc": "trc", "arc": "tinker", "txyz": "tinker", "config": "config", "history": "history", "in": "aims", "xml": "hoomd", "log": "gamess", "dcd": "dcd"}


def kind_of(path: str) -> str:
    """The kind of file that a path's name stands for."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    found = _SUFFIXES.get(name.rsplit(".", 1)[-1])
    if found is None:
        raise ValueError(f"no kind of file is known for {name!r}: name it")
    return found


def _tinker_bonds(spark: SparkSession, path: str) -> DataFrame:
    rows = sections.read_tinker(spark, path).where("frame_index = 0")
    other = rows.select("file", F.col("id").alias("partner"), F.col("atom_index").alias("j"))
    pairs = rows.select("file", F.col("atom_index").alias("i"), F.explode("partners").alias("partner")).join(other, ["file", "partner"])
    return pairs.select(F.least("i", "j").alias("atom1"), F.greatest("i", "j").alias("atom2")).where("atom1 < atom2").distinct()


def _data_bonds(spark: SparkSession, path: str) -> DataFrame:
    index = sections.read_lammps_data(spark, path).select("id", "atom_index")
    found = sections.read_lammps_bonds(spark, path)
    for k in "12":
        found = found.join(index.withColumnsRenamed({"id": f"id{k}", "atom_index": f"atom{k}"}), f"id{k}")
    return found.select("atom1", "atom2")


def _hoomd_bonds(spark: SparkSession, path: str) -> DataFrame:
    rows = sections.read_hoomd_groups(spark, path).where("frame_index = 0")
    return rows.select(F.get("members", F.lit(0)).alias("atom1"), F.get("members", F.lit(1)).alias("atom2"))


def _itp(of: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, path: of(gromacs.read_itp(spark, path))


#: Of each kind: its atoms, with their places where it has any, its bonds and its cells.
_TOPOLOGIES: dict[str, tuple[Callable, Callable | None, Callable | None]] = {
    "pdb": (structures.read_pdb, structures.read_pdb_bonds, structures.read_pdb_box),
    "pdbqt": (sections.read_pdbqt, None, structures.read_pdb_box),
    "pqr": (structures.read_pqr, None, None),
    "gro": (structures.read_gro, None, structures.read_gro_box),
    "xyz": (structures.read_xyz, None, None),
    "mol2": (sections.read_mol2_atoms, sections.read_mol2_bonds, sections.read_mol2_box),
    "psf": (sections.read_psf_atoms, structures.read_psf_bonds, None),
    "crd": (sections.read_crd, None, None),
    "prmtop": (amber.read_prmtop_atoms, amber.read_prmtop_bonds, None),
    "itp": (_itp(gromacs.system_atoms), _itp(gromacs.system_groups), None),
    "data": (sections.read_lammps_data, _data_bonds, sections.read_lammps_box),
    "tinker": (sections.read_tinker, _tinker_bonds, None),
    "aims": (sections.read_aims, None, sections.read_aims_box),
    "config": (sections.read_dlpoly_config, None, sections.read_dlpoly_box),
    "hoomd": (sections.read_hoomd_xml, _hoomd_bonds, sections.read_hoomd_box),
    "gamess": (gamess.read_gamess, None, None),
}
#: Of each kind of trajectory: its places and its cells.
_FRAMES: dict[str, tuple[Callable, Callable | None]] = {k: (v[0], v[2]) for k, v in _TOPOLOGIES.items() if k not in ("psf", "prmtop", "itp")} | {
    "inpcrd": (sections.read_inpcrd, sections.read_inpcrd_box),
    "dump": (sections.read_lammps_dump, sections.read_lammps_dump_box),
    "trc": (amber.read_gromos, amber.read_gromos_box),
    "history": (sections.read_dlpoly_history, sections.read_dlpoly_history_box),
    "dcd": (trajectory.read_frames, lambda spark, path: trajectory.read_frames(spark, path, cells=True)),
}


def _framed(rows: DataFrame) -> DataFrame:
    return rows if "frame_index" in rows.columns else rows.withColumn("frame_index", F.lit(0))


def _boxes(found: DataFrame) -> DataFrame:
    return _framed(found).select("frame_index", *CELL).where(" and ".join(f"{c} is not null" for c in CELL))


def read_system(spark: SparkSession, path: str, frames: str | None = None, kind: str | None = None, frames_kind: str | None = None) -> Universe:
    """The system of a structure file, or of a topology and the frames of another file.

    Each frame must hold the topology's atoms: as many, and for a LAMMPS data file with its dump the same ids, by which
    they meet. Cells come from the frames' file where it has any, else from the structure's. Labels that the file lacks
    are filled as ``Universe.from_structure`` does; a topology without frames has null places.
    """
    kind = kind or kind_of(path)
    if kind not in _TOPOLOGIES:
        raise ValueError(f"{kind} files hold no atoms to begin with: give them as frames")
    read, bonds, cells = _TOPOLOGIES[kind]
    rows = read(spark, path).drop("file")
    placed = "x" in rows.columns
    if not placed:
        rows = rows.withColumns({c: F.lit(None).cast("double") for c in "xyz"})
    first = rows.where("frame_index = 0").drop("frame_index") if "frame_index" in rows.columns else rows
    system = Universe.from_structure(first, bonds(spark, path).select("atom1", "atom2") if bonds else None)
    system = replace(system, boxes=_boxes(cells(spark, path)) if cells else None)
    if frames is None:
        own = _framed(rows).select("frame_index", "atom_index", *"xyz")
        return replace(system, coords=own)
    frames_kind = frames_kind or kind_of(frames)
    if frames_kind == "mdcrd":
        coords, cells = amber.read_mdcrd(spark, frames, system.atoms.count()), None
    elif frames_kind in _FRAMES:
        of, cells = _FRAMES[frames_kind]
        coords = of(spark, frames)
    else:
        raise ValueError(f"{frames_kind} files hold no frames")
    by_id = kind == "data" and frames_kind == "dump"
    met = Universe.from_topology(system.atoms, _framed(coords).select("frame_index", "atom_index", *(["id"] if by_id else []), *"xyz"), system.bonds, ids=by_id)
    return replace(met, boxes=_boxes(cells(spark, frames)) if cells else system.boxes)


def _box_lines(system: Universe, frame: int, form: str) -> DataFrame | None:
    if system.boxes is None:
        return None
    return system.boxes.where(F.col("frame_index") == frame).select(F.format_string(form, *(F.col(c) for c in CELL)).alias("value"))


def write_system(system: Universe, path: str, kind: str | None = None, frame: int = 0, title: str = "system") -> None:
    """One frame of a system as a folder of part files that this package's readers take for one file.

    Kinds: pdb, pdbqt, pqr (radius 0 where atoms have none), gro, xyz, crd (extended), psf, mol2, config, and history, which holds all frames. Atoms come in the order of their numbers, bonds (pdb, psf, mol2) by
    both of theirs, the frame's cell (pdb, pdbqt, gro, config, history) where there is one. What has no room in its columns is an error.
    """
    spark, kind = system.atoms.sparkSession, kind or kind_of(path)
    atoms = system.frame(frame)
    bonds = None if system.bonds is None else system.bonds.select(F.least("atom1", "atom2").alias("atom1"), F.greatest("atom1", "atom2").alias("atom2")).distinct()
    one = lambda *c: F.concat_ws(" ", *((F.col(x) + 1).cast("string") for x in c))
    by, both = ("atom_index",), ("atom1", "atom2")
    if kind == "pdb":
        parts = [Section(_box_lines(system, frame, "CRYST1%9.3f%9.3f%9.3f%7.2f%7.2f%7.2f P 1           1")), Section(structures.pdb_lines(atoms), by), Section(None if bonds is None else structures.conect_lines(bonds), both, tail=("END",))]
    elif kind == "gro":
        cell = _box_lines(system, frame, "%10.5f%10.5f%10.5f")
        parts = [Section(structures.gro_lines(atoms), by, head=(title, "{n}")), Section(cell, tail=() if cell is not None else ("   0.00000   0.00000   0.00000",))]
    elif kind == "pdbqt":
        cell = _box_lines(system, frame, "CRYST1%9.3f%9.3f%9.3f%7.2f%7.2f%7.2f P 1           1")
        parts = [Section(cell), Section(sections.pdbqt_lines(atoms), by, tail=("END",))]
    elif kind == "pqr":
        parts = [Section(structures.pqr_lines(atoms if "radius" in atoms.columns else atoms.withColumn("radius", F.lit(0.0))), by)]
    elif kind == "xyz":
        line = F.concat_ws(" ", "name", *(F.format_string("%.8f", F.col(c)) for c in "xyz"))
        parts = [Section(atoms.select("atom_index", line.alias("value")), by, head=("{n}", title))]
    elif kind == "crd":
        parts = [Section(sections.crd_lines(atoms, extended=True), by, head=(f"* {title}", "*", "{n}  EXT"))]
    elif kind == "psf":
        pairs = None if bonds is None else bonds.select(*both, one(*both).alias("value"))
        parts = [Section(sections.psf_lines(atoms), by, head=("PSF", "", "1 !NTITLE", title, "", "{n} !NATOM")), Section(pairs, both, head=("", "{n} !NBOND: bonds"))]
    elif kind == "mol2":
        pairs = None if bonds is None else bonds.select(*both, F.concat_ws(" ", F.lit("1"), one(*both), F.lit("1")).alias("value"))
        parts = [Section(sections.mol2_lines(atoms), by, head=("@<TRIPOS>MOLECULE", title, "{n0} {n1}", "SMALL", "USER_CHARGES", "@<TRIPOS>ATOM")), Section(pairs, both, head=("@<TRIPOS>BOND",))]
    elif kind in ("config", "history"):
        chosen = system.coords if kind == "history" else system.coords.where(F.col("frame_index") == frame)
        cells = None if system.boxes is None else system.boxes.join(chosen.select("frame_index").distinct(), "frame_index", "left_semi")
        lines = sections.dlpoly_lines(chosen.join(system.atoms.select("atom_index", "name"), "atom_index"), cells, kind == "history")
        parts = [Section(lines, ("frame_index", "part", "n"), head=(title, f"0 {0 if cells is None else 3} {{n}}"), entries="entries")]
    else:
        raise ValueError(f"{kind} files are not written")
    write_sections(spark, path, *parts)
