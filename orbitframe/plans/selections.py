"""Selections written as text over all frames, each with the SQL condition that it stands for."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitframe.operators import selection_text as T
from orbitframe.plans import views as V

_PROTEIN = "p.resname in ('ALA', 'GLY', 'SER', 'LYS', 'ASP', 'VAL')"
_NUCLEIC = "p.resname in ('ADE', 'GUA')"
_WATER = "p.resname in ('HOH', 'SOL')"
_SAME_FRAME = "exists (select 1 from every q where q.frame_index = p.frame_index and {})"
_NEAR = "(p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2 < {}"
_BONDED = "exists (select 1 from edges e join atoms q on e.b = q.atom_index where e.a = p.atom_index and {})"

#: name: (text, condition on a row ``p`` of atoms in all frames)
TEXTS = {
    "all": ("all", "true"),
    "none": ("none or index 3", "p.atom_index = 3"),
    "name": ("name C? or name 'N'", "p.name in ('CA', 'CB', 'N')"),
    "name_class": ("name [!C]*", "p.name in ('N', 'O')"),
    "resname": ("resname A[DL]* SOL", "p.resname in ('ALA', 'ADE', 'SOL')"),
    "element": ("not element C", "p.element <> 'C'"),
    "chain": ("chainID B D and segid S1 S2", "p.chain_id in ('B', 'D') and p.segid in ('S1', 'S2')"),
    "type": ("not type C O", "not coalesce(p.atom_type in ('C', 'O'), false)"),
    "resid": ("resid 3-9 20 30 to 33", "p.resid between 3 and 9 or p.resid = 20 or p.resid between 30 and 33"),
    "index": ("index 5:9 100", "p.atom_index between 5 and 9 or p.atom_index = 100"),
    "bynum": ("bynum 10:40", "p.atom_index + 1 between 10 and 40"),
    "prop": ("prop abs x < 1.5 and prop z >= -0.25 and not prop y == 0", "abs(p.x) < 1.5 and p.z >= -0.25 and not abs(p.y) <= 1e-6"),
    "protein": ("protein and not backbone", f"{_PROTEIN} and p.name = 'CB'"),
    "nucleic": ("nucleic and not nucleicbackbone", _NUCLEIC),
    "nucleic_parts": ("nucleicbase or nucleicsugar or water", _WATER),
    "precedence": ("name CA or name N and water", f"p.name = 'CA' or (p.name = 'N' and {_WATER})"),
    "point": ("point 0.5 0 -0.5 1.5", "(p.x - 0.5) ** 2 + p.y ** 2 + (p.z + 0.5) ** 2 < 2.25"),
    "around": ("around 0.9 water", f"not {_WATER} and " + _SAME_FRAME.format("q.resname in ('HOH', 'SOL') and " + _NEAR.format("0.81"))),
    "around_or": ("protein and (name CB or around 0.7 name O)", f"{_PROTEIN} and (p.name = 'CB' or (p.name <> 'O' and " + _SAME_FRAME.format("q.name = 'O' and " + _NEAR.format("0.49")) + "))"),
    "same_resname": ("same resname as index 12", "p.resname = (select resname from atoms where atom_index = 12)"),
    "same_type": ("same type as index 7", "p.atom_type is null"),
    "same_x": ("same x as resid 4", _SAME_FRAME.format("q.resid = 4 and abs(p.x - q.x) <= 1e-6")),
    "same_charge": ("same charge as name CA and index 0:30", "exists (select 1 from atoms q where q.name = 'CA' and q.atom_index between 0 and 30 and abs(p.charge - q.charge) <= 1e-6)"),
    "byres": ("byres prop x > 2.0", _SAME_FRAME.format("q.x > 2.0 and q.resid = p.resid and q.segid = p.segid")),
    "bonded": ("bonded name CA and not element N", _BONDED.format("q.name = 'CA'") + " and p.element <> 'N'"),
    "bonded_water": ("not bonded water", "not " + _BONDED.format("q.resname in ('HOH', 'SOL')")),
    "group": ("not group positive and name CA", "not p.charge > 0.1 and p.name = 'CA'"),
    "atom": ("atom S1 30 CA", "p.segid = 'S1' and p.resid = 30 and p.name = 'CA'"),
}


def _select(text: str):
    def run(spark, d):
        atoms = V.atoms(spark, d)
        every = atoms.join(V.coords(spark, d), "atom_index")
        groups = {"positive": atoms.where("charge > 0.1").select("atom_index")}
        return T.select(every, text, V.bonds(spark, d), groups, by=("frame_index",)).select("frame_index", "atom_index")

    return run


def _scoped(text: str):
    """Of the atoms of odd residues, or of all where the text begins with ``global``."""

    def run(spark, d):
        every = V.atoms(spark, d).join(V.coords(spark, d), "atom_index")
        return T.select(every.where(F.col("resid") % 2 == 1), text, everything=every, by=("frame_index",)).select("frame_index", "atom_index")

    return run


_EVERY = V.SQL + ", every as (select * from atoms join coords using (atom_index)) "
SCOPED = {
    "global": ("global name CA", "p.name = 'CA'"),
    "around_global": ("around 0.6 global name O", "p.resid % 2 = 1 and p.name <> 'O' and " + _SAME_FRAME.format("q.name = 'O' and " + _NEAR.format("0.36"))),
    "local": ("around 0.6 name O", "p.resid % 2 = 1 and p.name <> 'O' and " + _SAME_FRAME.format("q.name = 'O' and q.resid % 2 = 1 and " + _NEAR.format("0.36"))),
}


def queries() -> dict:
    return {f"text_{k}": _select(v[0]) for k, v in TEXTS.items()} | {f"text_{k}": _scoped(v[0]) for k, v in SCOPED.items()}


def oracle_sql() -> dict[str, str]:
    return {f"text_{k}": f"{_EVERY} select frame_index, atom_index from every p where {v[1]}" for k, v in (TEXTS | SCOPED).items()}
