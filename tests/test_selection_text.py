"""Selections written as text: grammar, precedence, scopes and errors."""

import pytest

from orbitframe.operators import selection_text as T

ROWS = [
    (0, "N", "ALA", 1, "PROT", "A", "N", "NH1", None, 0.0, 0.0, 0.0, 14.0, 0.5),
    (1, "CA", "ALA", 1, "PROT", "A", "C", "CT1", None, 1.0, 0.0, 0.0, 12.0, None),
    (2, "OH2", "HOH", 8, "WAT", "B", "O", None, None, 0.0, 0.0, 3.0, None, None),
    (3, "C5'", "4AK", -2, "4AKE", "B", None, "CT1", None, 9.0, 9.0, None, 12.0, 0.5),
]
SCHEMA = "atom_index long, name string, resname string, resid long, segid string, chain_id string, element string, atom_type string, insertion_code string, x double, y double, z double, mass double, charge double"


@pytest.fixture(scope="module")
def atoms(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def chosen(atoms, text, **more):
    return sorted(r.atom_index for r in T.select(atoms, text, **more).collect())


@pytest.mark.parametrize(
    "text, want",
    [
        ("all", [0, 1, 2, 3]),
        ("none", []),
        ("protein", [0, 1]),
        ("BACKBONE", [0, 1]),
        ("water or nucleic", [2]),
        ("name CA N", [0, 1]),
        ("name C*", [1, 3]),
        ("name [!C]*", [0, 2]),
        ("name 'C5\\''", [3]),
        ('name "C5\'"', [3]),
        ("segid 4AKE", [3]),
        ("resname 4AK", [3]),
        ("resname \\protein", []),
        ("type CT1", [1, 3]),
        ("not type CT1", [0, 2]),
        ("element C N", [0, 1]),
        ("chainID B", [2, 3]),
        ("resid 1 8", [0, 1, 2]),
        ("resid -2--1", [3]),
        ("resid -2 to 1", [0, 1, 3]),
        ("resnum 1:8", [0, 1, 2]),
        ("bynum 1:2", [0, 1]),
        ("index 2-3", [2, 3]),
        ("atom PROT 1 CA", [1]),
        ("prop x <= 0.5", [0, 2]),
        ("prop x == 1", [1]),
        ("prop abs z < 2", [0, 1]),
        ("prop z != 0", [2]),
        ("not prop z > -1e9", [3]),
        ("point 0 0 0 1.01", [0, 1]),
        ("point .5 0 0 .6", [0, 1]),
        ("around 1.01 name CA", [0]),
        ("around 1.0 name CA", []),
        ("same resname as resid 1", [0, 1]),
        ("same x as index 0", [0, 2]),
        ("same charge as index 3", [0, 3]),
        ("same element as index 3", [3]),
        ("same mass as index 2", []),
        ("same segment as name CA or name OH2", [0, 1, 2]),
        ("(same segment as name CA) or name OH2 and not protein", [0, 1, 2]),
        ("byres name CA", [0, 1]),
        ("global backbone", [0, 1]),
        ("bonded name N", []),
        ("name CA or name N and resname HOH", [1]),
        ("(name CA or name N) and not chainID B", [0, 1]),
        ("not around 1.01 name CA", [1, 2, 3]),
        ("around 1.5 (name CA or around 1.01 name CA)", []),
        ("water or around 1.01 name CA", [0, 2]),
    ],
)
def test_texts(atoms, text, want):
    assert chosen(atoms, text) == want
    assert chosen(atoms.where("atom_index < 0"), text) == []


def test_bonds_groups_and_scope(spark, atoms):
    bonds = spark.createDataFrame([(0, 1), (1, 2)], "atom1 long, atom2 long")
    assert chosen(atoms, "bonded name CA", bonds=bonds) == [0, 2]
    assert chosen(atoms, "type NH1 and bonded name CA", bonds=bonds) == [0]
    groups = {"solvent": atoms.where("atom_index in (0, 2)").select("atom_index")}
    assert chosen(atoms, "not group solvent", groups=groups) == [1, 3]
    part = atoms.where("atom_index <> 1")
    assert chosen(part, "around 1.01 name CA") == []
    assert chosen(part, "around 1.01 global name CA", everything=atoms) == [0]
    assert chosen(part, "global name CA", everything=atoms) == [1]
    assert chosen(part, "name CA", everything=atoms) == []
    assert T.select(atoms, "around 1.01 name CA").columns == atoms.columns


@pytest.mark.parametrize("text", ["", "  ", "wat CA", "index -1", "resid 5-1", "(name CA", "name", "name CA)", "prop w < 1", "prop x = 1", "prop x", "same mood as all", "same x all", "around x all", "point 1 2 3", "group", "name 'CA", "name CA $", "resid 1.5", "group missing"])
def test_errors(atoms, text):
    with pytest.raises(T.SelectionError):
        T.select(atoms, text)
