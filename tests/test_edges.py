"""Null places, repeated rows, ties and empty tables in the trajectory operators."""

import math

import numpy as np
import pytest

from orbitframe.functions.vectors import Box
from orbitframe.operators import aggregates as A
from orbitframe.operators import analysis, fitting, neighbors, selection, timeseries, topology, transforms

ROWS = [(0, 0, 0.0, 0.0, 0.0, 1.0), (0, 1, 2.0, 0.0, 0.0, 1.0), (0, 2, None, 5.0, 5.0, 4.0), (0, 3, 0.0, 2.0, 0.0, None), (1, 0, 1.0, 1.0, 1.0, 1.0), (1, 1, 3.0, 1.0, 1.0, 1.0), (1, 3, 1.0, 3.0, 1.0, None), (2, 2, None, None, None, 1.0)]


@pytest.fixture(scope="module")
def coords(spark):
    return spark.createDataFrame(ROWS, "frame_index int, atom_index long, x double, y double, z double, mass double")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_measures_leave_null_places_out(coords):
    assert rows(A.center_of_mass(coords)) == [(0, 1.0, 0.0, 0.0), (1, 2.0, 1.0, 1.0)]
    assert rows(A.center_of_geometry(coords))[0] == (0, 2 / 3, 2 / 3, 0.0)
    assert [r[0] for r in rows(A.radius_of_gyration(coords))] == [0, 1] and rows(A.radius_of_gyration(coords))[0][1] == 1.0
    first = coords.where("frame_index = 0").drop("frame_index", "mass")
    assert rows(A.rmsd(coords, first)) == [(0, 0.0), (1, math.sqrt(3))]
    assert rows(A.rmsf(coords))[0] == (0, pytest.approx(math.sqrt(0.75)))
    assert rows(analysis.run(analysis.Msd(), coords)) == [(0, 0.0), (1, 3.0)]
    fits = fitting.fit_to_reference(coords, first).collect()
    assert sorted(r.frame_index for r in fits) == [0, 1] and all(r.rmsd == pytest.approx(0, abs=1e-7) for r in fits)
    assert sorted(r.frame_index for r in fitting.fit_to_reference(coords, first, weight="mass").collect()) == [0, 1]
    assert sorted(r.frame_index for r in fitting.helix_axis(coords).collect()) == [0, 1]


def test_repeated_rows_count_each(coords):
    twice = coords.union(coords)
    assert rows(A.center_of_mass(twice)) == rows(A.center_of_mass(coords))
    assert rows(A.total(twice, "mass")) == [(0, 12.0), (1, 4.0), (2, 2.0)]
    assert transforms.translate(twice, (1.0, 0.0, 0.0)).count() == 16


def test_transformations_keep_null_places(coords):
    moved = {(r.frame_index, r.atom_index): (r.x, r.y, r.z) for r in transforms.translate(coords, (1.0, 2.0, 3.0)).collect()}
    assert moved[0, 2] == (None, 7.0, 8.0) and moved[2, 2] == (None, None, None) and moved[0, 0] == (1.0, 2.0, 3.0)
    assert transforms.wrap(coords, Box(5, 5, 5)).where("x is null").count() == 2
    assert transforms.rotate(coords, math.pi, (0.0, 0.0, 1.0)).count() == 8
    assert transforms.unwrap(coords, Box(5, 5, 5), ("atom_index",), "frame_index").count() == 8


def test_null_places_meet_nothing(coords):
    found = neighbors.self_pairs_within(coords, 100.0, ("frame_index",)).collect()
    assert all(2 not in (r.i, r.j) for r in found) and len(found) == 6
    assert all(2 not in (r.i, r.j) for r in neighbors.self_pairs_within(coords, 2.0, ("frame_index",), Box(9, 9, 9)).collect())
    for bad in ("nan", "inf", "-inf"):
        with pytest.raises(Exception, match="not finite"):
            neighbors.guess_bonds(coords.where("frame_index = 0").selectExpr("atom_index", "x", "y", f"coalesce(z, double('{bad}')) + if(atom_index = 1, double('{bad}'), 0) as z")).collect()
    elements = coords.where("frame_index = 1").selectExpr("*", "if(atom_index = 0, 'QQ', 'C') as element")
    with pytest.raises(Exception, match="unknown element QQ"):
        neighbors.guess_bonds(elements, element="element").collect()
    assert neighbors.guess_bonds(elements.where("atom_index > 0"), 10.0, "element").count() == 1
    assert timeseries.msd_by_lag(coords, 1).orderBy("lag").collect()[1].msd == 3.0


def test_ties_at_the_cutoff(spark):
    points = spark.createDataFrame([(k, float(k), 0.0, 0.0) for k in range(4)] + [(9, 1.0, 0.0, 0.0)], "atom_index long, x double, y double, z double")
    assert {(r.i, r.j) for r in neighbors.self_pairs_within(points, 1.0).collect()} == {(0, 1), (1, 2), (2, 3), (0, 9), (1, 9), (2, 9)}
    assert {(r.i, r.j) for r in neighbors.pairs_within(points, points, 1.0, strict=True).where("i < j").collect()} == {(1, 9)}
    assert [(r.atom_index, r.center) for r in neighbors.neighbors(points, points.where("atom_index in (1, 9)"), 0.5).orderBy("atom_index").collect()] == [(1, 1), (9, 1)]


def test_empty_tables(coords):
    none, bonds = coords.where("frame_index > 9"), coords.selectExpr("atom_index as atom1", "atom_index + 1 as atom2").where("atom1 > 9")
    first = none.drop("frame_index", "mass")
    results = [A.center_of_mass(none), A.center_of_geometry(none), A.radius_of_gyration(none), A.bounding_box(none), A.rmsd(none, first), A.rmsf(none), fitting.fit_to_reference(none, first), fitting.helix_axis(none), transforms.wrap(none, Box(5, 5, 5)), transforms.unwrap(none, Box(5, 5, 5), ("atom_index",), "frame_index"), timeseries.msd_by_lag(none), timeseries.dihedral_series(none), neighbors.self_pairs_within(none, 1.0), topology.bond_lengths(bonds, none, ("frame_index",)), topology.angles(bonds, none, ("frame_index",)), topology.dihedrals(bonds, none, ("frame_index",)), topology.fragments(none, bonds), timeseries.survival(none.selectExpr("frame_index as frame", "atom_index as id"), 3), timeseries.frame_dt(none.selectExpr("frame_index", "x as time"))]
    assert [df.count() for df in results] == [0] * len(results)


def test_displacement_by_lag_over_chunks(spark):
    """Gaps in frames, repeated rows, negative frames, a far place and nulls, over several chunks; both ways agree with brute force."""
    rng = np.random.default_rng(4)
    rows = [(a, int(f), *(float(v) + 1000 * a for v in rng.normal(size=3).cumsum())) for a in range(3) for f in np.flatnonzero(rng.random(9000) < 0.02) - 100]
    rows += [rows[5], rows[5], (1, 3, None, 1.0, 1.0), (1, 4, float("nan"), 1.0, 1.0), (None, 4, 1.0, 1.0, 1.0)]
    want = {}
    good = [r for r in rows if None not in r and np.isfinite(r[2])]
    for a in good:
        for b in good:
            if a[0] == b[0] and b[1] >= a[1]:
                total, n = want.get(b[1] - a[1], (0.0, 0))
                want[b[1] - a[1]] = total + sum((p - q) ** 2 for p, q in zip(a[2:], b[2:], strict=True)), n + 1
    coords = spark.createDataFrame(rows, "atom_index long, frame_index long, x double, y double, z double")
    got = {r.lag: r.msd for r in timeseries.msd_by_lag(coords).collect()}
    assert got.keys() == want.keys() and max(want) > 2 * timeseries.CHUNK
    assert all(abs(got[k] - t / n) < 1e-6 for k, (t, n) in want.items())
    near = {r.lag: r.msd for r in timeseries.msd_by_lag(coords, 50).collect()}
    assert near.keys() == {k for k in want if k <= 50} and all(abs(near[k] - want[k][0] / want[k][1]) < 1e-6 for k in near)


def test_presence_with_nulls_and_repeats(spark):
    states = spark.createDataFrame([(0, 1), (0, 1), (3, 1), (0, 2), (1, 2), (None, 1), (2, None), (None, None)], "frame int, id int")
    assert rows(timeseries.fill_gaps(states, 2)) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (3, 1)]
    assert rows(timeseries.fill_gaps(states, 1)) == [(0, 1), (0, 2), (1, 2), (3, 1)]
    assert rows(timeseries.survival(states, 1)) == rows(timeseries.survival(states.dropna().distinct(), 1)) == [(0, 1.0), (1, 0.25)]
    assert timeseries.fill_gaps(states.where("frame > 9"), 1).count() == timeseries.survival(states.where("frame > 9"), 1).count() == 0


def test_dihedral_series_with_nulls(spark):
    places = [(0.0, 1.0, 0.0), (0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (1.0, 0.0, 1.0), (2.0, 0.0, 1.0), (None, 3.0, 1.0), (3.0, 3.0, 3.0)]
    points = spark.createDataFrame([(0, k, *p) for k, p in enumerate(places)], "frame_index int, atom_index int, x double, y double, z double")
    got = {r.atom_index: r.dihedral for r in timeseries.dihedral_series(points).collect()}
    assert {k: v is None for k, v in got.items()} == {0: False, 1: False, 2: True, 3: True}
    assert timeseries.dihedral_series(points.where("atom_index < 3")).count() == 0


def test_selections_with_nulls_and_repeats(spark):
    atoms = spark.createDataFrame([(0, 1, "A", None), (1, 1, "A", None), (2, 1, "A", "x"), (3, None, "A", None), (4, None, "A", None), (5, 1, None, None)], "atom_index long, resid int, segid string, insertion_code string")
    first = selection.F.col("atom_index")
    assert rows(selection.by_residue(atoms, first == 0)) == [(0,), (1,)]
    assert rows(selection.by_residue(atoms, first == 3)) == [(3,), (4,)]
    assert rows(selection.by_residue(atoms, first > 9)) == []
    bonds = spark.createDataFrame([(1, 0), (0, 1), (0, 2), (0, 2), (0, None), (None, 3), (0, 77)], "atom1 long, atom2 long")
    assert rows(selection.bonded(atoms, bonds, first == 0)) == [(1,), (2,)]
    assert rows(selection.bonded(atoms, bonds.where("atom1 > 9"), first == 0)) == []
    groups = {"some": spark.createDataFrame([(1,), (1,), (None,), (77,)], "atom_index long"), "none": spark.createDataFrame([], "atom_index long")}
    assert rows(selection.group(atoms, groups, "some")) == [(1,)] and rows(selection.group(atoms, groups, "none")) == []
    with pytest.raises(ValueError, match="unknown group"):
        selection.group(atoms, groups, "other")
