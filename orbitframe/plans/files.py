"""Round trips through text formats over all frames: coordinates are written as a format asks, read back, and held against SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitframe.plans import views as V
from orbitframe.sources import amber, gromacs, sections, structures
from orbitframe.sources.checkpoints import scratch
from orbitframe.sources.lines import write_lines
from orbitframe.sources.sink import Section, write_sections
from orbitframe.sources.systems import read_system, write_system
from orbitframe.sources.trajectory import read_frames, write_frames
from orbitframe.universe import Universe

_QUERIES, _SQL = {}, {}
TILTED = "5.0::double as a, 6.0::double as b, 7.0::double as c, 90.0::double as alpha, 80.0::double as beta, 70.0::double as gamma"
FRAMES = "(select cast(unnest(range(0, 21)) as integer) as frame_index)"


def query(sql: str):
    def add(f):
        _QUERIES[f"file_{f.__name__}"] = f
        _SQL[f"file_{f.__name__}"] = f"{V.SQL} {sql}"
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _p(digits: int, *columns: str) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 as {c}" for c in columns or "xyz")


def _zero(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) + F.lit(0.0) for c in columns or "xyz"})


def _every(spark: SparkSession, d: str) -> DataFrame:
    return V.coords(spark, d).join(V.atoms(spark, d), "atom_index")


def _frames(rows: DataFrame, head: list[Column], line: Column, tail: list[Column] = ()) -> DataFrame:
    """(frame_index, part, n, value): of each frame some lines, a line an atom, some lines; all may use the frame's size."""
    sizes = rows.groupBy("frame_index").agg(F.count("*").alias("size"))
    fixed = lambda part, some: sizes.select("frame_index", F.lit(part).alias("part"), F.posexplode(F.array(*some)).alias("n", "value")).withColumn("n", F.col("n").cast("long"))
    out = rows.select("frame_index", F.lit(1).alias("part"), F.col("atom_index").alias("n"), line.alias("value"))
    out = fixed(0, head).union(out) if head else out
    return out.union(fixed(2, tail)) if tail else out


def _write(spark: SparkSession, name: str, lines: DataFrame, head: list[str] = (), tail: list[str] = ()) -> str:
    path = scratch(spark, name)
    write_lines(lines, path, "frame_index", "part", "n", head=head, tail=tail)
    return path


def _f(c: str, digits: int, width: int = 0) -> Column:
    text = F.format_string(f"%.{digits}f", F.col(c))
    return F.lpad(text, width, " ") if width else text


@query(f"select frame_index, atom_index, name, {_p(8)} from coords join atoms using (atom_index)")
def xyz_frames(spark, d):
    path = scratch(spark, "xyz")
    write_lines(structures.xyz_lines(_every(spark, d), "frames"), path, "frame_index", "n")
    return _zero(structures.read_xyz(spark, path).select("frame_index", "atom_index", "name", *"xyz"))


def _gro(spark, d):
    rows = _every(spark, d)
    label = [F.lpad((F.col("resid") % 100000).cast("string"), 5, " "), F.rpad("resname", 5, " "), F.lpad("name", 5, " "), F.lpad(((F.col("atom_index") + 1) % 100000).cast("string"), 5, " ")]
    line = F.concat(*label, *(_f(c, 3, 8) for c in "xyz"), *(_f(c, 4, 8) for c in "xyz"))
    tail = F.when(F.col("frame_index") % 2 == 0, "5.0 6.0 7.0").otherwise("5.0 5.638155725 6.732303 0 0 2.05212086 0 1.215537244 1.4788")
    return _write(spark, "gro", _frames(rows, [F.lit("title"), F.col("size").cast("string")], line, [tail]))


@query(f"select frame_index, atom_index, name, resname, resid, {_p(3)}, round(y, 4) + 0.0 as vy from coords join atoms using (atom_index)")
def gro_frames(spark, d):
    got = structures.read_gro(spark, _gro(spark, d))
    return _zero(got.select("frame_index", "atom_index", "name", "resname", F.col("resid").cast("long").alias("resid"), *"xyz", "vy"), *"xyz", "vy")


@query(f"select frame_index, case when frame_index % 2 = 0 then 5.0::double else 5.0::double end as a, round(case when frame_index % 2 = 0 then 90.0::double else 70.0::double end, 3) as gamma from {FRAMES}")
def gro_boxes(spark, d):
    return structures.read_gro_box(spark, _gro(spark, d)).select("frame_index", "a", F.round("gamma", 3).alias("gamma"))


def _pdb(spark, d):
    rows = _every(spark, d).drop("insertion_code")
    lines = structures.pdb_lines(rows.withColumn("key", F.col("frame_index") * 100_000_000 + F.col("atom_index")), "key", F.col("key") % 100_000_000 + 1)
    body = lines.select(F.floor(F.col("key") / 100_000_000).alias("frame_index"), F.lit(1).alias("part"), (F.col("key") % 100_000_000).alias("n"), "value")
    ends = V.coords(spark, d).select(F.col("frame_index").cast("long").alias("frame_index")).distinct()
    heads = ends.select("frame_index", F.lit(0).alias("part"), F.lit(0).cast("long").alias("n"), F.format_string("MODEL     %d", F.col("frame_index") + 1).alias("value"))
    tails = ends.select("frame_index", F.lit(2).alias("part"), F.lit(0).cast("long").alias("n"), F.lit("ENDMDL").alias("value"))
    links = structures.conect_lines(V.bonds(spark, d)).select(F.lit(1_000_000).cast("long").alias("frame_index"), F.lit(1).alias("part"), (F.col("atom1") * 100_000_000 + F.col("atom2")).alias("n"), "value")
    return _write(spark, "pdb", heads.union(body).union(tails).union(links), head=[structures.pdb_box_line(V.TILTED)], tail=["END"])


@query(f"select frame_index, atom_index, name, resname, resid, chain_id, segid, element, {_p(3)} from coords join atoms using (atom_index)")
def pdb_models(spark, d):
    got = structures.read_pdb(spark, _pdb(spark, d))
    return _zero(got.select("frame_index", "atom_index", "name", "resname", F.col("resid").cast("long").alias("resid"), "chain_id", "segid", "element", *"xyz"))


@query("select atom1, atom2 from bonds")
def pdb_bonds(spark, d):
    return structures.read_pdb_bonds(spark, _pdb(spark, d)).select("atom1", "atom2")


@query(f"select {TILTED}")
def pdb_box(spark, d):
    return structures.read_pdb_box(spark, _pdb(spark, d)).drop("file")


def _dump(spark, d):
    head = [F.lit("ITEM: TIMESTEP"), (F.col("frame_index") * 10).cast("string"), F.lit("ITEM: NUMBER OF ATOMS"), F.col("size").cast("string"), F.lit("ITEM: BOX BOUNDS xy xz yz pp pp pp"), F.lit("0 14 4"), F.lit("0 10 0"), F.lit("-5 5 0"), F.lit("ITEM: ATOMS type id x ys zs vx")]
    line = F.concat_ws(" ", F.lit("1"), (F.col("size_") - F.col("atom_index")).cast("string"), _f("x", 6), _f("y", 6), _f("z", 6), _f("z", 6))
    rows = _every(spark, d)
    total = rows.agg((F.max("atom_index") + 1).alias("size_"))  # one row
    return _write(spark, "dump", _frames(rows.join(F.broadcast(total)), head, line))


@query("select frame_index, frame_index * 10 as step, t.top - atom_index as atom_index, round(x, 6) + 0.0 as x, round(round(y, 6) * 10, 6) + 0.0 as y, round(-5 + round(z, 6) * 10, 6) + 0.0 as z, round(z, 6) + 0.0 as vx from coords, (select max(atom_index) as top from coords) t")
def dump_frames(spark, d):
    got = sections.read_lammps_dump(spark, _dump(spark, d))
    return _zero(got.select("frame_index", F.col("step").cast("int").alias("step"), "atom_index", "x", F.round("y", 6).alias("y"), F.round("z", 6).alias("z"), "vx"), *"xyz", "vx")


@query(f"select frame_index, 10.0::double as a, round(sqrt(116::double), 6) as b, 10.0::double as c, 90.0::double as alpha, 90.0::double as beta, round(degrees(acos(4 / sqrt(116::double))), 6) as gamma from {FRAMES}")
def dump_boxes(spark, d):
    got = sections.read_lammps_dump_box(spark, _dump(spark, d))
    return got.select("frame_index", *(F.round(c, 6).alias(c) for c in structures.CELL))


def _history(spark, d):
    n = V.atoms(spark, d).count()
    head = [F.format_string(f"timestep %d {n} 1 1 0.001 %.3f", F.col("frame_index"), F.col("frame_index") * F.lit(0.5)), F.lit("5 0 0"), F.lit("0 6 0"), F.lit("0 0 7")]
    place = lambda *c: F.concat_ws(" ", *(_f(x, 7) for x in c))
    line = F.concat_ws("\n", F.concat_ws(" ", "name", (F.col("atom_index") + 1).cast("string")), place(*"xyz"), place(*"zxy"))
    return _write(spark, "history", _frames(_every(spark, d), head, line), head=["title", f"1 1 {n}"])


@query(f"select frame_index, 0.5::double * frame_index as time, atom_index, name, {_p(7)}, round(z, 7) + 0.0 as vx from coords join atoms using (atom_index)")
def history_frames(spark, d):
    got = sections.read_dlpoly_history(spark, _history(spark, d))
    return _zero(got.select("frame_index", "time", "atom_index", "name", *"xyz", "vx"), *"xyz", "vx")


@query(f"select frame_index, 5.0::double as a, 6.0::double as b, 7.0::double as c from {FRAMES}")
def history_boxes(spark, d):
    return sections.read_dlpoly_history_box(spark, _history(spark, d)).select("frame_index", "a", "b", "c")


def _gromos(spark, d):
    head = [F.lit("TIMESTEP"), F.format_string("%d %.3f", F.col("frame_index"), F.col("frame_index") * F.lit(0.5)), F.lit("END"), F.lit("POSITIONRED")]
    tail = [F.lit(x) for x in ("END", "GENBOX", "1", "5.0 6.0 7.0", "90 80 70", "0 0 0", "0 0 0", "END")]
    return _write(spark, "gromos", _frames(_every(spark, d), head, F.concat_ws(" ", *(_f(c, 9) for c in "xyz")), tail), head=["TITLE", "frames", "END"])


@query(f"select frame_index, 0.5::double * frame_index as time, atom_index, {_p(9)} from coords")
def gromos_frames(spark, d):
    return _zero(amber.read_gromos(spark, _gromos(spark, d)).select("frame_index", "time", "atom_index", *"xyz"))


@query(f"select frame_index, {TILTED} from {FRAMES}")
def gromos_boxes(spark, d):
    return amber.read_gromos_box(spark, _gromos(spark, d)).drop("file")


@query(f"select frame_index, atom_index, {_p(3)} from coords")
def mdcrd_frames(spark, d):
    rows = V.coords(spark, d)
    n = rows.where("frame_index = 0").count()
    # ten numbers a line: the k-th of a frame stands in line k / 10
    each = rows.select("frame_index", F.posexplode(F.array(*(_f(c, 3, 8) for c in "xyz"))).alias("k", "v"), "atom_index").withColumn("at", F.col("atom_index") * 3 + F.col("k"))
    lines = each.groupBy("frame_index", F.floor(F.col("at") / 10).alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]), "").alias("value")).select("frame_index", F.lit(1).alias("part"), "n", "value")
    return _zero(amber.read_mdcrd(spark, _write(spark, "mdcrd", lines, head=["title"]), n).select("frame_index", "atom_index", *"xyz"))


@query(f"select frame_index, atom_index, name, {_p(6)}, atom_index + 1 as id from coords join atoms using (atom_index)")
def tinker_frames(spark, d):
    rows = _every(spark, d).withColumns({"partners": F.array(F.col("atom_index") + 1), "atom_type": F.lit("7")})
    path = scratch(spark, "tinker")
    write_lines(sections.tinker_lines(rows, "frames"), path, "frame_index", "n")
    return _zero(sections.read_tinker(spark, path).select("frame_index", "atom_index", "name", *"xyz", "id"))


def _one(spark, name: str, lines: DataFrame, head: list[str], tail: list[str] = (), order: str = "atom_index") -> str:
    path = scratch(spark, name)
    write_lines(lines, path, order, head=head, tail=tail)
    return path


def _lammps(spark, d):
    atoms = V.placed_atoms(spark, d).withColumn("atom_type", F.when(F.col("element") == "N", 1).when(F.col("element") == "C", 2).otherwise(3))
    return _one(spark, "data", sections.lammps_lines(atoms), ["title", "", f"{atoms.count()} atoms", "3 atom types", "0 5 xlo xhi", "0 6 ylo yhi", "-1 6 zlo zhi", "", "Masses", "", "1 14.007", "2 12.011", "3 15.999", "", "Atoms # full", ""])


@query(f"select atom_index, resid, mass, {_p(6, 'charge', *'xyz')} from placed")
def lammps_data(spark, d):
    return _zero(sections.read_lammps_data(spark, _lammps(spark, d)).select("atom_index", F.col("resid").cast("long").alias("resid"), "mass", "charge", *"xyz"), "charge", *"xyz")


@query("select 5.0::double as a, 6.0::double as b, 7.0::double as c, 90.0::double as gamma")
def lammps_box(spark, d):
    return sections.read_lammps_box(spark, _lammps(spark, d)).select("a", "b", "c", "gamma")


def _psf(spark, d):
    atoms, bonds = V.atoms(spark, d), V.bonds(spark, d)
    body = sections.psf_lines(atoms).select(F.lit(0).cast("long").alias("frame_index"), F.lit(0).alias("part"), F.col("atom_index").alias("n"), "value")
    title = spark.createDataFrame([(1, 0, 0, " "), (1, 0, 1, f"{bonds.count()} !NBOND: bonds")], "frame_index long, part int, n long, value string")
    pairs = bonds.select(F.lit(1).cast("long"), F.lit(1), F.col("atom1") * 1_000_000 + F.col("atom2"), F.concat_ws(" ", (F.col("atom1") + 1).cast("string"), (F.col("atom2") + 1).cast("string")))
    return _write(spark, "psf", body.union(title).union(pairs), head=["PSF", "", "1 !NTITLE", "title", "", f"{atoms.count()} !NATOM"])


@query(f"select atom_index, segid, resid, resname, name, coalesce(atom_type, '-') as atom_type, {_p(6, 'charge')}, {_p(4, 'mass')} from atoms")
def psf_atoms(spark, d):
    got = sections.read_psf_atoms(spark, _psf(spark, d))
    return _zero(got.select("atom_index", "segid", F.col("resid").cast("long").alias("resid"), "resname", "name", "atom_type", "charge", "mass"), "charge", "mass")


@query("select atom1, atom2 from bonds")
def psf_bonds(spark, d):
    return structures.read_psf_bonds(spark, _psf(spark, d)).select("atom1", "atom2")


@query(f"select atom_index, name, resname, chain_id, atom_type, {_p(3, 'charge', *'xyz')} from placed")
def pdbqt(spark, d):
    atoms = V.placed_atoms(spark, d).withColumn("resid", F.col("resid") % 9999)
    got = sections.read_pdbqt(spark, _one(spark, "pdbqt", sections.pdbqt_lines(atoms), ["REMARK x"], ["END", "ATOM      1  ZZ"]))
    return _zero(got.select("atom_index", "name", "resname", "chain_id", "atom_type", "charge", *"xyz"), "charge", *"xyz")


@query(f"select atom_index, name, resname, segid, resid, {_p(10)} from placed")
def crd_extended(spark, d):
    atoms = V.placed_atoms(spark, d)
    got = sections.read_crd(spark, _one(spark, "crd", sections.crd_lines(atoms, extended=True), ["* atoms", "*", f"{atoms.count()}  EXT"]))
    return got.select("atom_index", "name", "resname", "segid", F.col("resid").cast("long").alias("resid"), *((F.col(c) + F.lit(0.0)).alias(c) for c in "xyz"))


def _restart(spark, d):
    atoms = V.placed_atoms(spark, d)
    n = atoms.count()
    half = sections.inpcrd_lines(atoms).select(F.lit(0).cast("long").alias("frame_index"), F.lit(0).alias("part"), "n", "value")
    speeds = sections.inpcrd_lines(atoms.withColumns({"x": F.col("y"), "y": F.col("z"), "z": F.col("x")})).select(F.lit(1).cast("long"), F.lit(0), "n", "value")
    return _write(spark, "restart", half.union(speeds), head=["atoms", f"{n} 0.5"], tail=["".join(f"{v:12.7f}" for v in V.TILTED)])


@query("select atom_index, round(x, 7) + 0.0 as x, round(y, 7) + 0.0 as vx, round(z, 7) + 0.0 as vy from placed")
def restart_velocities(spark, d):
    return _zero(sections.read_inpcrd(spark, _restart(spark, d)).select("atom_index", "x", "vx", "vy"), "x", "vx", "vy")


@query(f"select {TILTED}")
def restart_box(spark, d):
    return sections.read_inpcrd_box(spark, _restart(spark, d)).drop("file")


def _config(spark, d):
    atoms = V.placed_atoms(spark, d)
    place = lambda *c: F.concat_ws(" ", *(_f(x, 7) for x in c))
    lines = atoms.select("atom_index", F.concat_ws("\n", F.concat_ws(" ", "name", (F.col("atom_index") + 1).cast("string")), place(*"xyz"), place(*"yzx"), place(*"zxy")).alias("value"))
    return _one(spark, "config", lines, ["title", f"2 1 {atoms.count()}", "5 0 0", "0 6 0", "0 0 7"])


@query(f"select atom_index, name, {_p(7)}, round(y, 7) + 0.0 as vx, round(z, 7) + 0.0 as fx from placed")
def dlpoly_config(spark, d):
    return _zero(sections.read_dlpoly_config(spark, _config(spark, d)).select("atom_index", "name", *"xyz", "vx", "fx"), *"xyz", "vx", "fx")


def _aims(spark, d):
    place = lambda kind, *c: F.concat_ws(" ", F.lit(kind), *(_f(x, 8) for x in c))
    lines = V.placed_atoms(spark, d).select("atom_index", F.concat(place("atom_frac", *"xyz"), F.lit(" "), F.col("name"), F.lit("\n"), place("velocity", *"yzx")).alias("value"))
    return _one(spark, "aims", lines, ["lattice_vector 5 0 0", "lattice_vector 0 6 0", "lattice_vector 0 0 7"])


@query("select atom_index, name, round(5 * round(x, 8), 8) + 0.0 as x, round(7 * round(z, 8), 8) + 0.0 as z, round(y, 8) + 0.0 as vx from placed")
def aims_fractional(spark, d):
    got = sections.read_aims(spark, _aims(spark, d))
    return got.select("atom_index", "name", *((F.round(c, 8) + F.lit(0.0)).alias(c) for c in "xz"), (F.col("vx") + F.lit(0.0)).alias("vx"))


# binary frames, and whole systems written and read by one call

_SINGLE = ", ".join(f"cast(cast({c} as float) as double) as {c}" for c in "xyz")


def _binary(spark: SparkSession, d: str) -> str:
    cell = {c: F.lit(v) + (F.col("frame_index") if c == "a" else F.lit(0)) for c, v in zip(structures.CELL, V.TILTED)}
    path = scratch(spark, "frames")
    write_frames(V.coords(spark, d).withColumns(cell), path, delta=0.5, run_bytes=1 << 16)
    return path


@query(f"select frame_index, cast(frame_index as bigint) as step, 0.5::double * frame_index as time, atom_index, {_SINGLE} from coords")
def binary_frames(spark, d):
    return read_frames(spark, _binary(spark, d))


@query(f"select frame_index, atom_index, {_SINGLE} from coords where frame_index between 5 and 7")
def binary_frames_5_to_7(spark, d):
    return read_frames(spark, _binary(spark, d)).where("frame_index between 5 and 7").select("frame_index", "atom_index", *"xyz")


@query(f"select frame_index, 5.0::double + frame_index as a, 6.0::double as b, 7.0::double as c, 90.0::double as alpha, 80.0::double as beta, 70.0::double as gamma, (select count(*) from atoms) as n_atoms from {FRAMES}")
def binary_cells(spark, d):
    return read_frames(spark, _binary(spark, d), cells=True).select("frame_index", *structures.CELL, "n_atoms")


def _system(spark: SparkSession, d: str) -> Universe:
    box = V.coords(spark, d).select("frame_index").distinct().select("frame_index", *(F.lit(v).alias(c) for c, v in zip(structures.CELL, V.TILTED)))
    return Universe(V.atoms(spark, d), V.coords(spark, d), V.bonds(spark, d), box)


@query(f"select atom_index, name, resname, resid, segid, element, {_p(3)}, 80.0::double as beta, (select count(*) from bonds b where b.atom1 = atom_index or b.atom2 = atom_index) as degree from atoms join coords using (atom_index) where frame_index = 4")
def system_as_pdb(spark, d):
    path = scratch(spark, "system") + ".pdb"
    write_system(_system(spark, d), path, frame=4)
    u = read_system(spark, path)
    degree = u.bonds.select(F.explode(F.array("atom1", "atom2")).alias("atom_index")).groupBy("atom_index").agg(F.count("*").alias("degree"))
    met = u.frame(0).join(u.boxes.select("beta")).join(degree, "atom_index", "left")  # one box
    return _zero(met.select("atom_index", "name", "resname", F.col("resid").cast("long").alias("resid"), "segid", "element", *"xyz", "beta", F.coalesce("degree", F.lit(0)).alias("degree")))


@query(f"select frame_index, atom_index, name, segid, round(mass, 4) + 0.0 as mass, {_SINGLE}, (select count(*) from bonds) as n_bonds from coords join atoms using (atom_index)")
def system_of_psf_and_frames(spark, d):
    system, path = _system(spark, d), scratch(spark, "system") + ".psf"
    write_system(system, path)
    u = read_system(spark, path, _binary(spark, d), frames_kind="dcd")
    n = u.bonds.agg(F.count("*").alias("n_bonds"))  # one row
    return u.coords.join(u.atoms, "atom_index").join(F.broadcast(n)).select("frame_index", "atom_index", "name", "segid", F.round("mass", 4).alias("mass"), *"xyz", "n_bonds")


@query(f"select atom_index, name, resname, resid, segid, {_p(10)} from placed")
def system_as_crd(spark, d):
    path = scratch(spark, "system") + ".crd"
    write_system(_system(spark, d), path)
    u = read_system(spark, path)
    return u.frame(0).select("atom_index", "name", "resname", F.col("resid").cast("long").alias("resid"), "segid", *((F.col(c) + F.lit(0.0)).alias(c) for c in "xyz"))


@query(f"select atom_index, name, resname, {_p(4)}, (select count(*) from bonds) as n_bonds from placed")
def system_as_mol2(spark, d):
    path = scratch(spark, "system") + ".mol2"
    write_system(_system(spark, d), path)
    u = read_system(spark, path)
    n = u.bonds.agg(F.count("*").alias("n_bonds"))  # one row
    return _zero(u.frame(0).join(F.broadcast(n)).select("atom_index", "name", "resname", *"xyz", "n_bonds"))


def _fields(rows: DataFrame, order: Column, text: Column, per: int) -> DataFrame:
    """(k, value): fixed fields, so many a line."""
    held = rows.select(order.alias("i"), text.alias("v")).groupBy(F.floor(F.col("i") / per).alias("k"))
    return held.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]), "").alias("value"))


def _prmtop(spark: SparkSession, d: str) -> str:
    atoms = V.atoms(spark, d)
    starts = atoms.groupBy("resid").agg(F.min("atom_index").alias("first"), F.min("resname").alias("resname"))
    i, r = F.col("atom_index"), F.col("resid") - 1
    word = lambda c: F.rpad(F.coalesce(c, F.lit("X")), 4, " ")
    number = lambda c: F.format_string("%16.8E", c)
    bonds = V.bonds(spark, d).select((F.col("atom1") * 10 + F.col("atom2") - F.col("atom1")).alias("at"), F.concat(*(F.lpad(x.cast("string"), 8, " ") for x in (F.col("atom1") * 3, F.col("atom2") * 3, F.lit(1)))).alias("v"))
    flag = lambda name, form: (f"%FLAG {name}", f"%FORMAT({form})")
    parts = [Section(_fields(atoms, i, word(F.col("name")), 20), ("k",), ("%VERSION  VERSION_STAMP = V0001.000", *flag("ATOM_NAME", "20a4"))), Section(_fields(atoms, i, number(F.col("charge") * amber.CHARGE_SCALE), 5), ("k",), flag("CHARGE", "5E16.8")), Section(_fields(atoms, i, number(F.col("mass")), 5), ("k",), flag("MASS", "5E16.8")), Section(_fields(atoms, i, word(F.col("atom_type")), 20), ("k",), flag("AMBER_ATOM_TYPE", "20a4")), Section(_fields(starts, r, word(F.col("resname")), 20), ("k",), flag("RESIDUE_LABEL", "20a4")), Section(_fields(starts, r, F.lpad((F.col("first") + 1).cast("string"), 8, " "), 10), ("k",), flag("RESIDUE_POINTER", "10I8")), Section(bonds.select("at", F.col("v").alias("value")), ("at",), flag("BONDS_WITHOUT_HYDROGEN", "10I8"))]
    path = scratch(spark, "system") + ".prmtop"
    write_sections(spark, path, *parts)
    return path


@query(f"select atom_index, name, coalesce(atom_type, 'X') as atom_type, resname, resid, mass, round(charge, 6) + 0.0 as charge, {_p(7)}, (select count(*) from bonds) as n_bonds from placed")
def system_of_prmtop_and_inpcrd(spark, d):
    places = scratch(spark, "system") + ".inpcrd"
    write_sections(spark, places, Section(sections.inpcrd_lines(V.placed_atoms(spark, d)).withColumn("entries", F.floor((F.length("value")) / 36)), ("n",), ("title", "{n}"), entries="entries"))
    u = read_system(spark, _prmtop(spark, d), places)
    n = u.bonds.agg(F.count("*").alias("n_bonds"))  # one row
    got = u.frame(0).join(F.broadcast(n)).select("atom_index", "name", "atom_type", "resname", F.col("resid").cast("long").alias("resid"), "mass", F.round("charge", 6).alias("charge"), *"xyz", "n_bonds")
    return _zero(got, "charge", *"xyz")


@query(f"select frame_index, atom_index, name, {_p(7)} from coords join atoms using (atom_index)")
def hoomd_frames(spark, d):
    rows = _every(spark, d)
    n = F.col("atom_index")
    place = F.concat_ws(" ", *(_f(c, 7) for c in "xyz"))
    lines = lambda part, value: rows.select("frame_index", F.lit(part).alias("part"), n.alias("n"), value.alias("value"))
    frames = rows.select("frame_index").distinct()
    tag = lambda part, value: frames.select("frame_index", F.lit(part), F.lit(0).cast("long"), F.lit(value))
    every = lines(1, place).union(lines(3, F.col("name")))
    for part, value in ((0, '<configuration time_step="0"><box lx="5" ly="6" lz="7" xy="0" xz="0" yz="0"/><position>'), (2, "</position><type>"), (4, "</type></configuration>")):
        every = every.union(tag(part, value))
    path = scratch(spark, "particles") + ".xml"
    write_sections(spark, path, Section(every, ("frame_index", "part", "n"), ('<?xml version="1.0"?><hoomd_xml>',), ("</hoomd_xml>",)))
    return _zero(sections.read_hoomd_xml(spark, path).select("frame_index", "atom_index", "name", *"xyz"))


@query(f"select frame_index, atom_index, name, {_p(7)}, 7.0::double as c from coords join atoms using (atom_index)")
def system_as_history(spark, d):
    system, path = _system(spark, d), scratch(spark, "system")
    write_system(system, f"{path}.history")
    write_system(system, f"{path}.crd")
    u = read_system(spark, f"{path}.crd", f"{path}.history")
    met = u.coords.join(u.atoms.select("atom_index", "name"), "atom_index").join(u.boxes.select("frame_index", F.round("c", 6).alias("c")), "frame_index")
    return _zero(met.select("frame_index", "atom_index", "name", *(F.round(c, 7).alias(c) for c in "xyz"), "c"))


_TOP = ("#define COPIES 2", "#ifndef RIGID", '#include "molecule.itp"', "#endif", "[ system ]", "two of them", "[ molecules ]", "SYS COPIES")


def _included(spark: SparkSession, d: str) -> DataFrame:
    """A topology of two copies of all atoms, whose one molecule type stands in an included file."""
    folder, atoms = scratch(spark, "topology"), V.atoms(spark, d)
    line = F.concat_ws(" ", (F.col("atom_index") + 1).cast("string"), F.lit("X"), F.col("resid").cast("string"), "resname", "name", F.lit("1"), F.format_string("%.6f", "charge"), F.lit("WEIGHT"))
    pairs = V.bonds(spark, d).select("atom1", "atom2", F.concat_ws(" ", (F.col("atom1") + 1).cast("string"), (F.col("atom2") + 1).cast("string"), F.lit("1")).alias("value"))
    write_sections(spark, f"{folder}/molecule.itp", Section(atoms.select("atom_index", line.alias("value")), ("atom_index",), ("#define WEIGHT 12.5", "[ moleculetype ]", "SYS 3", "[ atoms ]")), Section(pairs, ("atom1", "atom2"), ("#undef WEIGHT", "[ bonds ]")))
    write_sections(spark, f"{folder}/all.top", Section(None, head=_TOP))
    return gromacs.read_itp(spark, f"{folder}/all.top")


@query(f", n as (select count(*) as n, max(resid) as r from atoms), k as (select unnest(range(0, 2)) as k) select atom_index + k * n as atom_index, k + 1 as molecule_number, resname, name, resid + k * r as resid, 12.5::double as mass, {_p(6, 'charge')} from atoms, n, k")
def topology_with_includes(spark, d):
    got = gromacs.system_atoms(_included(spark, d))
    return _zero(got.select("atom_index", F.col("molecule_number").cast("long").alias("molecule_number"), "resname", "name", F.col("resid").cast("long").alias("resid"), "mass", "charge"), "charge")


@query(", n as (select count(*) as n from atoms), k as (select unnest(range(0, 2)) as k) select atom1 + k * n as atom1, atom2 + k * n as atom2 from bonds, n, k")
def topology_bonds_with_includes(spark, d):
    return gromacs.system_groups(_included(spark, d)).select("atom1", "atom2")


@query(f"select frame_index, atom_index, name, resname, {_SINGLE}, 5.0::double + frame_index as a from coords join atoms using (atom_index)")
def system_of_gro_and_frames(spark, d):
    path = scratch(spark, "system") + ".gro"
    write_system(_system(spark, d), path)
    u = read_system(spark, path, _binary(spark, d), frames_kind="dcd")
    met = u.coords.join(u.atoms.select("atom_index", "name", "resname"), "atom_index").join(u.boxes.select("frame_index", "a"), "frame_index")
    return met.select("frame_index", "atom_index", "name", "resname", *"xyz", "a")


@query(f"select atom_index, atom_type, {_p(3)}, 6.0::double as b, 80.0::double as beta from placed")
def system_as_pdbqt(spark, d):
    path = scratch(spark, "system") + ".pdbqt"
    atoms = V.placed_atoms(spark, d).withColumn("resid", F.col("resid") % 9999)
    write_sections(spark, path, Section(sections.pdbqt_lines(atoms), ("atom_index",), (structures.pdb_box_line(V.TILTED),), ("END",)))
    u = read_system(spark, path)
    return _zero(u.frame(0).join(F.broadcast(u.boxes.select("b", "beta"))).select("atom_index", "atom_type", *"xyz", "b", "beta"))  # one box
