"""Sectioned and free-form text formats: a marker line starts a section, whose rows are split on blanks in the JVM.

Fields that are missing or no numbers are null; lines outside the known sections are passed over; empty files give
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitframe.functions.vectors import Vec, cell_vectors, lattice_angles
from orbitframe.sources.lines import fit, fixed, scan, source_file
from orbitframe.sources.structures import CELL, _cut, _number, cells


def _scanned(spark: SparkSession, path: str, name: Column, rows: Column | None = None, within: dict | None = None, counts: dict | None = None, heads: dict | None = None) -> DataFrame:
    """Rows below a marker, without markers and blank lines: ``section`` is its text, ``at`` its line, ``k`` the row's number below it."""
    some = (F.trim("line") != "") if rows is None else rows
    held = scan(spark, path, {"_mark": name}, {"_row": some} | (counts or {}), within, heads).where(some & (F.col("n") > F.col("_mark.n")))
    return held.withColumns({"section": F.col("_mark.value"), "at": F.col("_mark.n"), "k": F.col("_row") - F.col("_mark._row") - 1}).drop("_mark", "_row", "_row_total")


def _fields(rows: DataFrame) -> DataFrame:
    return rows.withColumn("p", F.split(F.trim("line"), r"\s+"))


def _p(i: int, kind: str = "string") -> Column:
    return F.get("p", F.lit(i)).try_cast(kind)


def _float(c: Column) -> Column:
    """Numbers with D exponents too."""
    return F.regexp_replace(c, "[Dd]", "E").try_cast("double")


def _mol2(spark: SparkSession, path: str) -> DataFrame:
    """Rows with their section's kind, the molecule's number and, at atoms, their number in the file."""
    kind = F.when(F.col("line").startswith("@<TRIPOS>"), F.trim(F.substring("line", 10, 40)))
    row = (F.trim("line") != "") & ~F.col("line").startswith("@<TRIPOS>")
    return _fields(_scanned(spark, path, kind, within={"atom": ("_mark", ("ATOM",), row)}, counts={"molecule": kind == "MOLECULE"}))


def read_mol2_atoms(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of one or many molecules of a file, one after another; their numbers in the file must agree with the molecules' counts."""
    rows = _mol2(spark, path).where("section = 'ATOM'")
    return rows.select("file", (F.col("atom") - 1).alias("atom_index"), _p(0, "long").alias("serial"), _p(1).alias("name"), *(_p(2 + k, "double").alias(c) for k, c in enumerate("xyz")), _p(5).alias("atom_type"), F.coalesce(_p(6, "int"), F.lit(1)).alias("resid"), F.coalesce(_p(7), F.lit("UNK")).alias("resname"), _p(8, "double").alias("charge"))


def check_mol2(spark: SparkSession, path: str) -> DataFrame:
    """(file, section, declared, found): sections that hold another number of rows than their MOLECULE lines declare."""
    rows, none = _mol2(spark, path), F.lit(0).cast("long")
    head = (F.col("section") == "MOLECULE") & F.trim("line").rlike(r"^\d+(\s+\d+)*$")
    said = lambda section, k: F.sum(F.when(head, F.coalesce(_p(k, "long"), none)).otherwise(none)).alias(f"said{section}")
    had = lambda section: F.sum((F.col("section") == section).cast("long")).alias(f"had{section}")
    sums = rows.groupBy("file").agg(said("ATOM", 0), said("BOND", 1), had("ATOM"), had("BOND"))
    both = F.inline(F.array(*(F.struct(F.lit(x).alias("section"), F.col(f"said{x}").alias("declared"), F.col(f"had{x}").alias("found")) for x in ("ATOM", "BOND"))))
    return sums.select("file", both).where("declared <> found")


def read_mol2_box(spark: SparkSession, path: str) -> DataFrame:
    """(file, a, b, c, alpha, beta, gamma) of a CRYSIN section."""
    return cells(_mol2(spark, path).where("section = 'CRYSIN'"), F.array(*(_p(k, "double") for k in range(6))))


def read_mol2_bonds(spark: SparkSession, path: str) -> DataFrame:
    """(file, atom1, atom2, order): serials, which count within a molecule, become indices; the order is null unless it is a number."""
    rows, none = _mol2(spark, path), F.lit(None).cast("long")
    entry = lambda serial, index, end: F.struct(serial.alias("serial"), index.alias("index"), end.cast("int").alias("end"))
    own = F.when(F.col("section") == "ATOM", F.array(entry(_p(0, "long"), F.col("atom") - 1, none)))
    ends = F.when(F.col("section") == "BOND", F.array(*(entry(_p(k, "long"), none, F.lit(k)) for k in (1, 2))))
    met = rows.select("file", "n", "molecule", _p(3, "int").alias("order"), F.inline(F.coalesce(own, ends))).where("serial is not null")
    # the ends of a bond meet the atom of their serial in the molecule, then each other
    met = met.withColumn("atom", F.max("index").over(Window.partitionBy("file", "molecule", "serial"))).where("end is not null and atom is not null")
    one = lambda k: F.max(F.when(F.col("end") == k, F.col("atom")))
    return met.groupBy("file", "n", "order").agg(one(1).alias("atom1"), one(2).alias("atom2")).where("atom1 is not null and atom2 is not null").select("file", "atom1", "atom2", "order")


def mol2_lines(atoms: DataFrame, order: str = "atom_index") -> DataFrame:
    """(order, value): lines of the ATOM section."""
    x = lambda c: F.lpad(F.format_string("%.4f", F.col(c)), 10, " ")
    return atoms.select(order, F.concat_ws(" ", (F.col(order) + 1).cast("string"), "name", *map(x, "xyz"), F.coalesce("atom_type", F.lit("C.3")), F.col("resid").cast("string"), "resname", x("charge")).alias("value"))


def read_psf_atoms(spark: SparkSession, path: str) -> DataFrame:
    """segid, resid, resname, name, atom_type, charge and mass of the NATOM section."""
    rows = _fields(_scanned(spark, path, F.when(F.col("line").contains("!"), F.regexp_extract("line", r"!(\w+)", 1))).where("section = 'NATOM'"))
    return rows.select("file", F.col("k").alias("atom_index"), _p(1).alias("segid"), F.regexp_extract(_p(2), r"-?\d+", 0).cast("int").alias("resid"), _p(3).alias("resname"), _p(4).alias("name"), _p(5).alias("atom_type"), _float(_p(6)).alias("charge"), _float(_p(7)).alias("mass"))


def psf_lines(atoms: DataFrame, order: str = "atom_index") -> DataFrame:
    """(order, value): lines of the NATOM section, in fields that blanks part at any size."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    return atoms.select(order, F.concat_ws(" ", (F.col(order) + 1).cast("string"), text("segid"), text("resid"), text("resname"), text("name"), text("atom_type"), F.format_string("%.6f", "charge"), F.format_string("%.4f", "mass"), F.lit("0")).alias("value"))


def read_crd(spark: SparkSession, path: str) -> DataFrame:
    """Atoms below `*` titles and a count line, in the fixed columns of the standard layout or, after EXT, of the extended one."""
    row = ~F.col("line").startswith("*") & (F.trim("line") != "")
    rows = scan(spark, path, counts={"k": row}, heads={"head": (row, 1)}).where(row).withColumns({"k": F.col("k") - 1, "wide": F.upper(F.get("head", F.lit(0))["line"]).contains("EXT")}).where("k > 0")
    at = lambda standard, extended, read=_cut: F.when(F.col("wide"), read(*extended)).otherwise(read(*standard))
    x = [at((21 + 10 * k, 10), (41 + 20 * k, 20), _number).alias(c) for k, c in enumerate("xyz")]
    resid = F.coalesce(at((57, 4), (113, 8)).try_cast("int"), at((6, 5), (11, 10)).try_cast("int"))
    return rows.select("file", (F.col("k") - 1).alias("atom_index"), at((12, 4), (23, 8)).alias("resname"), at((17, 4), (33, 8)).alias("name"), *x, at((52, 4), (103, 8)).alias("segid"), resid.alias("resid"))


def crd_head(atoms: DataFrame, order: str = "atom_index") -> tuple[str, bool]:
    """(count line, whether it asks for the extended layout): it does where the standard one has no room for the atoms."""
    labels = F.greatest(*(F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("resname", "name", "segid", "resid")))
    n, top, longest, far = atoms.agg(F.count("*"), F.max(order), F.max(labels), F.max(F.greatest(*(F.length(F.format_string("%.5f", F.col(c))) for c in "xyz")))).first()
    extended = bool(n) and (top >= 99_999 or longest > 4 or (far or 0) > 10)
    return f"{n}  EXT" if extended else str(n), extended


def crd_lines(atoms: DataFrame, order: str = "atom_index", extended: bool = False, digits: int | None = None) -> DataFrame:
    """(order, value): the standard layout holds 99,999 atoms, 9,999 residues and labels of four letters; the extended one more.

    Values without room raise an error. Above the lines belong `*` titles and the count, followed by EXT if extended
    (``crd_head``). Places have 5 decimals, extended 10, or ``digits``.
    """
    n, label, number, gap = (10, 8, 20, "  ") if extended else (5, 4, 10, " ")
    word = lambda c: fit(F.col(c), label, right=False)
    parts = [fit(F.col(order) + 1, n), fit(F.col("resid"), n), F.lit(gap), word("resname"), F.lit(gap), word("name"), *(fixed(F.col(c), number, digits or (10 if extended else 5)) for c in "xyz"), F.lit(gap), word("segid"), F.lit(gap), word("resid"), F.lit("0.00000".rjust(number))]
    return atoms.select(order, F.concat(*parts).alias("value"))


def read_pdbqt(spark: SparkSession, path: str) -> DataFrame:
    """One structure: the columns of a PDB line, then partial charge and atom type; reading stops at END."""
    atom = F.substring("line", 1, 6).isin("ATOM  ", "HETATM")
    rows = scan(spark, path, counts={"ended": F.trim("line") == "END", "atom": atom}).where((F.col("ended") == 0) & atom)
    return rows.select("file", (F.col("atom") - 1).alias("atom_index"), _cut(13, 4).alias("name"), _cut(18, 4).alias("resname"), _cut(22, 1).alias("chain_id"), _number(23, 4, "int").alias("resid"), *(_number(31 + 8 * k, 8).alias(c) for k, c in enumerate("xyz")), _number(69, 8).alias("charge"), _cut(78, 2).alias("atom_type"))


def pdbqt_lines(atoms: DataFrame, order: str = "atom_index") -> DataFrame:
    """(order, value): a line of 79 columns for each atom; what has no room raises an error."""
    word = lambda c, w: fit(F.col(c), w, right=False)
    parts = [F.lit("ATOM  "), fit(F.col(order) % 99999 + 1, 5), F.lit("  "), word("name", 3), F.lit(" "), word("resname", 4), word("chain_id", 1), fit(F.col("resid"), 4), F.lit("    "), *(fixed(F.col(c), 8, 3) for c in "xyz"), F.lit("  1.00  0.00  "), fixed(F.col("charge"), 8, 3), F.lit(" "), word("atom_type", 2)]
    return atoms.select(order, F.concat(*parts).alias("value"))


def _lammps(spark: SparkSession, path: str) -> DataFrame:
    mark = F.when(F.col("line").rlike(r"^\s*[A-Z][a-z]+( [A-Z][a-z]+)*\s*(#.*)?$"), F.trim(F.regexp_replace("line", "#.*", "")))
    return _fields(_scanned(spark, path, mark, heads={"atoms_line": (F.col("line").rlike(r"^\s*Atoms\s*(#.*)?$"), 2)}).where("at > 0"))  # the first line is a title


#: The fields of the styles that have a name.
ATOM_STYLES = {"atomic": "id type x y z", "charge": "id type q x y z", "molecular": "id mol type x y z", "full": "id mol type q x y z"}


def _style_fields(style: str | None) -> Column:
    """The names of an atom line's fields: of a style, of the style named behind ``Atoms #``, or of one with so many fields."""
    named = lambda text: F.split(F.coalesce(F.get(F.filter(F.array(*(F.when(text == k, F.lit(v)) for k, v in ATOM_STYLES.items())), lambda x: x.isNotNull()), 0), text), r"\s+")
    whole = lambda names: F.forall(F.array(*map(F.lit, ("id", "type", "x", "y", "z"))), lambda x: F.array_contains(names, x))
    if style is not None:
        names = named(F.lit(style.strip().lower()))
        return F.when(whole(names), names).otherwise(F.raise_error(F.lit(f"the style {style!r} lacks id, type, x, y or z")).cast("array<string>"))
    said = named(F.lower(F.trim(F.regexp_extract(F.get(F.filter("atoms_line", lambda x: x["n"] > 0), 0)["line"], "#(.*)$", 1))))
    size = F.size(F.split(F.trim(F.regexp_replace("line", "#.*", "")), r"\s+"))
    guess = F.when(size.isin(5, 8), ATOM_STYLES["atomic"]).when(size.isin(6, 9), ATOM_STYLES["molecular"]).otherwise(ATOM_STYLES["full"])
    return F.when(whole(said), said).otherwise(F.split(guess, " "))


def read_lammps_data(spark: SparkSession, path: str, style: str | None = None) -> DataFrame:
    """Atoms of a data file by id, with masses by type and velocities by id.

    ``style`` is atomic, charge, molecular or full, or the names of an atom line's fields; where it is not given, the
    file's own word behind ``Atoms #`` counts, else the number of fields. Ids are sorted in one task a file: they may come in any order.
    """
    rows = _lammps(spark, path).withColumn("fields", _style_fields(style))
    value = lambda name, t: F.get("p", F.nullif(F.array_position("fields", name), F.lit(0)).cast("int") - 1).try_cast(t)
    one = lambda section, *columns: F.max(F.when(F.col("section") == section, F.struct(*columns)))
    atom = one("Atoms", "n", F.coalesce(value("mol", "int"), F.lit(1)).alias("resid"), value("type", "string").alias("atom_type"), value("q", "double").alias("charge"), *(value(c, "double").alias(c) for c in "xyz"))
    speed = one("Velocities", "n", *(_p(1 + k, "double").alias(f"v{c}") for k, c in enumerate("xyz")))
    key = F.when(F.col("section") == "Atoms", value("id", "long")).otherwise(_p(0, "long"))
    found = rows.where(F.col("section").isin("Atoms", "Velocities")).groupBy("file", key.alias("id")).agg(atom.alias("a"), speed.alias("v")).where("a is not null")
    atoms = found.select("file", "id", "a.resid", "a.atom_type", "a.charge", *(f"a.{c}" for c in "xyz"), *(f"v.v{c}" for c in "xyz"))
    masses = rows.where("section = 'Masses'").select("file", _p(0).alias("atom_type"), _p(1, "double").alias("mass"))
    index = (F.row_number().over(Window.partitionBy("file").orderBy("id")) - 1).cast("long")
    return atoms.join(masses, ["file", "atom_type"], "left").select("file", index.alias("atom_index"), "id", F.concat(F.lit("TYPE"), "atom_type").alias("name"), "atom_type", "resid", "mass", "charge", *"xyz", "vx", "vy", "vz")


def read_lammps_bonds(spark: SparkSession, path: str) -> DataFrame:
    """(file, id1, id2, order): atom ids and the bond's type as its order."""
    rows = _lammps(spark, path).where("section = 'Bonds'")
    return rows.select("file", _p(2, "long").alias("id1"), _p(3, "long").alias("id2"), _p(1, "int").alias("order"))


def _tilted(low: list[Column], high: list[Column], tilt: list[Column]) -> Column:
    """[a, b, c, alpha, beta, gamma] of a cell given by edges along the axes and tilts xy, xz, yz."""
    side = [h - n for n, h in zip(low, high)]
    zero = F.lit(0.0)
    xy, xz, yz = (F.coalesce(t, zero) for t in tilt)
    return lattice_angles(Vec(side[0], zero, zero), Vec(xy, side[1], zero), Vec(xz, yz, side[2]))


def read_lammps_box(spark: SparkSession, path: str) -> DataFrame:
    """(file, a, b, c, alpha, beta, gamma) from a data file's xlo xhi, ylo yhi, zlo zhi and xy xz yz lines."""
    rows = _fields(spark.read.text(path).select(source_file().alias("file"), F.regexp_replace("value", "\r", "").alias("line")))
    pick = lambda tag, at, k: F.max(F.when(_p(at) == tag, _p(k, "double")))
    held = rows.groupBy("file").agg(*(pick(f"{c}lo", 2, k).alias(f"{side}{c}") for c in "xyz" for k, side in enumerate(("low", "high"))), *(pick("xy", 3, k).alias(t) for k, t in enumerate(("xy", "xz", "yz"))))
    return cells(held.where("lowx is not null"), _tilted([F.col(f"low{c}") for c in "xyz"], [F.col(f"high{c}") for c in "xyz"], [F.col(t) for t in ("xy", "xz", "yz")]))


def lammps_lines(atoms: DataFrame, order: str = "atom_index") -> DataFrame:
    """(order, value): lines of an Atoms section in the full style; ids are indices plus one and types numbers."""
    return atoms.select(order, F.concat_ws(" ", (F.col(order) + 1).cast("string"), F.col("resid").cast("string"), F.col("atom_type").cast("string"), F.format_string("%.6f", "charge"), *(F.format_string("%.6f", c) for c in "xyz")).alias("value"))


def _dump(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all items with their frame, and each frame's step and cell: edges of the cell itself, which tilts make smaller than the bounds."""
    item = F.when(F.col("line").startswith("ITEM:"), F.trim(F.substring("line", 6, 1000)))
    rows = _fields(_scanned(spark, path, item, counts={"stepped": item == "TIMESTEP"})).withColumn("frame", F.col("stepped") - 1)
    frame = Window.partitionBy("file", "frame")  # atoms are sorted frame by frame below
    bound = lambda k, e: F.coalesce(F.max(F.when(F.col("section").startswith("BOX BOUNDS") & (F.col("k") == k), _p(e, "double"))).over(frame), F.lit(0.0))
    step = F.max(F.when(F.col("section") == "TIMESTEP", _p(0, "long"))).over(frame)
    held = rows.withColumns({"step": step, **{f"{side}_{c}": bound(k, e) for k, c in enumerate("xyz") for e, side in enumerate(("low", "high"))}, **{t: bound(k, 2) for k, t in enumerate(("xy", "xz", "yz"))}})
    zero, both = F.lit(0.0), F.col("xy") + F.col("xz")
    inner = {"low_x": F.col("low_x") - F.least(zero, F.col("xy"), F.col("xz"), both), "high_x": F.col("high_x") - F.greatest(zero, F.col("xy"), F.col("xz"), both), "low_y": F.col("low_y") - F.least(zero, F.col("yz")), "high_y": F.col("high_y") - F.greatest(zero, F.col("yz"))}
    return held.withColumns(inner)


def read_lammps_dump(spark: SparkSession, path: str, unwrap: bool = False, extra: tuple[str, ...] = (), corner: bool = False) -> DataFrame:
    """(file, frame_index, step, id, atom_index, x, y, z, vx, vy, vz), sorted by id within frames; scaled xs, ys, zs are multiplied out, in tilted cells too.

    ``unwrap`` moves wrapped places by the cells that the image flags ix, iy, iz count; unwrapped columns stay. ``extra``
    names further columns of numbers to keep. ``corner`` takes the cell's lower corner off all places; products of
    scaled ones are then counted from it to begin with. Missing columns give nulls.
    """
    held = _dump(spark, path).where("startswith(section, 'ATOMS')").withColumn("names", F.split(F.trim(F.substring("section", 6, 1000)), r"\s+"))
    named = lambda name: F.get("p", (F.array_position("names", name) - 1).cast("int")).try_cast("double")  # noqa: E731  (null for a name that is missing)
    has = lambda name: F.array_contains("names", name)
    span = lambda c: F.col(f"high_{c}") - F.col(f"low_{c}")
    s = {c: F.coalesce(named(f"{c}s"), named(f"{c}su")) for c in "xyz"}
    scaled = {"x": F.col("low_x") + s["x"] * span("x") + s["y"] * F.col("xy") + s["z"] * F.col("xz"), "y": F.col("low_y") + s["y"] * span("y") + s["z"] * F.col("yz"), "z": F.col("low_z") + s["z"] * span("z")}
    place = {c: F.coalesce(named(c), scaled[c], named(f"{c}u")) for c in "xyz"}
    if unwrap:
        i = {c: F.when(has(c) | has(f"{c}s"), named(f"i{c}")).otherwise(0.0) for c in "xyz"}
        moved = {"x": i["x"] * span("x") + i["y"] * F.col("xy") + i["z"] * F.col("xz"), "y": i["y"] * span("y") + i["z"] * F.col("yz"), "z": i["z"] * span("z")}
        place = {c: place[c] + moved[c] for c in "xyz"}
    if corner:
        place = {c: v - F.col(f"low_{c}") * F.when(has(c) | has(f"{c}u") & ~has(f"{c}s") & ~has(f"{c}su"), 1).otherwise(2) for c, v in place.items()}
    index = (F.row_number().over(Window.partitionBy("file", "frame").orderBy("id")) - 1).cast("long")
    held = held.withColumns({"id": named("id").cast("long"), **{f"_{c}": v for c, v in place.items()}})
    return held.select("file", F.col("frame").cast("int").alias("frame_index"), "step", "id", *(F.col(f"_{c}").alias(c) for c in "xyz"), *(named(f"v{c}").alias(f"v{c}") for c in "xyz"), *(named(c).alias(c) for c in extra), index.alias("atom_index"))


def read_lammps_dump_box(spark: SparkSession, path: str) -> DataFrame:
    """(file, frame_index, a, b, c, alpha, beta, gamma) of every frame."""
    held = _dump(spark, path).where("section = 'TIMESTEP'").withColumn("frame_index", F.col("frame").cast("int"))
    return cells(held, _tilted([F.col(f"low_{c}") for c in "xyz"], [F.col(f"high_{c}") for c in "xyz"], [F.col(t) for t in ("xy", "xz", "yz")]), "frame_index")


def read_tinker(spark: SparkSession, path: str) -> DataFrame:
    """(file, frame_index, atom_index, id, name, x, y, z, atom_type, partners) of one or many frames, with or without box lines."""
    p = F.split(F.trim("line"), r"\s+")
    number = lambda k: F.get(p, F.lit(k)).try_cast("double")
    atom = (F.size(p) >= 6) & number(1).isNull() & number(2).isNotNull()
    rows = scan(spark, path, counts={"k": atom}, heads={"head": (F.trim("line") != "", 1)}).where(atom)
    rows = _fields(rows.withColumns({"k": F.col("k") - 1, "size": F.get(F.split(F.trim(F.get("head", F.lit(0))["line"]), r"\s+"), F.lit(0)).try_cast("int")}))
    return rows.select("file", F.floor(F.col("k") / F.col("size")).cast("int").alias("frame_index"), (F.col("k") % F.col("size")).cast("long").alias("atom_index"), _p(0, "long").alias("id"), _p(1).alias("name"), *(_p(2 + k, "double").alias(c) for k, c in enumerate("xyz")), _p(5).alias("atom_type"), F.transform(F.slice("p", 7, 99), lambda s: s.try_cast("long")).alias("partners"))


def tinker_lines(coords: DataFrame, title: str = "") -> DataFrame:
    """(frame_index, n, value): a count line and a line an atom; coords need name, atom_type and partners (ids counted from 1)."""
    head = coords.groupBy("frame_index").agg(F.count("*").alias("count")).select("frame_index", F.lit(-1).cast("long").alias("n"), F.concat_ws(" ", F.col("count").cast("string"), F.lit(title)).alias("value"))
    body = coords.select("frame_index", F.col("atom_index").alias("n"), F.concat_ws(" ", (F.col("atom_index") + 1).cast("string"), "name", *(F.format_string("%.6f", c) for c in "xyz"), F.col("atom_type").cast("string"), F.array_join(F.col("partners").cast("array<string>"), " ")).alias("value"))
    return head.union(body)


def _inpcrd(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, i, v, total): the numbers below the header, fixed fields of 12 columns, six a line."""
    fields = F.when(F.trim("line") != "", F.ceil(F.length(F.rtrim("line")) / 12)).otherwise(0)
    lines = scan(spark, path, counts={"row": F.trim("line") != "", "fields": fields}, heads={"head": (F.lit(True), 2)})
    above = lambda of: F.aggregate("head", F.lit(0).cast("long"), lambda s, x: s + of(x["line"]))
    size = F.element_at(F.split(F.trim(F.get("head", F.lit(1))["line"]), r"\s+"), 1).try_cast("long")
    full = above(lambda x: (F.trim(x) != "").cast("long"))
    held = lines.where("n >= 2 and trim(line) <> ''").withColumns({"size": size, "row": F.col("row") - full - 1, "total": F.col("fields_total") - above(lambda x: F.when(F.trim(x) != "", F.ceil(F.length(F.rtrim(x)) / 12)).otherwise(0))})
    cut = F.expr("transform(sequence(0, cast(ceil(length(rtrim(line)) / 12) as int) - 1), k -> try_cast(trim(substring(line, 12 * k + 1, 12)) as double))")
    # only the last line of the coordinates, and of the velocities, may be short
    held = held.withColumn("per", F.ceil(F.col("size") / 2)).withColumn("part", F.floor(F.col("row") / F.col("per")))
    values = held.select("file", "size", "row", "per", "part", "total", F.posexplode(cut).alias("k", "v"))
    return values.withColumn("i", F.col("part") * 3 * F.col("size") + (F.col("row") - F.col("part") * F.col("per")) * 6 + F.col("k"))


def read_inpcrd(spark: SparkSession, path: str) -> DataFrame:
    """(file, atom_index, x, y, z, vx, vy, vz): velocities are null where the file has none; six numbers after coordinates are a box."""
    rows = _inpcrd(spark, path).withColumns({"second": F.col("i") >= 3 * F.col("size"), "atom_index": F.floor((F.col("i") % (3 * F.col("size"))) / 3), "axis": F.col("i") % 3})
    rows = rows.where((F.col("i") < 3 * F.col("size")) | ((F.col("i") < 6 * F.col("size")) & F.col("total").isin(6 * F.col("size"), 6 * F.col("size") + 6) & (F.col("total") != 3 * F.col("size") + 6)))
    pick = lambda second, k: F.max(F.when((F.col("axis") == k) & (F.col("second") == second), F.col("v")))
    return rows.groupBy("file", "atom_index").agg(*(pick(False, k).alias(c) for k, c in enumerate("xyz")), *(pick(True, k).alias(f"v{c}") for k, c in enumerate("xyz")))


def read_inpcrd_box(spark: SparkSession, path: str) -> DataFrame:
    """(file, a, b, c, alpha, beta, gamma): the six numbers after coordinates, or after coordinates and velocities."""
    rows = _inpcrd(spark, path).where(F.col("total").isin(3 * F.col("size") + 6, 6 * F.col("size") + 6)).withColumn("k", F.col("i") - F.col("total") + 6).where("k >= 0")
    return rows.groupBy("file").agg(*(F.max(F.when(F.col("k") == k, F.col("v"))).alias(c) for k, c in enumerate(CELL)))


def inpcrd_lines(atoms: DataFrame, order: str = "atom_index") -> DataFrame:
    """(n, value): two atoms a line."""
    one = F.concat(*(F.lpad(F.format_string("%.7f", F.col(c)), 12, " ") for c in "xyz"))
    return atoms.groupBy(F.floor(F.col(order) / 2).alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("i"), one.alias("v")))), lambda s: s["v"]), "").alias("value"))


def _aims(spark: SparkSession, path: str) -> DataFrame:
    """Rows of fields with the number of atoms up to each, and the lattice vectors, if any."""
    row = (F.trim("line") != "") & ~F.trim("line").startswith("#")
    word = F.element_at(F.split(F.trim("line"), r"\s+"), 1)
    rows = scan(spark, path, counts={"atoms": row & word.isin("atom", "atom_frac")}, heads={"cell": (row & (word == "lattice_vector"), 3)}).where(row)
    at = lambda k, m: F.get(F.split(F.trim(F.get("cell", F.lit(k))["line"]), r"\s+"), F.lit(1 + m)).try_cast("double")
    return _fields(rows.withColumns({f"{v}{c}": at(k, m) for k, v in enumerate("abc") for m, c in enumerate("xyz")}))


def read_aims(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of a geometry file, with the velocity line below each, if any; fractional ones are multiplied by its three lattice vectors."""
    rows = _aims(spark, path).where(_p(0).isin("atom", "atom_frac", "velocity"))
    frac = _p(0) == "atom_frac"
    place = lambda m, c: F.when(frac, sum(_p(1 + k, "double") * F.col(f"{v}{c}") for k, v in enumerate("abc"))).otherwise(_p(1 + m, "double"))
    atom = F.max(F.when(_p(0) != "velocity", F.struct("n", _p(4).alias("name"), *(place(m, c).alias(c) for m, c in enumerate("xyz")))))
    speed = F.max(F.when(_p(0) == "velocity", F.struct("n", *(_p(1 + k, "double").alias(f"v{c}") for k, c in enumerate("xyz")))))
    found = rows.groupBy("file", (F.col("atoms") - 1).cast("long").alias("atom_index")).agg(atom.alias("a"), speed.alias("v")).where("a is not null")
    return found.select("file", "atom_index", "a.name", *(f"a.{c}" for c in "xyz"), *(f"v.v{c}" for c in "xyz"))


def read_aims_box(spark: SparkSession, path: str) -> DataFrame:
    """(file, a, b, c, alpha, beta, gamma) of its lattice vectors."""
    cell = _aims(spark, path).where(F.size("cell") > 0).groupBy("file").agg(*(F.max(f"{v}{c}").alias(f"{v}{c}") for v in "abc" for c in "xyz"))
    return cells(cell, lattice_angles(*(Vec(*(F.col(f"{v}{c}") for c in "xyz")) for v in "abc")))


def aims_lines(atoms: DataFrame, order: str = "atom_index") -> DataFrame:
    return atoms.select(order, F.concat_ws(" ", F.lit("atom"), *(F.format_string("%.8f", F.col(c)) for c in "xyz"), "name").alias("value"))


def _dlpoly(spark: SparkSession, path: str, history: bool) -> DataFrame:
    """Lines below the header with the frame, and the place k in it: a step line (in a history), three cell rows unless imcon is 0, then blocks of an atom."""
    lines = _fields(scan(spark, path, heads={"head": (F.lit(True), 2)}).where("trim(line) <> ''")).withColumn("head", F.split(F.trim(F.get("head", F.lit(1))["line"]), r"\s+"))
    of = lambda k, kind: F.get("head", F.lit(k)).try_cast(kind)
    rows = lines.where("n >= 2").withColumns({"lev": of(0, "int"), "imcon": of(1, "int"), "size": of(2, "long")}).withColumn("cell", F.when(F.col("imcon") != 0, 3).otherwise(0))
    if not history:
        return rows.withColumns({"frame": F.lit(0).cast("long"), "k": F.col("n") - 2})
    per = 1 + F.col("cell") + F.col("size") * (F.col("lev") + 2)
    return rows.withColumns({"frame": F.floor((F.col("n") - 2) / per), "k": (F.col("n") - 2) % per - 1})


def _dlpoly_atoms(rows: DataFrame, head: dict[str, Column] | None = None) -> DataFrame:
    """Atoms in the order of their numbers, frame by frame; ``head``: what to take from each frame's first line (k = -1)."""
    head = head or {}
    rows = rows.where((F.col("k") == -1) | (F.col("k") >= F.col("cell"))).withColumn("a", F.col("k") - F.col("cell"))
    rows = rows.withColumns({"block": F.when(F.col("k") < 0, -1).otherwise(F.floor(F.col("a") / (F.col("lev") + 2))), "m": F.when(F.col("k") >= 0, F.col("a") % (F.col("lev") + 2))})
    three = lambda m, name: F.max(F.when(F.col("m") == m, F.struct(*(_float(_p(k)).alias(c) for k, c in enumerate("xyz"))))).alias(name)
    found = rows.groupBy("file", "frame", "block").agg(F.max(F.when(F.col("m") == 0, F.struct(_p(0).alias("name"), _p(1, "long").alias("id")))).alias("a"), three(1, "r"), three(2, "v"), three(3, "f"), *(F.max(F.when(F.col("k") == -1, c)).alias(name) for name, c in head.items()))
    frame = Window.partitionBy("file", "frame")
    found = found.withColumns({name: F.max(name).over(frame) for name in head}).where("block >= 0")
    return found.select("file", F.col("frame").cast("int").alias("frame_index"), *head, (F.row_number().over(frame.orderBy("a.id", "block")) - 1).cast("long").alias("atom_index"), "a.name", *(F.col(f"{t}.{c}").alias(f"{p}{c}") for t, p in (("r", ""), ("v", "v"), ("f", "f")) for c in "xyz"))


def _dlpoly_cells(rows: DataFrame) -> DataFrame:
    held = rows.where("cell = 3 and k between 0 and 2").groupBy("file", F.col("frame").cast("int").alias("frame_index")).agg(*(F.max(F.when(F.col("k") == k, _float(_p(m)))).alias(f"{v}{c}") for k, v in enumerate("abc") for m, c in enumerate("xyz")))
    return cells(held, lattice_angles(*(Vec(*(F.col(f"{v}{c}") for c in "xyz")) for v in "abc")), "frame_index")


def read_dlpoly_config(spark: SparkSession, path: str) -> DataFrame:
    """(file, atom_index, name, x, y, z, vx, vy, vz, fx, fy, fz) of a CONFIG file, sorted by the atoms' numbers; what its level lacks is null."""
    return _dlpoly_atoms(_dlpoly(spark, path, False)).drop("frame_index")


def read_dlpoly_box(spark: SparkSession, path: str) -> DataFrame:
    """(file, a, b, c, alpha, beta, gamma) of a CONFIG file with a cell."""
    return _dlpoly_cells(_dlpoly(spark, path, False)).drop("frame_index")


def read_dlpoly_history(spark: SparkSession, path: str) -> DataFrame:
    """(file, frame_index, step, time, atom_index, name, x ... fz) of every frame of a HISTORY file; the time is the last number of a step line."""
    last = F.element_at(F.filter(F.transform("p", lambda s: s.try_cast("double")), lambda v: v.isNotNull()), -1)
    return _dlpoly_atoms(_dlpoly(spark, path, True), {"step": _p(1, "long"), "time": last})


def read_dlpoly_history_box(spark: SparkSession, path: str) -> DataFrame:
    return _dlpoly_cells(_dlpoly(spark, path, True))


def dlpoly_lines(frames: DataFrame, cells: DataFrame | None = None, history: bool = True, level: int = 0) -> DataFrame:
    """(frame_index, part, n, value, entries): the lines below the header of a history, or of a configuration of one frame.

    ``frames`` holds frame_index, atom_index, name, x, y, z and, from level 1 on, vx, vy, vz, at level 2 fx, fy, fz;
    ``cells`` frame_index and a ... gamma. Above the lines belong a title, and level, 0 or 3 with cells, and the number
    of atoms: the entries of the first frame.
    """
    three = lambda *c: F.format_string("%.12e %.12e %.12e", *(F.col(x) for x in c))
    parts = [F.format_string("%-8s %8d", "name", F.col("atom_index") + 1), three(*"xyz"), *([three("vx", "vy", "vz")] if level else []), *([three("fx", "fy", "fz")] if level > 1 else [])]
    least = frames.agg(F.min("frame_index").alias("_first"))  # one row
    body = frames.join(F.broadcast(least)).select("frame_index", F.lit(2).alias("part"), F.col("atom_index").alias("n"), F.concat_ws("\n", *parts).alias("value"), (F.col("frame_index") == F.col("_first")).cast("long").alias("entries"))
    out = body
    none = F.lit(0).cast("long")
    if history:
        sizes = frames.groupBy("frame_index").agg(F.count("*").alias("_n"))
        out = out.union(sizes.select("frame_index", F.lit(0), none, F.format_string(f"timestep %d %d {level} {0 if cells is None else 3} %.12e", "frame_index", "_n", F.col("frame_index").cast("double")), none))
    if cells is not None:
        v = cell_vectors(*(F.col(c) for c in CELL))
        rows = cells.select("frame_index", F.posexplode(F.array(*(F.format_string("%.12e %.12e %.12e", *x) for x in v))).alias("k", "value"))
        out = out.union(rows.select("frame_index", F.lit(1), F.col("k").cast("long"), "value", none))
    return out


def _hoomd(spark: SparkSession, path: str) -> DataFrame:
    """(file, frame, tag, i, word): the words of every element with their place in it, and the number of its configuration.

    Tags must stand within a line; what is between two tags may take any number of lines. Comments are tags.
    """
    piece = F.filter(F.regexp_extract_all("line", F.lit("<[^>]*>|[^<]+"), 0), lambda x: F.trim(x) != "")
    words = F.when(F.col("line").startswith("<"), 0).otherwise(F.size(F.split(F.trim("line"), r"\s+")))
    begins = F.col("line").rlike(r"^<configuration\b")
    rows = scan(spark, path, {"tag": F.when(F.col("line").startswith("<"), F.col("line"))}, {"words": words, "frame": begins}, pieces=piece)
    name = F.regexp_extract(F.col("tag.value"), r"^<(\w+)", 1)
    return rows.where("tag is not null").select("file", (F.greatest("frame", F.lit(1)) - 1).cast("int").alias("frame"), name.alias("tag"), F.when(F.col("line").startswith("<box"), F.col("line")).alias("box"), (F.col("words") - words - F.col("tag.words")).alias("first"), F.when(~F.col("line").startswith("<"), F.split(F.trim("line"), r"\s+")).alias("p"))


def _words(rows: DataFrame, *tags: str) -> DataFrame:
    some = rows.where(F.col("tag").isin(*tags) & F.col("p").isNotNull())
    return some.select("file", "frame", "tag", "first", F.posexplode("p").alias("_k", "word")).select("file", "frame", "tag", (F.col("first") + F.col("_k")).alias("i"), "word")


def read_hoomd_xml(spark: SparkSession, path: str) -> DataFrame:
    """(file, frame_index, atom_index, name, x, y, z, mass, charge, radius): the lists of each configuration, side by side.

    Lists may lie in any number of blocks of the file: words are numbered within their element and meet by their atom.
    """
    rows = _words(_hoomd(spark, path), "position", "type", "mass", "charge", "diameter")
    three = F.col("tag") == "position"
    atom = F.when(three, F.floor(F.col("i") / 3)).otherwise(F.col("i"))
    one = lambda tag: F.max(F.when(F.col("tag") == tag, F.col("word")))
    axis = lambda k: F.max(F.when(three & (F.col("i") % 3 == k), F.col("word"))).try_cast("double")
    found = rows.groupBy("file", F.col("frame").alias("frame_index"), atom.cast("long").alias("atom_index")).agg(one("type").alias("name"), *(axis(k).alias(c) for k, c in enumerate("xyz")), F.coalesce(one("mass").try_cast("double"), F.lit(1.0)).alias("mass"), F.coalesce(one("charge").try_cast("double"), F.lit(0.0)).alias("charge"), (one("diameter").try_cast("double") / 2).alias("radius"), F.sum((three & (F.col("i") % 3 == 2)).cast("int")).alias("_placed"))
    return found.where("_placed = 1").drop("_placed")


def read_hoomd_groups(spark: SparkSession, path: str, tag: str = "bond") -> DataFrame:
    """(file, frame_index, i, kind, members): the rows of a ``bond``, ``angle``, ``dihedral`` or ``improper`` element."""
    size = {"bond": 2, "angle": 3, "dihedral": 4, "improper": 4}[tag] + 1
    rows = _words(_hoomd(spark, path), tag).withColumns({"row": F.floor(F.col("i") / size), "k": F.col("i") % size})
    one = lambda k: F.max(F.when(F.col("k") == k, F.col("word")))
    found = rows.groupBy("file", F.col("frame").alias("frame_index"), F.col("row").cast("long").alias("i")).agg(one(0).alias("kind"), F.array(*(one(k).try_cast("long") for k in range(1, size))).alias("members"), F.count("*").alias("_n"))
    return found.where(F.col("_n") == size).drop("_n")


def read_hoomd_box(spark: SparkSession, path: str) -> DataFrame:
    """(file, frame_index, a, b, c, alpha, beta, gamma) of the box elements: edges lx ly lz, tilts xy xz yz as shares of ly, lz, lz."""
    text = _hoomd(spark, path).where("box is not null").withColumnRenamed("frame", "frame_index")
    at = lambda name: F.coalesce(F.regexp_extract("box", rf'\b{name}\s*=\s*"([^"]*)"', 1).try_cast("double"), F.lit(0.0))
    zero = F.lit(0.0)
    return cells(text, lattice_angles(Vec(at("lx"), zero, zero), Vec(at("xy") * at("ly"), at("ly"), zero), Vec(at("xz") * at("lz"), at("yz") * at("lz"), at("lz"))), "frame_index")


def attach(atoms: DataFrame, coords: DataFrame, ids: bool = False) -> DataFrame:
    """Topology and trajectory joined; rows of frames whose atoms are not the topology's raise an error.

    Each frame must have the topology's number of atoms, met by atom_index. With ``ids`` atoms meet by ``id`` instead,
    whatever order a frame has them in, and take the topology's atom_index; each frame must hold each of the
    topology's ids once and no other, compared as they are. The check runs with the result, not before.
    """
    if not ids:
        whole = atoms.agg(F.count("*").alias("_n"), F.lit(True).alias("_single"))
        frames = coords.groupBy("frame_index").agg(F.count("*").alias("_m"), F.count("*").alias("_known"), F.count("*").alias("_distinct"))
        met = atoms.drop(*"xyz").join(coords, "atom_index")
    else:
        whole = atoms.agg(F.count("*").alias("_n"), (F.count("*") == F.count_distinct("id")).alias("_single"))
        own = atoms.select("id", F.lit(1).alias("_own"))
        frames = coords.select("frame_index", "id").join(own, "id", "left").groupBy("frame_index").agg(F.count("*").alias("_m"), F.count("_own").alias("_known"), F.count_distinct("id").alias("_distinct"))
        met = atoms.drop(*"xyz").join(coords.drop("atom_index"), "id")
    fine = F.col("_single") & (F.col("_m") == F.col("_n")) & (F.col("_known") == F.col("_n")) & (F.col("_distinct") == F.col("_n"))
    checked = frames.join(F.broadcast(whole)).select("frame_index", F.when(fine, F.lit(0)).otherwise(F.raise_error(F.concat(F.lit("frame "), F.col("frame_index").cast("string"), F.lit(" has other atoms than the topology"))).cast("int")).alias("_ok"))  # whole is one row
    return met.join(checked, "frame_index", "right").where("_ok = 0").drop("_ok")
