"""Structure files as DataFrames: fixed-width and column text by built-in string functions.

Every reader returns atoms with atom_index (order in the file), labels and x, y, z; multi-frame files also carry
frame_index. Fields that are blank or no numbers are null; empty files give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitframe.functions.vectors import Vec, lattice_angles
from orbitframe.sources.lines import fit, fixed, scan, write_lines

__all__ = ["write_lines"]
CELL = ("a", "b", "c", "alpha", "beta", "gamma")


def _cut(start: int, length: int) -> Column:
    """Trimmed columns of a fixed-width line, counted from one; null if blank."""
    part = F.trim(F.substring("line", start, length))
    return F.when(part != "", part)


def _number(start: int, length: int, kind: str = "double") -> Column:
    return _cut(start, length).try_cast(kind)


def cells(rows: DataFrame, box: Column, *by: str) -> DataFrame:
    """(file, *by, a, b, c, alpha, beta, gamma) from an array of the six."""
    held = rows.select("file", *by, box.alias("_box"))
    return held.select("file", *by, *(F.get("_box", F.lit(k)).alias(c) for k, c in enumerate(CELL)))


def hybrid36(value: Column, width: int) -> Column:
    """The number of a field of ``width`` columns that goes on in base 36 where its digits end: 9999, A000 ... ZZZZ, a000."""
    number = F.conv(F.upper(value), 36, 10).cast("long")
    upper, lower = number - 10 * 36 ** (width - 1) + 10**width, number + 16 * 36 ** (width - 1) + 10**width
    whole = F.length(value) == width
    return F.when(value.rlike(r"^-?\d+$"), value.try_cast("long")).when(whole & value.rlike("^[A-Z][0-9A-Z]*$"), upper).when(whole & value.rlike("^[a-z][0-9a-z]*$"), lower)


def hybrid36_text(number: Column, width: int) -> Column:
    """What ``hybrid36`` reads as this number: digits as far as they reach, then base 36; numbers without room raise an error."""
    digits, letters = 10**width, 26 * 36 ** (width - 1)
    coded = F.conv((number - F.when(number < digits + letters, 0).otherwise(letters) + (10 * 36 ** (width - 1) - digits)).cast("string"), 10, 36)
    text = F.when(number < digits, number.cast("string")).when(number < digits + letters, coded).when(number < digits + 2 * letters, F.lower(coded)).otherwise(number.cast("string"))
    return fit(text, width)


def _segid() -> Column:
    """Columns 73 to 76; a longer label ends there and reaches, without a blank, into the unused columns before."""
    return F.when(F.substring("line", 72, 2).rlike(r"^\S\S$"), F.regexp_extract(F.rtrim(F.substring("line", 67, 10)), r"(\S+)$", 1)).otherwise(_cut(73, 4))


def _is_atom() -> Column:
    return F.substring("line", 1, 6).isin("ATOM  ", "HETATM")


def _pdb(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the model's number and, at atoms, the atom's in it."""
    begins = F.substring("line", 1, 5) == "MODEL"
    serial = hybrid36(_cut(7, 5), 5)
    lines = scan(spark, path, {"at": F.when(begins, F.lit(True)), "told": F.when(_is_atom(), serial)}, {"model": begins, "atom": _is_atom()})
    # where a serial has run over into stars, numbers go on from the last one
    lines = lines.withColumn("serial", F.when(_cut(7, 5).rlike(r"^\*+$"), F.col("told.value") + F.col("atom") - F.col("told.atom")).otherwise(serial))
    return lines.withColumns({"frame_index": (F.greatest("model", F.lit(1)) - 1).cast("int"), "atom_index": F.col("atom") - 1 - F.when(F.col("model") > 1, F.col("at.atom")).otherwise(0)})


def read_pdb(spark: SparkSession, path: str) -> DataFrame:
    """ATOM and HETATM records, a frame a MODEL; later models repeat the atoms of the first.

    Serials and residue numbers may be hybrid-36; serials of stars follow the number before them; residue numbers of five digits reach into the next column. Where
    numbers start again after 9999, 10,000 is added for the rest of the model (taken model by model, in one task each).
    """
    rows = _pdb(spark, path).where(_is_atom())
    wide = F.substring("line", 23, 5).rlike(r"^\s*\d{5}$")
    rows = rows.withColumns({"wide": wide, "number": F.when(wide, _number(23, 5, "long")).otherwise(F.coalesce(hybrid36(_cut(23, 4), 4), F.lit(1)))})
    model = Window.partitionBy("file", "frame_index").orderBy("atom_index")
    rows = rows.withColumn("fell", F.col("number") - F.lag("number").over(model) < -5000)
    again = F.max(F.col("fell")).over(model.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(
        "file", "frame_index", "atom_index", "serial", _cut(13, 4).alias("name"), _cut(18, 4).alias("resname"), _cut(22, 1).alias("chain_id"),
        (F.col("number") + F.when(F.coalesce(again, F.lit(False)) & ~F.col("wide"), 10_000).otherwise(0)).cast("int").alias("resid"), F.when(~F.col("wide"), _cut(27, 1)).alias("insertion_code"), _number(31, 8).alias("x"), _number(39, 8).alias("y"), _number(47, 8).alias("z"),
        _number(55, 6).alias("occupancy"), _number(61, 6).alias("temp_factor"), _segid().alias("segid"), _cut(77, 2).alias("element"),
    )


def read_pdb_box(spark: SparkSession, path: str) -> DataFrame:
    """(file, a, b, c, alpha, beta, gamma) of the last CRYST1 record that is complete and no unit placeholder."""
    at = ((7, 9), (16, 9), (25, 9), (34, 7), (41, 7), (48, 7))
    rows = scan(spark, path).where("startswith(line, 'CRYST1')").withColumn("box", F.array(*(_number(*x) for x in at)))
    good = rows.where(F.forall("box", lambda v: v.isNotNull()) & (F.col("box") != F.array(*map(F.lit, (1.0, 1.0, 1.0, 90.0, 90.0, 90.0)))))
    return cells(good.groupBy("file").agg(F.max_by("box", "n").alias("box")), F.col("box"))


def read_pdb_bonds(spark: SparkSession, path: str) -> DataFrame:
    """(file, atom1, atom2) of CONECT records, each bond once with atom1 < atom2; serials that no atom has are left out."""
    rest = F.rtrim(F.substring("line", 7, 1000))
    free = F.filter(F.split(rest, r"\s+"), lambda s: s != "")
    cut = F.transform(F.sequence(F.lit(0), F.ceil(F.length(rest) / 5).cast("int") - 1), lambda k: F.trim(F.substr(rest, 5 * k + 1, F.lit(5))))
    fields = F.when(F.forall(free, lambda s: F.length(s) <= 5), free).otherwise(F.filter(cut, lambda s: s != ""))
    p = F.transform(fields, lambda s: hybrid36(s, 5))
    entry = lambda serial, index, k: F.struct(serial.alias("end"), index.alias("index"), k.cast("long").alias("k"))
    none = F.lit(None).cast("long")
    own = F.when(_is_atom() & (F.col("frame_index") == 0), F.array(entry(F.col("serial"), F.col("atom_index"), none)))
    ends = F.when(F.col("line").startswith("CONECT"), F.flatten(F.transform(F.slice(p, 2, 100), lambda s, k: F.array(entry(F.get(p, F.lit(0)), none, k), entry(s, none, k)))))
    met = _pdb(spark, path).select("file", "n", F.inline(F.coalesce(own, ends))).where("end is not null")
    # the ends of a bond meet the atom of their serial, then each other
    met = met.withColumn("atom", F.max("index").over(Window.partitionBy("file", "end"))).where("k is not null and atom is not null")
    pairs = met.groupBy("file", "n", "k").agg(F.min("atom").alias("atom1"), F.max("atom").alias("atom2"), F.count("*").alias("ends"))
    return pairs.where("ends = 2 and atom1 < atom2").select("file", "atom1", "atom2").distinct()


def pdb_lines(atoms: DataFrame, order: str = "atom_index", serial: Column | None = None) -> DataFrame:
    """(order, value): a line of 80 columns for each atom; serials, the order and one if not given, go on in hybrid-36.

    Residue numbers of five digits take the next column, larger ones are hybrid-36; segments of up to ten letters reach
    into the unused columns before theirs.
    """
    c = {f.name for f in atoms.schema}
    col = lambda name, default="": F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in c else F.lit(default)
    full = (F.length(col("element")) == 2) | (F.length(col("name")) >= 4)
    name = fit(F.when(full, col("name")).otherwise(F.concat(F.lit(" "), col("name"))), 4, right=False)
    number = lambda n, w, d: fixed(F.col(n), w, d) if n in c else F.lit(" " * w)
    resid = F.when(F.length(col("resid", "1")) > 5, F.concat(hybrid36_text(F.col("resid"), 4) if "resid" in c else F.lit(""), fit(col("insertion_code"), 1))).when(F.length(col("resid", "1")) > 4, fit(col("resid", "1"), 5)).otherwise(F.concat(fit(col("resid", "1"), 4), fit(col("insertion_code"), 1)))
    segid = F.when(F.length(col("segid")) > 4, fit(col("segid"), 10)).otherwise(F.concat(F.lit(" " * 6), fit(col("segid"), 4, right=False)))
    parts = [F.lit("ATOM  "), hybrid36_text(F.col(order) + 1 if serial is None else serial, 5), F.lit(" "), name, F.lit(" "), fit(col("resname"), 4, right=False), fit(col("chain_id"), 1), resid, F.lit("   "), number("x", 8, 3), number("y", 8, 3), number("z", 8, 3), number("occupancy", 6, 2), number("temp_factor", 6, 2), segid, fit(col("element"), 2), F.lit("  ")]
    return atoms.select(order, F.concat(*parts).alias("value"))


def pdb_box_line(box: tuple[float, ...]) -> str:
    return "CRYST1" + "".join(f"{v:9.3f}" for v in box[:3]) + "".join(f"{v:7.2f}" for v in box[3:]) + " P 1           1"


def conect_lines(bonds: DataFrame) -> DataFrame:
    """(atom1, atom2, value): a CONECT record for each bond of zero-based atoms, with the serials of ``pdb_lines``."""
    return bonds.select("atom1", "atom2", F.concat(F.lit("CONECT"), *(hybrid36_text(F.col(c) + 1, 5) for c in ("atom1", "atom2"))).alias("value"))


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """(file, frame_index, atom_index, name, x, y, z) of one or many frames of equal size."""
    lines = scan(spark, path, heads={"head": (F.lit(True), 1)}).withColumn("size", F.trim(F.get("head", F.lit(0))["line"]).try_cast("int"))
    rows = lines.withColumns({"frame_index": F.floor(F.col("n") / (F.col("size") + 2)).cast("int"), "k": F.col("n") % (F.col("size") + 2)})
    part = F.split(F.trim("line"), r"\s+")
    return rows.where("k >= 2 and trim(line) <> ''").select("file", "frame_index", (F.col("k") - 2).cast("long").alias("atom_index"), part[0].alias("name"), *(part[1 + i].try_cast("double").alias(c) for i, c in enumerate("xyz")))


def xyz_lines(coords: DataFrame, title: str = "") -> DataFrame:
    """(frame_index, n, value): count, title and a line an atom, eight decimals; coords need name."""
    head = coords.groupBy("frame_index").agg(F.count("*").cast("string").alias("count")).select("frame_index", F.explode(F.array(F.struct(F.lit(-2).alias("n"), F.col("count").alias("value")), F.struct(F.lit(-1).alias("n"), F.lit(title).alias("value")))).alias("p")).select("frame_index", F.col("p.n").cast("long").alias("n"), "p.value")
    body = coords.select("frame_index", F.col("atom_index").alias("n"), F.concat_ws(" ", "name", *(F.format_string("%.8f", F.col(c)) for c in "xyz")).alias("value"))
    return head.union(body)


def _gro(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the frame's size, its number, and the place k in it: title, size, atoms, box."""
    lines = scan(spark, path, heads={"head": (F.lit(True), 2)}).withColumn("size", F.trim(F.get("head", F.lit(1))["line"]).try_cast("int"))
    return lines.withColumns({"frame_index": F.floor(F.col("n") / (F.col("size") + 3)).cast("int"), "k": F.col("n") % (F.col("size") + 3)})


def read_gro(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of fixed columns in nm, with velocities where lines hold them, of one or many frames of equal size.

    Where residue numbers start again after 99,999, 100,000 is added, as often as they do.
    """
    rows = _gro(spark, path).where("k >= 2 and k < size + 2").withColumn("number", _number(1, 5, "int"))
    frame = Window.partitionBy("file", "frame_index").orderBy("k")
    again = F.sum((F.col("number") < F.col("before") - 50_000).cast("int")).over(frame)
    resid = F.col("number") + 100_000 * F.coalesce(again, F.lit(0))
    rows = rows.withColumn("before", F.lag("number").over(frame))
    return rows.select("file", "frame_index", (F.col("k") - 2).cast("long").alias("atom_index"), resid.cast("int").alias("resid"), _cut(6, 5).alias("resname"), _cut(11, 5).alias("name"), *(_number(21 + 8 * k, 8).alias(c) for k, c in enumerate(("x", "y", "z", "vx", "vy", "vz"))))


def read_gro_box(spark: SparkSession, path: str) -> DataFrame:
    """(file, frame_index, a, b, c, alpha, beta, gamma) of each frame's last line: three lengths in nm, or nine vector components."""
    p = F.transform(F.split(F.trim("line"), r"\s+"), lambda s: s.try_cast("double"))
    at = lambda k: F.get("p", F.lit(k))
    tilted = lattice_angles(Vec(at(0), at(3), at(4)), Vec(at(5), at(1), at(6)), Vec(at(7), at(8), at(2)))
    right = F.array(at(0), at(1), at(2), *map(F.lit, (90.0, 90.0, 90.0)))
    nothing = F.array(*map(F.lit, (0.0, 0.0, 0.0, 90.0, 90.0, 90.0)))
    empty = F.forall("p", lambda v: F.abs(v) <= 2.3e-16)
    rows = _gro(spark, path).where("k = size + 2").withColumn("p", p).where(F.size("p").isin(3, 9))
    return cells(rows, F.when(F.size("p") == 3, right).when(empty, nothing).otherwise(tilted), "frame_index")


def gro_lines(atoms: DataFrame, order: str = "atom_index") -> DataFrame:
    """(order, value): a line an atom; numbers start again after 99,999."""
    parts = [fit(F.col("resid") % 100000, 5), fit(F.col("resname"), 5, right=False), fit(F.col("name"), 5), fit((F.col(order) + 1) % 100000, 5), *(fixed(F.col(c), 8, 3) for c in "xyz")]
    return atoms.select(order, F.concat(*parts).alias("value"))


def read_pqr(spark: SparkSession, path: str) -> DataFrame:
    """Atoms with charge and radius: record serial name resname [chain] resid x y z charge radius."""
    p = F.split(F.trim("line"), r"\s+")
    atom = p[0].isin("ATOM", "HETATM")
    lines = scan(spark, path, counts={"atom": atom}).where(atom).withColumn("p", p)
    k = F.when(F.size("p") >= 11, 1).otherwise(0)
    at = lambda i: F.get("p", F.lit(i) + k)
    return lines.select("file", (F.col("atom") - 1).alias("atom_index"), F.col("p")[2].alias("name"), F.col("p")[3].alias("resname"), F.when(k == 1, F.col("p")[4]).alias("chain_id"), at(4).try_cast("int").alias("resid"), *(at(5 + i).try_cast("double").alias(c) for i, c in enumerate(("x", "y", "z", "charge", "radius"))))


def pqr_lines(atoms: DataFrame, order: str = "atom_index") -> DataFrame:
    return atoms.select(order, F.concat_ws(" ", F.lit("ATOM"), (F.col(order) + 1).cast("string"), "name", "resname", "chain_id", F.col("resid").cast("string"), *(fixed(F.col(c), 10, 5) for c in "xyz"), fixed(F.col("charge"), 9, 5), fixed(F.col("radius"), 8, 5)).alias("value"))


def read_psf_bonds(spark: SparkSession, path: str) -> DataFrame:
    """(file, atom1, atom2), zero-based, from the !NBOND section: eight numbers a line."""
    rows = scan(spark, path, {"section": F.when(F.col("line").contains("!"), F.regexp_extract("line", r"!(\w+)", 1))})
    rows = rows.where("section.value = 'NBOND' and not contains(line, '!') and trim(line) <> ''")
    p = F.transform(F.split(F.trim("line"), r"\s+"), lambda s: s.try_cast("long") - 1)
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("p") / 2).cast("int") - 1), lambda i: F.struct(F.get("p", 2 * i).alias("atom1"), F.get("p", 2 * i + 1).alias("atom2")))
    return rows.withColumn("p", p).select("file", F.explode(pairs).alias("b")).select("file", "b.atom1", "b.atom2")
