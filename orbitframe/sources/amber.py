"""Fixed-format topologies and block or column trajectories, read with Spark's own string functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitframe.sources.lines import numbered, scan
from orbitframe.sources.sections import _fields, _float, _p, _scanned
from orbitframe.sources.structures import cells

#: Fixed value: charges are stored times this.
CHARGE_SCALE = 18.2223


def prmtop_values(spark: SparkSession, path: str) -> DataFrame:
    """(file, section, i, value): every fixed-width field of a topology, numbered within its %FLAG section."""
    flag = F.when(F.col("line").startswith("%FLAG"), F.trim(F.substring("line", 6, 80)))
    part = lambda k: F.regexp_extract("line", r"%FORMAT\((\d+)[aA-Z](\d+)", k).cast("int")
    layout = F.when(F.col("line").startswith("%FORMAT"), F.struct(part(1).alias("per"), part(2).alias("width")))
    row = ~F.col("line").startswith("%") & (F.trim("line") != "")
    rows = scan(spark, path, {"flag": flag, "layout": layout}).where(row & F.col("flag").isNotNull())
    rows = rows.select("file", "block", F.col("flag.value").alias("section"), "layout.value.*", "n", "line")
    cut = F.expr("transform(sequence(0, per - 1), j -> trim(substring(line, j * width + 1, width)))")
    values = rows.select("file", "block", "section", "n", F.posexplode(cut).alias("j", "value")).where("value <> ''")
    return numbered(values.withColumn("n", F.col("n") * 1000 + F.col("j")), "i", "section").select("file", "section", "i", "value")


def read_prmtop_atoms(spark: SparkSession, path: str) -> DataFrame:
    """(file, atom_index, name, atom_type, charge, mass, resid, resname): charges in e, residues numbered from 1."""
    get = lambda section: F.max(F.when(F.col("section") == section, F.col("value"))).alias(section)
    labels = ("ATOM_NAME", "AMBER_ATOM_TYPE", "CHARGE", "MASS")
    begins = F.col("section").isin("RESIDUE_LABEL", "RESIDUE_POINTER")
    rows = prmtop_values(spark, path).where(begins | F.col("section").isin(*labels))
    held = rows.groupBy("file", begins.alias("begins"), "i").agg(*map(get, (*labels, "RESIDUE_LABEL", "RESIDUE_POINTER")))
    # residues go to their first atoms
    place = F.when(F.col("begins"), F.col("RESIDUE_POINTER").try_cast("long") - 1).otherwise(F.col("i"))
    met = held.groupBy("file", place.alias("atom_index")).agg(*(F.max(c).alias(c) for c in labels), F.max("RESIDUE_LABEL").alias("resname"), F.max(F.when(F.col("begins"), F.col("i") + 1)).cast("int").alias("resid"), F.max(~F.col("begins")).alias("is_atom")).where("is_atom")
    met = met.select("file", "atom_index", F.col("ATOM_NAME").alias("name"), F.col("AMBER_ATOM_TYPE").alias("atom_type"), (_float(F.col("CHARGE")) / CHARGE_SCALE).alias("charge"), _float(F.col("MASS")).alias("mass"), "resid", "resname")
    w = Window.partitionBy("file").orderBy("atom_index").rowsBetween(Window.unboundedPreceding, 0)
    return met.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in ("resname", "resid")})


def read_prmtop_bonds(spark: SparkSession, path: str) -> DataFrame:
    """(file, atom1, atom2) of both bond sections, whose entries are coordinate offsets of three an atom."""
    rows = prmtop_values(spark, path).where(F.col("section").isin("BONDS_INC_HYDROGEN", "BONDS_WITHOUT_HYDROGEN"))
    three = rows.groupBy("file", "section", F.floor(F.col("i") / 3).alias("k")).agg(*(F.floor(F.max(F.when(F.col("i") % 3 == m, F.col("value").try_cast("long"))) / 3).alias(f"atom{m + 1}") for m in (0, 1)))
    return three.select("file", "atom1", "atom2")


def _prmtop_groups(values: DataFrame, sections: tuple[str, str], size: int) -> DataFrame:
    """(file, section, k, v1 ... v of the group): entries of ``size`` numbers."""
    rows = values.where(F.col("section").isin(*sections))
    return rows.groupBy("file", "section", F.floor(F.col("i") / size).alias("k")).agg(*(F.max(F.when(F.col("i") % size == m, F.col("value").try_cast("long"))).alias(f"v{m + 1}") for m in range(size)))


def read_prmtop_angles(spark: SparkSession, path: str) -> DataFrame:
    """(file, atom1, atom2, atom3), each once."""
    rows = _prmtop_groups(prmtop_values(spark, path), ("ANGLES_INC_HYDROGEN", "ANGLES_WITHOUT_HYDROGEN"), 4)
    return rows.select("file", *(F.floor(F.col(f"v{k}") / 3).alias(f"atom{k}") for k in (1, 2, 3))).distinct()


def read_prmtop_dihedrals(spark: SparkSession, path: str) -> DataFrame:
    """(file, atom1, atom2, atom3, atom4, improper): a negative fourth entry marks an improper; dihedrals come once, impropers as often as listed."""
    rows = _prmtop_groups(prmtop_values(spark, path), ("DIHEDRALS_INC_HYDROGEN", "DIHEDRALS_WITHOUT_HYDROGEN"), 5)
    found = rows.select("file", *(F.floor(F.abs(f"v{k}") / 3).alias(f"atom{k}") for k in (1, 2, 3, 4)), (F.col("v4") < 0).alias("improper"))
    return found.where("not improper").distinct().union(found.where("improper"))


def read_mdcrd(spark: SparkSession, path: str, n_atoms: int) -> DataFrame:
    """(file, frame_index, atom_index, x, y, z): a title, then ten fields of eight columns a line; box lines after frames are told by their three fields."""
    size, full = 3 * n_atoms, -(-3 * n_atoms // 10)
    # the line below the first frame tells whether there are boxes; short are also the title and the last line of a frame
    short = (F.length(F.rtrim("line")) <= 24) & (F.trim("line") != "")
    lines = scan(spark, path, heads={"short": (short, 3)}).where("n >= 1 and trim(line) <> ''")
    boxed = F.exists("short", lambda x: x["n"] == full + 1) & F.lit(min(size, 10) != 3)
    rows = lines.withColumn("per", full + boxed.cast("int")).drop("short")
    rows = rows.withColumns({"frame": F.floor((F.col("n") - 1) / F.col("per")), "k": (F.col("n") - 1) % F.col("per")}).where(F.col("k") < full)
    cut = F.expr("transform(sequence(0, cast(ceil(length(rtrim(line)) / 8) as int) - 1), j -> try_cast(trim(substring(line, 8 * j + 1, 8)) as double))")
    values = rows.select("file", "frame", "k", F.posexplode(cut).alias("j", "v")).withColumn("at", F.col("k") * 10 + F.col("j"))
    found = values.groupBy("file", F.col("frame").cast("int").alias("frame_index"), F.floor(F.col("at") / 3).alias("atom_index"))
    return found.agg(*(F.max(F.when(F.col("at") % 3 == m, F.col("v"))).alias(c) for m, c in enumerate("xyz")))


def _gromos(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all blocks with the frame and the number in their block; comments are passed over."""
    block = F.when(F.col("line").rlike(r"^[A-Z]+\s*$"), F.trim("line"))
    row = (F.trim("line") != "") & ~F.col("line").startswith("#")
    return _fields(_scanned(spark, path, block, row, counts={"stepped": block == "TIMESTEP"})).withColumn("frame", F.col("stepped") - 1)


def read_gromos(spark: SparkSession, path: str) -> DataFrame:
    """(file, frame_index, step, time, atom_index, x, y, z) in nm from TIMESTEP and POSITIONRED blocks."""
    rows = _gromos(spark, path)
    times = rows.where("section = 'TIMESTEP'").select("file", "frame", _p(0, "long").alias("step"), _p(1, "double").alias("time"))
    places = rows.where("section = 'POSITIONRED'").select("file", "frame", F.col("k").alias("atom_index"), *(_p(k, "double").alias(c) for k, c in enumerate("xyz")))
    return places.join(times, ["file", "frame"]).select("file", F.col("frame").cast("int").alias("frame_index"), "step", "time", "atom_index", *"xyz")


def read_gromos_box(spark: SparkSession, path: str) -> DataFrame:
    """(file, frame_index, a, b, c, alpha, beta, gamma) of GENBOX blocks: a type, then lengths in nm, angles, origin and turn; type 0 has no box.

    Truncated octahedra, other types, and boxes that are shifted or turned are errors.
    """
    rows = _gromos(spark, path).where("section = 'GENBOX'")
    at = lambda k, m: F.max(F.when(F.col("k") == k, _p(m, "double")))
    three = lambda k: F.array(*(at(k, m) for m in range(3)))
    held = rows.groupBy("file", F.col("frame").cast("int").alias("frame_index")).agg(at(0, 0).alias("kind"), F.concat(three(1), three(2)).alias("box"), F.concat(three(3), three(4)).alias("moved"))
    wrong = F.when(F.col("kind") == -1, "truncated octahedra are no cells of this kind").when(~F.col("kind").isin(1, 2), "an unknown kind of box").when(F.exists("moved", lambda v: F.abs(v) > 1e-10), "a box that is shifted or turned")
    checked = held.where("kind <> 0").withColumn("box", F.when(wrong.isNotNull(), F.raise_error(F.concat_ws(" ", F.lit("frame"), "frame_index", wrong)).cast("array<double>")).otherwise(F.col("box")))
    return cells(checked, F.col("box"), "frame_index")
