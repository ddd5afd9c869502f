"""Logs of geometry optimisations and of scans over a surface: atoms of the first table, and a frame a step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitframe.sources.lines import counted, filled, numbered, read_lines
from orbitframe.sources.sections import _fields, _float, _p


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their fields, the kind of run, the table they stand in, the step, and how many tables came before in the file."""
    lines = read_lines(spark, path)
    upper = F.upper(F.trim("line"))
    comment = F.substring(upper, 1, 1).isin("!", "*")
    run = F.lower(F.regexp_extract("line", r"(?i)\bRUNTYP\s*=\s*(\w+)", 1))
    named = lines.where(~comment & (run != "")).select("file", "n", run.alias("run"), upper.contains("INPUT CARD>").alias("echo"))
    # the last line that is no echo of the input decides, else the last echo
    kind = named.groupBy("file").agg(F.coalesce(F.max_by("run", F.when(~F.col("echo"), F.col("n"))), F.max_by("run", "n")).alias("run"))
    first = upper.contains("ATOMIC") & upper.contains("COORDINATES") & upper.contains("(BOHR)")
    table = F.when(first, "atoms").when(upper.contains("COORDINATES OF ALL ATOMS ARE"), "optimize").when(upper.startswith("HAS ENERGY VALUE"), "surface").when(upper.rlike(r"^.NSERCH=|^COORD 1="), "step")
    step = upper.rlike(r"^.NSERCH=|^COORD 1=")
    marked = counted(filled(lines.withColumn("mark", table), table=F.col("mark")), step=step, tables=F.col("mark") == "atoms")
    return _fields(marked.where("mark is null").join(kind, "file"))


def read_gamess_atoms(spark: SparkSession, path: str) -> DataFrame:
    """(file, atom_index, name, charge) of the first table of atomic coordinates in Bohr: label, nuclear charge, place."""
    rows = _rows(spark, path).where((F.col("table") == "atoms") & (F.col("tables") == 1) & (F.size("p") >= 5) & _p(0).rlike("^[A-Za-z_]") & F.forall(F.slice("p", 2, 4), lambda s: _float(s).isNotNull()))
    found = numbered(rows, "atom_index")
    whole = (F.col("n") - F.min("n").over(_of_file())) == F.col("atom_index")  # the table ends at the first other line
    return found.withColumn("whole", whole).where("whole").select("file", "atom_index", _p(0).alias("name"), _float(_p(1)).alias("charge"))


def _of_file():
    from pyspark.sql import Window

    return Window.partitionBy("file")  # rows of one table of atoms


def read_gamess(spark: SparkSession, path: str) -> DataFrame:
    """(file, frame_index, atom_index, name, x, y, z) of the tables in Angstrom, one a step; optimisations and surface scans are known.

    Tables hold a label, a nuclear charge (optimisations only) and a place a line; a frame has as many atoms as the
    first table, and further lines of that form are left out.
    """
    rows = _rows(spark, path)
    size = read_gamess_atoms(spark, path).groupBy("file").agg(F.count("*").alias("size"))
    skip = F.when(F.col("run") == "optimize", 2).otherwise(1)
    at = lambda k: _float(F.get("p", skip + k))
    wanted = (F.col("table") == F.col("run")) & (F.col("step") > 0) & (F.size("p") >= skip + 3) & at(0).isNotNull() & at(1).isNotNull() & at(2).isNotNull()
    found = numbered(rows.where(wanted), "atom_index", "step").join(size, "file").where("atom_index < size")
    return found.select("file", (F.col("step") - 1).cast("int").alias("frame_index"), "atom_index", _p(0).alias("name"), *(at(k).alias(c) for k, c in enumerate("xyz")))
