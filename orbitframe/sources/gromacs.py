"""Topologies of molecule types: directives, sections of rows below ``[ name ]`` lines, and a system of repeated molecules.

Directive lines alone go to the driver, where they are followed one after another through all included files; what they
say is a table of segments, the lines between two directives, that are in force, in their order and with the names
defined there. Lines themselves are joined with it and stay distributed.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitframe.sources.checkpoints import ensure_checkpoints
from orbitframe.sources.lines import filled, numbered, scan
from orbitframe.sources.sections import _fields, _p

_SIZES = {"bonds": 2, "constraints": 2, "angles": 3, "dihedrals": 4}


def _logical(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, block, n, d, text): lines without comments, those that end in a backslash joined with the next; ``d`` counts directives up to each."""
    going = F.col("line").rlike(r"\\\s*$")
    lines = scan(spark, paths, counts={"d": F.trim("line").startswith("#"), "ended": ~going})
    part = F.when(going, F.regexp_replace("line", r"\s*\\\s*$", "")).otherwise(F.col("line"))
    lines = lines.select("file", "block", "n", "d", (F.col("ended") - (~going).cast("long")).alias("id"), part.alias("part"))
    whole = lines.groupBy("file", "id").agg(F.min("block").alias("block"), F.min("n").alias("n"), F.min("d").alias("d"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda s: s["part"]), " ").alias("text"))
    return whole.withColumn("text", F.trim(F.regexp_replace("text", ";.*", ""))).drop("id")


class _Directives:
    """The directive lines of files and of what they include, read file by file as includes name them."""

    def __init__(self, spark: SparkSession, paths: list[str], include_dirs: Iterable[str]):
        self.spark, self.dirs, self.lines, self.known = spark, list(include_dirs), {}, {}
        self._load(paths)
        given, todo = list(self.lines), list(self.lines)
        while todo:
            file = todo.pop()
            for _, text in self.lines[file]:
                if text[1:].split()[:1] == ["include"] and (target := self.target(file, text)) and target not in self.lines:
                    self._load([target])
                    todo.append(target)
        inner = {self.target(file, text) for file, rows in self.lines.items() for _, text in rows if text[1:].split()[:1] == ["include"]}
        self.roots = [file for file in sorted(given) if file not in inner] or sorted(given)[:1]

    def _load(self, paths: list[str]) -> None:
        rows = _logical(self.spark, paths)
        for r in rows.select("file").distinct().collect():
            self.lines[r.file] = []
        for r in rows.where("startswith(text, '#')").select("file", "d", "text").orderBy("file", "d").collect():
            self.lines[r.file].append((r.d, r.text))

    def target(self, file: str, text: str) -> str | None:
        """The file that an include names: beside the one it stands in, or in a folder of includes; None if there is none."""
        word = (text[1:].split() + [""])[1]
        if len(word) < 3 or (word[0], word[-1]) not in (('"', '"'), ("<", ">")):
            raise ValueError(f"{file}: an include needs a quoted path: {text}")
        if (file, word) not in self.known:
            jvm, found = self.spark._jvm, None
            for folder in (posixpath.dirname(file), *self.dirs):
                path = jvm.org.apache.hadoop.fs.Path(word[1:-1] if word[1] == "/" else f"{folder}/{word[1:-1]}")
                path = jvm.org.apache.hadoop.fs.Path(path.toUri().normalize())
                system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
                if system.exists(path):
                    found = system.makeQualified(path).toString()
                    break
            self.known[file, word] = found
        return self.known[file, word]


def _holds(command: str, words: list[str], defined: dict[str, str]) -> bool:
    if command != "if":
        return (bool(words) and words[0] in defined) == (command == "ifdef")
    said = " ".join(words)
    if said.endswith(")") and said.startswith(("defined(", "!defined(")):
        return (said[said.index("(") + 1 : -1].strip() in defined) != said.startswith("!")
    return defined.get(said, "0").lower() not in ("0", "false")


def _in_force(found: _Directives, given: dict[str, str]) -> list[tuple[int, str, str, int, dict[str, str]]]:
    """(place, root, file, d, names): segments in force, in order; names that the caller gives keep their values."""
    out: list[tuple[int, str, str, int, dict[str, str]]] = []
    defined = dict(given)

    def follow(root: str, file: str, within: tuple[str, ...]) -> None:
        nonlocal defined
        if file in within:
            raise ValueError(f"{file} includes itself")
        open_ifs: list[list[bool]] = []  # whether all around holds, whether it holds itself, whether its else has come
        rows = [(0, ""), *found.lines[file], (None, "")]
        for (d, text), (then, _) in zip(rows, rows[1:]):
            command, *words = text[1:].split() if text else [""]
            active = all(around and own for around, own, _ in open_ifs)
            if command in ("ifdef", "ifndef", "if"):
                open_ifs.append([active, active and _holds(command, words, defined), False])
            elif command in ("else", "endif"):
                if not open_ifs or (command == "else" and open_ifs[-1][2]):
                    raise ValueError(f"{file}: unmatched conditionals: #{command}")
                if command == "endif":
                    open_ifs.pop()
                else:
                    open_ifs[-1][1:] = [not open_ifs[-1][1], True]
            elif active and command == "define" and words and words[0] not in given:
                defined = defined | {words[0]: " ".join(words[1:]) or "1"}
            elif active and command == "undef" and words and words[0] not in given:
                defined = {k: v for k, v in defined.items() if k != words[0]}
            elif active and command == "include" and (target := found.target(file, text)):
                follow(root, target, (*within, file))
            if all(around and own for around, own, _ in open_ifs):
                out.extend((len(out) + k, root, file, d + k, defined) for k in range((then or d + 1) - d))
        if open_ifs:
            raise ValueError(f"{file}: unmatched conditionals: a missing #endif")

    for root in found.roots:
        follow(root, root, ())
    return out


def read_itp(spark: SparkSession, path: str, defines: dict[str, str] | None = None, include_dirs: tuple[str, ...] = ()) -> DataFrame:
    """(file, block, n, section, molecule, p): fields of every row that counts, with its section and molecule type.

    ``;`` begins a comment, a backslash at a line's end goes on in the next. ``#include`` puts a file's rows in its place,
    as often as it is named, and is passed over where there is no such file; a file that includes itself is an error, and
    so are unmatched conditionals, which may be of any depth. ``#define`` and ``#undef`` hold from their line on, in
    conditionals and for whole fields; names in ``defines`` keep their values. Files of a folder that others
    include are read there only; ``file`` is the one that all begins with. An empty file gives no rows.
    """
    ensure_checkpoints(spark)
    given = defines or {}
    found = _Directives(spark, [path], include_dirs)
    segments = spark.createDataFrame(_in_force(found, given), "place long, root string, file string, d long, names map<string,string>")
    lines = _logical(spark, list(found.lines)) if found.lines else _logical(spark, [path])
    rows = lines.where("text <> '' and not startswith(text, '#')").join(segments, ["file", "d"])
    rows = rows.select(F.col("root").alias("file"), F.concat(F.format_string("%012d/", "place"), "block").alias("block"), "n", "names", "text").checkpoint()
    mark = F.when(F.col("text").rlike(r"^\[.*\]$"), F.lower(F.trim(F.regexp_replace("text", r"[\[\]]", ""))))
    rows = filled(rows.withColumn("mark", mark), section=F.col("mark")).where("mark is null")
    rows = _fields(rows.withColumn("line", F.col("text")))
    rows = rows.withColumn("p", F.flatten(F.transform("p", lambda s: F.split(F.coalesce(F.element_at("names", s), s), r"\s+"))))
    rows = filled(rows, molecule=F.when(F.col("section") == "moleculetype", _p(0)))
    return rows.select("file", "block", "n", "section", "molecule", "p").checkpoint()


def itp_atoms(rows: DataFrame) -> DataFrame:
    """(molecule, atom_index, id, atom_type, resid, resname, name, charge, mass) of molecule types; what a row lacks comes from atomtypes."""
    typed = F.when(F.expr("try_cast(p[1] as double)").isNull(), 1).otherwise(0)
    last = F.size("p") - 1
    letter = lambda k: F.get("p", last - k).rlike("^[A-Za-z]$")
    kind = F.when(letter(0), last).when(letter(2), last - 2).when(letter(3), last - 3).otherwise(3 + typed)
    types = rows.where("section = 'atomtypes'").select(_p(0).alias("atom_type"), F.get("p", kind - 2).try_cast("double").alias("_mass"), F.get("p", kind - 1).try_cast("double").alias("_charge")).dropDuplicates(["atom_type"])
    atoms = numbered(rows.where("section = 'atoms'"), "atom_index", "molecule")
    atoms = atoms.select("molecule", "atom_index", _p(0, "long").alias("id"), _p(1).alias("atom_type"), _p(2, "int").alias("resid"), _p(3).alias("resname"), _p(4).alias("name"), _p(6, "double").alias("charge"), _p(7, "double").alias("mass"))
    met = atoms.join(types, "atom_type", "left")
    return met.select("molecule", "atom_index", "id", "atom_type", "resid", "resname", "name", F.coalesce("charge", "_charge").alias("charge"), F.coalesce("mass", "_mass").alias("mass"))


def itp_groups(rows: DataFrame, kind: str) -> DataFrame:
    """(molecule, atom1 ..., function) of ``bonds`` (constraints among them), ``angles``, ``dihedrals`` or ``impropers``: ids within a type, each group once.

    Dihedrals of functions 2 and 4 are impropers. ``settles`` give (molecule, atom1, function, oh, hh).
    """
    if kind == "settles":
        return rows.where("section = 'settles'").select("molecule", _p(0, "long").alias("atom1"), _p(1, "int").alias("function"), _p(2).alias("oh"), _p(3).alias("hh"))
    section = {"impropers": "dihedrals"}.get(kind, kind)
    size = _SIZES[section]
    held = rows.where(F.col("section").isin(section, "constraints") if kind == "bonds" else F.col("section") == section)
    names = [f"atom{k + 1}" for k in range(size)]
    found = held.select("file", "n", "molecule", *(_p(k, "long").alias(name) for k, name in enumerate(names)), F.coalesce(_p(size, "int"), F.lit(1)).alias("function"))
    if section == "dihedrals":
        found = found.where(F.col("function").isin(2, 4) if kind == "impropers" else ~F.col("function").isin(2, 4))
    return found.groupBy("molecule", *names).agg(F.min_by("function", F.struct("file", "n")).alias("function"))


def _copies(rows: DataFrame, atoms: DataFrame) -> DataFrame:
    """(molecule, number, first_atom, first_resid): every molecule of the system in order; without [ molecules ] each type once."""
    kinds = atoms.groupBy("molecule").agg(F.count("*").alias("size"), F.max("resid").alias("span"))
    listed = rows.where("section = 'molecules'").select(F.struct("file", "block", "n").alias("at"), _p(0).alias("molecule"), _p(1, "long").alias("copies"))
    types = rows.where("section = 'moleculetype'").select(F.struct("file", "block", "n").alias("at"), "molecule", F.lit(1).cast("long").alias("copies"))
    given = listed.limit(1).agg(F.count("*").alias("given"))  # one row
    system = listed.union(types.join(F.broadcast(given), F.col("given") == 0).drop("given"))
    before = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # a row a line of the list
    sum_of = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    placed = system.join(kinds, "molecule").select("molecule", "copies", "size", "span", sum_of("copies").alias("m"), sum_of(F.col("copies") * F.col("size")).alias("a"), sum_of(F.col("copies") * F.col("span")).alias("r"))
    each = placed.where("copies > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return each.select("molecule", (F.col("m") + F.col("k") + 1).alias("number"), (F.col("a") + F.col("k") * F.col("size")).alias("first_atom"), (F.col("r") + F.col("k") * F.col("span")).alias("first_resid"))


def system_atoms(rows: DataFrame) -> DataFrame:
    """(atom_index, molecule, molecule_number, atom_type, resid, resname, name, charge, mass) of the whole system; residue numbers go on from molecule to molecule."""
    atoms = itp_atoms(rows)
    met = _copies(rows, atoms).join(atoms, "molecule")
    return met.select((F.col("first_atom") + F.col("atom_index")).alias("atom_index"), "molecule", F.col("number").alias("molecule_number"), "atom_type", (F.col("first_resid") + F.col("resid")).cast("int").alias("resid"), "resname", "name", "charge", "mass")


def system_groups(rows: DataFrame, kind: str = "bonds") -> DataFrame:
    """(atom1 ..., function) of the whole system, as atom_index values; groups that name missing ids are left out. Settles are two bonds each."""
    atoms = itp_atoms(rows)
    found = itp_groups(rows, kind)
    names = [c for c in found.columns if c.startswith("atom")]
    if kind == "bonds":  # rigid water: the oxygen and the two atoms after it
        water = itp_groups(rows, "settles").select("molecule", "atom1", F.explode(F.array(F.col("atom1") + 1, F.col("atom1") + 2)).alias("atom2"), "function")
        found = found.union(water.join(found, ["molecule", "atom1", "atom2"], "left_anti").select("molecule", "atom1", "atom2", "function"))
    index = atoms.select("molecule", "id", "atom_index")
    for c in names:
        found = found.join(index.withColumnsRenamed({"id": c, "atom_index": f"_{c}"}), ["molecule", c])
    place: dict[str, Column] = {c: F.col("first_atom") + F.col(f"_{c}") for c in names}
    return _copies(rows, atoms).join(found, "molecule").select(*(v.alias(k) for k, v in place.items()), "function")
