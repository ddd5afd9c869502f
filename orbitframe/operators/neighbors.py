"""Distance joins on a grid: cells as wide as the cutoff turn a radius search into an equi-join with 27 cells.

Inputs hold atom_index, x, y, z and any frame columns named in ``by``. The join shuffles on (frame, cell), so work
spreads over all cells of all frames; nothing is broadcast and no cross product is built. Rows with a null coordinate
meet nothing; repeated atoms meet each; empty tables give empty results.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitframe.functions.chemistry import element_mass
from orbitframe.functions.vectors import Box, Vec, vec
from orbitframe.operators.blocks import BUCKET, bitmaps, close_pairs, distance_histogram, grid


def _steps(reach: list[int]) -> list[tuple[int, ...]]:
    """Steps to the cells around one."""
    return list(product(*(range(-n, n + 1) for n in reach)))


def _images(rows: DataFrame, cutoff: float, box: Box | None) -> tuple[DataFrame, DataFrame]:
    """(rows with their place x, y, z and cell c0, c1, c2; rows once for each cell around theirs, at the place of the image next to it).

    In a periodic cell places lie inside it. A cell of the grid that is reached across a face is one at the other side,
    and whoever meets there meets the image that lies across the face.
    """
    width = cutoff or 1e-9
    if box is None:
        cells = [F.floor(c / width).cast("long") for c in vec()]
        held = rows.withColumns({f"c{k}": c for k, c in enumerate(cells)})
        around = held.withColumn("step", F.explode(F.array(*(F.array(*map(F.lit, d)) for d in _steps([1, 1, 1])))))
        return held, around.withColumns({f"c{k}": F.col(f"c{k}") + F.col("step")[k] for k in range(3)})
    counts, reach = grid(box, cutoff)
    s = box.to_fractional(vec())
    held = rows.withColumns({f"s{k}": F.pmod(c, F.lit(1.0)) for k, c in enumerate(s)})
    held = held.withColumns({f"c{k}": F.least(F.floor(F.col(f"s{k}") * n).cast("long"), F.lit(n - 1)) for k, n in enumerate(counts)})
    around = held.withColumn("step", F.explode(F.array(*(F.array(*map(F.lit, d)) for d in _steps(reach)))))
    around = around.withColumns({f"w{k}": F.floor((F.col(f"c{k}") + F.col("step")[k]) / n).cast("long") for k, n in enumerate(counts)})
    around = around.withColumns({f"c{k}": F.col(f"c{k}") + F.col("step")[k] - F.col(f"w{k}") * n for k, n in enumerate(counts)})
    inside, across = box.to_cartesian(Vec(*(F.col(f"s{k}") for k in range(3)))), box.to_cartesian(Vec(*(F.col(f"s{k}") - F.col(f"w{k}") for k in range(3))))
    return held.withColumns(dict(zip("xyz", inside))), around.withColumns(dict(zip("xyz", across)))


def _met(left: DataFrame, right: DataFrame, cutoff: float, by: tuple[str, ...], box: Box | None) -> DataFrame:
    """(*by, i, j, distance) of points in neighbouring cells; images of one pair each count in a cell that is short for the cutoff."""
    here = _images(left, cutoff, box)[0].select(*by, F.col("atom_index").alias("i"), *(F.col(c).alias(f"{c}1") for c in "xyz"), "c0", "c1", "c2")
    there = _images(right, cutoff, box)[1].select(*by, F.col("atom_index").alias("j"), *(F.col(c).alias(f"{c}2") for c in "xyz"), "c0", "c1", "c2")
    return here.join(there, [*by, "c0", "c1", "c2"]).select(*by, "i", "j", (vec(suffix="2") - vec(suffix="1")).norm().alias("distance"))


def _nearest(found: DataFrame, cutoff: float, by: tuple[str, ...], box: Box | None) -> DataFrame:
    """Each pair at its nearest image. Two images of a point within the cutoff lie at most twice that apart."""
    if box is None or math.sqrt(sum(c * c for c in box.reduced()[0])) > 2 * cutoff * (1 + 1e-9):
        return found
    return found.groupBy(*by, "i", "j").agg(F.min("distance").alias("distance"))


def _check(cutoff: float, lower: float | None) -> None:
    if not math.isfinite(cutoff) or cutoff < 0 or (lower is not None and not 0 <= lower <= cutoff):
        raise ValueError("cutoffs must be finite, not negative and in order")


def pairs_within(left: DataFrame, right: DataFrame, cutoff: float, by: tuple[str, ...] = (), box: Box | None = None, strict: bool = False, lower: float | None = None) -> DataFrame:
    """(*by, i, j, distance) of all pairs with distance <= cutoff (< if ``strict``) and > lower.

    With a box distances are to the nearest image and the grid wraps around. Negative or non-finite cutoffs are errors.
    """
    _check(cutoff, lower)
    keep = F.col("distance") < cutoff if strict else F.col("distance") <= cutoff
    found = _nearest(_met(left, right, cutoff, by, box).where(keep), cutoff, by, box)
    return found if lower is None else found.where(F.col("distance") > lower)


def self_pairs_within(atoms: DataFrame, cutoff: float, by: tuple[str, ...] = (), box: Box | None = None, lower: float | None = None) -> DataFrame:
    """Unique pairs i < j; blocks of a cell meet themselves and half of their neighbours only, across the faces of a box as well."""
    _check(cutoff, lower)
    found = _nearest(close_pairs(atoms, cutoff, by, box), cutoff, by, box)
    return found if lower is None else found.where(F.col("distance") > lower)


def all_distances(left: DataFrame, right: DataFrame, by: tuple[str, ...], box: Box | None = None) -> DataFrame:
    """The full distance array of each frame: its size is the product of both sides, so it is meant for small groups."""
    a = left.select(*by, F.col("atom_index").alias("i"), *(F.col(c).alias(f"{c}1") for c in "xyz"))
    b = right.select(*by, F.col("atom_index").alias("j"), *(F.col(c).alias(f"{c}2") for c in "xyz"))
    d = vec(suffix="2") - vec(suffix="1")
    return a.join(b, list(by)).select(*by, "i", "j", (box.nearest(d) if box else d).norm().alias("distance"))


def neighbors(atoms: DataFrame, centers: DataFrame, radius: float, by: tuple[str, ...] = (), box: Box | None = None) -> DataFrame:
    """(*by, atom_index, center, distance): each atom within ``radius`` of a centre once, with the first such centre."""
    found = pairs_within(centers, atoms, radius, by, box)
    first = found.groupBy(*by, "j").agg(F.min(F.struct("i", "distance")).alias("m"))
    return first.select(*by, F.col("j").alias("atom_index"), F.col("m.i").alias("center"), F.col("m.distance").alias("distance"))


def neighbor_level(atoms: DataFrame, centers: DataFrame, radius: float, level: str, box: Box | None = None) -> DataFrame:
    """Distinct values of an atom column (atom_index, resid, segid ...) among the neighbours of centres."""
    near = neighbors(atoms, centers, radius, box=box).select("atom_index")
    return atoms.join(near, "atom_index", "left_semi").select(level).distinct()


def guess_bonds(atoms: DataFrame, cutoff: float = 1.7, element: str | None = None) -> DataFrame:
    """Bonds (atom1 < atom2) between all atoms at most ``cutoff`` apart.

    Coordinates that are no finite numbers are an error (null ones meet nothing), and so are unknown elements where a
    column of them is named.
    """
    bad = reduce(lambda a, b: a | b, (F.isnan(c) | (F.abs(c) == float("inf")) for c in "xyz"))
    checks = F.when(bad, F.raise_error(F.lit("a coordinate is not finite"))).otherwise(True)
    if element:
        checks = checks & F.when(element_mass(F.col(element)).isNull(), F.raise_error(F.concat(F.lit("unknown element "), F.coalesce(element, F.lit("null"))))).otherwise(True)
    return self_pairs_within(atoms.where(checks), cutoff).select(F.col("i").alias("atom1"), F.col("j").alias("atom2"))


def contact_matrix(atoms: DataFrame, cutoff: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, atom_index, contacts): a row of the contact matrix for each atom, a flag for each atom in order; false on the diagonal.

    The matrix has as many flags as atoms squared, so it is meant for small groups; ``self_pairs_within`` gives its pairs.
    """
    pairs = self_pairs_within(atoms, cutoff, by).select(*by, "i", "j")
    both = pairs.union(pairs.select(*by, "j", "i")).groupBy(*by, "i").agg(F.collect_set("j").alias("_near"))
    order = atoms.groupBy(*by).agg(F.sort_array(F.collect_list("atom_index")).alias("_all"))
    rows = atoms.select(*by, "atom_index").join(both.withColumnRenamed("i", "atom_index"), [*by, "atom_index"], "left")
    met = rows.join(order, list(by)) if by else rows.join(F.broadcast(order))  # one row
    near = F.coalesce("_near", F.array().cast("array<long>"))
    return met.select(*by, "atom_index", F.transform("_all", lambda k: F.array_contains(near, k)).alias("contacts"))


def paired_atoms(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, atom_index): every atom that any pair (i, j) holds, once."""
    return pairs.select(*by, F.explode(F.array("i", "j")).alias("atom_index")).distinct()


def contact_bitmaps(atoms: DataFrame, cutoff: float, by: tuple[str, ...] = (), box: Box | None = None) -> DataFrame:
    """(*by, atom_index, bucket, contacts): the contacts of each atom as bitmaps, one for each run of 32,768 atoms that holds any.

    Bits stand as ``bitmap_bit_position(atom + 1)`` says in the bucket ``bitmap_bucket_number(atom + 1)``; count them
    with ``bitmap_count``, join them with ``bitmap_or_agg``. Each cell meets what lies around it, a bucket at a time, so a
    bitmap is whole when it is made and neither pairs nor bitmaps are shuffled; only those of atoms that stand in several
    rows of a frame are joined afterwards. Atom numbers must not be negative.
    """
    once, again, around = _often(atoms, cutoff, by, box)
    return bitmaps(once, around, cutoff, by).unionByName(_joined(again, around, cutoff, by))


def contact_buckets(atoms: DataFrame, cutoff: float, by: tuple[str, ...] = (), box: Box | None = None) -> DataFrame:
    """(*by, atom_index, bucket, n, first): how many atoms each bitmap of ``contact_bitmaps`` holds, and the first.

    Bitmaps are read in the task that makes them, so their 4 KB leave it only for atoms that stand in several rows of a frame.
    """
    once, again, around = _often(atoms, cutoff, by, box)
    bits = F.hex("contacts")
    byte = F.floor(F.length(F.regexp_extract(bits, "^(0*)", 1)) / 2)  # the first that holds a bit
    low = F.conv(F.substr(bits, (2 * byte + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    first = (F.col("bucket") - 1) * BUCKET + byte * 8 + F.log2(low.bitwiseAND(-low)).cast("long")
    joined = _joined(again, around, cutoff, by).select(*by, "atom_index", "bucket", F.expr("bitmap_count(contacts)").alias("n"), first.alias("first"))
    return bitmaps(once, around, cutoff, by, read=True).unionByName(joined)


def _often(atoms: DataFrame, cutoff: float, by: tuple[str, ...], box: Box | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(placed rows of atoms that stand in one row of a frame, those of others, all rows next to each cell)."""
    _check(cutoff, None)
    held, around = _images(atoms.where("atom_index is not null"), cutoff, box)
    keep = [*by, "atom_index", *"xyz", "c0", "c1", "c2"]
    held, around = (rows.select(*keep).where("x is not null and y is not null and z is not null") for rows in (held, around))
    often = held.groupBy(*by, "atom_index").count().where("count > 1").drop("count")
    key = [*by, "atom_index"]
    return held.join(often, key, "left_anti"), held.join(often, key, "left_semi"), around


def _joined(rows: DataFrame, around: DataFrame, cutoff: float, by: tuple[str, ...]) -> DataFrame:
    """Bitmaps of rows, one for each atom and bucket."""
    return bitmaps(rows, around, cutoff, by).groupBy(*by, "atom_index", "bucket").agg(F.bitmap_or_agg("contacts").alias("contacts"))


def radial_counts(first: DataFrame, second: DataFrame, bin_width: float, max_radius: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, bin, edge, n): raw counts of distances below ``max_radius``; a set with itself counts each atom at 0; empty bins are 0."""
    spark = first.sparkSession
    bins = math.ceil(max_radius / bin_width)
    if first is second and max_radius > 0:  # each pair once, counted from both ends, and each atom at 0
        own = first.where("x is not null and y is not null and z is not null").groupBy(*by).agg(F.lit(0).cast("long").alias("bin"), F.count("*").alias("n")).where("n > 0")
        ends = distance_histogram(first, bin_width, max_radius, by).withColumn("n", 2 * F.col("n")).unionByName(own)
        hits = ends.groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    else:
        hits = pairs_within(first, second, max_radius, by, strict=True).groupBy(*by, F.floor(F.col("distance") / bin_width).alias("bin")).agg(F.count("*").alias("n"))
    grid = first.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))) if by else spark.range(bins).withColumnRenamed("id", "bin")
    return grid.join(hits, [*by, "bin"], "left").select(*by, F.col("bin").cast("long").alias("bin"), (F.col("bin") * F.lit(bin_width)).alias("edge"), F.coalesce("n", F.lit(0)).alias("n"))
