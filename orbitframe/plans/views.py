"""Deterministic molecular views of the synthetic tables: atoms, bonds, coordinates and states.

``SQL`` holds the same views as common table expressions, to put before the SQL of a query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FRAMES = 21
NAMES = ("N", "CA", "C", "O", "CB")
RESNAMES = ("ALA", "GLY", "SER", "HOH", "LYS", "ASP", "ADE", "GUA", "SOL", "VAL")
ELEMENT_MASS = {"N": 14.007, "C": 12.011, "O": 15.999}
BOX = (5.0, 6.0, 7.0, 90.0, 90.0, 90.0)
TILTED = (5.0, 6.0, 7.0, 90.0, 80.0, 70.0)
ELONGATED = (5.0, 20.0, 20.0, 90.0, 90.0, 40.0)
NEEDLE = (1.0, 20.0, 20.0, 90.0, 90.0, 30.0)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def coords(spark: SparkSession, sf_dir: str, frames: int = FRAMES) -> DataFrame:
    """(frame_index, atom_index, x, y, z): three components a frame, ten Angstrom a unit."""
    e = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("atom_index"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(frames - 1))).alias("frame_index"))
    at = lambda k: 10.0 * F.get("embedding", 3 * F.col("frame_index") + k).cast("double")
    return e.select("frame_index", "atom_index", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


def six(distance: str) -> Column:
    """A distance to six places, half up as ``round`` does, in arithmetic of doubles where they hold it: ``round`` makes a decimal of every row."""
    d = F.col(distance)
    return F.when(d < 1e9, F.floor(d * 1e6 + 0.5) / 1e6).otherwise(F.round(d, 6))


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    residue = F.floor(i / 5)
    name = F.get(F.array(*map(F.lit, NAMES)), (i % 5).cast("int"))
    element = F.substring(name, 1, 1)
    return _table(spark, sf_dir, "embeddings").select(
        i.alias("atom_index"),
        name.alias("name"),
        (residue + 1).alias("resid"),
        F.get(F.array(*map(F.lit, RESNAMES)), (residue % 10).cast("int")).alias("resname"),
        F.concat(F.lit("S"), F.floor(i / 125).cast("string")).alias("segid"),
        F.char(F.lit(65) + F.col("label")).alias("chain_id"),
        element.alias("element"),
        F.when(i % 7 == 0, None).otherwise(element).alias("atom_type"),
        F.lit(None).cast("string").alias("insertion_code"),
        F.when(element == "N", 14.007).when(element == "C", 12.011).otherwise(15.999).alias("mass"),
        F.get("embedding", F.lit(63)).cast("double").alias("charge"),
    )


def placed_atoms(spark: SparkSession, sf_dir: str, frame: int = 0) -> DataFrame:
    """Atoms with their place in one frame."""
    return atoms(spark, sf_dir).join(coords(spark, sf_dir, frame + 1).where(F.col("frame_index") == frame).drop("frame_index"), "atom_index")


def bonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(atom1, atom2): neighbours within a residue, and its first and third atom in every fourth residue."""
    i = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("atom1"))
    n = i.agg(F.max("atom1").alias("top"))
    chain = i.where("atom1 % 5 < 4").select("atom1", (F.col("atom1") + 1).alias("atom2"))
    rings = i.where("atom1 % 20 = 0").select("atom1", (F.col("atom1") + 2).alias("atom2"))
    return chain.union(rings).join(F.broadcast(n), F.col("atom2") <= F.col("top")).select("atom1", "atom2")  # n is one row


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, id): users by day of the purchases."""
    e = _table(spark, sf_dir, "events").where("event_type = 'purchase'")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return e.select(day.cast("int").alias("frame"), F.col("user_id").alias("id")).distinct()


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, value): the mean event value of each day."""
    e = _table(spark, sf_dir, "events")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return e.groupBy(day.cast("double").alias("day")).agg(F.avg("value").alias("value"))


SQL = """
with coords as (select t as frame_index, vec_id as atom_index,
    10.0 * cast(embedding[3 * t + 1] as double) as x, 10.0 * cast(embedding[3 * t + 2] as double) as y, 10.0 * cast(embedding[3 * t + 3] as double) as z
  from embeddings, (select cast(unnest(range(0, 21)) as integer) as t)),
atoms as (select vec_id as atom_index, ['N', 'CA', 'C', 'O', 'CB'][vec_id % 5 + 1] as name, vec_id // 5 + 1 as resid,
    ['ALA', 'GLY', 'SER', 'HOH', 'LYS', 'ASP', 'ADE', 'GUA', 'SOL', 'VAL'][(vec_id // 5) % 10 + 1] as resname,
    'S' || (vec_id // 125) as segid, chr(65 + label) as chain_id, substr(['N', 'CA', 'C', 'O', 'CB'][vec_id % 5 + 1], 1, 1) as element,
    case when vec_id % 7 = 0 then null else substr(['N', 'CA', 'C', 'O', 'CB'][vec_id % 5 + 1], 1, 1) end as atom_type,
    case vec_id % 5 when 0 then 14.007::double when 3 then 15.999::double else 12.011::double end as mass, cast(embedding[64] as double) as charge from embeddings),
placed as (select atoms.*, x, y, z from atoms join coords using (atom_index) where frame_index = 0),
bonds as (select * from (select vec_id as atom1, vec_id + 1 as atom2 from embeddings where vec_id % 5 < 4
  union all select vec_id, vec_id + 2 from embeddings where vec_id % 20 = 0) where atom2 <= (select max(vec_id) from embeddings)),
edges as (select atom1 as a, atom2 as b from bonds union select atom2, atom1 from bonds),
states as (select distinct datediff('day', date '2024-01-01', cast(ts as date)) as frame, user_id as id from events where event_type = 'purchase'),
series as (select cast(datediff('day', date '2024-01-01', cast(ts as date)) as double) as day, avg(value) as value from events group by 1)
"""
