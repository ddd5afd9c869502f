"""Structure measures as plain aggregations: every function groups by ``by`` (usually the frame) and combines map-side.

Rows with a null coordinate or a null weight take no part; repeated rows count each; a frame without rows, and an
empty table, give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitframe.functions.vectors import vec
from orbitframe.operators.topology import bond_lengths

FRAME = ("frame_index",)


def placed(coords: DataFrame, prefix: str = "") -> DataFrame:
    """Rows whose place is known."""
    return coords.dropna(subset=[f"{prefix}{c}" for c in "xyz"])


def _div(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def center_of_geometry(coords: DataFrame, by: tuple[str, ...] = FRAME) -> DataFrame:
    return placed(coords).groupBy(*by).agg(*(F.avg(c).alias(c) for c in "xyz"))


def center_of_mass(coords: DataFrame, by: tuple[str, ...] = FRAME, weight: str = "mass") -> DataFrame:
    """Null coordinates where the total mass is 0."""
    w = F.col(weight)
    return placed(coords).groupBy(*by).agg(*(_div(F.sum(w * F.col(c)), F.sum(w)).alias(c) for c in "xyz"))


def total(coords: DataFrame, column: str, by: tuple[str, ...] = FRAME) -> DataFrame:
    return coords.groupBy(*by).agg(F.sum(column).alias(column))


def bounding_box(coords: DataFrame, by: tuple[str, ...] = FRAME) -> DataFrame:
    return coords.groupBy(*by).agg(*(f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"))


def radius_of_gyration(coords: DataFrame, by: tuple[str, ...] = FRAME, weight: str | None = "mass") -> DataFrame:
    """sqrt(sum m |r - center|^2 / sum m), centres first so that nothing cancels; unweighted where masses sum to 0 or less."""
    w = F.col(weight) if weight else F.lit(1.0)
    coords = placed(coords)
    centers = coords.groupBy(*by).agg(F.sum(w).alias("_w"), *(F.sum(w * F.col(c)).alias(f"_m{c}") for c in "xyz"), *(F.avg(c).alias(f"_g{c}") for c in "xyz"))
    centers = centers.select(*by, (F.col("_w") > 0).alias("_weighted"), *(F.when(F.col("_w") > 0, _div(F.col(f"_m{c}"), F.col("_w"))).otherwise(F.col(f"_g{c}")).alias(f"_c{c}") for c in "xyz"))
    use = F.when(F.col("_weighted"), w).otherwise(1.0)
    d2 = (vec() - vec("_c")).norm_squared()
    return coords.join(centers, list(by)).groupBy(*by).agg(F.sqrt(_div(F.sum(use * d2), F.sum(use))).alias("rg"))


def with_reference(coords: DataFrame, reference: DataFrame) -> DataFrame:
    """coords with rx, ry, rz of the same atom in a reference structure; atoms without a known place in both are left out."""
    ref = placed(reference).select("atom_index", *(F.col(c).alias(f"r{c}") for c in "xyz"))
    return placed(coords).join(ref, "atom_index")


def rmsd(coords: DataFrame, reference: DataFrame, by: tuple[str, ...] = FRAME, weight: str | None = None) -> DataFrame:
    """Root mean square distance to a reference structure, without superposition; 0 where weights sum to 0."""
    w = F.col(weight) if weight else F.lit(1.0)
    d2 = (vec() - vec("r")).norm_squared()
    return with_reference(coords, reference).groupBy(*by).agg(F.sqrt(F.coalesce(_div(F.sum(w * d2), F.sum(w)), F.lit(0.0))).alias("rmsd"))


def mean_square_displacement(coords: DataFrame, reference: DataFrame, by: tuple[str, ...] = FRAME) -> DataFrame:
    return with_reference(coords, reference).groupBy(*by).agg(F.avg((vec() - vec("r")).norm_squared()).alias("msd"))


def rmsf(coords: DataFrame) -> DataFrame:
    """Root mean square fluctuation of each atom about its mean place."""
    return placed(coords).groupBy("atom_index").agg(F.sqrt(F.var_pop("x") + F.var_pop("y") + F.var_pop("z")).alias("rmsf"))


def native_fractions(pairs: DataFrame, by: tuple[str, ...], beta: float = 5.0, scale: float = 1.8, cutoff: float = 4.5, radius: float = 0.5) -> DataFrame:
    """Soft, hard and radius fractions of native contacts from (distance, reference) pairs."""
    d, d0 = F.col("distance"), F.col("reference")
    share = lambda test: F.avg(test.cast("double"))
    return pairs.groupBy(*by).agg(F.avg(1 / (1 + F.exp(beta * (d - scale * d0)))).alias("soft_q"), share(d <= cutoff).alias("hard_q"), share(F.abs(d - d0) <= radius).alias("radius_q"))


def contact_score(native: DataFrame, coords: DataFrame, cutoff: float, by: tuple[str, ...] = FRAME) -> DataFrame:
    """Share of native contacts (i, j) that each frame still has at most ``cutoff`` apart; no row without native contacts.

    Only native pairs are measured, so the work follows their number, not that of all neighbours.
    """
    pairs = native.select(F.col("i").alias("atom1"), F.col("j").alias("atom2"))
    return bond_lengths(pairs, coords, by).groupBy(*by).agg(F.avg((F.col("length") <= cutoff).cast("double")).alias("score"))


def linear_regression(rows: DataFrame, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """slope, intercept and r2 in [0, 1]; null with fewer than two points or a constant x; r2 is 1 for a constant y."""
    ok = (F.count("*") > 1) & (F.regr_sxx(y, x) > 2.2e-16)
    r2 = F.when(F.regr_syy(y, x) <= 2.2e-16, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.regr_r2(y, x))))
    return rows.groupBy(*by).agg(F.when(ok, F.regr_slope(y, x)).alias("slope"), F.when(ok, F.regr_intercept(y, x)).alias("intercept"), F.when(ok, r2).alias("r2"))


def exponential_decay(rows: DataFrame, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """amplitude, rate and r2 of y = amplitude * exp(-rate x) by regression of ln y; null if any y is not positive."""
    logs = rows.withColumn("_ln", F.when(F.col(y) > 0, F.ln(F.col(y))))
    fit = logs.groupBy(*by).agg(F.min(F.col(y) > 0).alias("ok"), F.regr_slope("_ln", x).alias("s"), F.regr_intercept("_ln", x).alias("i"), F.regr_r2("_ln", x).alias("q"))
    return fit.select(*by, F.when(F.col("ok"), F.exp("i")).alias("amplitude"), F.when(F.col("ok"), -F.col("s")).alias("rate"), F.when(F.col("ok"), F.col("q")).alias("r2"))


def diffusion_coefficient(rows: DataFrame, time: str, msd: str, dimensions: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """slope of the displacement over time / (2 dimensions)."""
    if dimensions not in (1, 2, 3):
        raise ValueError("one to three dimensions")
    return linear_regression(rows, time, msd, by).select(*by, (F.col("slope") / (2 * dimensions)).alias("diffusion"))
