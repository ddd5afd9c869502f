"""Frame transformations: projections over coordinates, and windows where images follow each other.

A null coordinate stays null (``rotate`` and a tilted ``wrap`` mix coordinates, so the others turn null with it);
repeated rows are moved each; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitframe.functions.vectors import Box, Vec, rotation, transformed, vec
from orbitframe.operators.aggregates import FRAME, center_of_geometry, center_of_mass


def _put(df: DataFrame, place: Vec) -> DataFrame:
    return df.withColumns(dict(zip("xyz", place)))


def translate(coords: DataFrame, offset: tuple[float, float, float]) -> DataFrame:
    return _put(coords, vec() + Vec(*map(F.lit, offset)))


def rotate(coords: DataFrame, angle: float, axis: tuple[float, float, float], origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Rotation about an axis through ``origin``; velocity and force columns (vx.., fx..) turn along. A zero axis is an error."""
    if not any(axis):
        raise ValueError("the axis must not be zero")
    m, o = rotation(angle, axis), Vec(*map(F.lit, origin))
    out = _put(coords, transformed(m, vec() - o) + o)
    for p in "vf":
        if {f"{p}{c}" for c in "xyz"} <= set(coords.columns):
            out = out.withColumns(dict(zip((f"{p}{c}" for c in "xyz"), transformed(m, vec(p)))))
    return out


def set_dimensions(frames: DataFrame, *boxes: Box, order: str = "frame_index") -> DataFrame:
    """frames with a, b, c, alpha, beta, gamma: one box for all, or as many as there are frames, in order of ``order`` from 0.

    A frame without a box of its own is an error, as are more boxes than frames.
    """
    if not boxes:
        raise ValueError("a box is needed")
    names = ("a", "b", "c", "alpha", "beta", "gamma")
    if len(boxes) == 1:
        return frames.withColumns({n: F.lit(getattr(boxes[0], n)) for n in names})
    table = frames.sparkSession.createDataFrame([(k, *(getattr(b, n) for n in names)) for k, b in enumerate(boxes)], f"_k long, {', '.join(f'{n} double' for n in names)}")
    met = frames.drop(*names).join(F.broadcast(table), F.col(order) == F.col("_k"), "full")  # the boxes are held by the caller
    fine = F.col(order).isNotNull() & F.col("_k").isNotNull()
    return met.withColumn("a", F.when(fine, F.col("a")).otherwise(F.raise_error(F.lit("as many boxes as frames are needed")))).drop("_k")


def wrap(coords: DataFrame, box: Box) -> DataFrame:
    return _put(coords, box.wrap(vec()))


def fractional(coords: DataFrame, box: Box) -> DataFrame:
    return _put(coords, box.to_fractional(vec()))


def unwrap(coords: DataFrame, box: Box, by: tuple[str, ...], order: str) -> DataFrame:
    """Points of a sequence each at the image nearest to the one before: the running sum of nearest-image steps."""
    w = Window.partitionBy(*by).orderBy(order)
    step = box.nearest(Vec(*(F.col(c) - F.lag(c).over(w) for c in "xyz")))
    steps = coords.withColumns({f"_d{c}": F.coalesce(s, F.lit(0.0)) for c, s in zip("xyz", step)})
    rows = w.rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumns({c: F.first(c).over(rows) + F.sum(f"_d{c}").over(rows) for c in "xyz"}).drop("_dx", "_dy", "_dz")


def center_in_box(coords: DataFrame, chosen: DataFrame, box: Box, weight: str | None = None, point: tuple[float, float, float] | None = None, by: tuple[str, ...] = FRAME, wrapped: bool = False) -> DataFrame:
    """Every frame moved so that the centre of ``chosen`` (rows of coords) is at ``point`` or the middle of the box."""
    if wrapped:
        chosen = wrap(chosen, box)
    middle = point or [sum(v[k] for v in box.vectors()) / 2 for k in range(3)]
    center = center_of_mass(chosen, by, weight) if weight else center_of_geometry(chosen, by)
    moved = coords.join(center.select(*by, *(F.col(c).alias(f"_c{c}") for c in "xyz")), list(by))
    return _put(moved, vec() - vec("_c") + Vec(*map(F.lit, middle))).drop("_cx", "_cy", "_cz")
