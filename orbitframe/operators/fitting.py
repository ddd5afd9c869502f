"""Rigid-body superposition: sums per frame by Spark, then a 4x4 eigenproblem a frame on those few numbers.

Rows with a null coordinate or weight take no part; repeated rows count each; frames without rows have no result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitframe.functions.vectors import Vec, vec
from orbitframe.operators.aggregates import FRAME, placed, with_reference

_OUT = "rotation array<array<double>>, translation array<double>, rmsd double"


def _rotations(s: np.ndarray) -> np.ndarray:
    """The proper rotations that take first point sets onto second ones, from their covariances, by Horn's quaternions."""
    t = s.transpose(1, 2, 0)
    k = np.array(
        [
            [t[0, 0] + t[1, 1] + t[2, 2], t[1, 2] - t[2, 1], t[2, 0] - t[0, 2], t[0, 1] - t[1, 0]],
            [t[1, 2] - t[2, 1], t[0, 0] - t[1, 1] - t[2, 2], t[0, 1] + t[1, 0], t[2, 0] + t[0, 2]],
            [t[2, 0] - t[0, 2], t[0, 1] + t[1, 0], t[1, 1] - t[0, 0] - t[2, 2], t[1, 2] + t[2, 1]],
            [t[0, 1] - t[1, 0], t[2, 0] + t[0, 2], t[1, 2] + t[2, 1], t[2, 2] - t[0, 0] - t[1, 1]],
        ]
    )
    w, x, y, z = np.linalg.eigh(k.transpose(2, 0, 1))[1][:, :, -1].T
    turn = np.array([[w * w + x * x - y * y - z * z, 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), w * w - x * x + y * y - z * z, 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), w * w - x * x - y * y + z * z]])
    return turn.transpose(2, 0, 1)


def fit_to_reference(coords: DataFrame, reference: DataFrame, by: tuple[str, ...] = FRAME, weight: str | None = None) -> DataFrame:
    """(*by, rotation, translation, rmsd): R r + t brings each frame onto the reference; the identity where weights sum to 0."""
    w = F.col(weight) if weight else F.lit(1.0)
    met = with_reference(coords, reference).withColumn("_w", w.cast("double")).dropna(subset=["_w"])
    means = met.groupBy(*by).agg(F.sum("_w").alias("n"), *(F.try_divide(F.sum(F.col("_w") * F.col(p + c)), F.sum("_w")).alias(f"m{p}{c}") for p in ("", "r") for c in "xyz"))
    d = {p + c: F.col(p + c) - F.col(f"m{p}{c}") for p in ("", "r") for c in "xyz"}
    sums = met.join(means, list(by)).groupBy(*by, "n", *(f"m{p}{c}" for p in ("", "r") for c in "xyz")).agg(*(F.sum(F.col("_w") * d[a] * d["r" + b]).alias(f"s{a}{b}") for a in "xyz" for b in "xyz"), F.sum(F.col("_w") * sum(v * v for v in d.values())).alias("e"))

    def solve(batches):
        for rows in batches:
            n = np.nan_to_num(rows["n"].to_numpy(float))
            some = n > 0
            held = np.nan_to_num(rows[[f"s{a}{b}" for a in "xyz" for b in "xyz"]].to_numpy(float)).reshape(-1, 3, 3)
            turn = np.where(some[:, None, None], _rotations(held), np.eye(3))
            first, second = (np.nan_to_num(rows[[f"m{p}{c}" for c in "xyz"]].to_numpy(float)) for p in ("", "r"))
            move = np.where(some[:, None], second - np.einsum("nij,nj->ni", turn, first), 0.0)
            left = np.nan_to_num(rows["e"].to_numpy(float)) - 2 * np.einsum("nji,nij->n", turn, held)
            err = np.where(some, np.sqrt(np.maximum(0.0, left / np.where(some, n, 1.0))), 0.0)
            yield pd.DataFrame({**{c: rows[c] for c in by}, "rotation": turn.tolist(), "translation": move.tolist(), "rmsd": err})

    keys = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in coords.select(*by).schema)
    return sums.mapInPandas(solve, keys + _OUT)  # a row a frame


def apply_fit(coords: DataFrame, fits: DataFrame, by: tuple[str, ...] = FRAME) -> DataFrame:
    """coords moved by each frame's fit."""
    met = coords.join(fits.select(*by, "rotation", "translation"), list(by))
    r, out = vec(), []
    for k in range(3):
        row = F.col("rotation")[k]
        out.append(r.dot(Vec(row[0], row[1], row[2])) + F.col("translation")[k])
    return met.withColumns(dict(zip("xyz", out))).drop("rotation", "translation")


def helix_axis(coords: DataFrame, by: tuple[str, ...] = FRAME, order: str = "atom_index", toward_first: bool = False) -> DataFrame:
    """(*by, ax, ay, az, rms, length): first principal axis pointing from the first to the last point (or back), rms distance from it, projected length."""
    coords = placed(coords)
    means = coords.groupBy(*by).agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"), F.min_by(F.struct("x", "y", "z"), order).alias("first"), F.max_by(F.struct("x", "y", "z"), order).alias("last"))
    d = {c: F.col(c) - F.col(f"m{c}") for c in "xyz"}
    sums = coords.join(means, list(by)).groupBy(*by).agg(F.count("*").alias("n"), *(F.sum(d[a] * d[b]).alias(a + b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")), *((F.first(f"last.{c}") - F.first(f"first.{c}")).alias(f"d{c}") for c in "xyz"))

    def solve(batches):
        for rows in batches:
            c = rows[["xx", "xy", "xz", "xy", "yy", "yz", "xz", "yz", "zz"]].to_numpy(float).reshape(-1, 3, 3)
            n, span = rows["n"].to_numpy(float), rows[["dx", "dy", "dz"]].to_numpy(float)
            axis = np.where((n > 1)[:, None], np.linalg.eigh(c)[1][:, :, -1], 0.0)
            along = (axis * span).sum(1)
            axis = np.where(((along < 0) != toward_first)[:, None], -axis, axis)
            rest = np.trace(c, axis1=1, axis2=2) - np.einsum("ni,nij,nj->n", axis, c, axis)
            yield pd.DataFrame({**{k: rows[k] for k in by}, **dict(zip(("ax", "ay", "az"), axis.T)), "rms": np.sqrt(np.maximum(0.0, rest / n)), "length": np.abs(along)})

    keys = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in coords.select(*by).schema)
    return sums.mapInPandas(solve, keys + "ax double, ay double, az double, rms double, length double")
