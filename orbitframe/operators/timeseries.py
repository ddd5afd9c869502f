"""Trajectory analyses over time: lag joins, runs of presence and sliding windows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitframe.functions.vectors import dihedral, vec
from orbitframe.operators.numbering import numbered


CHUNK = 1 << 12  # frames of an atom that one row holds


def _spectra(places: pa.StructArray, size: int) -> np.ndarray:
    """Transforms of count, sum of squares and sums of x, y, z by frame, from the first frame of the places on."""
    at = places.field("at").to_numpy()
    held = np.zeros((5, size))
    for k, name in enumerate(("n", "square", "x", "y", "z")):
        held[k, at - at.min()] = places.field(name).to_numpy()
    return np.fft.rfft(held)


def _lag_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lag, total, pairs) for rows (step, early, late) by rising step: chunks of one atom, ``step`` chunks apart.

    Sums over all pairs at each lag are correlations: counts with squares, squares with counts, less twice places with places.
    """
    step, total, pairs = None, np.zeros(2 * CHUNK), np.zeros(2 * CHUNK)

    def result() -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(step * CHUNK + at - CHUNK), pa.array(total[at]), pa.array(pairs[at].astype(np.int64))], ["lag", "total", "pairs"])

    for batch in batches:
        for row in range(batch.num_rows):
            if batch.column("step")[row].as_py() != step:
                if step is not None:
                    yield from result()
                step = batch.column("step")[row].as_py()
                total[:], pairs[:] = 0, 0
            early, late = batch.column("early")[row].values, batch.column("late")[row].values
            (a0, a1), (b0, b1) = ((x.min(), x.max()) for x in (early.field("at").to_numpy(), late.field("at").to_numpy()))
            size = 1 << int(a1 - a0 + b1 - b0 + 1).bit_length()
            a, b = _spectra(early, size).conj(), _spectra(late, size)
            sums = np.fft.irfft(np.stack([a[0] * b[1] + a[1] * b[0] - 2 * (a[2:] * b[2:]).sum(0), a[0] * b[0]]), size)
            shift = np.arange(a0 - a1, b1 - b0 + 1)  # from the first frames on
            if step == 0:
                shift = shift[shift >= 0]
            count = np.rint(sums[1, shift % size])
            total[CHUNK + b0 - a0 + shift] += np.where(count > 0, sums[0, shift % size], 0)
            pairs[CHUNK + b0 - a0 + shift] += count
    if step is not None:
        yield from result()


def msd_by_lag(coords: DataFrame, max_lag: int | None = None) -> DataFrame:
    """(lag, msd): displacement over all origins and atoms, up to ``max_lag`` frames apart.

    With a bound, every frame of an atom meets those up to ``max_lag`` later, by equal frame numbers. Without one, an
    atom's frames are packed into chunks of ``CHUNK`` frames and pairs of chunks are correlated by Fourier transforms,
    so a pair of chunks costs CHUNK log CHUNK and no row or task holds more than chunks. Repeated rows count each.
    Places with a null component, and those that are not finite, count nowhere; a lag without pairs has no row.
    """
    fine = reduce(lambda a, b: a & b, (F.abs(c) < float("inf") for c in "xyz"))
    held = coords.where(fine & F.col("atom_index").isNotNull() & F.col("frame_index").isNotNull())
    if max_lag is not None:
        late = held.select("atom_index", F.col("frame_index").alias("later"), *(F.col(c).alias(f"{c}2") for c in "xyz"))
        early = held.withColumn("later", F.explode(F.sequence("frame_index", F.col("frame_index") + max_lag)))
        pairs = early.join(late, ["atom_index", "later"])
        return pairs.groupBy((F.col("later") - F.col("frame_index")).alias("lag")).agg(F.avg((vec(suffix="2") - vec()).norm_squared()).alias("msd"))
    # displacements do not depend on the origin: near an atom's own mean, squares stay small
    means = held.groupBy("atom_index").agg(*(F.avg(c).alias(f"_{c}") for c in "xyz"))
    about = held.select("atom_index", F.col("frame_index").cast("long").alias("frame_index"), *"xyz").join(means, "atom_index").withColumns({c: F.col(c) - F.col(f"_{c}") for c in "xyz"})
    frames = about.groupBy("atom_index", "frame_index").agg(F.count("*").alias("n"), F.sum(vec().norm_squared()).alias("square"), *(F.sum(c).alias(c) for c in "xyz"))
    chunk = F.floor(F.col("frame_index") / CHUNK)
    at = F.col("frame_index") - chunk * CHUNK
    packed = frames.groupBy("atom_index", chunk.alias("chunk")).agg(F.collect_list(F.struct(at.alias("at"), "n", "square", *"xyz")).alias("places"))
    early = packed.select("atom_index", F.col("chunk").alias("_first"), F.col("places").alias("early"))
    met = early.join(packed, "atom_index").where("chunk >= _first").select((F.col("chunk") - F.col("_first")).alias("step"), "early", F.col("places").alias("late"))
    sums = met.sortWithinPartitions("step").mapInArrow(_lag_sums, "lag long, total double, pairs long")
    return sums.groupBy(F.col("lag").cast(coords.schema["frame_index"].dataType).alias("lag")).agg((F.greatest(F.sum("total"), F.lit(0.0)) / F.sum("pairs")).alias("msd"))


def fill_gaps(states: DataFrame, intermittency: int) -> DataFrame:
    """(frame, id) with absences of at most ``intermittency`` frames between two appearances filled.

    Rows with a null frame or id take no part; repeated rows count once; an empty table gives an empty result.
    """
    following = F.lead("frame").over(Window.partitionBy("id").orderBy("frame"))
    gap = F.col("next") - F.col("frame") - 1
    held = states.select("frame", "id").dropna().distinct().withColumn("next", following)
    last = F.when(F.col("next").isNotNull() & gap.between(1, intermittency), F.col("next") - 1).otherwise(F.col("frame"))
    return held.select(F.explode(F.sequence("frame", last)).alias("frame"), "id")


def survival(states: DataFrame, tau_max: int, step: int = 1) -> DataFrame:
    """(tau, survival): mean share of an origin's ids that stay present in every frame up to origin + tau.

    Origins are frames 0, step, 2 step ... that hold any id; ids' runs of consecutive frames give how long each
    stays, so every (origin, id) is one row whatever tau is. Rows with a null frame or id take no part; repeated rows
    count once; an empty table gives an empty result.
    """
    states = states.select("frame", "id").dropna()
    w = Window.partitionBy("id").orderBy("frame")
    runs = states.distinct().withColumn("run", F.col("frame") - F.row_number().over(w))
    stay = runs.withColumn("left", F.max("frame").over(Window.partitionBy("id", "run")) - F.col("frame"))
    last = F.broadcast(states.agg(F.max("frame").alias("_last")))  # one row
    origins = stay.where(F.col("frame") % step == 0).join(last)
    taus = origins.withColumn("tau", F.explode(F.sequence(F.lit(0), F.least(F.lit(tau_max), (F.col("_last") - F.col("frame")).cast("int")))))
    shares = taus.groupBy("frame", "tau").agg(F.avg((F.col("left") >= F.col("tau")).cast("double")).alias("share"))
    return shares.groupBy("tau").agg(F.avg("share").alias("survival"))


def dihedral_series(coords: DataFrame, by: tuple[str, ...] = ("frame_index",), order: str = "atom_index") -> DataFrame:
    """(*by, order, dihedral) of every four consecutive points, one row for each that three more follow.

    The angle is null where a component of one of the four is null; points of equal ``order`` stand in no certain order.
    """
    w = Window.partitionBy(*by).orderBy(order)
    held = coords.withColumns({f"{c}{k}": F.lead(c, k).over(w) for c in "xyz" for k in (1, 2, 3)}).withColumn("_more", F.lead(F.lit(True), 3).over(w)).where("_more")
    p = [vec(), *(vec(suffix=str(k)) for k in (1, 2, 3))]
    return held.select(*by, order, dihedral(p[1] - p[0], p[2] - p[1], p[3] - p[2]).alias("dihedral"))


def frame_dt(frames: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """frames with dt: time to the next frame; for the last one, since the frame before; 0 for a single frame.

    Frames of one trajectory are numbered in ranges and meet their neighbours by number; with ``by``, windows do it.
    """
    if by:
        w = Window.partitionBy(*by).orderBy("frame_index")
        after, before = F.lead("time").over(w), F.lag("time").over(w)
        return frames.withColumn("dt", F.coalesce(after - F.col("time"), F.col("time") - before, F.lit(0.0)))
    held = numbered(frames, "frame_index", "_k")
    near = lambda step, name: held.select((F.col("_k") - step).alias("_k"), F.col("time").alias(name))
    met = held.join(near(1, "_after"), "_k", "left").join(near(-1, "_before"), "_k", "left")
    return met.withColumn("dt", F.coalesce(F.col("_after") - F.col("time"), F.col("time") - F.col("_before"), F.lit(0.0))).select(*frames.columns, "dt")


def last_known(series: DataFrame, by: tuple[str, ...], order: str, column: str) -> DataFrame:
    """The column with gaps filled by the last value at or before each row."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumn(column, F.last(column, ignorenulls=True).over(w))
