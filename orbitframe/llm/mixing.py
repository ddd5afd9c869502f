"""Operator 5: mixing sources to target weights by entropy balancing.

Documents start at one copy each. The rates nearest to that in relative entropy whose words meet every source's
target have the form min(cap, exp(l * size)): the dual has one multiplier a source, found by Newton steps whose
sums Spark takes over the counts of documents by source and size. Rates then become whole copies: sizes of a
source, largest first, pass their rounding error on, and within a size a hash of the id picks who gets one more.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitframe.llm.storage import Workspace

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
_UNIT = 1024.0
MANY = 100_000  # sources; tables of more are joined, not broadcast


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, total: float = 1.5, cap: float = 2.0) -> dict[str | None, float]:
    """Words wanted of each source: a share of ``total`` times all words by weight, at most ``cap`` times its size, the excess reshared by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    found, free, rest = {}, list(order), total * sum(sizes.values())
    while free:
        unit = rest / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * unit > cap * sizes[s]]
        if not over:
            return found | {s: weight[s] * unit for s in free}
        found |= {s: cap * sizes[s] for s in over}
        rest -= sum(found[s] for s in over)
        free = [s for s in free if s not in found]
    return found


def _small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= MANY else table


def _sum(x: Column) -> Column:
    """A sum in whole units, the same in whatever order its terms arrive."""
    return F.sum(F.round(x * _UNIT).cast("decimal(38, 0)"))


def multipliers(cells: DataFrame, wanted: dict[int, float], scale: dict[int, float], cap: float, rounds: int = 40, within: float = 1e-6) -> dict[int, float]:
    """Newton's method on the convex dual of all sources at once, kept inside a bracket by bisection.

    ``cells`` holds (sid, size, n); a round is one distributed sum of gradient and curvature over them.
    """
    spark = cells.sparkSession
    at, low, high, open_ = dict.fromkeys(wanted, 0.0), dict.fromkeys(wanted, -math.inf), dict.fromkeys(wanted, math.inf), set(wanted)
    for _ in range(rounds):
        if not open_:
            break
        now = spark.createDataFrame([(s, at[s] / scale[s]) for s in sorted(open_)], "sid int, l double")
        rate = F.least(F.lit(cap), F.exp(F.least(F.col("l") * F.col("size"), F.lit(50.0))))
        words = F.col("n") * F.col("size")
        sums = cells.join(_small(now, len(open_)), "sid").groupBy("sid").agg(_sum(words * rate).alias("taken"), _sum(F.when(rate < cap, words * F.col("size") * rate).otherwise(0.0)).alias("slope")).collect()
        for s, taken, slope in sums:
            taken, slope = float(taken) / _UNIT, float(slope) / _UNIT
            gap = wanted[s] - taken
            if abs(gap) <= within * wanted[s]:
                open_.discard(s)
                continue
            if gap > 0:
                low[s] = at[s]
            else:
                high[s] = at[s]
            step = at[s] + gap * scale[s] / slope if slope else math.inf * gap
            if not low[s] < step < high[s] or not math.isfinite(step):
                step = (low[s] + high[s]) / 2 if math.isfinite(low[s] + high[s]) else (2 * at[s] + 1 if gap > 0 else 2 * at[s] - 1)
            at[s] = step
        open_ &= {s for s, *_ in sums}
    return {s: at[s] / scale[s] for s in wanted}


def round_cells(cells: pd.DataFrame, cap: float) -> pd.DataFrame:
    """Copies of one source's documents by size, largest first; each size's rounding error goes to the next."""
    cells = cells.sort_values("size", ascending=False)
    error, copies = 0.0, []
    for size, n, rate in zip(cells["size"], cells["n"], cells["rate"], strict=True):
        if not size:
            copies.append(n)
            continue
        due = n * rate + error / size
        whole = min(max(math.floor(due + 0.5), 0), int(cap * n))
        error = (due - whole) * size
        copies.append(whole)
    return cells.assign(copies=copies)[["sid", "size", "n", "copies"]]


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, total: float = 1.5, cap: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, size, source_size, target, taken, copies): how many whole copies of each document the mix takes.

    Null and empty texts have size 0 and stay with one empty copy; a null source is a source of its own, the last
    in order; repeated rows count each, ties among them falling by ``keep``; sources without words have target 0; an empty table gives an empty result.
    Sources are held on the driver (a row a source, as the weights are); documents never are.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "mixing")
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    row = F.xxhash64(id_col, text_col)  # rows of one id, or without one, are told apart by their texts
    sized = work.save(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), row.alias("_row_hash"), F.struct(F.lit(0).alias("_"), *keep).alias("_keep")), "sizes")
    cells = work.keep(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    sources = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("words"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size") * F.col("size")).alias("square")).collect()
    sources = sorted(sources, key=lambda r: (r.source is None, r.source or ""))
    want = targets({r.source: r.words for r in sources}, weights, total, cap)
    known = spark.createDataFrame([(k, r.source, r.words, float(want[r.source])) for k, r in enumerate(sources)], "sid int, source string, source_size long, target double")
    cells = work.keep(cells.join(_small(known, len(sources)), cells.source.eqNullSafe(known.source)).select("sid", "size", "n"))
    free = {k: want[r.source] for k, r in enumerate(sources) if 0 < want[r.source] < cap * r.words * (1 - 1e-9)}
    found = multipliers(cells, free, {k: r.square / r.words for k, r in enumerate(sources) if r.words}, cap)
    rates = spark.createDataFrame([(k, found.get(k), float(cap if want[r.source] else 0)) for k, r in enumerate(sources)], "sid int, l double, fixed double")
    rate = F.when(F.col("l").isNull(), F.col("fixed")).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(F.col("l") * F.col("size"), F.lit(50.0)))))
    rated = cells.join(_small(rates, len(sources)), "sid").select("sid", "size", "n", rate.alias("rate"))
    # a group holds a row for each size in a source: at most the square root of twice its words
    rounded = work.save(rated.groupBy("sid").applyInPandas(lambda rows: round_cells(rows, cap), "sid int, size long, n long, copies long"), "rounded")
    work.free()
    # both the cells of a size and the rows of a cell grow with the root of n
    cell = F.pmod("_row_hash", F.ceil(F.sqrt(F.col("n").cast("double"))).cast("long"))
    numbered = sized.join(_small(known, len(sources)), sized.source.eqNullSafe(known.source)).drop("source")
    dealt = numbered.join(rounded, ["sid", "size"]).withColumn("cell", cell)
    base, more = F.floor(F.col("copies") / F.col("n")), F.col("copies") % F.col("n")
    counted = dealt.groupBy("sid", "size", "cell").agg(F.count("*").alias("k"), F.first("n").alias("n"), F.first("copies").alias("copies"))
    so_far = F.sum("k").over(Window.partitionBy("sid", "size").orderBy("cell"))
    share = lambda k: F.floor(k * more / F.col("n"))
    quota = counted.select("sid", "size", "cell", base.alias("base"), (share(so_far) - share(so_far - F.col("k"))).alias("quota"))
    place = F.row_number().over(Window.partitionBy("sid", "size", "cell").orderBy("_row_hash", "doc_id", "_keep"))
    out = dealt.join(quota, ["sid", "size", "cell"]).withColumn("copies", F.col("base") + (place <= F.col("quota")).cast("long"))
    return out.select("doc_id", *(F.col("_keep")[c].alias(c) for c in keep), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
