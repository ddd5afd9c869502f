"""Lines of text files with their place in the file, and running values over them, without a task that sees a whole file.

A file is read in the blocks that Spark splits it into. Numbers, last markers and counts are taken within each block;
what the blocks before it hold, a row a block, is added by a join. Part files of one written folder count as one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def source_file() -> Column:
    """The path of the file that a line comes from; the part files of a folder count as one."""
    return F.when(F.col("_metadata.file_name").startswith("part-"), F.regexp_replace("_metadata.file_path", "/[^/]*$", "")).otherwise(F.col("_metadata.file_path"))


def _raw(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, _at, line): ``_at`` orders the lines of a block."""
    meta = spark.read.text(path).select("value", source_file().alias("file"), "_metadata.file_name", "_metadata.file_block_start")
    block = F.concat("file_name", F.format_string("@%020d", "file_block_start"))
    return meta.select("file", block.alias("block"), F.monotonically_increasing_id().alias("_at"), F.regexp_replace("value", "\r", "").alias("line"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, n, line) of every line; n counts from 0 in each file, ``block`` orders the blocks of a file."""
    raw = _raw(spark, path)
    sizes = raw.groupBy("file", "block").agg(F.min("_at").alias("_first"), F.count("*").alias("_size"))
    begin = F.coalesce(F.sum("_size").over(_earlier_blocks("file")), F.lit(0))
    return raw.join(sizes.select("file", "block", "_first", begin.alias("_begin")), ["file", "block"]).select("file", "block", (F.col("_at") - F.col("_first") + F.col("_begin")).alias("n"), "line")


def scan(spark: SparkSession, path: str | list[str], marks: dict[str, Column] | None = None, counts: dict[str, Column] | None = None, within: dict[str, tuple[str, tuple[str, ...], Column]] | None = None, heads: dict[str, tuple[Column, int]] | None = None, pieces: Column | None = None) -> DataFrame:
    """(file, block, n, line) of every line with running values of its file, all from one summary a block.

    ``marks``: the last value that is not null, at the line or above it, as a struct (value, n, and every count at that
    line). ``counts``: running sums of numbers or flags up to and with the line; ``<name>_total`` is the file's sum.
    ``within``: how many lines up to this one have a flag and stand below a mark with one of some values. ``heads``:
    the first lines of the file that have a flag, as an array of structs (n, line). ``pieces``: an array that takes a
    line's place, each of its strings being a line of its own.

    Each block is summed up by itself; the summaries, a row a block, are added up in the order of blocks and joined
    once. Marks, flags and numbers are expressions of ``line``; null ones count as nothing.
    """
    marks, within, heads = marks or {}, within or {}, heads or {}
    add = {k: F.coalesce(c.cast("long"), F.lit(0)) for k, c in (counts or {}).items()}
    key, w = ["file", "block"], Window.partitionBy("file", "block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    rows = _raw(spark, path).repartition(*key)
    if pieces is not None:
        rows = rows.select(*key, "_at", F.posexplode(pieces).alias("_piece", "line")).withColumn("_at", F.struct("_at", "_piece")).drop("_piece")
    rows = rows.withColumns({"_n": F.row_number().over(Window.partitionBy(*key).orderBy("_at")).cast("long") - 1, **{k: F.sum(c).over(w) for k, c in add.items()}, **{f"_h_{k}": F.sum(F.coalesce(flag.cast("long"), F.lit(0))).over(w) for k, (flag, _) in heads.items()}})
    held = lambda value, n, at: F.struct(value.alias("value"), n.alias("n"), *(at(k).alias(k) for k in add))
    rows = rows.withColumns({k: F.last(F.when(c.isNotNull(), held(c, F.col("_n"), F.col)), ignorenulls=True).over(w) for k, c in marks.items()})
    below = lambda mark, values: F.coalesce(F.col(mark)["value"].isin(*values), F.lit(False))
    flagged = lambda flag, here: F.sum((F.coalesce(flag, F.lit(False)) & here).cast("long")).over(w)
    # above a block's first mark the one carried into the block decides
    rows = rows.withColumns({f"_{side}_{k}": flagged(flag, F.col(mark).isNull() if side == "open" else below(mark, values)) for k, (mark, values, flag) in within.items() for side in ("open", "known")})
    first = {k: F.array_sort(F.collect_list(F.when(flag & (F.col(f"_h_{k}") <= n), F.struct("_n", "line")))) for k, (flag, n) in heads.items()}
    sums = ["_size", *add, *(f"_{side}_{k}" for k in within for side in ("open", "known"))]
    blocks = rows.groupBy(*key).agg(F.count("*").alias("_size"), *(F.max(c).alias(c) for c in sums[1:]), *(F.max_by(k, "_at").alias(k) for k in marks), *(c.alias(k) for k, c in first.items()))
    before, whole = _earlier_blocks("file"), Window.partitionBy("file")
    blocks = blocks.withColumns({f"_to_{c}": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in sums[: 1 + len(add)]})
    moved = lambda m: F.when(m.isNotNull(), held(m["value"], m["n"] + F.col("_to__size"), lambda k: m[k] + F.col(f"_to_{k}")))
    blocks = blocks.withColumns({f"_to_{k}": F.last(moved(F.col(k)), ignorenulls=True).over(before) for k in marks})
    carried = lambda mark, values: F.coalesce(F.col(f"_to_{mark}")["value"].isin(*values), F.lit(False)).cast("long")
    blocks = blocks.withColumns({f"_to_{k}": F.coalesce(F.sum(F.col(f"_known_{k}") + carried(mark, values) * F.col(f"_open_{k}")).over(before), F.lit(0)) for k, (mark, values, _) in within.items()})
    blocks = blocks.withColumns({**{f"{k}_total": F.sum(k).over(whole) for k in add}, **{f"_to_{k}": F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", k, "_to__size")).over(whole)), lambda s: F.transform(s[k], lambda x: F.struct((x["_n"] + s["_to__size"]).alias("n"), x["line"].alias("line"))))), 1, n) for k, (_, n) in heads.items()}})
    found = rows.join(blocks.select(*key, *(c for c in blocks.columns if c.startswith("_to_") or c.endswith("_total"))), key)
    put = {"n": F.col("_n") + F.col("_to__size"), **{k: F.col(k) + F.col(f"_to_{k}") for k in add}, **{k: F.coalesce(moved(F.col(k)), F.col(f"_to_{k}")) for k in marks}, **{k: F.col(f"_to_{k}") + F.col(f"_known_{k}") + carried(mark, values) * F.col(f"_open_{k}") for k, (mark, values, _) in within.items()}, **{k: F.col(f"_to_{k}") for k in heads}}
    return found.select(*key, *(c.alias(k) for k, c in put.items()), *(f"{k}_total" for k in add), "line")


def _earlier_blocks(*by: str):
    return Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def _within_block(*by: str):
    return Window.partitionBy(*by, "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)


def filled(lines: DataFrame, **marks: Column) -> DataFrame:
    """lines with a column for each mark: its last value that is not null, at the line or above it in the file."""
    lines = lines.withColumns(marks)
    last = lines.groupBy("file", "block").agg(*(F.max_by(k, F.when(F.col(k).isNotNull(), F.col("n"))).alias(f"_{k}") for k in marks))
    above = last.select("file", "block", *(F.last(f"_{k}", ignorenulls=True).over(_earlier_blocks("file")).alias(f"_{k}") for k in marks))
    found = lines.join(above, ["file", "block"])
    return found.withColumns({k: F.coalesce(F.last(k, ignorenulls=True).over(_within_block("file")), F.col(f"_{k}")) for k in marks}).drop(*(f"_{k}" for k in marks))


def counted(lines: DataFrame, **flags: Column) -> DataFrame:
    """lines with a column for each flag: how many lines of the file, up to and with this one, have it."""
    lines = lines.withColumns({k: F.coalesce(f, F.lit(False)).cast("long") for k, f in flags.items()})
    sums = lines.groupBy("file", "block").agg(*(F.sum(k).alias(f"_{k}") for k in flags))
    above = sums.select("file", "block", *(F.coalesce(F.sum(f"_{k}").over(_earlier_blocks("file")), F.lit(0)).alias(f"_{k}") for k in flags))
    found = lines.join(above, ["file", "block"])
    return found.withColumns({k: F.sum(k).over(_within_block("file")) + F.col(f"_{k}") for k in flags}).drop(*(f"_{k}" for k in flags))


def numbered(rows: DataFrame, name: str, *by: str) -> DataFrame:
    """rows with ``name``: 0, 1, 2 ... by n within each file and ``by``."""
    key = ["file", *by]
    sizes = rows.groupBy(*key, "block").agg(F.count("*").alias("_size"))
    begin = F.coalesce(F.sum("_size").over(_earlier_blocks(*key)), F.lit(0))
    place = F.row_number().over(Window.partitionBy(*key, "block").orderBy("n")) - 1
    found = rows.withColumn(name, place).join(sizes.select(*key, "block", begin.alias("_begin")), [*key, "block"])
    return found.withColumn(name, (F.col(name) + F.col("_begin")).cast("long")).drop("_begin")


def write_lines(lines: DataFrame, path: str, *order: str, head: list[str] = (), tail: list[str] = ()) -> None:
    """Sorted lines between a head and a tail, as the part files of one folder, which ``read_lines`` takes for one file."""
    rows = lines.select(F.lit(1).alias("_part"), F.lit(0).alias("_k"), F.struct(*order).alias("_key"), "value")
    fixed = lines.sparkSession.createDataFrame([(part, k, v) for part, some in ((0, head), (2, tail)) for k, v in enumerate(some)], "_part int, _k int, value string")
    none = F.lit(None).cast(rows.schema["_key"].dataType)
    rows.union(fixed.select("_part", "_k", none, "value")).orderBy("_part", "_k", "_key").select("value").write.mode("overwrite").text(path)


def fit(text: Column, width: int, right: bool = True) -> Column:
    """A label in a field of ``width`` columns; null is blank, and one that is too long raises an error."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    padded = F.lpad(text, width, " ") if right else F.rpad(text, width, " ")
    return F.when(F.length(text) <= width, padded).otherwise(F.raise_error(F.concat(F.lit(f"no room in {width} columns for "), text)))


def fixed(value: Column, width: int, digits: int) -> Column:
    """A number with so many decimals in a field; null is blank, and one that is too long raises an error."""
    return fit(F.when(value.isNotNull(), F.format_string(f"%.{digits}f", value)), width)
