"""Consecutive numbers for rows in a global order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitframe.sources.checkpoints import ensure_checkpoints


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """rows with ``name``: 0, 1, 2 ... by ``order``, a column without ties.

    Rows are dealt into ranges and numbered within each; the ranges' sizes, a row a range, give the offsets.
    """
    spark = rows.sparkSession
    ensure_checkpoints(spark)
    dealt = rows.repartitionByRange(order).withColumn("_range", F.spark_partition_id()).checkpoint()
    begin, offsets = 0, []
    for r in dealt.groupBy("_range").count().orderBy("_range").collect():
        offsets.append((r["_range"], begin))
        begin += r["count"]
    known = spark.createDataFrame(offsets, "_range int, _begin long")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return dealt.withColumn(name, place).join(F.broadcast(known), "_range").withColumn(name, F.col(name) + F.col("_begin")).drop("_range", "_begin")
