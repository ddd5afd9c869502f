"""Tables that cut lineage: written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one where it is unset and Spark runs locally."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    where = tempfile.mkdtemp(prefix="orbitframe-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


class Workspace:
    """The intermediate tables of one operator call.

    Tables that a lazy result reads, or that would make plans grow from step to step, are written (``save``) and
    removed by the operator (``drop``) when its result no longer reads them. Small tables that a loop of jobs reads
    are kept on the executors' disks (``keep``) until its end (``free``); what a lost executor held is computed again.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.kept = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", []

    def save(self, df: DataFrame, name: str, files: int | None = None) -> DataFrame:
        """Write df as Parquet, in at most ``files`` files, and read it back with its schema."""
        path = f"{self.root}/{name}"
        (df.coalesce(files) if files else df).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, df: DataFrame) -> DataFrame:
        """df, computed once for several uses."""
        self.kept.append(df.persist(StorageLevel.DISK_ONLY))
        return self.kept[-1]

    def free(self) -> None:
        while self.kept:
            self.kept.pop().unpersist()

    def drop(self, *names: str) -> None:
        """Remove written tables; names that were never saved are passed over."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
