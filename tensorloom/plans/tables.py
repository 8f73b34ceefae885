"""Shared-folder tables, and dense numbering without a global window."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from ``spark.checkpoint.dir``; a local one if a local master leaves it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or LOCAL_CHECKPOINTS).rstrip("/")


def settle(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, fixes what is random."""
    path = f"{shared_dir(df.sparkSession)}/tensorloom-core-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, position: Column, size: int, out: str, chunk: int = 1 << 16) -> DataFrame:
    """``df`` plus the rank (from 0) of the integer ``position``, unique and below ``size``.

    Rows are ranked in chunks of positions; chunks are shifted by the counts of
    those before, so only one row per chunk meets in one place.
    """
    cut = df.withColumn("_num_pos", position.cast("bigint")).withColumn("_num_part", F.expr(f"_num_pos div {chunk}"))
    inside = F.row_number().over(Window.partitionBy("_num_part").orderBy("_num_pos")) - 1
    if size <= chunk:
        return cut.withColumn(out, inside.cast("bigint")).drop("_num_pos", "_num_part")
    sums = cut.groupBy("_num_part").agg(F.count("*").alias("_num_rows"))
    before = Window.orderBy("_num_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select("_num_part", F.coalesce(F.sum("_num_rows").over(before), F.lit(0)).alias("_num_shift"))
    return cut.withColumn("_num_in", inside).join(shift, "_num_part").withColumn(out, (F.col("_num_in") + F.col("_num_shift")).cast("bigint")).drop("_num_pos", "_num_part", "_num_in", "_num_shift")


def ranked(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """``df`` plus its rank (from 0) in ``order``, which must be total.

    Rows are dealt by ranges of the order; the ranges are settled once, ranked
    inside, and shifted by the counts of those before.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = settle(df.repartitionByRange(parts, *order).withColumn("_num_part", F.spark_partition_id()), "ranges")
    inside = F.row_number().over(Window.partitionBy("_num_part").orderBy(*order)) - 1
    sums = dealt.groupBy("_num_part").agg(F.count("*").alias("_num_rows"))
    before = Window.orderBy("_num_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range.
    shift = F.broadcast(sums.select("_num_part", F.coalesce(F.sum("_num_rows").over(before), F.lit(0)).alias("_num_shift")))
    return dealt.withColumn("_num_in", inside).join(shift, "_num_part").withColumn(out, (F.col("_num_in") + F.col("_num_shift")).cast("bigint")).drop("_num_part", "_num_in", "_num_shift")


class Steps:
    """Tables of an iteration, each computed from the one before, in one folder of the shared one.

    Putting a table deletes those older than the last two, which nothing may read any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self._spark, self._n = spark, 0
        self._home = f"{shared_dir(spark)}/tensorloom-core-{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self._home}/{self._n}"
        df.write.parquet(path)
        self._n += 1
        self._drop(self._n - 3)
        return self._spark.read.schema(df.schema).parquet(path)

    def keep_last(self) -> None:
        """At the end of the iteration: only the last table is still read."""
        self._drop(self._n - 2)

    def drop_all(self) -> None:
        self._delete(self._home)

    def _drop(self, n: int) -> None:
        if n >= 0:
            self._delete(f"{self._home}/{n}")

    def _delete(self, path: str) -> None:
        p = self._spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self._spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
