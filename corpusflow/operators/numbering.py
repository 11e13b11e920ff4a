"""Dense numbers of rows in an order, whole or by group, without a task that sees a whole group."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only in local mode, as in tests, a temporary one may take its place."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="corpusflow-")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder of spark.checkpoint.dir."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path below spark.checkpoint.dir, which all executors see."""
    return f"{_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"


def number(df: DataFrame, order: list[str], keys: list[str] | None = None, into: str = "n") -> DataFrame:
    """df with `into`: 1, 2, 3 ... in the order of the columns `order`, anew for each value of `keys`; null keys are one group.

    Rows are dealt into ranges of (keys, order). A row's number is its number in its range plus the sizes of its group in the ranges
    before, which are as many rows as ranges and groups that meet. Ranges are kept in the checkpoint folder, as both parts
    of the sum must see the same ones. Ties get neighbouring numbers in either order.
    """
    keys = keys or []
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = checkpoint(df.repartitionByRange(ranges, *keys, *order).withColumn("__range", F.spark_partition_id()))
    before = F.coalesce(F.sum("__size").over(Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = laid.groupBy("__range", *keys).agg(F.count("*").alias("__size")).withColumn("__before", before)
    named = sizes.select(F.col("__range").alias("__r"), "__before", *[F.col(k).alias(f"__{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.col("__range") == F.col("__r"))
    local = F.row_number().over(Window.partitionBy("__range", *keys).orderBy(*order))
    return laid.withColumn("__local", local).join(named, same).select(*df.columns, (F.col("__local") + F.col("__before")).cast("long").alias(into))
