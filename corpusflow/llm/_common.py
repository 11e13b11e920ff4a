"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import sys
import tempfile
import types
import zlib
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of the table `documents`, in its order.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Most keys that looked_up() splits, rows of such a key in one part, and most parts.
HOT, PER_PART, PARTS = 1000, 256, 4096
#: Rows of a few numbers that one task does, so that grouping and joining them needs no shuffle.
FEW = 100_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` in the folder that the cluster shares (spark.checkpoint.dir); a lost executor costs no data.

    Only in local mode, as in tests, a temporary folder may take its place.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="corpusflow-checkpoint-"))
    return df.checkpoint()


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, what runs in Python workers gets and gives so many rows at a time, where the session has more: for whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) < rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fold(column: Column, n: int) -> Column:
    """crc32 of an id written as text, modulo n; 0 for a null id."""
    return F.coalesce(F.crc32(column.cast("string")) % n, F.lit(0)).cast("int")


def gathered(rows: DataFrame, n: int | None = None) -> DataFrame:
    """rows, of which there are n (else they are counted, so keep them before), in one partition if they are FEW at most, as Spark then joins and groups
    them without a shuffle. A shuffle writes a file for each partition and task, which for few rows is far more than they are."""
    return rows.coalesce(1) if (rows.count() if n is None else n) <= FEW else rows


def looked_up(rows: DataFrame, table: DataFrame, key: str, counted: DataFrame | None = None) -> DataFrame:
    """rows joined with table, which holds each value of `key` once.

    The HOT keys with most rows are split into parts of about PER_PART rows, and their row of the table is repeated for each part; any
    other key has at most a HOT-th of all rows. Only those keys and their numbers of parts are broadcast. They are counted in `counted`, where
    its keys are about as frequent as those of rows and it is cheaper to read, else in rows.
    """
    parts = F.least(F.ceil(F.col("__n") / PER_PART), F.lit(PARTS)).cast("int")
    hot = (rows if counted is None else counted).groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > PER_PART).orderBy(F.desc("__n"), key).limit(HOT).select(key, parts.alias("__parts"))
    others = [F.col(c) for c in rows.columns if c != key]
    many = rows.join(F.broadcast(hot), key, "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(*others), F.col("__parts")), F.lit(0)).cast("int")).drop("__parts")
    each = table.join(F.broadcast(hot), key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return many.join(each, [key, "__part"]).drop("__part")


def kept_in_worker(name: str, key: Hashable, make: Callable[[Any], Any]) -> Any:
    """make(key), kept for the tasks to come of this Python worker: the last one of each name. This package travels by value with each task, so
    a module of the worker's own holds it."""
    kept = sys.modules.setdefault("_corpusflow_worker", types.ModuleType("_corpusflow_worker")).__dict__
    if name not in kept or kept[name][0] != key:
        kept[name] = key, make(key)
    return kept[name][1]


def packed(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x, dtype=np.float64).tobytes(), 1)


def added(parts: DataFrame) -> dict[int, np.ndarray]:
    """Sums by key of (key int, data: packed array). A task adds up one row after the other and holds one array for each of its keys, so
    memory does not follow the number of rows. What reaches the driver is one array for each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(zlib.decompress(data.as_py()))
                held[k] = held[k] + x if k in held else x
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(list(map(packed, held.values())), pa.binary())], ["key", "data"])

    rows = parts.select("key", "data").repartition("key").mapInArrow(run, "key int, data binary").collect()
    return {r["key"]: np.frombuffer(zlib.decompress(r["data"])) for r in rows}
