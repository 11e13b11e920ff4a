"""Searches of a stated query set against all vectors, in shards of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(vec_id, v: array<double>) of the rows with an id and a vector without null or non-finite components."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(fine)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def search(rows: DataFrame, every: int, k: int, per_shard: int, build: Callable, find: Callable, score_type: str) -> DataFrame:
    """(query_id, rank, vec_id, score): k best of all rows for each row of `rows` (vec_id, v) whose id is divisible by `every`.

    Rows are dealt to shards of about `per_shard` rows by a hash of id and vector, one shard to a partition; every query goes to every shard. Of rows that
    repeat a query's id the one with the least vector asks, so an id has one result; all of them stay candidates of others. A shard's rows come
    before its queries in one sorted partition, so a task holds one shard and a batch of queries: build(ids, matrix) makes the
    index of those of one length, find(index, query_ids, matrix) yields (query, ids, scores) with k entries at most, best first. Only those k are shuffled on.
    """
    n = rows.count()
    shards = max(1, -(-n // per_shard))
    one = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int")).select("shard", F.size("v").alias("dim"), F.lit(0).alias("query"), "vec_id", "v")
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.size("v").alias("dim"), F.lit(1).alias("query"), "vec_id", "v")
    laid = one.union(asked).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "dim", "query", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, index, ids, parts = None, None, [], []
        for batch in batches:
            s, d, q, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            cuts = np.flatnonzero((np.diff(s) != 0) | (np.diff(d) != 0) | (np.diff(q) != 0)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(s)]):
                if low == high:
                    continue
                if (s[low], d[low]) != shard:
                    shard, index, ids, parts = (s[low], d[low]), None, [], []
                if q[low] == 0:
                    ids.append(v[low:high])
                    parts.append(_matrix(batch.column(4).slice(low, high - low)))
                    continue
                if index is None:
                    index = build(np.concatenate(ids), np.vstack(parts)) if ids else ()
                    ids, parts = [], []
                if index == ():
                    continue
                out = list(find(index, v[low:high], _matrix(batch.column(4).slice(low, high - low))))
                if out:
                    query = np.repeat([x[0] for x in out], [len(x[1]) for x in out]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(np.concatenate([x[1] for x in out])), pa.array(np.concatenate([x[2] for x in out]))], ["query_id", "vec_id", "score"])

    best = laid.mapInArrow(run, f"query_id long, vec_id long, score {score_type}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
