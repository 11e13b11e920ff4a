"""Exact centroid clustering (Lloyd's rounds) with Yinyang bounds.

Centroids are put into groups once. Every vector keeps an upper bound of the distance to its own centroid and, for each group, a lower
bound of the distance to the group's other centroids. When centroids have moved, the bounds move by as much; a vector whose upper bound stays
below all lower bounds keeps its centroid unseen (global filter), else only the groups whose bound it reaches are looked at (group filter), and in
them only the centroids that their own movement has not ruled out are scanned, exactly (local filter). Components are whole numbers and distances are
compared as such, so the result is that of scanning all centroids; bounds are rounded away from a decision.

Vectors are packed in blocks, one per Arrow batch, with their bounds. A round is one pass without a shuffle over the blocks, which writes them anew to the checkpoint
folder, and a sum of one row per task: k x (components + 2) numbers. Only those sums and k centroids reach the driver.

Edge cases: vectors that are null, of another number of components, or hold a null or non-finite component take no part; a row without an id is
clustered but starts a centroid only if there are too few others; fewer vectors than k give as many centroids; repeated rows count each; equal vectors that start
two centroids leave the larger number empty, and an empty centroid stays; no vectors, no rows. Components of 2**31 or more, and squared distances
beyond 64 bits, raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import checkpoint
from ._shards import _matrix

K, ROUNDS, COMPONENTS, SCALE, SEED, PER_GROUP = 40, 5, 64, 256, 2, 10
#: Bounds are kept in 32 bits; they are widened by this share so that rounding never rules out a nearer centroid.
_SLACK = 1e-6
_BLOCK = "ids array<long>, kind string, x binary, cluster binary, upper binary, lower binary, distance binary, sums array<decimal(38,0)>"


def finite(v: Column) -> Column:
    """Whether no component of an array<double> is null or not finite."""
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of c, exact: in floating point, 64 bits or Python's numbers, as their size allows."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    reach = 4 * most * most * max(1, x.shape[1])
    if reach < 2**53:
        x, c = x.astype(np.float64), c.astype(np.float64)
    elif reach >= 2**63:
        x, c = x.astype(object), c.astype(object)
    else:
        x, c = x.astype(np.int64), c.astype(np.int64)
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)


def _own(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of each row of x to the same row of c."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    apart = x.astype(np.int64) - c
    if 4 * most * most * max(1, x.shape[1]) >= 2**63:
        apart = apart.astype(object)
    return (apart * apart).sum(axis=1)


def _root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


class Groups:
    """Which group each centroid is in; the groups' centroids side by side."""

    def __init__(self, centroids: np.ndarray, per_group: int = PER_GROUP):
        k = len(centroids)
        t = max(1, -(-k // per_group))
        x = centroids.astype(np.float64)
        heads, of = x[:t].copy(), np.zeros(k, dtype=np.int64)
        for _ in range(5):
            of = ((x[:, None, :] - heads[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
            for g in range(t):
                if (of == g).any():
                    heads[g] = x[of == g].mean(axis=0)
        _, self.of = np.unique(of, return_inverse=True)  # no group without centroids
        self.order = np.argsort(self.of, kind="stable")
        self.members = [np.flatnonzero(self.of == g) for g in range(self.of.max(initial=-1) + 1)]
        self.starts = np.concatenate([[0], np.cumsum([len(m) for m in self.members])[:-1]]).astype(np.int64)

    def least(self, values: np.ndarray) -> np.ndarray:
        """The least value of each group, for each row of values by centroid."""
        return np.minimum.reduceat(values[:, self.order], self.starts, axis=1)


def _low(x: np.ndarray) -> np.ndarray:
    return (x - np.abs(np.where(np.isfinite(x), x, 0)) * _SLACK).astype(np.float32)


def _high(x: np.ndarray) -> np.ndarray:
    return (x * (1 + _SLACK)).astype(np.float32)


def first(x: np.ndarray, centroids: np.ndarray, groups: Groups) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper bound, lower bounds by group) from all distances."""
    d = squared(x, centroids)
    cluster = d.argmin(axis=1)
    rows = np.arange(len(x))
    roots = _root(d)
    upper = _high(roots[rows, cluster])
    roots[rows, cluster] = np.inf
    return cluster.astype(np.int32), upper, _low(groups.least(roots))


def again(x: np.ndarray, centroids: np.ndarray, moved: np.ndarray, groups: Groups, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray):
    """(cluster, upper, lower, number of distances computed) after the centroids have moved by `moved`."""
    most = np.array([moved[m].max() for m in groups.members])
    was = lower.astype(np.float64)
    cluster, upper, low = cluster.copy(), upper.astype(np.float64) + moved[cluster], was - most
    n = 0
    rows = np.flatnonzero(upper * (1 + _SLACK) >= low.min(axis=1))  # the global filter
    if len(rows):
        own = _own(x[rows], centroids[cluster[rows]])
        n += len(rows)
        upper[rows] = _root(own)
        near = upper[rows] * (1 + _SLACK) >= low[rows].min(axis=1)  # and once more with the exact distance
        rows, own = rows[near], own[near]
    if len(rows):
        u, at, mine = upper[rows] * (1 + _SLACK), np.arange(len(rows)), cluster[rows]
        scan = low[rows] <= u[:, None]  # the group filter
        each = was[rows][:, groups.of] - moved  # the bound of each centroid by its own movement
        bounds = np.where(scan[:, groups.of], each, low[rows][:, groups.of])
        exact = np.full((len(rows), len(centroids)), np.inf, dtype=object if own.dtype == object else np.float64)
        whole = np.full((len(rows), len(centroids)), np.iinfo(np.int64).max, dtype=object if own.dtype == object else np.int64)
        for g, members in enumerate(groups.members):
            some = np.flatnonzero(scan[:, g])
            if not len(some):
                continue
            left = members[(each[np.ix_(some, members)] <= u[some, None]).any(axis=0)]  # the local filter
            if len(left):
                d = squared(x[rows[some]], centroids[left])
                n += d.size
                whole[np.ix_(some, left)] = d if d.dtype == whole.dtype else d.astype(whole.dtype)
                exact[np.ix_(some, left)] = _root(d)
        whole[at, mine] = own
        exact[at, mine] = _root(own)
        best = whole.argmin(axis=1)
        known = exact.astype(np.float64)
        bounds = np.where(np.isfinite(known), known, bounds)
        upper[rows] = known[at, best]
        bounds[at, best] = np.inf
        low[rows] = groups.least(bounds)
        cluster[rows] = best
    return cluster, _high(upper), _low(low), n


def _packed_rows(batch: pa.RecordBatch, scale: int) -> tuple[pa.Array, np.ndarray]:
    x = np.floor(scale * _matrix(batch.column(1)))
    most = np.abs(x).max(initial=0)
    if most >= 2**31:
        raise ValueError("a component of 2**31 or more")
    return batch.column(0), x.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 - 1 else np.int64)


def _sums(held: dict[int, list], k: int, width: int) -> pa.Array:
    flat = [Decimal(int(v)) for c in range(k) for v in held.get(c, [0] * width)]
    return pa.array([flat], pa.list_(pa.decimal128(38, 0)))


def _add(held: dict[int, list], x: np.ndarray, cluster: np.ndarray, distance: np.ndarray | None) -> None:
    order = np.argsort(cluster, kind="stable")
    present, starts = np.unique(cluster[order], return_index=True)
    parts = np.add.reduceat(x[order].astype(np.int64), starts, axis=0)
    ends = np.append(starts[1:], len(cluster))
    for c, part, low, high in zip(present.tolist(), parts, starts, ends):
        far = 0 if distance is None else sum(distance[order[low:high]].tolist())
        new = [*part.tolist(), int(high - low), far]
        held[c] = [a + b for a, b in zip(held[c], new)] if c in held else new


def _pass(source: DataFrame, centroids: np.ndarray, moved: np.ndarray | None, groups: Groups, scale: int, last: bool) -> DataFrame:
    """Blocks with new clusters and bounds, and one row of sums for each task; from rows (vec_id, v) if nothing has moved yet."""
    k, width = centroids.shape[0], centroids.shape[1] + 2
    columns = ["ids", "kind", "x", "cluster", "upper", "lower", "distance", "sums"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for i in range(1 if moved is None else batch.num_rows):
                if moved is None:
                    if not batch.num_rows:
                        continue
                    ids, x = _packed_rows(batch, scale)
                    cluster, upper, lower = first(x, centroids, groups)
                else:
                    row = {name: batch.column(j)[i] for j, name in enumerate(batch.schema.names)}
                    ids, x = row["ids"].values, np.frombuffer(row["x"].as_buffer(), row["kind"].as_py()).reshape(-1, width - 2)
                    cluster = np.frombuffer(row["cluster"].as_buffer(), np.int32)
                    upper = np.frombuffer(row["upper"].as_buffer(), np.float32)
                    lower = np.frombuffer(row["lower"].as_buffer(), np.float32).reshape(len(x), -1)
                    cluster, upper, lower, _ = again(x, centroids, moved, groups, cluster, upper, lower)
                distance = None
                if last:
                    distance = _own(x, centroids[cluster])
                    if distance.max() >= 2**63:
                        raise ValueError("a squared distance beyond 64 bits")
                    distance = distance.astype(np.int64)
                _add(held, x, cluster, distance)
                listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.cast(pa.int64()))
                data = [None if a is None else np.ascontiguousarray(a).tobytes() for a in (x, cluster.astype(np.int32), upper, lower, distance)]
                yield pa.RecordBatch.from_arrays(
                    [listed, pa.array([x.dtype.str]), *[pa.array([d], pa.binary()) for d in data], pa.nulls(1, pa.list_(pa.decimal128(38, 0)))], columns
                )
        if held:
            empty = [pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.string()), *[pa.nulls(1, pa.binary())] * 5]
            yield pa.RecordBatch.from_arrays([*empty, _sums(held, k, width)], columns)

    return checkpoint(source.mapInArrow(run, _BLOCK))


def _totals(blocks: DataFrame, k: int, width: int) -> list[list[int]]:
    """Sums of components, number and sum of distances for each centroid."""
    parts = blocks.where("sums is not null").select(F.posexplode("sums").alias("pos", "v")).groupBy("pos").agg(F.sum("v").cast("decimal(38,0)").alias("v"))
    out = [[0] * width for _ in range(k)]
    for r in parts.collect():
        out[r["pos"] // width][r["pos"] % width] = int(r["v"])
    return out


def cluster(
    vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, seed: int = SEED, per_group: int = PER_GROUP
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every row that takes part.

    Centroids start as the k rows with the smallest sha256 of `seed:id`; equal ids are taken by their vectors.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where((F.size("v") == components) & finite(F.col("v")))
    by = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    begun = rows.orderBy(by.asc_nulls_last(), "v").limit(k).select("v").collect()
    spark = rows.sparkSession
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not begun:
        return spark.createDataFrame([], schema)
    start = np.floor(scale * np.array([r["v"] for r in begun]))
    if np.abs(start).max() >= 2**31:
        raise ValueError("a component of 2**31 or more")
    centroids = start.astype(np.int64)
    k, width, groups = len(centroids), components + 2, Groups(centroids, per_group)
    blocks, moved = _pass(rows, centroids, None, groups, scale, rounds == 0), None
    for i in range(rounds):
        new = np.array([[s // t[-2] for s in t[:-2]] if t[-2] else c.tolist() for t, c in zip(_totals(blocks, k, width), centroids)], dtype=np.int64)
        moved, centroids = _root(_own(new, centroids)), new
        still = not moved.any()
        blocks = _pass(blocks.where("sums is null"), centroids, moved, groups, scale, still or i + 1 == rounds)
        if still:
            break
    totals = _totals(blocks, k, width)
    known = [(c, totals[c][-1], sum(t[-1] for t in totals), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c in range(k)]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, c, d in zip(*batch.columns):
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(np.frombuffer(c.as_buffer(), np.int32)), pa.array(np.frombuffer(d.as_buffer(), np.int64))], ["vec_id", "cluster", "distance"])

    placed = blocks.where("sums is null").select("ids", "cluster", "distance").mapInArrow(unpack, "vec_id long, cluster int, distance long")
    table = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
