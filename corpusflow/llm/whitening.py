"""Embedding whitening by matrix-free block subspace iteration.

A component c becomes the whole number x = floor(SCALE * c) + SHIFT. The fit list holds each different vector once; it is packed in blocks and kept
in the checkpoint folder, so vectors are shuffled once, in as many parts as its size needs, as each pass runs a task on each of them. A pass over the blocks computes Z = X'(XQ) on rows centred before they are multiplied, for a block Q
of k orthonormal columns; the covariance itself is never formed. The driver keeps a space S of BLOCK * k columns at most with its images Z: Rayleigh-Ritz on S'Z
gives eigenpairs, ZW - SWL their residuals; the best Ritz vectors stay, and the residuals, made orthonormal to them by QR, are the next Q. As the space holds
earlier blocks, a spectrum that is flat or far from zero needs few more passes than another. The iteration ends when the residuals of all k components
are below TOLERANCE times the largest eigenvalue, or when S spans everything, which vectors of more than BLOCK * k components never come to. A last pass whitens the fit list and
measures how far its covariance is from the identity.

Parts of sums are added by entry of Z, as a grouping of Spark's own, so nothing holds the parts of all tasks. Sums of x are whole numbers.

Edge cases: vectors that are null, empty, or hold a null or non-finite entry take no part, nor do those of another length than the commonest (of equally
common ones the longest); null and repeated ids are treated row by row; a direction in which the fit list does not vary has no unit variance and is no component, so a
list of one vector, or none, gives no rows; `deviation` is null where it does not fit in 64 bits; an entry whose x leaves 2**52 raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpoint
from ._shards import _matrix
from .yinyang import finite

K, SCALE, SHIFT, BLOCK = 16, 64, 1_000_000, 3
TOLERANCE, PASSES, SEED, NO_VARIANCE = 1e-13, 1000, 13, 1e-12
#: Entries of vectors that a part of the fit list is worth.
ENTRIES = 1 << 20


def whole(column: pa.Array, scale: int) -> np.ndarray:
    """x - SHIFT of each entry."""
    x = np.floor(scale * _matrix(column))
    if np.abs(x).max(initial=0) >= 2.0**52:
        raise ValueError("an entry beyond 2**52")
    return x.astype(np.int64)


def _codes(x: np.ndarray) -> list[bytes]:
    """Each row in the fewest bytes an entry; equal rows have equal codes."""
    most = np.abs(x).max(axis=1)
    out = [b""] * len(x)
    for kind, low, high in (("<i1", -1, 2**7), ("<i2", 2**7, 2**15), ("<i4", 2**15, 2**31), ("<i8", 2**31, 2**62)):
        at = np.flatnonzero((most >= low) & (most < high))
        data = x[at].astype(kind)
        for i, row in zip(at.tolist(), data):
            out[i] = row.tobytes()
    return out


def _rows(codes: pa.Array, d: int) -> np.ndarray:
    out = np.empty((len(codes), d), dtype=np.int64)
    size = np.array([len(c.as_buffer()) for c in codes]) // d
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        out[at] = np.frombuffer(b"".join(codes[i].as_py() for i in at.tolist()), f"<i{n}").reshape(len(at), d)
    return out


def _smallest(x: np.ndarray) -> np.ndarray:
    most = np.abs(x).max(initial=0)
    return x.astype("<i1" if most < 2**7 else "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<i8")


def fit_list(rows: DataFrame, d: int, scale: int, parts: int | None = None) -> DataFrame:
    """(kind, x): blocks of the different vectors of rows (v), in `parts` partitions at most."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_codes(whole(batch.column(0), scale)), pa.binary())], ["code"])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _smallest(_rows(batch.column(0), d))
                yield pa.RecordBatch.from_arrays([pa.array([x.dtype.str]), pa.array([x.tobytes()], pa.binary())], ["kind", "x"])

    codes = rows.select("v").mapInArrow(code, "code binary").distinct()
    return checkpoint((codes.coalesce(parts) if parts else codes).mapInArrow(block, "kind string, x binary"))


def _each(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for kind, x in zip(batch.column(0), batch.column(1)):
            yield np.frombuffer(x.as_buffer(), kind.as_py()).reshape(-1, d).astype(np.int64)


def sums(blocks: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension's x - SHIFT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (d + 1)
        for x in _each(batches, d):
            part = x.sum(axis=0) if int(np.abs(x).max(initial=0)) * len(x) < 2**62 else x.astype(object).sum(axis=0)
            total = [a + b for a, b in zip(total, [*part.tolist(), len(x)])]
        yield pa.RecordBatch.from_arrays([pa.array([list(map(Decimal, total))], pa.list_(pa.decimal128(38, 0)))], ["s"])

    parts = blocks.mapInArrow(run, "s array<decimal(38,0)>").select(F.posexplode("s").alias("pos", "s")).groupBy("pos").agg(F.sum("s").cast("decimal(38,0)").alias("s"))
    found = {r["pos"]: int(r["s"]) for r in parts.collect()}
    return found.get(d, 0), [found.get(i, 0) for i in range(d)]


def _summed(blocks: DataFrame, d: int, make) -> np.ndarray:
    """The sum over all blocks of make(x), a matrix, added up by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _each(batches, d):
            part = make(x)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    entries = blocks.mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x"))
    found = entries.groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    total = np.empty((found["i"].max() + 1, found["j"].max() + 1))
    total[found["i"], found["j"]] = found["x"]
    return total


def components(blocks: DataFrame, d: int, n: int, mean: np.ndarray, k: int = K, block: int = BLOCK, tolerance: float = TOLERANCE, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(eigenvalues, eigenvectors by column, trace, passes) of the covariance: the k largest, without those of no variance."""
    k = min(k, d)
    new = np.linalg.qr(np.random.default_rng(SEED).normal(size=(d, k)))[0]
    space, images = np.empty((d, 0)), np.empty((d, 0))
    for i in range(1, passes + 1):

        def product(x: np.ndarray, q: np.ndarray = new) -> np.ndarray:
            y = x - mean
            z = y.T @ (y @ q)
            return np.vstack([z, np.full((1, z.shape[1]), (y * y).sum())])

        z = _summed(blocks, d, product) / n
        trace = float(z[d, 0])
        space, images = np.hstack([space, new]), np.hstack([images, z[:d]])
        values, turn = np.linalg.eigh((space.T @ images + images.T @ space) / 2)
        values, space, images = values[::-1], space @ turn[:, ::-1], images @ turn[:, ::-1]
        left = images[:, :k] - space[:, :k] * values[:k]
        sizes = np.linalg.norm(left, axis=0)
        if sizes.max(initial=0.0) <= tolerance * max(values[0], 0.0):
            break
        if space.shape[1] == d:  # the whole space: what is left is rounding
            break
        room = min(space.shape[1], max(block - 1, 1) * k)
        space, images = space[:, :room], images[:, :room]
        # QR gives orthonormal columns also where a residual is nothing, then any direction
        new = np.linalg.qr(np.hstack([space, left / np.maximum(sizes, 1e-300)]))[0][:, room : min(room + k, d)]
    else:
        raise ValueError(f"residuals above {tolerance} after {passes} passes")
    values, vectors = values[:k], space[:, :k]
    varied = values > NO_VARIANCE * max(values[0], 0.0)
    values, vectors = values[varied], vectors[:, varied]
    vectors = vectors / np.linalg.norm(vectors, axis=0)
    return values, vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))] < 0, -1.0, 1.0), trace, i


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE, shift: int = SHIFT, block: int = BLOCK) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row that takes part and each component."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where((F.size("v") > 0) & finite(F.col("v")))
    spark = rows.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    d = common["d"]
    rows = rows.where(F.size("v") == d)
    blocks = fit_list(rows, d, scale, -(-common["count"] * d // ENTRIES))
    n, s = sums(blocks, d)  # of x - shift, which changes neither n*x - S nor what is centred
    mean = np.array([a / n for a in s])
    values, axes, trace, _ = components(blocks, d, n, mean, k, block)
    if not len(values):
        return spark.createDataFrame([], schema)
    turn = axes / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ turn
        return np.vstack([w.T @ w, w.sum(axis=0)])

    m = _summed(blocks, d, moments) / n
    error = float(np.abs(m[:-1] - np.outer(m[-1], m[-1]) - np.eye(len(values))).max())
    explained, largest = values / trace, max(map(abs, s))

    def deviations(x: np.ndarray) -> pa.Array:
        reach = n * int(np.abs(x).max(initial=0)) + largest
        kind = np.int64 if reach < 2**62 and d * reach * reach < 2**63 else object
        apart = x.astype(kind) * n - np.array(s, dtype=kind)
        found = (apart * apart).sum(axis=1)
        return pa.array([v if v < 2**63 else None for v in found.tolist()], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = len(values)
        for batch in batches:
            if batch.num_rows:
                x, at = whole(batch.column(1), scale), np.repeat(np.arange(batch.num_rows), r)
                flat = lambda a, x=x: pa.array(np.tile(a, len(x)))
                columns = [batch.column(0).take(pa.array(at)), flat(np.arange(1, r + 1, dtype=np.int32)), pa.array(np.full(len(at), n)), deviations(x).take(pa.array(at))]
                columns += [pa.array(((x - mean) @ turn).ravel()), flat(explained), pa.array(np.full(len(at), error))]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return rows.mapInArrow(run, schema)
