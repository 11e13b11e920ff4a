"""Approximate nearest neighbours by multi-index hashing, for the largest inner product.

fit() learns, from SAMPLE vectors at most (those with the smallest hashes; a documented bound), a rotation for binary
codes by iterative quantisation, and the Hamming radius that holds the share RECALL of the sample's own k nearest. Every row is indexed: a
shard cuts its codes into substrings and keeps a table of rows for each. By the pigeonhole principle a code within the
radius r = m*s + a differs by s bits at most in one of the first a + 1 of m substrings, or by s - 1 in one of the others, so
probing these neighbours of each substring retrieves every code within the radius. What passes the whole distance is ranked by the
inner product of the original vectors in double precision; if fewer than k pass, the whole shard is ranked.

A shard's k best join those of the others, so recall stays the same whatever the number of rows, as a shard's size is fixed.

Edge cases: vectors that are null, empty, zero or hold a null or non-finite component, or whose id is null, take no part; a
vector of another length than the query's is no candidate; all rows of the query's id count as its own, and of several the one with the least
vector asks; ties go to the smaller id.

On vectors without clusters probing can't rule much out: where the k-th neighbour's cosine is 0.36, the radius that keeps the recall is nearly half
of the bits, and the substrings' neighbours at that radius meet nearly every row. within() then saves the float ranking of what the codes rule out.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shards import search, usable

EVERY, K, PER_SHARD = 20, 20, 16_384
SAMPLE, RECALL, ROUNDS, SEED, SUBSTRING = 8192, 0.97, 30, 11, 8


def _bits(x: np.ndarray) -> np.ndarray:
    """Rows of bytes; one byte is one substring."""
    return np.packbits(x > 0, axis=1)


def _distance(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(axis=1, dtype=np.int32)


def rotation(sample: np.ndarray) -> np.ndarray:
    """Principal directions, then the rotation that brings the sample closest to its own signs."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    _, vectors = np.linalg.eigh(unit.T @ unit)
    base = unit @ vectors
    turn, _ = np.linalg.qr(np.random.default_rng(SEED).normal(size=(base.shape[1],) * 2))
    for _ in range(ROUNDS):
        left, _, right = np.linalg.svd(base.T @ np.where(base @ turn > 0, 1.0, -1.0))
        turn = left @ right
    return vectors @ turn


def fit(rows: DataFrame, k: int = K, sample: int = SAMPLE, recall: float = RECALL) -> dict[int, tuple[np.ndarray, int]]:
    """The rotation and the radius for each length of vectors in the sample."""
    taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).select("v").collect()
    model = {}
    for d in {len(r["v"]) for r in taken}:
        x = np.array([r["v"] for r in taken if len(r["v"]) == d])
        turn = rotation(x)
        codes, asked = _bits(x @ turn), min(len(x), 256)
        score = x[:asked] @ x.T
        score[np.arange(asked), np.arange(asked)] = -np.inf
        best = np.argsort(-score, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
        apart = np.concatenate([_distance(codes[b], codes[i]) for i, b in enumerate(best)] or [np.zeros(0, np.int32)])
        model[d] = turn, int(np.ceil(np.quantile(apart, recall))) if len(apart) else d
    return model


def masks(within: int) -> np.ndarray:
    """All bytes of `within` set bits at most."""
    return np.array([sum(1 << i for i in c) for n in range(within + 1) for c in combinations(range(SUBSTRING), n)], dtype=np.uint8)


def build(ids: np.ndarray, rows: np.ndarray, model: dict):
    turn, radius = model.get(rows.shape[1]) or (np.eye(rows.shape[1]), rows.shape[1])
    codes = _bits(rows @ turn)
    tables = []
    for j in range(codes.shape[1]):
        order = np.argsort(codes[:, j], kind="stable")
        tables.append((order, np.searchsorted(codes[order, j], np.arange(257))))
    s, a = divmod(radius, len(tables))
    return ids, rows, turn, radius, codes, tables, [masks(min(SUBSTRING, s if j <= a else s - 1)) if s or j <= a else None for j in range(len(tables))]


def within(index, code: np.ndarray) -> np.ndarray:
    """Rows of every code within the radius."""
    _, _, _, radius, codes, tables, probes = index
    seen = np.zeros(len(codes), dtype=bool)
    for (order, start), flips, byte in zip(tables, probes, code):
        if flips is None:
            continue
        keys = (flips ^ byte).astype(np.int64)
        low, n = start[keys], start[keys + 1] - start[keys]
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        seen[order[at]] = True
    found = np.flatnonzero(seen)
    return found[_distance(codes[found], code) <= radius]


def find(index, queries: np.ndarray, vectors: np.ndarray, k: int = K):
    ids, rows, turn = index[:3]
    for q, v, code in zip(queries, vectors, _bits(vectors @ turn)):
        at = within(index, code)
        at = at[ids[at] != q]
        if len(at) < k:
            at = np.flatnonzero(ids != q)
        score = rows[at] @ v
        if len(at) > 4 * k:  # only those that reach the k-th score are sorted
            least = np.partition(score, len(score) - k)[len(score) - k]
            at, score = at[score >= least], score[score >= least]
        order = np.lexsort((ids[at], -score))[:k]
        yield q, ids[at[order]], score[order]


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", every: int = EVERY, k: int = K, per_shard: int = PER_SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score) of every row whose id is divisible by `every`, against all rows but its own."""
    rows = usable(vectors, id_col, vector).where(F.exists("v", lambda x: x != 0))
    model = fit(rows, k)
    return search(rows, every, k, per_shard, lambda i, x: build(i, x, model), lambda i, q, v: find(i, q, v, k), "double")
