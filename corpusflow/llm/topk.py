"""Exact top-k inner products of integer vectors by block-at-a-time pruning.

A component is a term, its value the term's impact. Rows of a shard are put in an order that brings like rows together (by
their nearest of some pivot rows), cut into blocks, and each block keeps every term's maximum and minimum. A query takes
blocks by falling bounds, the sum of its weight times the maximum (the minimum for negative weights), scores a block through
its forward index, the rows' components side by side, and stops when a bound falls below its k-th score. A bound that
equals the k-th score is still scored, as ties go to the smaller id; so the result is exact whatever the order of rows.

Edge cases: vectors that are null, empty or hold a null or non-finite component, or whose id is null, take no part; a vector of
another length than the query's is no candidate; repeated rows are candidates each, but all rows of the query's id count
as its own, and of several the one with the least vector asks; fewer candidates than k give fewer rows. Scores beyond 64 bits raise an error.

On vectors without clusters no block's bound falls below the k-th score, and all blocks are scored: exact, but no faster than a scan. Rows that
lie in clusters are put in blocks of their own, and most blocks are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ._shards import search, usable

SCALE, EVERY, K, PER_SHARD, BLOCK = 1024, 100, 10, 32_768, 64


def _kind(a: np.ndarray, b: np.ndarray) -> type:
    """The fastest type in which no sum of products of these whole numbers rounds or overflows."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[-1])
    return np.float64 if most < 2.0**53 else np.int64 if most < 2.0**63 else object


def _cast(x: np.ndarray, kind: type) -> np.ndarray:
    return np.frompyfunc(int, 1, 1)(x) if kind is object else x.astype(kind, copy=False)


def build(ids: np.ndarray, rows: np.ndarray):
    whole = np.floor(SCALE * rows)
    if np.abs(whole).max(initial=0) < 2**52:
        pivots = whole[:: max(1, len(whole) // 256)][:256]
        order = np.lexsort((ids, np.argmax(whole @ pivots.T, axis=1)))
    else:
        order = np.argsort(ids, kind="stable")
    ids, whole = ids[order], whole[order]
    starts = np.arange(0, len(ids), BLOCK)
    return ids, whole, np.maximum.reduceat(whole, starts), np.minimum.reduceat(whole, starts)


def find(index, queries: np.ndarray, vectors: np.ndarray, k: int = K):
    ids, whole, most, least = index
    asked = np.floor(SCALE * vectors)
    kind = _kind(whole, asked)
    rows, high, low = _cast(whole, kind), _cast(most, kind), _cast(least, kind)
    for q, v in zip(queries, _cast(asked, kind)):
        bound = high @ np.maximum(v, 0) + low @ np.minimum(v, 0)
        best_score, best_id = np.empty(0, kind), np.empty(0, np.int64)
        for b in np.argsort(-bound, kind="stable"):
            if len(best_id) == k and bound[b] < best_score[-1]:
                break
            at = slice(b * BLOCK, (b + 1) * BLOCK)
            got, here = rows[at] @ v, ids[at]
            use = here != q
            if len(best_id) == k:
                use &= got >= best_score[-1]
            if not use.any():
                continue
            score, who = np.concatenate([best_score, got[use]]), np.concatenate([best_id, here[use]])
            order = np.lexsort((who, -score))[:k] if kind is not object else sorted(range(len(who)), key=lambda i: (-score[i], who[i]))[:k]
            best_score, best_id = score[order], who[order]
        yield q, best_id, best_score.astype(np.int64)


def scored(index, vectors: np.ndarray, k: int = K) -> float:
    """The share of blocks whose bound reaches the k-th score, that is of those that find() scores."""
    _, whole, most, least = index
    share = []
    for v in np.floor(SCALE * vectors):
        bound, score = most @ np.maximum(v, 0) + least @ np.minimum(v, 0), np.sort(whole @ v)
        share.append(np.mean(bound >= score[-min(k, len(score))]))
    return float(np.mean(share))


def top(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", every: int = EVERY, k: int = K, per_shard: int = PER_SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score) of every row whose id is divisible by `every`, against all rows but itself."""
    return search(usable(vectors, id_col, vector), every, k, per_shard, build, lambda i, q, v: find(i, q, v, k), "long")
