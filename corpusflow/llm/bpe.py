"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves every pre-token that is itself a vocabulary entry. Tier two:
other pre-tokens are merged with a heap of neighbouring pairs over a doubly linked list of bytes, lowest rank first, leftmost
among equals, so a pre-token of n bytes takes O(n log n). Both tiers are asked once per different pre-token and batch of
memory: answers are kept in a bounded memo.

Edge cases: a null or empty text has no tokens and decodes to no bytes; a text of any length is cut only between a letter and
a blank before a letter, where no pre-token crosses, so memory follows a megabyte of text and its longest pre-token.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ._common import kept_in_worker

_CHUNK = 1 << 20
#: Pre-tokens whose ids a worker keeps, some 80 MB; those of the vocabulary stay when it is full.
_MEMO = 400_000
#: Bytes of ids after which a batch is handed over.
_PART = 8 << 20
_MASK = (1 << 64) - 1


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank of a file of base64 tokens and ranks; read on the driver only."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    tokens = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(tokens) != list(range(len(tokens))):
        raise ValueError("ranks must run from 0 without a gap")
    return [tokens[i] for i in range(len(tokens))]


def build_hash(tokens: list[bytes], per_bucket: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """A minimal perfect hash (displacements by bucket, rank by slot): hash and displace, largest buckets first.

    A bucket of one key points at its slot directly, by a negative displacement.
    """
    n, buckets = len(tokens), max(1, len(tokens) // per_bucket)
    groups: list[list[tuple[int, int]]] = [[] for _ in range(buckets)]
    for rank, token in enumerate(tokens):
        h = xxhash.xxh64_intdigest(token)
        groups[h % buckets].append((h, rank))
    moves, slots = np.zeros(buckets, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    order = sorted(range(buckets), key=lambda b: -len(groups[b]))
    free: list[int] | None = None
    for b in order:
        keys = groups[b]
        if not keys:
            break
        if len(keys) == 1:
            if free is None:
                free = np.flatnonzero(slots < 0).tolist()
            at = free.pop()
            moves[b], slots[at] = -at - 1, keys[0][1]
            continue
        move = 0
        while True:
            places = [_place(h, move, n) for h, _ in keys]
            if len(set(places)) == len(places) and all(slots[p] < 0 for p in places):
                break
            move += 1
        moves[b] = move
        for p, (_, rank) in zip(places, keys):
            slots[p] = rank
    return moves, slots


def _place(h: int, move: int, n: int) -> int:
    """Slot of a key's hash under a displacement."""
    x = (h ^ (move * 0x9E3779B97F4A7C15)) & _MASK
    x ^= x >> 33
    x = (x * 0xFF51AFD7ED558CCD) & _MASK
    return (x ^ (x >> 33)) % n


def _places(h: np.ndarray, move: np.ndarray, n: int) -> np.ndarray:
    x = h ^ (move.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    return ((x ^ (x >> np.uint64(33))) % np.uint64(n)).astype(np.int64)


def merge(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Tier two. Stale heap entries are told by the ends they were made for."""
    n = len(token)
    if n < 2:
        return [ranks[token]] if n else []
    stop, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the piece that starts at i: where it ends, where the one before starts
    get = ranks.get
    heap = []
    for i in range(n - 1):
        r = get(token[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        r, i, end = pop(heap)
        mid = stop[i]
        if mid <= 0 or mid >= end or stop[mid] != end:
            continue
        stop[i], stop[mid] = end, -1
        if end < n:
            before[end] = i
            r = get(token[i : stop[end]])
            if r is not None:
                push(heap, (r, i, stop[end]))
        p = before[i]
        if p >= 0:
            r = get(token[p:end])
            if r is not None:
                push(heap, (r, p, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[token[i : stop[i]]])
        i = stop[i]
    return out


class Codec:
    """Encoder and decoder over the tokens of a vocabulary; one per worker."""

    def __init__(self, tokens: list[bytes], moves: np.ndarray, slots: np.ndarray, pattern: str):
        self.tokens, self.moves, self.slots = tokens, moves, slots
        self.ranks = {t: i for i, t in enumerate(tokens)}  # of merged pairs in tier two
        self.split = regex.compile(pattern).findall
        self.cut = regex.compile(r"(?<=\p{L})(?= \p{L})").search
        self.memo: dict[str, bytes] = {}

    def _resolve(self, words: list[str]) -> None:
        """The hash settles the pre-tokens that are in the vocabulary, merging the others."""
        keys = [w.encode("utf-8", "surrogatepass") for w in words]
        h = np.array([xxhash.xxh64_intdigest(k) for k in keys], dtype=np.uint64)
        move = self.moves[(h % np.uint64(len(self.moves))).astype(np.int64)]
        found = self.slots[np.where(move < 0, -move - 1, _places(h, np.maximum(move, 0), len(self.slots)))].tolist()
        tokens, ranks, memo = self.tokens, self.ranks, self.memo
        for word, key, rank in zip(words, keys, found):
            ids = [rank] if tokens[rank] == key else merge(key, ranks)
            memo[word] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids, as little-endian unsigned 32-bit integers, of a megabyte of the text after the other."""
        start, end = 0, len(text)
        while start < end:
            at = self.cut(text, start + _CHUNK) if end - start > _CHUNK else None
            stop = at.start() if at else end
            words = self.split(text, start, stop)
            new = set(words).difference(self.memo)
            if new:
                if len(self.memo) + len(new) > _MEMO:
                    self.memo = {w: ids for w, ids in self.memo.items() if len(ids) == 4}
                    new = set(words).difference(self.memo)
                self._resolve(list(new))
            yield b"".join(map(self.memo.__getitem__, words))
            start = stop

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _codec(spark: SparkSession, tokens: list[bytes], pattern: str):
    """A function that gives a worker its codec: made at its first use in a process, then kept for tasks of the same vocabulary."""
    key = f"{hashlib.sha256(b' '.join(map(base64.b64encode, tokens))).hexdigest()}:{pattern}"
    sent = spark.sparkContext.broadcast((tokens, *build_hash(tokens), pattern))  # a vocabulary's size, whatever the input

    def get() -> Codec:
        return kept_in_worker("bpe", key, lambda _: Codec(*sent.value))

    return get


def _lists(ends: list[int], ids: bytearray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(ids)]))


def encode(text: Column, spark: SparkSession, tokens: list[bytes], pattern: str) -> Column:
    """array<int> of the ids of a text."""
    get = _codec(spark, tokens, pattern)

    @F.arrow_udf("array<int>")
    def ids(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = get()
        for batch in texts:
            ends, out = [0], bytearray()
            for text in batch:
                for part in codec.encode(text.as_py() or ""):
                    out += part
                ends.append(len(out) // 4)
                if len(out) >= _PART:
                    yield _lists(ends, out)
                    ends, out = [0], bytearray()
            if len(ends) > 1:
                yield _lists(ends, out)

    return ids(text)


def decode(ids: Column, spark: SparkSession, tokens: list[bytes]) -> Column:
    """The bytes of an array of ids, as binary; null for null."""
    sent = spark.sparkContext.broadcast(tokens)

    @F.arrow_udf("binary")
    def data(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = sent.value
        for batch in batches:
            yield pa.array([None if x is None else b"".join(map(tokens.__getitem__, x)) for x in (v.as_py() for v in batch)], pa.binary())

    return data(ids)


def round_trip(text: Column, spark: SparkSession, tokens: list[bytes], pattern: str) -> Column:
    """struct<n_tokens, ids_sha256, decoded_sha256, round_trip>: digests of what encoding gives and of what decoding that gives."""
    get = _codec(spark, tokens, pattern)

    @F.arrow_udf("struct<n_tokens: long, ids_sha256: string, decoded_sha256: string, round_trip: boolean>")
    def digests(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = get()
        for batch in texts:
            rows = []
            for text in batch:
                text, n, ids, data = text.as_py() or "", 0, hashlib.sha256(), hashlib.sha256()
                for part in codec.encode(text):
                    n += len(part) // 4
                    ids.update(part)
                    data.update(codec.decode(part))
                rows.append((n, ids.hexdigest(), data.hexdigest(), data.digest() == hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()))
            columns = list(zip(*rows)) or [(), (), (), ()]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_())
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])

    return digests(text)
