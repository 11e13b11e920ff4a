"""Near-duplicates by 64-bit SimHash fingerprints within a small Hamming distance.

Words are runs of characters other than ASCII white space, A-Z in lower case; shingles are runs of words joined by a space,
repeats included; a text with fewer words is one shingle, one without words has fingerprint 0. A bit is set if it is set in
over half of the shingles' XXH64 values.

Search is meet-in-the-middle: each distinct fingerprint emits all values within half the radius; two fingerprints within the
radius share one, and a shared one proves no more than the radius for an even radius (odd radii are verified). A value has
at most as many emitters as its ball has members, so no group is large whatever the data: a million equal copies are one
distinct fingerprint. Within a value's group every member is linked with the smallest, which keeps all that is reachable.

Edge cases: a null text counts as empty, all such rows are one class; rows with a null id keep their row and get the
smallest id of the class, null if no row of the class has an id; repeated rows and ids change nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import added, batches_of, checkpoint, gathered, looked_up, packed
from ._components import components

SHINGLE, SEED, RADIUS = 3, 42, 2
_CHUNK = 1 << 20
#: Bytes of short texts whose shingles are made together, and texts that one batch of marks is made of.
_GROUP, _BATCH = 1 << 17, 512


def _chunks(data: bytes) -> Iterator[bytes]:
    """Pieces of about a megabyte that end between words."""
    start, end = 0, len(data)
    while start < end:
        stop = min(start + _CHUNK, end)
        while stop < end and data[stop] not in b" \t\n\v\f\r":
            stop += 1
        yield data[start:stop]
        start = stop


def _words(data: bytes) -> Iterator[list[bytes]]:
    """The words in lists of about a megabyte; a long text is never split into all its words at once."""
    return (chunk.split() for chunk in _chunks(data))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """As a signed 64-bit number."""
    digest, ones, n, tail = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64), 0, []
    for words in _words((text or "").encode("utf-8", "surrogatepass").lower()):
        words = tail + words
        if len(words) >= shingle:
            if shingle == 3:
                hashes = [digest(b"%b %b %b" % x, SEED) for x in zip(words, words[1:], words[2:])]
            else:
                hashes = [digest(b" ".join(words[i : i + shingle]), SEED) for i in range(len(words) - shingle + 1)]
            bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
            n += len(hashes)
        tail = words[-(shingle - 1) :] if shingle > 1 else []
    if not n:
        if not tail:
            return 0
        ones = np.unpackbits(np.array([digest(b" ".join(tail), SEED)], dtype="<u8").view(np.uint8), bitorder="little").astype(np.int64)
        n = 1
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def simhash(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def ball(fp: Column, radius: int) -> Column:
    """All values within `radius` bits of fp. The masks are constants, 65 for radius 1."""
    masks = [0] + [sum(1 << i for i in c) for r in range(1, radius + 1) for c in combinations(range(64), r)]
    literal = F.lit([m - (1 << 64) if m >> 63 else m for m in masks])
    return F.transform(literal.cast("array<bigint>"), lambda m: fp.bitwiseXOR(m))


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between the distinct fingerprints of column `fp` that join the same classes as all pairs within the radius do."""
    emitted = distinct.select("fp", F.explode(ball(F.col("fp"), (radius + 1) // 2)).alias("variant"))
    if radius % 2 == 0:
        met = emitted.withColumn("b", F.min("fp").over(Window.partitionBy("variant"))).select(F.col("fp").alias("a"), "b")
    else:  # members of a group can be one bit too far apart: each with each, in groups of a ball's size at most
        other = emitted.select(F.col("fp").alias("b"), "variant")
        met = emitted.join(other, "variant").select(F.col("fp").alias("a"), "b")
    return met.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).distinct()


def classes(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, component_id) for each distinct fingerprint of `fingerprints` (doc_id, fp): the smallest doc_id that it reaches."""
    smallest = checkpoint(fingerprints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    joined = components(checkpoint(links(smallest.select("fp"), radius)))
    root = smallest.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    least = root.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = looked_up(joined, least.withColumnRenamed("root", "component"), "component").select(F.col("node").alias("fp"), "component_id")
    return smallest.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs."""
    prints = checkpoint(docs.select(F.col(id_col).alias("doc_id"), simhash(F.col(text)).alias("fp")))
    return looked_up(prints, checkpoint(classes(prints, radius)), "fp").select("doc_id", "fp", "component_id")


# Near copies by the similarity of their sets of five-word shingles, by an exact prefix filter. All shingles have one order, those that
# occur in few texts first. Two sets of a similarity of t share one of the first n - ceil(t * n) + 1 shingles of each in any such order, so
# every pair meets in a bucket, the texts that emit the same shingle. How many texts hold a shingle is counted over all rows, in COUNTERS
# counters by hash; that decides the cost alone. What meets is sifted by sizes, by the shingle's places in both orders and by parity bits,
# all of which only rule out what can't be similar, and then verified by the sets themselves (64-bit hashes of the shingles).

WORDS, SIMILARITY = 5, 0.8
COUNTERS, _SLICES = 1 << 20, 256
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _letters() -> np.ndarray:
    """A random number for each byte, for A-Z those of a-z, 0 for white space."""
    table = np.random.default_rng(WORDS).integers(1, 2**64, 256, dtype=np.uint64)
    table[65:91] = table[97:123]
    table[[9, 10, 11, 12, 13, 32]] = 0
    return table


_LETTERS, _BASE = _letters(), 0x9E3779B97F4A7C17
_POWERS = np.cumprod(np.full(64, _BASE, dtype=np.uint64))


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts, and its hash: the sum of its bytes' numbers, each times a power by its place."""
    global _POWERS
    numbers = _LETTERS[np.frombuffer(data, np.uint8)]
    filled = numbers != 0
    starts = np.flatnonzero(filled & ~np.concatenate(([False], filled[:-1])))
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    place = np.arange(starts[0], len(numbers)) - np.repeat(starts, np.diff(starts, append=len(numbers)))
    if (longest := int(place.max())) >= len(_POWERS):
        _POWERS = np.cumprod(np.full(2 * longest, _BASE, dtype=np.uint64))
    h = np.add.reduceat(numbers[starts[0] :] * _POWERS[place], starts - starts[0])
    return starts, (h ^ (h >> np.uint64(32))) * _STEP


def _runs(h: np.ndarray) -> np.ndarray:
    """A hash of each run of WORDS words."""
    n = max(0, len(h) - WORDS + 1)
    out = h[:n].copy()
    for i in range(1, WORDS):
        out = (out ^ (out >> np.uint64(32))) * _STEP + h[i : n + i]
    return out ^ (out >> np.uint64(29))


def _whole(h: np.ndarray) -> np.ndarray:
    """The one shingle of a text with fewer words; none without words."""
    return np.array([xxhash.xxh64_intdigest(h.tobytes())][: len(h)], dtype=np.uint64)


def _long(data: bytes) -> np.ndarray:
    """The set of one long text, a megabyte after the other."""
    tail, found = np.empty(0, np.uint64), []
    for chunk in _chunks(data):
        h = np.concatenate([tail, _word_hashes(chunk)[1]])
        found.append(np.unique(_runs(h)))
        tail = h[max(0, len(h) - WORDS + 1) :]
    sets_ = np.unique(np.concatenate(found))
    return sets_ if len(sets_) else _whole(tail)


def _short(group: list[bytes]) -> list[np.ndarray]:
    """The sets of several texts, made together."""
    starts, h = _word_hashes(b"\n".join(group))
    ends = np.cumsum([len(d) + 1 for d in group])
    owner = np.searchsorted(ends, starts, side="right")
    runs = _runs(h)
    inside = owner[: len(runs)] == owner[len(owner) - len(runs) :]
    runs, text = runs[inside], owner[: len(runs)][inside]
    order = np.lexsort((runs, text))
    runs, text = runs[order], text[order]
    new = np.ones(len(runs), dtype=bool)
    new[1:] = (runs[1:] != runs[:-1]) | (text[1:] != text[:-1])
    runs, text = runs[new], text[new]
    cuts = np.searchsorted(text, np.arange(len(group) + 1))
    words = np.searchsorted(owner, np.arange(len(group) + 1))
    return [runs[a:b] if a < b else _whole(h[c:d]) for a, b, c, d in zip(cuts, cuts[1:], words, words[1:])]


def sets(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """For each text the ascending distinct hashes of its runs of WORDS words; the whole sequence is one if there are fewer words."""
    group, size = [], 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if size + len(data) > _GROUP:
            yield from _short(group) if group else ()
            group, size = [], 0
        if len(data) > _GROUP:
            yield _long(data)
        else:
            group.append(data)
            size += len(data) + 1
    yield from _short(group) if group else ()


def _digest(text: str | None) -> bytes:
    """Of the word sequence."""
    digest = xxhash.xxh3_128()
    for words in _words((text or "").encode("utf-8", "surrogatepass").lower()):
        if words:
            digest.update(b" ".join(words) + b" ")
    return digest.digest()


def _counter(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int64)


def counted(rows: DataFrame) -> np.ndarray:
    """COUNTERS sums over rows (text): how many texts hold a shingle, and what else falls on its counter. Tasks add up their own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(COUNTERS, np.int64), [], 0
        for batch in batches:
            for h in sets(text.as_py() for text in batch.column(0)):
                held.append(_counter(h))
                size += len(held[-1])
                if size > COUNTERS // 4:
                    total += np.bincount(np.concatenate(held), minlength=COUNTERS)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=COUNTERS)
        slices = list(map(packed, total.reshape(_SLICES, -1)))
        yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array(slices, pa.binary())], ["key", "data"])

    sums = added(rows.select("text").mapInArrow(run, "key int, data binary"))
    return np.concatenate([sums[i] for i in range(_SLICES)]).astype(np.float32) if sums else np.zeros(COUNTERS, np.float32)


def prefix(h: np.ndarray, similarity: float, counts: np.ndarray) -> np.ndarray:
    """The first of the distinct shingles h in the order of their counts, as many as a set of that similarity can't all lack."""
    return h[np.lexsort((h, counts[_counter(h)]))[: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1]]


def parity(h: np.ndarray) -> bytes:
    """Bits, a power of two and no fewer than shingles: whether an odd number of shingles falls on each."""
    n = max(64, 1 << max(0, len(h) - 1).bit_length())
    return np.packbits(np.bincount((h & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1, bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """A number that the shingles in only one of two sets can't be fewer than, from their parity bits."""
    if len(a) < len(b):
        a, b = b, a
    x, n = int.from_bytes(a, "little"), 8 * len(a)
    while n > 8 * len(b):
        n //= 2
        x = (x >> n) ^ (x & ((1 << n) - 1))
    return (x ^ int.from_bytes(b, "little")).bit_count()


def signed(rows: DataFrame, similarity: float, prints: bool = False) -> DataFrame:
    """(doc_id, hash, digest, size, keys, bits, fp) of rows (doc_id, hash, text). A word sequence that a task has met has no keys, bits and fingerprint."""
    sent = rows.sparkSession.sparkContext.broadcast(counted(rows))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = sent.value, set()
        for batch in (x.slice(i, _BATCH) for x in batches for i in range(0, x.num_rows, _BATCH)):
            texts = batch.column(2).to_pylist()
            digests, sizes, keys, bits, fps = list(map(_digest, texts)), [], [], [], []
            for digest, text, h in zip(digests, texts, sets(texts)):
                if digest in seen:
                    sizes.append(None), keys.append(None), bits.append(None), fps.append(None)
                    continue
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add(digest)
                sizes.append(len(h)), keys.append(prefix(h, similarity, counts).view(np.int64)), bits.append(parity(h)), fps.append(fingerprint(text) if prints else None)
            columns = [pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary()), pa.array(fps, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "hash", "digest", "size", "keys", "bits", "fp"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "hash", "text").mapInArrow(run, f"doc_id {kind}, hash long, digest binary, size int, keys array<long>, bits binary, fp long")


def _least_shared(similarity: float, a: Column, b: Column) -> Column:
    """How many shingles two sets of sizes a and b share at least, if they are so similar."""
    return F.lit(similarity / (1 + similarity)) * (a + b) - 1e-9


def _can_be(similarity: float) -> Column:
    """Whether two members (size, pos) of a bucket, of which its shingle is the first that they share, can be so similar."""
    n, m = F.col("size_a"), F.col("size_b")
    left = F.least(n - F.col("pos_a"), m - F.col("pos_b"))
    return (F.least(n, m) >= F.lit(similarity) * F.greatest(n, m) - 1e-9) & (left >= _least_shared(similarity, n, m))


def _side(name: str) -> list[Column]:
    return [F.col(c).alias(f"{c}_{name}") for c in ("node", "size", "pos", "class")]


def stars(buckets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): each member of buckets (key, node, size, pos) with one of its bucket: the node that meets most, as an original does with its variants."""
    weights = buckets.groupBy("node").agg(F.count("*").alias("weight"))
    most = F.max(F.struct("weight", "node", "size", "pos")).over(Window.partitionBy("key"))
    met = buckets.join(weights, "node").withColumn("most", most)
    met = met.select(F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("pos").alias("pos_a"), F.col("most.node").alias("b"), F.col("most.size").alias("size_b"), F.col("most.pos").alias("pos_b"))
    return met.where("a <> b").where(_can_be(similarity)).select("a", "b").distinct()


def others(buckets: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """(a, b): all pairs of a bucket that can be so similar and that classes (node, component) do not hold together.

    Of two sets the smaller has the shingle in its first places (`early`), else it could not be the first that they share; so members
    that have it later, as they share a frequent passage, never pair with each other. Nor does a bucket's largest class with itself, so a
    large group that stars have linked costs nothing.
    """
    by = Window.partitionBy("key")
    held = buckets.join(classes, "node", "left").select("key", "node", "size", "pos", F.coalesce("component", "node").alias("class"))
    split = checkpoint(held.withColumn("low", F.min("class").over(by)).withColumn("high", F.max("class").over(by)).where("low <> high").drop("low", "high"))
    largest = split.groupBy("key", "class").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "class"))["class"].alias("largest"))
    named = split.join(largest, "key")
    early = named.where(F.col("size") - F.col("pos") >= _least_shared(similarity, F.col("size"), F.col("size")))
    fits = (F.col("class_a") != F.col("class_b")) & (F.col("size_a") <= F.col("size_b")) & _can_be(similarity)
    pairs = None
    for x, y in ((early.where("class <> largest"), named), (early.where("class = largest"), named.where("class <> largest"))):
        some = x.select("key", *_side("a")).join(y.select("key", *_side("b")), "key").where(fits).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
        pairs = some if pairs is None else pairs.union(some)
    return pairs.distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, radius: int | None = None) -> DataFrame:
    """(doc_id, hash): of every class of texts that copies and near copies link the row of smallest id (then of smallest hash).

    With a radius, fingerprints within so many bits link as well, as they do in near_duplicates(): the classes are those of both kinds of links.

    `hash` is xxhash64 of the text, so that different texts under one id are told apart. Rows without an id are left out. Equal word
    sequences are one node before anything is compared, so a large group of copies costs one row. The sets of those texts alone that
    met another and passed the sieves are made, and a link needs an exact Jaccard similarity.
    """
    with batches_of(docs.sparkSession, _BATCH):
        return _near_copies(docs, id_col, text, similarity, radius)


def _near_copies(docs: DataFrame, id_col: str, text: str, similarity: float, radius: int | None) -> DataFrame:
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text)).alias("hash"), F.col(text).alias("text"))
    marks = checkpoint(signed(rows, similarity, radius is not None).withColumn("node", F.xxhash64("digest")))
    # the node is a short name of the digest: should two digests share it, both texts are met and compared, but never taken for equal
    reps = checkpoint(marks.groupBy("digest").agg(F.min("node").alias("node"), F.min(F.struct("doc_id", "hash")).alias("rep"), F.min("fp").alias("fp")))
    emitted = marks.where("keys is not null").select("node", "size", F.posexplode("keys").alias("pos", "key"))
    by = Window.partitionBy("key")
    met = emitted.withColumn("low", F.min("node").over(by)).withColumn("high", F.max("node").over(by)).where("low <> high")
    buckets = checkpoint(met.groupBy("key", "node", "size").agg(F.min("pos").alias("pos")))
    bits = checkpoint(marks.where("bits is not null").join(buckets.select("node").distinct(), "node", "left_semi").dropDuplicates(["digest"]).select("node", "digest", "size", "bits"))

    @F.pandas_udf("int")
    def least_apart(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([apart(x, y) for x, y in zip(a, b)], dtype="int32")

    def alike(pairs: DataFrame) -> DataFrame:
        """(a, b) as digests, those of pairs (a, b) of nodes that are so similar."""
        pairs = gathered(pairs)
        sides = [bits.select(F.col("node").alias(s), F.struct("digest", "size", "bits").alias(f"x{s}")) for s in "ab"]
        both = looked_up(looked_up(pairs, sides[0], "a"), sides[1], "b", pairs)
        both = both.where(F.col("xa.size") + F.col("xb.size") - least_apart("xa.bits", "xb.bits") >= 2 * _least_shared(similarity, F.col("xa.size"), F.col("xb.size")))
        sifted = gathered(checkpoint(both.select(F.col("xa.digest").alias("a"), F.col("xb.digest").alias("b"))))
        wanted = sifted.select(F.explode(F.array("a", "b")).alias("digest")).distinct().join(reps, "digest").select("digest", "rep.*")
        whole = checkpoint(rows.join(wanted, ["doc_id", "hash"]).dropDuplicates(["digest"]).select("digest", shingle_set("text").alias("set")))
        one = looked_up(sifted, whole.select(F.col("digest").alias("a"), F.col("set").alias("set_a")), "a")
        two = looked_up(one, whole.select(F.col("digest").alias("b"), F.col("set").alias("set_b")), "b", sifted)
        same = F.size(F.array_intersect("set_a", "set_b"))
        return checkpoint(two.where(same >= F.lit(similarity) * (F.size("set_a") + F.size("set_b") - same) - 1e-9).select("a", "b"))

    linked = alike(checkpoint(stars(buckets, similarity)))
    if radius is not None:  # each word sequence with the smallest one of its fingerprint, and those with each other that links() joins
        smallest = checkpoint(reps.groupBy("fp").agg(F.min("digest").alias("smallest")))
        same = looked_up(reps.select("digest", "fp"), smallest, "fp").where("digest <> smallest").select(F.col("digest").alias("a"), F.col("smallest").alias("b"))
        a, b = (smallest.select(F.col("fp").alias(s), F.col("smallest").alias(f"x{s}")) for s in "ab")
        near = gathered(checkpoint(links(smallest.select("fp"), radius))).join(a, "a").join(b, "b").select(F.col("xa").alias("a"), F.col("xb").alias("b"))
        linked = checkpoint(linked.union(same).union(near))
    found = components(linked)
    rest = alike(checkpoint(others(buckets, found.select(F.xxhash64("node").alias("node"), F.xxhash64("component").alias("component")), similarity)))
    if not rest.isEmpty():  # classes that stars have made, joined further
        found = components(rest.union(found.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))))
    joined = found.withColumnRenamed("node", "digest").join(reps.select("digest", "rep"), "digest")
    joined = checkpoint(joined)
    stays = joined.groupBy("component").agg(F.min("rep").alias("stays"))
    goes = looked_up(joined, stays, "component").where("rep <> stays").select("digest")
    return reps.join(goes, "digest", "left_anti").select("rep.*")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The row of each class that fingerprints within the radius and near copies link; of rows of that very id and text the least stays. Rows without an id stay."""
    kept = checkpoint(near_copies(docs, id_col, text, similarity, radius).select(F.col("doc_id").alias(id_col), F.col("hash").alias("__hash")))
    named = docs.where(F.col(id_col).isNotNull()).withColumn("__hash", F.xxhash64(F.col(text))).join(kept, [id_col, "__hash"], "left_semi")
    rest = [c for c in docs.columns if c != id_col]
    # the join has the rows of an id and text together and in order, so the least of them needs no more shuffle
    least = named.groupBy(id_col, "__hash").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("row"))
    return least.select(id_col, "row.*").select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))


@F.pandas_udf(T.ArrayType(T.LongType()))
def shingle_set(texts: pd.Series) -> pd.Series:
    """Distinct hashes of a text's shingles."""
    return pd.Series([h.view(np.int64) for h in sets(texts)])
