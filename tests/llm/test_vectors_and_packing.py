"""Clustering, packing and whitening on edge rows and against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusflow.llm import packing, queries, whitening, yinyang

VECTORS = "vec_id long, embedding array<float>, label int, cluster string, x int"


def vectors(spark, n=300, d=64, extra=(), seed=3, spread=0.3):
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(6, d))
    rows = [(i, (heads[i % 6] + spread * rng.normal(size=d)).astype(np.float32).tolist(), 1, "c", 0) for i in range(n)]
    rows += [(n, None, None, None, None), (n + 1, [float("nan")] * d, 1, "c", 0), (n + 2, [1.0] * (d - 1), 1, "c", 0), (n + 3, [None] * d, 1, "c", 0), (n + 4, [float("inf")] + [0.0] * (d - 1), 1, "c", 0), (n + 5, [], 1, "c", 0)]
    rows += [(None, rows[0][1], None, None, None), (0, rows[0][1], 1, "c", 0), rows[1], *extra]
    return spark.createDataFrame(rows, VECTORS), [r for r in rows if r[1] and len(r[1]) == d and None not in r[1] and np.isfinite(r[1]).all()]


def lloyd(rows, k, rounds, scale=256):
    x = np.array([[int(np.floor(scale * float(v))) for v in r[1]] for r in rows], dtype=object)
    start = sorted((r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1], i) for i, r in enumerate(rows))[:k]
    c = np.array([x[s[-1]] for s in start], dtype=object)
    for i in range(rounds + 1):
        d = np.array([[((a - b) ** 2).sum() for b in c] for a in x], dtype=object)
        at = [int(min(range(len(c)), key=lambda j: (row[j], j))) for row in d]
        if i < rounds:
            for j in range(len(c)):
                own = x[[a == j for a in at]]
                if len(own):
                    c[j] = [int(v) // len(own) for v in own.sum(axis=0)]
    return x, c, at, [d[i][a] for i, a in enumerate(at)]


@pytest.mark.parametrize("k,rounds,n,extra", [(40, 5, 300, ()), (7, 3, 60, ((90, [900.0] * 64, 1, "c", 0), (91, [-900.5] * 64, 1, "c", 0))), (40, 2, 10, ())])
def test_clusters_equal_brute_force(spark, k, rounds, n, extra):
    df, rows = vectors(spark, n, extra=extra)
    got = yinyang.cluster(df, k=k, rounds=rounds).collect()
    x, c, at, far = lloyd(rows, k, rounds)
    assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in got) == Counter((r[0], a, d) for r, a, d in zip(rows, at, far))
    per = Counter()
    for a, d in zip(at, far):
        per[a] += d
    for r in got:
        assert r["inertia"] == sum(far) and r["cluster_inertia"] == per[r["cluster"]]
        assert r["centroid_sha256"] == hashlib.sha256(",".join(str(int(v)) for v in c[r["cluster"]]).encode()).hexdigest()


def test_clusters_of_nothing(spark):
    df, _ = vectors(spark, 3)
    assert yinyang.cluster(df.where("vec_id < 0")).collect() == []
    assert yinyang.cluster(df.where("embedding is null")).collect() == []
    with pytest.raises(Exception, match="2\\*\\*31"):
        yinyang.cluster(spark.createDataFrame([(1, [3e30] * 64)], "vec_id long, embedding array<float>")).collect()


def test_bounds_save_distances():
    rng = np.random.default_rng(1)
    heads = rng.normal(size=(40, 64)) * 200
    x = np.floor(np.repeat(heads, 50, axis=0) + rng.normal(size=(2000, 64)) * 20).astype(np.int64)
    c = x[::50].copy()
    groups = yinyang.Groups(c)
    state, n = yinyang.first(x, c, groups), 0
    for i in range(5):
        new = np.array([x[state[0] == j].sum(axis=0) // max(1, (state[0] == j).sum()) for j in range(40)])
        moved, c = np.sqrt(((new - c) ** 2).sum(axis=1).astype(float)), new
        *state, computed = yinyang.again(x, c, moved, groups, *state)
        n += computed
        assert (state[0] == yinyang.squared(x, c).argmin(axis=1)).all()
    assert n < 0.1 * 5 * 2000 * 40


@pytest.mark.parametrize("size", [5, 2**20, 2**26, 2**30])
def test_bounds_keep_ties_and_sizes(size):
    rng = np.random.default_rng(size)
    x = rng.integers(-3, 4, size=(500, 4)) * (size // 4) + rng.integers(-1, 2, size=(500, 4))
    c = x[:12].copy()
    groups = yinyang.Groups(c, 4)
    state = yinyang.first(x, c, groups)
    for _ in range(6):
        new = np.array([[int(v) // int((state[0] == j).sum()) for v in x[state[0] == j].sum(axis=0)] if (state[0] == j).any() else c[j] for j in range(12)])
        moved, c = yinyang._root(yinyang._own(new, c)), new
        *state, _ = yinyang.again(x, c, moved, groups, *state)
        exact = [[sum((int(p) - int(q)) ** 2 for p, q in zip(a, b)) for b in c] for a in x]
        assert state[0].tolist() == [row.index(min(row)) for row in exact]


def whitened(rows, k, scale=64):
    x = np.array([[int(np.floor(scale * float(v))) + 1_000_000 for v in r[1]] for r in rows], dtype=object)
    fit = np.array(sorted({tuple(a) for a in x}), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    y = (fit * n - s).astype(float) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    return n, [int(((a * n - s) ** 2).sum()) for a in x], ((x * n - s).astype(float) / n) @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


@pytest.mark.parametrize("d,k,n", [(64, 16, 300), (100, 4, 400), (3, 16, 50)])
def test_whitening_equals_brute_force(spark, d, k, n):
    df, rows = vectors(spark, n, d)
    got = defaultdict(list)
    for r in whitening.whiten(df, k=k).collect():
        got[r["component"]].append(r)
    n, deviations, w, share = whitened(rows, min(k, d))
    assert sorted(got) == list(range(1, min(k, d) + 1))
    for c, found in got.items():
        assert len(found) == len(rows) and {r["n"] for r in found} == {n}
        assert all(abs(r["explained"] / share[c - 1] - 1) < 1e-9 and r["identity_error"] < 1e-9 for r in found)
        want = sorted((r[0] is not None, r[0] or 0, dev, v) for r, dev, v in zip(rows, deviations, w[:, c - 1]))
        have = sorted((r["vec_id"] is not None, r["vec_id"] or 0, r["deviation"], r["whitened"]) for r in found)
        assert [x[:3] for x in want] == [x[:3] for x in have]
        a, b = np.array([x[3] for x in want]), np.array([x[3] for x in have])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6


def test_whitening_iterates_at_the_size_of_the_query(spark, monkeypatch):
    df, _ = vectors(spark, 500, 64, spread=1.0)
    rows = df.where("size(embedding) = 64").select(F.col("embedding").cast("array<double>").alias("v")).where("forall(v, x -> abs(x) < 1e9)")
    blocks = whitening.fit_list(rows, 64, whitening.SCALE)
    n, s = whitening.sums(blocks, 64)
    widths, made = [], whitening._summed

    def summed(blocks, d, make):
        z = made(blocks, d, make)
        widths.append(z.shape[1])
        return z

    monkeypatch.setattr(whitening, "_summed", summed)
    values, axes, trace, passes = whitening.components(blocks, 64, n, np.array([a / n for a in s]))
    assert passes == len(widths) > 3 and max(widths) == whitening.K  # blocks of k columns, never the covariance
    x = np.concatenate(list(whitening._each([pa.RecordBatch.from_arrays([pa.array([r[c] for r in blocks.collect()]) for c in ("kind", "x")], ["kind", "x"])], 64)))
    e, u = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.abs(values / e[::-1][:16] - 1).max() < 1e-12 and abs(trace / e.sum() - 1) < 1e-12 and np.abs(np.abs((axes * u[:, ::-1][:, :16]).sum(axis=0)) - 1).max() < 1e-9


def test_passes_of_whitening_run_as_many_tasks_as_the_fit_list_is_worth(spark, monkeypatch):
    df, rows = vectors(spark, 300, 64)
    parts, made = [], whitening._summed

    def summed(blocks, d, make):
        parts.append(blocks.rdd.getNumPartitions())
        return made(blocks, d, make)

    monkeypatch.setattr(whitening, "_summed", summed)
    monkeypatch.setattr(whitening, "ENTRIES", 64 * 100)
    wide = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wide}
    try:
        for k, v in wide.items():
            spark.conf.set(k, v)
        found = whitening.whiten(df).count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == 16 * len(rows) and max(parts) <= -(-len(rows) // 100)


def test_whitening_of_little(spark):
    df, rows = vectors(spark, 4)
    assert whitening.whiten(df.where("vec_id < 0")).collect() == []
    assert whitening.whiten(df.where("vec_id = 1")).collect() == []  # one vector, twice: no variance
    two = whitening.whiten(df.where("vec_id in (0, 1)")).collect()
    assert {r["component"] for r in two} == {1} and {r["n"] for r in two} == {2} and all(abs(abs(r["whitened"]) - 1) < 1e-9 for r in two)
    far = spark.createDataFrame([(1, [1e9] * 64), (2, [-1e9] * 64)], "vec_id long, embedding array<double>")
    assert all(r["deviation"] is None for r in whitening.whiten(far).collect())


TEXTS = [
    "The cat sat. The cat!", "", None, "ÀÉ straße ÿ", "don't stop_it 12a 3.5 x́ é", "日本語 text　wide space", "a\nb\tc\r\nd\x0be\x1cf\x85g", "<|endoftext|> is text", "İstanbul ΣΑΣ ﬁ Ⅷ ½",
    "word " * 30_000, "x" * 30_000, " ".join(f"w{i}" for i in range(20_000)), "🙂🙂 \U0001f9d1‍\U0001f680 ퟿", "naïve café, Über; ª µ º",
]


def packed_rows(spark, ids=False, texts=TEXTS):
    rows = [(i, t, 5, "s") for i, t in enumerate(texts)] + [(None, "orphan", 1, "s"), (1, "", 1, "s"), (0, texts[0] if texts else "x", 5, "s")]
    return rows, packing.pack(spark.createDataFrame(rows, "doc_id long, text string, length int, rank string").repartition(3), queries.definition(), ids=ids)


def test_words_of_ascii_reach_the_model_as_they_are(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    class Untouched(dict):
        def __getitem__(self, key):
            raise AssertionError(chr(key))

    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        encoder = packing.Encoder(f.read())
    monkeypatch.setattr(packing, "_HIDDEN", Untouched())
    for text in ("Plain words, and a MARK! or? two;: of them.", "a, , a,, .a x1 don't A B-c [d] e?! f\x0b g\x1f", "it's we'll , ,, . !a a!"):
        got = np.frombuffer(b"".join(encoder.encode(text)), "<u4").tolist()
        assert got == Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids, text


def test_new_words_of_many_texts_reach_the_model_in_one_call(monkeypatch):
    encoder, calls = packing.Encoder(queries.definition()), []
    texts = [f"Word{i}*** don't (see p.{i}), 'S été-{'ab' * (i % 7)}É&&& a_b@c.d It'll" for i in range(300)]
    want = [tuple(e.ids) for e in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    whole = encoder.model

    class Counted:
        def encode_batch_fast(self, rows, **other):
            calls.append(len(rows))
            return whole.encode_batch_fast(rows, **other)

    class Unused:
        def encode_batch_fast(self, rows, **other):
            assert not rows, rows
            return []

    monkeypatch.setattr(encoder, "model", Counted())
    monkeypatch.setattr(encoder, "tokenizer", Unused())
    assert [tuple(np.frombuffer(b"".join(parts), "<u4").tolist()) for parts in encoder.encode_all(texts)] == want
    assert calls == [1]


@pytest.mark.parametrize("chunk,keys,held", [(1 << 20, 500_000, 16 << 20), (64, 40, 16 << 20), (300, 500_000, 200)])
def test_odd_texts_have_the_ids_of_the_library(monkeypatch, chunk, keys, held):
    for name, value in (("_CHUNK", chunk), ("_KEYS", keys), ("_HELD", held)):
        monkeypatch.setattr(packing, name, value)
    encoder = packing.Encoder(queries.definition())
    rng = np.random.default_rng(5)
    signs = list("abIS.,!*'<>/w01 \n\t\r\x0b\x1f\x7f\x85\xa0ßÿÀµ×÷²ªéΣςİŸK\u0301\u200bжд中文🙂") + ["'s", "'LL", "</w>", "<|endoftext|>", "the ", " word, ", "  "]
    texts = ["", " ", "".join(map(chr, range(33, 384))), " ".join(map(chr, range(33, 384)))]
    texts += ["".join(rng.choice(signs, n)) for n in rng.integers(0, 120, 300)] + ["".join(rng.choice(signs[:12], n)) for n in rng.integers(0, 120, 100)]
    want = [tuple(encoder.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [tuple(np.frombuffer(b"".join(parts), "<u4").tolist()) for parts in encoder.encode_all(texts)] == want
    assert max(len(encoder.parts.numbers), len(encoder.others.numbers)) <= keys + chunk


def test_packing_equals_the_library(spark):
    rows, df = packed_rows(spark, ids=True)
    found = df.collect()
    tokenizer = Tokenizer.from_str(queries.definition())
    tokenizer.encode_special_tokens = True
    want = Counter((r[0], tuple(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + (2,)) for r in rows)
    pieces = defaultdict(list)
    for r in found:
        assert r["length"] == len(r["ids"]) > 0 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], tuple(r["ids"])))
    got = Counter()
    for (doc, n), parts in pieces.items():
        by_start = sorted(parts)
        copies = sum(s == 0 for s, _ in by_start)
        whole = sum((p for _, p in by_start[::copies]), ())
        assert len(whole) == n and all(by_start[i] == by_start[i - i % copies] for i in range(len(by_start)))
        got[doc, whole] += copies
    assert got == want
    check_sequences(found)
    together = {r["sequence_id"]: r for r in packing.assembled(df, pad=7).collect()}
    for r in found:
        whole = together[r["sequence_id"]]
        assert whole["ids"][r["offset"] : r["offset"] + r["length"]] == r["ids"] and len(whole["ids"]) == r["padded"] and set(whole["ids"][whole["n_tokens"] :]) <= {7}


def check_sequences(found):
    """Gapless from 0, no more than a sequence, and padded as stated; returns the share of padding."""
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["padded"]))
    total = padded = 0
    for parts in sequences.values():
        at = 0
        for offset, length, size in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096 and size == (at if at & (at - 1) == 0 else 4096)
        total, padded = total + at, padded + size
    assert sorted(sequences) == list(range(len(sequences)))
    return padded / total - 1


def test_packing_pads_little(spark):
    found = queries.op12_packing(spark, "/root/testdata/sf0.01").collect()
    assert check_sequences(found) < 0.005
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    assert len({r["doc_id"] for r in found}) == docs


def test_packing_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty, queries.definition()).collect() == []


@pytest.mark.parametrize("histogram", [{1: 1}, {4096: 5}, {100: 1, 64: 3}, {63: 1000}, {2048: 1, 1024: 1, 1: 1}, {3000 // 64 * 64: 7, 40: 2}])
def test_plans_hold_each_piece_once(histogram):
    uses = packing.plan(histogram)
    held = Counter()
    for pattern, times in uses:
        assert times > 0 and 0 < sum(n * c for n, c in pattern.items()) <= packing.CAPACITY
        for n, c in pattern.items():
            held[n] += c * times
    assert held == Counter(histogram)
    spots = sorted(packing.places(uses))
    for n, c in histogram.items():
        mine = [s for s in spots if s[0] == n]
        assert [s[1] for s in mine] == [0, *[s[2] for s in mine][:-1]] and mine[-1][2] == c


def test_columns_improve_on_single_lengths():
    lengths, counts = [1984, 1088, 1024], [300, 300, 300]
    found = packing.linear_program(lengths, counts)
    assert all(y > -1e-9 for _, y in found)
    assert np.allclose([sum(p[i] * y for p, y in found) for i in range(3)], counts)
    assert sum(y for _, y in found) < 301
