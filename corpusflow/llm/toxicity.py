"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, with distance-weighted votes.

Examples are EXAMPLES labelled training rows at most, those whose ids have the smallest hashes (a documented bound; the fit,
not the scoring, is bounded). Terms are the character n-grams of letters, n from 4 to 6 and whole words, with a blank for a word's ends, that
a chi-squared test finds more often in toxic examples, by sequential covering, repeated without the words that
hold kept terms until nothing passes, without a limit on terms or passes; their TF-IDF vectors have unit length. The index keeps postings in
blocks of examples with each term's maximum per block. A query takes blocks by falling sums of its weights times these
maxima, scores whole blocks through their postings, and stops when the next bound falls below the k-th cosine, so the k
nearest are exact; ties go to the example with the smaller id.

The vote is the sum of cosines of toxic neighbours over the sum of all, drawn to the base rate by PRIOR, calibrated
isotonically on the examples' own votes without themselves. Texts without any term get the share of toxic examples
among those without any. Evidence: the nearest example's id and cosine.

Edge cases: a null text counts as empty, an empty one has no term; null ids or labels teach nothing, several labels of
an id count as their largest, of near copies among the examples one teaches, as does
the least text of a repeated id; without examples every score is 0. Long texts are scanned whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import checkpoint, fold
from .quality import isotonic

EXAMPLES, NEIGHBOURS, PRIOR = 8192, 15, 0.25
#: Least chi-squared value, some seven toxic examples more than chance has, and least ratio of a term's odds to be in a toxic example to the base odds.
LEAST_CHI2, LEAST_ODDS = 60.0, 5.0
#: How often a term must occur for each of its dimensions: in place of a weight by frequency, which a vector of one term would lose.
LEVELS = (1, 2, 3, 5)
_BLOCK, _HELD_OUT, _FLUSH = 64, 0, 150_000
_WORD = re.compile(r"[^\W\d_]+")


def terms_of(text: str) -> set[str]:
    """Every different word between blanks, and every n-gram of these."""
    found = set()
    for w in set(_WORD.findall(text.lower())):
        w = f" {w} "
        for n in range(4, 7):
            found.update(w[i : i + n] for i in range(len(w) - n + 1))
        found.add(w)
    return found


def _plain(text: str) -> str:
    return f" {' '.join(_WORD.findall(text.lower()))} "


def _rest(text: str, without: list[str]) -> str:
    """The text's words that hold none of these terms."""
    if not without:
        return text
    hit = re.compile("|".join(map(re.escape, without))).search
    return " ".join(w for w in _WORD.findall(text.lower()) if not hit(f" {w} "))


@F.pandas_udf(T.ArrayType(T.LongType()))
def signature(texts: pd.Series) -> pd.Series:
    """Four MinHash values of three-word shingles: texts that share half their shingles nearly always share a value."""
    turns = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)

    def values(text: str) -> list[int]:
        words = text.split()
        shingles = {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
        h = np.array([xxhash.xxh64_intdigest(x) for x in shingles], dtype=np.uint64)
        mixed = (h[:, None] ^ (h[:, None] >> np.uint64(29))) * turns
        return (mixed ^ (mixed >> np.uint64(32))).min(axis=0).view(np.int64).tolist()

    return pd.Series([values(t) for t in texts])


def _automaton(terms: list[str]):
    automaton = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        automaton.add_word(t, i)
    automaton.make_automaton()
    return automaton


def counts_of(text: str | None, automaton) -> tuple[list[int], list[float]]:
    """Terms, ascending, and how often each occurs."""
    counts = Counter(i for _, i in automaton.iter(_plain(text))) if text else Counter()
    at = sorted(counts)
    return at, [float(counts[i]) for i in at]


def levels(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The dimensions of terms that occur n times: one for each of LEVELS that n reaches, ascending."""
    own = at[:, None] * len(LEVELS) + np.arange(len(LEVELS))
    return np.sort(own[n[:, None] >= np.array(LEVELS)])


def weighted(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dimensions, ascending, and TF-IDF weights of unit length."""
    dims = levels(at, n)
    w = idf[dims]
    return dims, w / np.sqrt((w * w).sum()) if len(dims) else w


def vector(text: str | None, automaton, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = counts_of(text, automaton)
    return weighted(np.array(at, dtype=np.int64), np.array(n), idf)


def chi_squared(n, y, all_n, all_y):
    return (y * all_n - n * all_y) ** 2 * all_n / (n * (all_n - n) * all_y * (all_n - all_y))


def own_evidence(names: list[str], found: list[np.ndarray], toxic: np.ndarray) -> list[int]:
    """Terms by sequential covering: the one with the largest chi-squared value among the examples that hold no kept term, until none
    passes the test. Of those within a fifth of the largest the longest is taken, so pieces that occur
    elsewhere by chance (`rthl` of ` worthless `) teach nothing, and neither does what stands beside another term."""
    all_n, all_y = float(len(toxic)), float(toxic.sum())
    where: list[list[int]] = [[] for _ in names]
    n, y = np.zeros(len(names)), np.zeros(len(names))
    for d, at in enumerate(found):
        n[at] += 1
        y[at] += toxic[d]
        for i in at.tolist():
            where[i].append(d)
    length, open_, kept = np.array([len(t) for t in names]), np.ones(len(toxic), dtype=bool), []
    while True:
        fine = (n > 0) & (n < all_n) & (y * (all_n - all_y) >= LEAST_ODDS * (n - y) * all_y)
        value = np.zeros(len(names))
        value[fine] = chi_squared(n[fine], y[fine], all_n, all_y)
        if not value.max(initial=0) >= LEAST_CHI2:
            break
        close = np.flatnonzero((value >= LEAST_CHI2) & (value >= 0.8 * value.max()))
        best = max(close.tolist(), key=lambda i: (length[i], value[i], names[i]))
        kept.append(best)
        for d in where[best]:
            if open_[d]:
                open_[d] = False
                n[found[d]] -= 1
                y[found[d]] -= toxic[d]
    return kept


class Index:
    """Block-max inverted index over unit vectors; the example's number is its order by id."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        self.n, self.blocks = len(vectors), -(-len(vectors) // _BLOCK)
        lengths = np.array([len(t) for t, _ in vectors], dtype=np.int64)
        example = np.repeat(np.arange(self.n), lengths)
        term = np.concatenate([np.empty(0, np.int64), *[t for t, _ in vectors]])
        weight = np.concatenate([np.empty(0), *[w for _, w in vectors]])
        order = np.lexsort((example, term))
        self.example, self.weight = example[order], weight[order]
        cell = term[order] * self.blocks + self.example // _BLOCK
        self.start = np.searchsorted(cell, np.arange(n_terms * self.blocks + 1))
        self.most = np.zeros(n_terms * self.blocks)
        np.maximum.at(self.most, cell, self.weight)
        self.most = self.most.reshape(n_terms, self.blocks)

    def nearest(self, at: np.ndarray, weights: np.ndarray, k: int, but: int = -1) -> list[tuple[float, int]]:
        """(cosine, example) of the k nearest by falling cosine, ties to the smaller example; cosines of 0 are left out."""
        if not len(at) or not self.n:
            return []
        bound = weights @ self.most[at]
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or len(best) == k and bound[b] < best[-1][0] - 1e-12:
                break
            got = np.zeros(_BLOCK)
            for t, w in zip(at.tolist(), weights.tolist()):
                low, high = self.start[t * self.blocks + b], self.start[t * self.blocks + b + 1]
                if low < high:
                    got[self.example[low:high] - b * _BLOCK] += w * self.weight[low:high]
            got = np.round(got, 12)  # equal vectors tie whatever the order of summing
            best += [(float(got[i]), b * _BLOCK + int(i)) for i in np.flatnonzero(got) if b * _BLOCK + i != but]
            best = sorted(best, key=lambda x: (-x[0], x[1]))[:k]
        return best


def vote(nearest: list[tuple[float, int]], toxic: np.ndarray, base: float) -> float:
    total = sum(c for c, _ in nearest)
    return (sum(c * toxic[i] for c, i in nearest) + PRIOR * base) / (total + PRIOR)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text: str = "text", examples: int = EXAMPLES) -> dict:
    """A model of plain arrays whose size is bounded by EXAMPLES and the terms that pass the test on them."""
    known = labels.where(f"{id_col} is not null and {label} is not null and {label} in (0, 1)").where(fold(F.col(id_col), 5) != _HELD_OUT)
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(examples).collect()
    model = {"terms": [], "idf": np.empty(0), "base": 0.0, "none": 0.0, "ids": [], "toxic": np.empty(0), "vectors": [], "steps": None}
    if not sample:
        return model
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(r["id"], r["toxic"]) for r in sample], f"id {known.schema['id'].dataType.simpleString()}, toxic int")
    # at most EXAMPLES ids; of rows that repeat an id the least text stands for it, by partial minima
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    texts = texts.groupBy("id").agg(F.min(F.struct("text", "toxic")).alias("x")).select("id", "x.text", "x.toxic")
    texts = checkpoint(texts.withColumn("copy", signature(F.col("text"))))
    # copies and near copies of one text would pass for many examples of what is in it: the one with the smallest id teaches
    seen, firsts = set(), []
    for r in texts.select("id", "toxic", "copy").orderBy("id").collect():
        if seen.isdisjoint(r["copy"]):
            firsts.append((r["id"], r["toxic"]))
        seen.update(r["copy"])
    texts = texts.drop("toxic", "copy").join(F.broadcast(spark.createDataFrame(firsts, chosen.schema)), "id")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_, toxic, n, y = Counter(), Counter(), 0, 0
        out = lambda: pd.DataFrame({"term": list(all_), "n": list(all_.values()), "y": [toxic[t] for t in all_]})
        for batch in batches:
            for t, label_ in zip(batch["text"], batch["toxic"]):
                found = terms_of(t)
                all_.update(found)
                n, y = n + 1, y + label_
                if label_:
                    toxic.update(found)
                if len(all_) > _FLUSH:
                    yield out()
                    all_.clear()
                    toxic.clear()
        all_[""], toxic[""] = n, y  # the numbers of examples
        yield out()

    counts = texts.mapInPandas(count, "term string, n long, y long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    counts = checkpoint(counts)
    total = counts.where("term = ''").first()
    if not total or not total["n"]:
        return model
    all_n, all_y = float(total["n"]), float(total["y"])
    if 0 < all_y < all_n:
        n, y = F.col("n").cast("double"), F.col("y").cast("double")
        chi2 = chi_squared(n, y, all_n, all_y)
        picked = counts.where((F.col("term") != "") & (n < all_n) & (y * (all_n - all_y) >= LEAST_ODDS * (n - y) * all_y)).withColumn("chi2", chi2)
        terms = picked.where(F.col("chi2") >= LEAST_CHI2).orderBy("term").select("term").collect()  # of EXAMPLES texts
    if not 0 < all_y < all_n or not terms:
        return model | {"base": all_y / all_n, "none": all_y / all_n}
    names = [r["term"] for r in terms]

    kind = chosen.schema["id"].dataType.simpleString()

    def counted(names: list[str], without: list[str]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            automaton = _automaton(names)
            for batch in batches:
                rows = [counts_of(_rest(t, without), automaton) for t in batch["text"]]
                yield pd.DataFrame({"id": batch["id"], "toxic": batch["toxic"], "at": [r[0] for r in rows], "n": [r[1] for r in rows]})

        return texts.mapInPandas(run, f"id {kind}, toxic int, at array<int>, n array<double>").orderBy("id").collect()

    kept: list[str] = []
    while True:  # a word that holds a kept term is left out of the next pass, so each pass keeps others, of finitely many
        rows = counted(names, kept)
        more = own_evidence(names, [np.array(r["at"], dtype=np.int64) for r in rows], np.array([r["toxic"] for r in rows]))
        more = [names[i] for i in more if names[i] not in kept]
        kept += more
        if not more:
            break
    names = kept
    if not names:
        return model | {"base": all_y / all_n, "none": all_y / all_n}
    rows = counted(names, [])
    toxic = np.array([r["toxic"] for r in rows])
    dims = np.concatenate([levels(np.array(r["at"], dtype=np.int64), np.array(r["n"])) for r in rows])
    idf = np.log(1 + len(rows) / np.maximum(1, np.bincount(dims, minlength=len(names) * len(LEVELS))))
    vectors = []
    for r in rows:
        vectors.append(weighted(np.array(r["at"], dtype=np.int64), np.array(r["n"]), idf))
    full = [i for i, v in enumerate(vectors) if len(v[0])]
    empty = [toxic[i] for i, v in enumerate(vectors) if not len(v[0])]
    base = float(toxic.mean())
    model |= {"terms": names, "idf": idf, "base": base, "none": float((sum(empty) + base) / (len(empty) + 1))}
    model |= {"ids": [rows[i]["id"] for i in full], "toxic": toxic[full], "vectors": [vectors[i] for i in full]}
    index = Index(model["vectors"], len(idf))
    seen: dict[bytes, list] = {}
    votes = []
    for i, (at, w) in enumerate(model["vectors"]):
        key = at.tobytes() + w.tobytes()
        if key not in seen:
            seen[key] = index.nearest(at, w, NEIGHBOURS + 1)
        votes.append(vote([x for x in seen[key] if x[1] != i][:NEIGHBOURS], model["toxic"], base))
    order = np.argsort(votes, kind="stable")
    x = np.array(votes)[order]
    if len(x):
        bins, where = np.unique(np.round(x, 3), return_inverse=True)
        model["steps"] = isotonic(bins, np.bincount(where).astype(float), np.bincount(where, weights=model["toxic"][order].astype(float)))
    return model


def score(text: Column, model: dict, spark) -> Column:
    """struct<score: double, neighbour: string, cosine: double> of a text."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<score: double, neighbour: string, cosine: double>")
    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = sent.value
        automaton, index = _automaton(m["terms"]) if m["terms"] else None, Index(m["vectors"], len(m["idf"]))
        for batch in texts:
            rows = []
            for t in batch:
                at, w = vector(t, automaton, m["idf"]) if automaton else ((), ())
                best = index.nearest(at, w, NEIGHBOURS) if len(at) else []
                if not best:
                    rows.append((float(m["none"]), None, None))
                    continue
                s = vote(best, m["toxic"], m["base"])
                s = float(np.interp(s, *m["steps"])) if m["steps"] is not None else s
                rows.append((min(1.0, max(0.0, s)), str(m["ids"][best[0][1]]), best[0][0]))
            yield pd.DataFrame(rows, columns=["score", "neighbour", "cosine"])

    return scores(text)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted, neighbour, cosine) for every row of docs."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    scored = rows.select("doc_id", (fold(F.col("doc_id"), 5) == _HELD_OUT).alias("held_out"), score(F.col("text"), fit(docs, labels), docs.sparkSession).alias("s"))
    return scored.select("doc_id", "held_out", "s.score", (F.col("s.score") >= threshold).cast("int").alias("predicted"), "s.neighbour", "s.cosine")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, with their columns."""
    name = "__toxicity"
    scored = docs.withColumn(name, score(F.col("text"), fit(docs, labels), docs.sparkSession))
    return scored.where(F.col(f"{name}.score") < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
