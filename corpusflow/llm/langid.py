"""Language identification by rank-order n-gram profiles.

Every language has the ranked list of its most frequent character n-grams (n = 1, 2, 3; letters only, each run of other
characters is one word boundary). A document gets the same list and goes to the language with the smallest out-of-place
distance: the sum over the document's n-grams of the difference of ranks, or the list's length where the language lacks
the n-gram. Equal counts rank by code point, equal distances go to the alphabetically first language.

Edge cases: a text that is null or has no letter is `und` with score 0; without any training row everything is `und`.
Rows with a null or letterless text, or a null language, teach nothing. Repeated rows count as often as they occur.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: n-grams in a profile; in a document's list as well.
PROFILE = 300
#: Most languages that a model holds, so that what is broadcast stays below some 50 MB.
MAX_LANGUAGES = 10_000
_FLUSH = 1_000_000


def _letters() -> np.ndarray:
    """Marks the UTF-16 units that count as letters; halves of surrogate pairs do, as _grams() keeps them for letters alone."""
    table = np.fromiter((chr(i).isalpha() for i in range(0x10000)), dtype=bool, count=0x10000)
    table[0xD800:0xE000] = True
    return table


_BEYOND = re.compile("[\U00010000-\U0010ffff]")


def _has_letter(text: str) -> bool:
    return text.isalpha() or any(map(str.isalpha, text))


def _grams(text: str, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the distinct n-grams, ascending, and their counts."""
    plain = text.lower()
    if not plain.isascii() and _BEYOND.search(plain):  # what is no letter, such as emoji, is a boundary like any other
        plain = _BEYOND.sub(lambda m: m[0] if m[0].isalpha() else " ", plain)
    units = np.frombuffer(plain.encode("utf-16-le", "surrogatepass"), dtype="<u2")
    units = np.where(letters[units], units, 0).astype(np.int64)
    units = np.concatenate(([0], units, [0]))
    keep = np.ones(len(units), dtype=bool)
    keep[1:] = (units[1:] != 0) | (units[:-1] != 0)
    units = units[keep]
    one = units[units != 0] | (1 << 48)
    pairs = (units[:-1] << 16) | units[1:]
    two = pairs | (2 << 48)
    three = ((pairs[:-1] << 16) | units[2:]) + (3 << 48)
    return np.unique(np.concatenate((one, two, three)), return_counts=True)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    letters, held, size = _letters(), {}, 0

    def merged(parts):
        codes, where = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        return codes, np.bincount(where, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

    def out():
        for lang, parts in held.items():
            codes, counts = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], ["lang", "gram", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            if not _has_letter(text):
                continue
            parts = held.setdefault(lang, [])
            parts.append(_grams(text, letters))
            size += len(parts[-1][0])
            if size > _FLUSH:
                held = {k: [merged(v)] for k, v in held.items()}
                size = sum(len(v[0][0]) for v in held.values())
                if size > _FLUSH // 2:  # many different n-grams: hand them over, memory stays bounded
                    yield from out()
                    held, size = {}, 0
    yield from out()


def fit(train: DataFrame, text: str = "text", lang: str = "lang", profile: int = PROFILE) -> dict[str, np.ndarray]:
    """Ranked n-gram codes for each language. Each task sums its own counts first; only the profiles reach the driver."""
    rows = train.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= profile)
    model: dict[str, list] = {}
    for lang_, gram, rank in best.select("lang", "gram", "rank").toLocalIterator():
        model.setdefault(lang_, []).append((rank, gram))
        if len(model) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return {k: np.array([g for _, g in sorted(v)], dtype=np.int64) for k, v in sorted(model.items())}


def _table(model: dict[str, np.ndarray], profile: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All codes, ascending, and the rank of each in each language; ranks of absent ones are negative."""
    codes = np.unique(np.concatenate([*model.values(), np.empty(0, np.int64)]))
    ranks = np.full((len(codes), len(model)), -1, dtype=np.int32)
    for k, grams in enumerate(model.values()):
        ranks[np.searchsorted(codes, grams), k] = np.arange(len(grams))
    return list(model), codes, ranks


def predict(text: str | None, names: list[str], codes: np.ndarray, ranks: np.ndarray, letters: np.ndarray, profile: int) -> tuple[str, float]:
    if not names or text is None or not _has_letter(text):
        return "und", 0.0
    grams, counts = _grams(text, letters)
    own = grams[np.argsort(-counts, kind="stable")[:profile]]
    at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
    theirs = np.where((codes[at] == own)[:, None], ranks[at], -1)
    away = np.where(theirs < 0, profile, np.minimum(np.abs(theirs - np.arange(len(own))[:, None]), profile)).sum(axis=0)
    best = int(np.argmin(away))
    return names[best], float(1 - away[best] / (profile * len(own)))


def language(text: Column, model: dict[str, np.ndarray], spark, profile: int = PROFILE) -> Column:
    """struct<lang: string, score: double> for a text; the score is 1 minus the distance over the largest possible one."""
    names, codes, ranks = _table(model, profile)
    sent = spark.sparkContext.broadcast((names, codes, ranks))

    @F.pandas_udf("struct<lang: string, score: double>")
    def identify(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        letters = _letters()
        for batch in texts:
            yield pd.DataFrame([predict(t, *sent.value, letters, profile) for t in batch], columns=["lang", "score"])

    return identify(text)
