"""Quality scores by random Fourier features, ridge regression and isotonic calibration.

Every text becomes STATISTICS, standardised over the training rows. Random Fourier features (fixed seed) approximate a
Gaussian kernel over them; each partition sums its normal equations, the sums are added and solved once. The scores are
calibrated isotonically (pool adjacent violators) on a fold of the training rows that the regression has not seen, from a
histogram of bounded size, and interpolated between its steps so that they keep their order.

Every row with a label in the training folds is used; nothing is sampled. Only sums whose size is set by the number of features
and of histogram bins reach the driver.

Edge cases: a null text counts as empty; both get the score that empty statistics have. Rows with a null id or label teach
nothing, repeated labels of an id are averaged. Without labels of both classes every score is the mean label, or 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import added, checkpoint, fold, packed

STATISTICS = (
    "log_chars", "log_words", "word_length", "distinct_words", "top_word", "same_as_before", "distinct_lines", "line_length",
    "upper", "digit", "space", "newline", "punctuation", "symbol", "non_ascii", "compressed",
)
FEATURES, WIDTH, RIDGE, BINS, SEED = 256, 4.0, 1e-3, 2048, 7
_FOLDS, _HELD_OUT, _CALIBRATION = 5, 0, 4


def _byte_classes() -> np.ndarray:
    table = np.zeros((256, 7))
    for k, chars in enumerate((range(65, 91), range(48, 58), b" \t\r\v\f", b"\n", b".,;:?'\"()-", b"!#$%&*+/<=>@[\\]^_`{|}~", range(128, 256))):
        table[list(chars), k] = 1
    return table


def statistics(text: str | None, classes: np.ndarray, compress) -> list[float]:
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return [0.0] * len(STATISTICS)
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    _, counts = np.unique(np.fromiter(map(hash, words), np.int64, len(words)), return_counts=True)
    share = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ classes / len(data)
    same = sum(map(str.__eq__, words, words[1:]))
    return [
        np.log1p(len(text)), np.log1p(len(words)), sum(map(len, words)) / n, len(counts) / n, counts.max(initial=0) / n, same / n,
        len(set(lines)) / len(lines), np.log1p(len(text) / len(lines)), *share, len(compress(data)) / len(data),
    ]


def measured(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, fold, x: array<double>): the statistics of every text."""
    classes = _byte_classes()

    @F.pandas_udf("array<double>")
    def stats(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compress = zstandard.ZstdCompressor(level=1).compress
        for batch in texts:
            yield pd.Series([statistics(t, classes, compress) for t in batch])

    rows = docs.select(F.col(id_col).alias("doc_id"), fold(F.col(id_col), _FOLDS).alias("fold"), stats(F.col(text)).alias("x"))
    return rows.select("doc_id", (F.col("fold") == _HELD_OUT).alias("held_out"), "fold", "x")


def _maps(mean: np.ndarray, deviation: np.ndarray):
    """A function from statistics to features; the last feature is 1."""
    rng = np.random.default_rng(SEED)
    turn, shift = rng.normal(0, 1 / WIDTH, (len(STATISTICS), FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)

    def features(x: np.ndarray) -> np.ndarray:
        z = np.clip((x - mean) / deviation, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ turn + shift), np.ones((len(x), 1))])

    return features


def isotonic(x: np.ndarray, total: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over ascending x: centres and heights of the steps."""
    pools: list[list[float]] = []
    for at, n, y in zip(x, total, ones):
        pools.append([n, y, at * n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[2] / p[0] for p in pools]), np.array([p[1] / p[0] for p in pools])


def fit(train: DataFrame) -> dict:
    """From (fold, x, y) to a model of plain arrays."""
    size = FEATURES + 1
    row = train.agg(F.count("*").alias("n"), F.avg("y").alias("y"), *[f(F.get("x", F.lit(i))).alias(f"{f.__name__}{i}") for i in range(len(STATISTICS)) for f in (F.avg, F.stddev_pop)]).first()
    flat = {"constant": float(row["y"] or 0.0)}
    if not row["n"] or row["y"] in (0.0, 1.0):
        return flat
    mean = np.array([row[f"avg{i}"] for i in range(len(STATISTICS))])
    deviation = np.array([row[f"stddev_pop{i}"] or 1.0 for i in range(len(STATISTICS))])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features, a = _maps(mean, deviation), np.zeros((size, size + 1))
        for batch in batches:
            if len(batch):
                z = features(np.vstack(batch["x"].to_numpy()))
                a += z.T @ np.hstack([z, batch["y"].to_numpy()[:, None]])
        yield pd.DataFrame({"key": range(size), "data": list(map(packed, a))})

    total = added(train.where(F.col("fold") != _CALIBRATION).select("x", "y").mapInPandas(sums, "key int, data binary"))
    a = np.vstack([total[i] for i in range(size)])
    n = max(1.0, a[-1, -2])
    weights = np.linalg.solve(a[:, :-1] + RIDGE * n * np.eye(size), a[:, -1])
    model = flat | {"mean": mean, "deviation": deviation, "weights": weights}
    bins = F.floor(F.greatest(F.lit(-0.5), F.least(F.lit(1.5), F.col("raw"))) * (BINS / 2))
    held = train.where(F.col("fold") == _CALIBRATION).select(_raw(train.sparkSession, model)(F.col("x")).alias("raw"), "y")
    steps = held.groupBy(bins.alias("bin")).agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.avg("raw").alias("at")).orderBy("bin").collect()
    if steps:
        model["at"], model["height"] = isotonic(*(np.array([float(r[c]) for r in steps]) for c in ("at", "n", "y")))
    return model


def _raw(spark: SparkSession, model: dict):
    @F.pandas_udf("double")
    def raw(xs: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features = _maps(model["mean"], model["deviation"])
        for batch in xs:
            yield pd.Series(features(np.vstack(batch.to_numpy())) @ model["weights"] if len(batch) else [], dtype=float)

    return raw


def score(rows: DataFrame, model: dict) -> DataFrame:
    """rows (with x) and a column `score`, from 0 to 1."""
    if "weights" not in model:
        return rows.withColumn("score", F.lit(model["constant"]))

    @F.pandas_udf("double")
    def calibrated(xs: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features = _maps(model["mean"], model["deviation"])
        for batch in xs:
            y = features(np.vstack(batch.to_numpy())) @ model["weights"] if len(batch) else np.empty(0)
            y = np.interp(y, model["at"], model["height"]) if "at" in model else y
            yield pd.Series(np.clip(y, 0, 1), dtype=float)

    return rows.withColumn("score", calibrated("x"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs; texts are read once, their statistics kept in the shared folder."""
    rows = checkpoint(measured(docs))
    known = labels.where(f"doc_id is not null and {label} is not null").groupBy("doc_id").agg(F.avg(label).cast("double").alias("y"))
    train = rows.where(~F.col("held_out")).join(known, "doc_id").select("fold", "x", "y")
    scored = score(rows, fit(train))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
