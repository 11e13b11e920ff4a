"""A corpus pipeline: toxic documents go, near-duplicates go but one of each group, personal data is masked, sources are mixed to
target weights, texts are encoded.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the last return the columns of
`documents`. Models are trained on the labels in sf_dir and on the rows that a stage gets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import bpe, mixing, pii, simhash, toxicity
from corpusflow.llm._common import DOCUMENT_COLUMNS, read
from corpusflow.llm.queries import vocabulary


def _own(docs: DataFrame) -> DataFrame:
    """Only the columns of documents, so that no other name can clash."""
    return docs.select(*DOCUMENT_COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(_own(docs), read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are linked by their SimHash fingerprints, as in op8, and by their shingle sets. Of each class the row with the smallest doc_id stays;
    rows without an id have no place in that order and stay."""
    return simhash.one_of_each(_own(docs))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(_own(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order of the mixture."""
    return mixing.mix(_own(docs)).orderBy("position", "row.doc_id").select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids)."""
    ids = bpe.encode(F.col("text"), spark, *vocabulary())
    return docs.select("doc_id", "source", ids.alias("ids")).select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: The classifier of the first stage can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
