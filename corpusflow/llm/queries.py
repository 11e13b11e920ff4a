"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, langid, licenses, mixing, packing, pii, quality, simhash, topk, toxicity, whitening, yinyang
from ._common import fold, read

#: Name of the vocabulary file that op7 uses; a parameter of vocabulary().
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: And of the tokenizer that op12 uses; a parameter of definition().
TOKENIZER = "word_bpe_49k.json"


def vocabulary(name: str = VOCABULARY) -> tuple[list[bytes], str]:
    """Tokens by rank, and the pattern that makes pre-tokens."""
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


def definition(name: str = TOKENIZER) -> str:
    """A tokenizer as JSON; read on the driver only."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"), "lang")
    docs = docs.withColumn("held_out", fold(F.col("doc_id"), 4) == 2)
    model = langid.fit(docs.where(~F.col("held_out")))
    return docs.select("doc_id", "held_out", langid.language(F.col("text"), model, spark).alias("p")).select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "source"))
    return mixed.select("row.doc_id", "row.source", "block", "slot", "position", "weight")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top(read(spark, sf_dir, "embeddings"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens, pattern = vocabulary()
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    return docs.select("doc_id", bpe.round_trip(F.col("text"), spark, tokens, pattern).alias("d")).select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang.cluster(read(spark, sf_dir, "embeddings"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), definition())


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    each = (op1_language_id, op2_mixing, op3_quality, op4_license_scan, op5_nearest_neighbours, op6_exact_top_k, op7_byte_bpe, op8_simhash, op9_pii, op10_toxicity, op11_centroid_clustering, op12_packing, op13_whitening, pipeline)
    return {f.__name__: f for f in each}


def oracle_sql() -> dict[str, str]:
    from . import sql

    return {"op1_language_id": sql.LANGUAGE, "op2_mixing": sql.MIXING, "op6_exact_top_k": sql.TOP_K, "op9_pii": sql.PII, "op11_centroid_clustering": sql.CLUSTERING}
