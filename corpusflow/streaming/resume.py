"""Incremental runs: new files only, results upserted or appended, safe to repeat."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def process_new(spark: SparkSession, source: str, schema: str, checkpoint: str, handle: Callable[[DataFrame, int], None], fmt: str = "parquet") -> None:
    """Hand what is new in a folder to handle(batch, number), then stop. The checkpoint remembers files; a batch that failed comes again
    with the same number, so handle() must give the same result for the same number."""
    stream = spark.readStream.format(fmt).schema(schema).load(source)
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle).start().awaitTermination()


def into_batches(store: str) -> Callable[[DataFrame, int], None]:
    """A handler that writes each batch into its own folder: repeating a batch replaces it."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{store}/batch={number}")
