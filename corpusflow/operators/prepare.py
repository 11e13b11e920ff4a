"""Checks, tokens, loss masks and padding of chat samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import or_empty, strip
from .numbering import number

IGNORED, MOST_TOKENS, LEAST_TOKENS, MULTIPLE, BATCH = -100, 2048, 4, 8, 16
#: Texts, and bytes of them, that a tokenizer gets at a time: their numbers take far more room than the texts, and a worker's batch may be 10,000 rows.
TOKENISED, TOKENISED_BYTES = 64, 1 << 19
#: Fields that every sample must have.
REQUIRED = ("sample_id", "source_id", "mission_name", "organization", "aspect", "difficulty", "chain_id", "messages")


def missing_field(line: Column, required: tuple[str, ...] = REQUIRED) -> Column:
    """Whether a line of JSON lacks a field; one that is there and null does not count. One issue per record at most."""
    keys = F.json_object_keys(line)
    return F.coalesce(~F.forall(F.array(*map(F.lit, required)), lambda k: F.array_contains(keys, k)), F.lit(True))


def has_assistant(messages: Column) -> Column:
    return F.coalesce(F.exists(messages, lambda m: m["role"] == "assistant"), F.lit(False))


def cleaned(messages: Column) -> Column:
    """developer becomes system; messages without content go."""
    named = F.transform(messages, lambda m: F.struct(F.when(m["role"] == "developer", "system").otherwise(m["role"]).alias("role"), strip(or_empty(m["content"])).alias("content")))
    return F.filter(named, lambda m: m["content"] != "")


def rendered(messages: Column, generation: bool = False) -> Column:
    """A plain chat template; callers with a model pass their own."""
    text = F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|> "), m["content"], F.lit(" <|end|>"))), " ")
    return F.concat(text, F.lit(" <|assistant|>")) if generation else text


def word_tokens(texts: pd.Series) -> list[list[int]]:
    """A stand-in for a model's tokenizer: a stable number for each word between blanks."""
    import zlib

    return [[zlib.crc32(w.encode()) % 50_000 for w in t.split(" ")] if t else [] for t in texts]


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, shown) in order, TOKENISED at most and with TOKENISED_BYTES of texts at most; a row that has more is a part of its own."""
    low = held = 0
    for i, sizes in enumerate(zip(*(pc.binary_length(batch.column(c)).to_pylist() for c in (1, 2)))):
        size = sum(n or 0 for n in sizes)
        if i > low and (i - low == TOKENISED or held + size > TOKENISED_BYTES):
            yield batch.slice(low, i - low)
            low, held = i, 0
        held += size
    if low < batch.num_rows:
        yield batch.slice(low)


def tokenised(rows: DataFrame, tokenizer: Callable[[pd.Series], list[list[int]]] = word_tokens, most: int = MOST_TOKENS) -> DataFrame:
    """(id, input_ids, prefix) of rows (id, text, shown): the tokens of text, and how many shown has, `most` at most. One pass, so a task has one
    Python worker, which holds the tokens of few texts at a time."""
    key = rows.columns[0]
    tokens = lambda part, i: tokenizer(pd.Series(part.column(i).to_pylist(), dtype=object))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                columns = [part.column(0), pa.array([x[:most] for x in tokens(part, 1)], pa.list_(pa.int32())), pa.array([min(len(x), most) for x in tokens(part, 2)], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, [key, "input_ids", "prefix"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, input_ids array<int>, prefix int")


def masked(ids: Column, prefix: Column) -> Column:
    """Labels: nothing is learnt from the first `prefix` tokens."""
    n = F.least(prefix, F.size(ids))
    return F.concat(F.array_repeat(F.lit(IGNORED), n), F.slice(ids, n + 1, F.size(ids)))


def examples(samples: DataFrame, id_col: str, messages: str = "messages", tokenizer: Callable = word_tokens, most: int = MOST_TOKENS) -> DataFrame:
    """(id, input_ids, attention_mask, labels) of the samples that can be learnt from. The prefix is all messages that aren't an
    assistant's, as suits samples of one turn; turn_mask() serves those of several."""
    rows = samples.select(F.col(id_col), cleaned(F.col(messages)).alias("m")).where(F.size("m") > 0)
    rows = tokenised(rows.select(id_col, rendered(F.col("m")).alias("text"), rendered(F.filter("m", lambda m: m["role"] != "assistant"), True).alias("shown")), tokenizer, most)
    rows = rows.where(F.size("input_ids") >= LEAST_TOKENS).withColumn("labels", masked(F.col("input_ids"), F.col("prefix")))
    rows = rows.where(F.exists("labels", lambda x: x != IGNORED))
    return rows.select(id_col, "input_ids", F.array_repeat(F.lit(1), F.size("input_ids")).alias("attention_mask"), "labels")


def turn_mask(roles: Column, ids: Column) -> Column:
    """Labels of single tokens by the role of the message that each is of."""
    return F.zip_with(roles, ids, lambda r, i: F.when(r == "assistant", i).otherwise(IGNORED))


def lengths(rows: DataFrame, ids: str = "input_ids") -> DataFrame:
    return rows.agg(F.min(F.size(ids)).alias("min_tokens"), F.max(F.size(ids)).alias("max_tokens"), F.round(F.avg(F.size(ids)), 0).alias("mean_tokens"))


def batched(rows: DataFrame, id_col: str, size: int = BATCH) -> DataFrame:
    """rows with `batch`: `size` rows of about equal length each, the last one fewer."""
    numbered = number(rows.withColumn("__length", F.size("input_ids")), ["__length", id_col], into="__number")
    return numbered.withColumn("batch", F.floor((F.col("__number") - 1) / size)).drop("__length", "__number")


def padded(rows: DataFrame, batch: str, pad: int = 0, multiple: int = MULTIPLE) -> DataFrame:
    """Each batch's rows brought to its longest length, rounded up to a multiple."""
    longest = F.max(F.size("input_ids")).over(Window.partitionBy(batch))
    rows = rows.withColumn("padded_len", (F.ceil(longest / multiple) * multiple).cast("int"))
    fill = lambda c, x: F.concat(c, F.array_repeat(F.lit(x), F.col("padded_len") - F.size(c))).alias(c)
    return rows.select(*[c for c in rows.columns if c not in ("input_ids", "attention_mask", "labels")], fill("input_ids", pad), fill("attention_mask", 0), fill("labels", IGNORED))


def sanity(samples: DataFrame) -> DataFrame:
    """(issues, no_assistant, n_chains) of samples with `issue` (see missing_field), messages and chain_id."""
    return samples.agg(F.count_if("issue").alias("issues"), F.count_if(~has_assistant(F.col("messages"))).alias("no_assistant"), F.count_distinct(F.coalesce("chain_id", F.lit(""))).alias("n_chains"))
