"""Question-answer chains from a completion model that the caller injects."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import after_reasoning
from ..schemas import CHAIN

#: What chains are made about, in order.
ASPECTS = (
    "mission objective and purpose",
    "spacecraft and technology",
    "scientific instruments and experiments",
    "launch date, timeline, and mission phases",
    "orbit and trajectory",
    "scientific discoveries and results",
    "significance and impact on space exploration",
    "challenges and risks",
    "international collaboration and agencies involved",
    "future missions or follow-ups inspired by this mission",
)
LEVELS = ("level_1", "level_2", "level_3")
LEAST_CONTEXT = 50


def lenient(raw: str | None) -> str | None:
    """JSON within other text, written plainly: the widest object, else the widest list, else the whole; null if none parses."""
    raw = raw or ""
    spans = [raw[raw.find(a) : raw.rfind(b) + 1] for a, b in ("{}", "[]") if a in raw and raw.rfind(b) > raw.find(a)]
    for text in [*spans, raw]:
        try:
            return json.dumps(json.loads(text), ensure_ascii=False)
        except ValueError:
            continue
    return None


def parsed(raw: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([lenient(t) for t in texts], dtype=object)

    return run(raw)


def is_chain(text: Column) -> Column:
    """Whether JSON text is an object with all three levels, whatever is in them."""
    keys = F.json_object_keys(text)
    return F.coalesce(F.forall(F.array(*map(F.lit, LEVELS)), lambda k: F.array_contains(keys, k)), F.lit(False))


def prompt(context: Column, aspect: Column) -> Column:
    shape = '{"aspect": "<aspect>", "level_1": {"question": "...", "answer": "..."}, "level_2": {"question": "...", "answer": "..."}, "level_3": {"question": "...", "answer": "..."}}'
    return F.concat(
        F.lit('Write three linked questions with answers about "'), aspect,
        F.lit('" for the mission below: a basic one, one that goes deeper into its answer, and one that goes deeper still. Be specific to this mission, use two or three sentences an answer, and fill gaps from general knowledge. Reply with JSON only, in this shape: '),
        F.lit(shape), F.lit(' with the aspect "'), aspect, F.lit('".\n\nMission:\n'), context,
    )


def stub(prompts: pd.Series) -> list[str]:
    """A deterministic completer for tests."""
    return [json.dumps({k: {"question": f"{k}? {len(p)}", "answer": p[-40:]} for k in LEVELS}) for p in prompts]


def completed(requests: DataFrame, complete: Callable[[pd.Series], list[str]], attempts: int = 2) -> DataFrame:
    """requests (with `prompt`) and `chain`: JSON text of a valid chain, null if no attempt gave one.

    The model is called within one mapInPandas, so no later filter makes Spark call it again in the same plan; requests are
    dealt out first, and each task asks anew only for what failed. An error of the completer counts as an empty reply.
    """
    schema = StructType([*requests.schema.fields, StructField("chain", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def valid(raw: str) -> str | None:
            if "<think>" in raw and "</think>" in raw:
                raw = raw.split("</think>", 1)[1].strip()
            text = lenient(raw)
            found = json.loads(text) if text else None
            return text if isinstance(found, dict) and all(k in found for k in LEVELS) else None

        for batch in batches:
            chains = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            for _ in range(attempts):
                open_ = chains[chains.isna()].index
                if not len(open_):
                    break
                try:
                    replies = complete(batch.loc[open_, "prompt"])
                except Exception:
                    replies = [""] * len(open_)
                for i, r in zip(open_, replies):
                    chains[i] = valid(r or "")
            yield batch.assign(chain=chains)

    return requests.mapInPandas(run, schema)


def attempted(requests: DataFrame, complete: Callable[[pd.Series], list[str]], clock: Column | None = None) -> DataFrame:
    """requests (with `prompt`) after one attempt each, with `chain`, `ok` and `at`: a log for streaming.retry, which says what to ask again and when.

    A model may answer otherwise when it is asked again, so write the log before reading it twice: the attempt that was written is the one that counts.
    """
    done = completed(requests, complete, attempts=1)
    return done.withColumn("ok", F.col("chain").isNotNull()).withColumn("at", clock if clock is not None else F.current_timestamp())


def chains(records: DataFrame, complete: Callable[[pd.Series], list[str]] = stub, aspects: tuple[str, ...] = ASPECTS) -> DataFrame:
    """(key columns, total_chains, qa_chains) from (organisation, mission_name, source_url, scraped_at, context): entries whose context is long
    enough and that got a chain; chains in the order of the aspects, each under the aspect that was asked for."""
    keys = ["organisation", "mission_name", "source_url", "scraped_at"]
    asked = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("aspect")) for i, a in enumerate(aspects)])
    requests = records.where(F.length("context") >= LEAST_CONTEXT).select(*keys, "context", F.explode(asked).alias("a"))
    requests = requests.select(*keys, F.col("a.i").alias("i"), F.col("a.aspect").alias("aspect"), prompt(F.col("context"), F.col("a.aspect")).alias("prompt"))
    done = completed(requests.repartition(*keys, "i"), complete).where("chain is not null")
    chain = F.from_json("chain", CHAIN)
    named = F.struct(F.col("aspect"), *[chain[k].alias(k) for k in LEVELS])
    grouped = done.select(*keys, F.struct("i", named.alias("chain")).alias("x")).groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return grouped.select(*keys, F.size("x").alias("total_chains"), F.transform("x", lambda x: x["chain"]).alias("qa_chains"))


def outcome(context: Column, n_chains: Column) -> Column:
    """skipped (too little context), failed or done."""
    return F.when(F.length(context) < LEAST_CONTEXT, "skipped").when(F.coalesce(n_chains, F.lit(0)) == 0, "failed").otherwise("done")


__all__ = ["ASPECTS", "after_reasoning", "attempted", "chains", "completed", "is_chain", "lenient", "outcome", "parsed", "prompt", "stub"]
