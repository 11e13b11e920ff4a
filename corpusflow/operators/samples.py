"""Flat chat samples out of nested question-answer chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import chain_id, or_empty, sample_id, slug, strip
from .numbering import number

#: Levels in order, with the difficulty of each.
LEVELS = (("level_1", "basic"), ("level_2", "intermediate"), ("level_3", "advanced"))
PROMPT = "Answer questions on space missions and astronomy accurately, and say so where something is not known."


def named(results: DataFrame) -> DataFrame:
    """results with trimmed `organization` (either spelling), `mission_name` and `source_url`; null counts as empty."""
    text = lambda c: F.col(c).cast("string") if c in results.columns else F.lit(None).cast("string")
    org = F.when(text("organisation").isNotNull() & (text("organisation") != ""), text("organisation")).otherwise(text("organization"))
    return results.withColumns({"organization": strip(or_empty(org)), "mission_name": strip(or_empty(text("mission_name"))), "source_url": strip(or_empty(text("source_url")))})


def valid(results: DataFrame) -> Column:
    return (F.col("organization") != "") & (F.col("mission_name") != "")


def messages(question: Column, answer: Column, prompt: str = PROMPT) -> Column:
    rows = (("developer", F.lit(prompt)), ("user", question), ("assistant", answer))
    return F.array(*[F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in rows])


def exploded(results: DataFrame, pos: str) -> DataFrame:
    """One row per level of every chain, valid or not: identifiers, positions, trimmed question and answer.

    A chain's id counts all chains of its entry, those without a valid level too.
    """
    rows = named(results).where(valid(results))
    rows = rows.select(F.col(pos).alias("m_pos"), "organization", "mission_name", "source_url", slug(F.col("organization"), F.col("mission_name")).alias("source_id"), F.posexplode("qa_chains").alias("chain_pos", "chain"))
    levels = F.array(*[F.struct(F.lit(i).alias("level_pos"), F.lit(d).alias("difficulty"), F.col(f"chain.{level}").alias("qa")) for i, (level, d) in enumerate(LEVELS)])
    rows = rows.withColumn("level", F.explode(levels))
    return rows.select(
        "m_pos", "chain_pos", "level.level_pos", "source_id", "mission_name", "organization", strip(or_empty(F.col("chain.aspect"))).alias("aspect"), "level.difficulty",
        chain_id(F.col("source_id"), F.col("chain_pos")).alias("chain_id"), "source_url",
        strip(or_empty(F.col("level.qa.question"))).alias("question"), strip(or_empty(F.col("level.qa.answer"))).alias("answer"),
    )


def flatten(results: DataFrame, pos: str, prompt: str = PROMPT) -> DataFrame:
    """Samples, numbered without gaps in the order of entry, chain and level."""
    rows = exploded(results, pos).where((F.col("question") != "") & (F.col("answer") != ""))
    rows = number(rows, ["m_pos", "chain_pos", "level_pos"], into="__n")
    return rows.select(sample_id(F.col("__n")).alias("sample_id"), "source_id", "mission_name", "organization", "aspect", "difficulty", "chain_id", "source_url", messages(F.col("question"), F.col("answer"), prompt).alias("messages"))


def accounting(results: DataFrame, pos: str) -> DataFrame:
    """(missions_in, missions_skipped, qa_skipped, samples) in one pass over the results."""
    per = named(results).withColumn("__valid", valid(results))
    fine = lambda c, level: (strip(or_empty(F.get(c, F.lit(0))[level]["question"])) != "") & (strip(or_empty(F.get(c, F.lit(0))[level]["answer"])) != "")
    good = F.aggregate("qa_chains", F.lit(0), lambda n, c: n + sum((fine(F.array(c), level).cast("int") for level, _ in LEVELS), F.lit(0)))
    all_ = F.coalesce(F.size("qa_chains"), F.lit(0)) * len(LEVELS)
    kept = F.when(F.col("__valid"), F.coalesce(good, F.lit(0))).otherwise(0)
    return per.agg(F.count("*").alias("missions_in"), F.count_if(~F.col("__valid")).alias("missions_skipped"), F.coalesce(F.sum(F.when(F.col("__valid"), all_ - kept)), F.lit(0)).alias("qa_skipped"), F.coalesce(F.sum(kept), F.lit(0)).alias("samples"))
