"""Splits of chains into train, validation and test without breaking a chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import number

TRAIN, VALIDATION = 0.85, 0.10


def chains(samples: DataFrame, chain: str, attributes: list[str], pos: list[str]) -> DataFrame:
    """One row per chain: the attributes of its first record, and its size."""
    order = F.struct(*pos)
    return samples.groupBy(chain).agg(*[F.min_by(a, order).alias(a) for a in attributes], F.count("*").alias("size"), F.min(order).alias("first"))


def reserved(found: DataFrame, chain: str, entry: str) -> DataFrame:
    """(entry, chain): the first chain of each entry by id; these go to train."""
    return found.groupBy(entry).agg(F.min(chain).alias(chain))


def assign(found: DataFrame, chain: str = "chain_id", org: str = "org", entry: str = "mission_name", train: float = TRAIN, validation: float = VALIDATION) -> DataFrame:
    """found with `split`. The first chain of each entry is for training; the others of an organisation are cut by rank into
    train, validation and test, shares rounded half to even, what is left over goes to test.

    An organisation can hold most of the chains, so ranks come from number(), which sorts no organisation in one task.
    """
    first = found.groupBy(entry).agg(F.min(chain).alias("__first"))
    marked = found.join(first.withColumnRenamed(entry, "__entry"), F.col(entry).eqNullSafe(F.col("__entry"))).withColumn("__reserved", F.col(chain) == F.col("__first"))
    keep = marked.where("__reserved").select(*found.columns, F.lit("train").alias("split"))
    rest = marked.where("not __reserved").select(*found.columns)
    sizes = rest.groupBy(F.col(org).alias("__org")).agg(F.count("*").alias("__n"))
    n_validation = F.bround(F.col("__n") * F.lit(validation))
    n_test = F.greatest(F.lit(0.0), F.col("__n") - F.bround(F.col("__n") * F.lit(train)) - n_validation)
    cuts = sizes.select("__org", (F.col("__n") - n_validation - n_test).alias("__train"), (F.col("__n") - n_test).alias("__known"))
    ranked = number(rest, [chain], [org], "__rank").join(cuts, F.col(org).eqNullSafe(F.col("__org")))
    split = F.when(F.col("__rank") <= F.col("__train"), "train").when(F.col("__rank") <= F.col("__known"), "validation").otherwise("test")
    return keep.unionByName(ranked.select(*found.columns, split.alias("split")))


def attach(samples: DataFrame, assignment: DataFrame, chain: str = "chain_id") -> DataFrame:
    """Records with their chain's split; chains without one train."""
    joined = samples.join(assignment.select(chain, F.col("split").alias("__split")), chain, "left")
    return joined.withColumn("split", F.coalesce("__split", F.lit("train"))).drop("__split")


def difficulty_order(difficulty: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in (("basic", 0), ("intermediate", 1), ("advanced", 2)) for x in kv]), difficulty), F.lit(99))


def counts(assignment: DataFrame) -> DataFrame:
    """Chains and their percentage for each split; null for an empty input."""
    found = assignment.groupBy("split").agg(F.count("*").alias("n_chains"))
    total = F.sum("n_chains").over(Window.partitionBy())  # over three rows
    return found.withColumn("pct", F.round(F.try_divide(F.lit(100.0) * F.col("n_chains"), total), 1))


def distribution(records: DataFrame, dims: list[str]) -> DataFrame:
    """(split, dim, value, n) for each of the dimensions, in one aggregation over grouping sets."""
    cols = ["split", *dims]
    sets = [[F.col("split"), F.col(d)] for d in dims]
    grouped = records.groupingSets(sets, *[F.col(c) for c in cols]).agg(F.count("*").alias("n"), *[F.grouping(d).alias(f"__{d}") for d in dims])
    dim, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for d in dims:
        dim, value = F.when(F.col(f"__{d}") == 0, d).otherwise(dim), F.when(F.col(f"__{d}") == 0, F.col(d).cast("string")).otherwise(value)
    return grouped.select("split", dim.alias("dim"), value.alias("value"), "n")


def size_histogram(records: DataFrame, chain: str, complete: int = 3) -> DataFrame:
    sizes = records.groupBy(chain).agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("n_chains")).withColumn("incomplete", F.col("size") != complete)


def conservation(before: DataFrame, after: DataFrame) -> DataFrame:
    """(n_in, n_out): equal unless a split lost or repeated records."""
    return before.agg(F.count("*").alias("n_in")).join(after.agg(F.count("*").alias("n_out")), how="cross")  # one row each
