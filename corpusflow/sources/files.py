"""JSON stores, JSON lines and the like, read and written in parallel; of a store that is one JSON value each task reads a range of bytes (bigjson)."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bigjson import values

#: Keys under which a list of results can stand, in the order in which they are tried.
WRAPPERS = ("missions", "data", "results", "records")


def _members(rows: DataFrame, record: str) -> DataFrame:
    """(pos, key, r) of the members of objects, as maps of one entry; what is no such member has no row."""
    entry = F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), f"map<string,struct<{record}>>")
    return rows.where(F.col("text").rlike(r'^\s*"')).select("pos", F.explode(entry).alias("key", "r")).where("r is not null")


def read_keyed(spark: SparkSession, path: str, record: str) -> DataFrame:
    """(key, record fields) of a JSON object of records, the last one of a repeated key; a missing or broken file is empty. `record` is DDL."""
    rows = _members(values(spark, path).where("root = '{'"), record)
    return rows.groupBy("key").agg(F.max_by("r", "pos").alias("r")).select("key", "r.*")


def read_records(spark: SparkSession, path: str, record: str) -> DataFrame:
    """(pos, record fields) of a JSON list or of a JSON object's values, where a repeated key counts once, as in read_keyed(); a missing or broken file is empty."""
    rows = values(spark, path)
    listed = rows.where("root = '['").select("pos", F.from_json("text", f"struct<{record}>").alias("r"))
    keyed = _members(rows.where("root = '{'"), record).groupBy("key").agg(F.max_by("r", "pos").alias("r"), F.min("pos").alias("pos")).select("pos", "r")
    return listed.unionByName(keyed).select("pos", "r.*")


def read_results(spark: SparkSession, path: str, record: str) -> DataFrame:
    """(pos, result fields) of results in a list, in an object under the first of WRAPPERS that holds a list, or as one object; a broken root raises an error, an empty file has no results.

    A list, whichever way it stands, is read by ranges; an object without any is one result, and read as such.
    """
    kind = f"struct<{record}>"
    inner = values(spark, path, 2)
    name = F.regexp_extract("header", r'^\s*"([^"\\]*)"\s*:\s*\[\s*$', 1)
    named = inner.where("root = '{'").withColumn("name", name)
    held = {r["name"] for r in named.where(F.col("name").isin(*WRAPPERS)).select("name").distinct().collect()}  # of four at most
    for w in WRAPPERS:
        if w in held:
            return named.where((F.col("name") == w) & F.col("text").isNotNull()).select("pos", F.from_json("text", kind).alias("r")).select("pos", "r.*")
    listed = values(spark, path).where("root = '['")
    if not listed.isEmpty():
        return listed.select("pos", F.from_json("text", kind).alias("r")).select("pos", "r.*")
    # an empty list, one object, or no valid root
    value, root = F.try_parse_json("value"), F.substring(F.ltrim("value"), 1, 1)
    rows = F.when(root == "[", F.from_json("value", f"array<{kind}>")).when(root == "{", F.array(F.from_json("value", kind)))
    rows = rows.otherwise(F.raise_error(F.lit("the root is neither a list nor an object")))
    checked = F.when(value.isNull(), F.raise_error(F.lit("no valid JSON"))).otherwise(rows)
    return spark.read.text(path, wholetext=True).select(F.posexplode(checked).alias("pos", "r")).select("pos", "r.*")


def read_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of JSON lines: blank lines vanish, malformed ones are counted among the rejects (line)."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    good = parsed.where("r is not null and r._corrupt is null").select("r.*").drop("_corrupt")
    return good, parsed.where("r is null or r._corrupt is not null").select(F.col("value").alias("line"))


def write_lines(rows: DataFrame, path: str, by: str | None = None) -> None:
    """Compact JSON lines with explicit nulls, in a folder for each value of `by`."""
    writer = rows.write.mode("overwrite").option("ignoreNullFields", "false")
    (writer.partitionBy(by) if by else writer).json(path)


def write_array(rows: DataFrame, path: str, by: list[str]) -> None:
    """One file, in a folder, with all rows as one indented JSON list in the order of `by`, nulls explicit; no rows give an empty list.

    For programs that read nothing else: one task sorts (on disk, if need be) and streams all rows. Large data go to write_lines().
    """
    keys = [F.col(c).alias(f"__k{i}") for i, c in enumerate(by)]
    body = rows.select(F.lit(0).alias("__end"), *keys, F.to_json(F.struct("*"), {"ignoreNullFields": "false", "pretty": "true"}).alias("value"))
    end = rows.sparkSession.range(1).select(F.lit(1).alias("__end"))
    one = body.unionByName(end, allowMissingColumns=True).repartition(1).sortWithinPartitions("__end", *[f"__k{i}" for i in range(len(by))])
    one = one.withColumn("__n", F.monotonically_increasing_id())  # of the only partition; a column, as its value counts evaluations
    first = F.col("__n") == 0
    before = F.when(F.col("__end") == 1, F.when(first, "[]").otherwise("]")).otherwise(F.when(first, "[").otherwise(","))
    one.select(F.concat(before, F.coalesce("value", F.lit(""))).alias("value")).write.mode("overwrite").text(path)


def write_version(rows: DataFrame, store: str) -> str:
    """Write a new version of a store beside the old ones and return its path; a reader of the old one is never disturbed."""
    path = f"{store}/v-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return path


def done_names(spark: SparkSession, path: str, name: str = "mission_name") -> DataFrame:
    """(name): what a store holds already; nothing if there is none."""
    try:
        return spark.read.parquet(path).select(name).distinct()
    except AnalysisException:
        return spark.createDataFrame([], f"{name} string")


def prior_results(spark: SparkSession, path: str, record: str, name: str = "mission_name") -> tuple[DataFrame, DataFrame]:
    """(results, done names) of a JSON store of an earlier run; a missing or broken one counts as empty."""
    results = read_records(spark, path, record)
    return results, results.select(name).where(F.col(name).isNotNull()).distinct()


def write_metrics(spark: SparkSession, path: str, **metrics) -> None:
    """One flat JSON object."""
    spark.createDataFrame([metrics]).coalesce(1).write.mode("overwrite").json(path)
