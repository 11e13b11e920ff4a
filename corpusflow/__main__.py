"""python -m corpusflow: from index pages to records, from records to chains, from a file of results to samples in splits.

    python -m corpusflow scrape --pages pages.tsv --org NAME --style list|cards|tables --tools module:object --output folder [--match REGEX] [--base URL] [--category PART] [--again]
    python -m corpusflow generate --records folder --org NAME --url URL --model NAME --output folder [--again]
    python -m corpusflow dataset --input results.json --output folder
    each with [--filter PART] [--skip N] [--limit N]

`scrape` reads lines of an address, or of a category, a tab and an address, and keeps records in a store of snapshots at `folder/store`; entries in it are done already and passed over.
Beside it come `status` (JSON lines), `failures` and `metrics`. `--tools` names a plans.runs.Tools, which holds the search, the fetching and the reading of documents. `generate` does the
same with the results of a completion service, whose prompts come from such a store. `dataset` writes `samples` (JSON lines, a folder for each split), `array` (with --array) and `metrics`.
"""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import discover
from .operators.numbering import checkpoint
from .operators.relational import failures, keep_first, pick, run_summary
from .plans.runs import dataset, generate_chains, scrape
from .sources.files import read_results, write_array, write_lines, write_metrics
from .sources.html import absolutised
from .sources.http import completer
from .sources.keyed import KeyedStore

_QA = "struct<question: string, answer: string>"
RESULT = f"organisation string, organization string, mission_name string, source_url string, qa_chains array<struct<aspect: string, level_1: {_QA}, level_2: {_QA}, level_3: {_QA}>>"


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="corpusflow")
    commands = parser.add_subparsers(dest="command", required=True)
    scraped = commands.add_parser("scrape", help="records of the entries named on index pages")
    scraped.add_argument("--pages", required=True)
    scraped.add_argument("--style", required=True, choices=("list", "cards", "tables"))
    scraped.add_argument("--tools", required=True, help="module:object of the tools")
    scraped.add_argument("--match", default=".", help="what an address of an entry matches, for lists")
    scraped.add_argument("--base", default="", help="what relative addresses of cards stand below")
    scraped.add_argument("--category", default="", help="part of the categories to take, in any case")
    made = commands.add_parser("generate", help="chains of the records of a store")
    made.add_argument("--records", required=True)
    made.add_argument("--url", required=True, help="of the completion service")
    made.add_argument("--model", required=True)
    run = commands.add_parser("dataset", help="samples in splits from a file of results")
    run.add_argument("--input", required=True)
    run.add_argument("--array", action="store_true", help="also write all samples as one JSON list")
    for p in (scraped, made):
        p.add_argument("--org", required=True)
        p.add_argument("--again", action="store_true", help="also entries that are done")
    for p in (scraped, made, run):
        p.add_argument("--output", required=True)
        p.add_argument("--filter", default="", help="part of the names to take, in any case")
        p.add_argument("--skip", type=int, default=0, help="entries to pass over")
        p.add_argument("--limit", type=int, default=0, help="entries to take at most; 0: all")
    return parser.parse_args(given)


def _object(name: str):
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _scrape(a: argparse.Namespace, spark: SparkSession) -> int:
    tools = _object(a.tools)
    parts = F.split("value", "\t", 2)
    listed = spark.read.text(a.pages).where(F.trim("value") != "").select(F.element_at(parts, -1).alias("url"), F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise("").alias("category"))
    pages = checkpoint(tools.pages(listed).where("body is not null").select("url", "category", F.col("body").cast("string").alias("html")))
    if a.style == "list":
        refs = absolutised(discover.listed(pages, "url", a.match).withColumn("page", F.col("url")), "page").select(F.col("page"), "pos", "name", F.col("url").alias("source_url")).withColumnRenamed("page", "url")
    elif a.style == "cards":
        refs = discover.carded(pages, "url", a.base)
    else:
        refs = discover.in_categories(pages.withColumn("page", F.col("url")), "page", "category", "url").withColumn("pos", F.col("at")).drop("at").withColumnRenamed("page", "url")
    refs = refs.withColumn("at", F.struct("url", "pos")).drop("url", "pos")
    refs = keep_first(refs, [F.lower("name")] + ([F.col("category")] if a.category else []), ["at"])
    chosen = pick(refs, "at", "name", a.filter, a.category, a.skip, a.limit)
    store = KeyedStore(spark, f"{a.output}/store", ["mission_name"])
    held = store.read()
    if held is not None and not a.again:
        chosen = chosen.join(held.select(F.col("mission_name").alias("name")), "name", "left_anti")
    records, status = scrape(checkpoint(chosen.drop("at")), a.org, a.style, tools)
    store.upsert(records, ["scraped_at"])
    status = checkpoint(status)
    write_lines(status, f"{a.output}/status")
    write_lines(failures(status), f"{a.output}/failures")
    write_metrics(spark, f"{a.output}/metrics", **run_summary(status).first().asDict())
    return 0


def _generate(a: argparse.Namespace, spark: SparkSession) -> int:
    records = KeyedStore(spark, a.records, ["mission_name"]).read()
    if records is None:
        print(f"no records at {a.records}", file=sys.stderr)
        return 1
    records = pick(records.withColumn("pos", F.col("mission_name")), "pos", "mission_name", a.filter, skip=a.skip, limit=a.limit)
    store = KeyedStore(spark, f"{a.output}/store", ["mission_name"])
    held = store.read()
    done = held.select("mission_name") if held is not None and not a.again else spark.createDataFrame([], "mission_name string")
    store.upsert(generate_chains([(a.org, records)], done, completer(a.url, a.model)), ["scraped_at"])
    results = store.read()
    write_metrics(spark, f"{a.output}/metrics", results=results.count() if results is not None else 0)
    return 0


def _dataset(a: argparse.Namespace, spark: SparkSession) -> int:
    results = pick(read_results(spark, a.input, RESULT), "pos", "mission_name", a.filter, skip=a.skip, limit=a.limit)
    samples, _, counts = dataset(results)
    write_lines(samples.drop("level"), f"{a.output}/samples", by="split")
    if a.array:
        write_array(samples.drop("level", "split"), f"{a.output}/array", ["sample_id"])
    write_metrics(spark, f"{a.output}/metrics", **counts.first().asDict())
    return 0


def main(given: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or 1 if there is no such input."""
    a = arguments(given)
    spark = spark or SparkSession.builder.appName("corpusflow").getOrCreate()
    try:
        return {"scrape": _scrape, "generate": _generate, "dataset": _dataset}[a.command](a, spark)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        print(f"no such input: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
