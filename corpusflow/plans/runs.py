"""Whole runs: from index pages to records, from records to question-answer chains, from chains to splits, from splits to training examples."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import timestamp_text
from ..operators import acquire, generate, prepare, relational, samples, split, structure
from ..operators.numbering import checkpoint
from ..sources.html import absolutised, blocks, html_links, html_nodes, links
from ..sources.http import fetch_pages, search
from ..sources.polite import Politeness, fetch_politely

Get = Callable[[str], tuple[int, str, bytes]]


@dataclass(frozen=True)
class Tools:
    """What a run calls outside: a search service, a fetcher (status, type, body), a reader of a document's pages, OCR of one page."""

    ask: Callable[[str], list[dict]]
    fetch: Get
    read: Callable[[bytes], list[str]]
    ocr: Callable[[bytes, int], str] | None = None
    peek: Get | None = None  #: fetches the start of a page, where links are looked for; without it `fetch` does
    polite: Politeness | None = None  #: with it pages are fetched by sessions at a host's rate, in place of `fetch` and `peek`; documents by `fetch`
    search_pause: float = 0.0  #: seconds between two searches
    tasks: int | None = None  #: that fetch at a time

    def pages(self, urls: DataFrame, start_only: bool = False) -> DataFrame:
        if self.polite is not None:
            return fetch_politely(urls, limits=self.polite, parallel=self.tasks)
        return fetch_pages(urls, fetch=(self.peek or self.fetch) if start_only else self.fetch, parallel=self.tasks)


def _body(fetch: Get) -> Callable[[str], bytes | None]:
    def get(url: str) -> bytes | None:
        status, kind, body = fetch(url)
        kind = (kind or "").lower()
        return body if status == 200 and not ("html" in kind and "pdf" not in kind) else None

    return get


def _parsed(pages: DataFrame) -> DataFrame:
    """The elements of fetched pages, kept: links and texts are taken from them."""
    return checkpoint(html_nodes(pages.where("body is not null").select("name", F.col("body").cast("string").alias("html")), "name"))


def _page_texts(parsed: DataFrame, extra: tuple[str, ...]) -> DataFrame:
    """(name, texts): the blocks of over 30 characters."""
    found = blocks(parsed, "name", extra=extra).where(F.length("text") > 30)
    return found.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("texts"))


def scrape(refs: DataFrame, org: str, style: str, tools: Tools, extra: tuple[str, ...] = (), clock: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, status) of entries (name, source_url, and a table's fields).

    Documents are looked for by search, then on the entry's page; entries without one take the page's text, and, for tables, what the
    table says of them. Each tier runs for the entries that the tiers before missed; what it fetched is kept before it is used again.
    """
    results = checkpoint(search(refs.select(acquire.query(org, F.col("name")).alias("q")), "q", tools.ask, acquire.RESULTS, tools.search_pause))
    results = refs.select("name", acquire.query(org, F.col("name")).alias("q")).join(results, "q").select("name", "rank", "url")
    sniffed = tools.pages(acquire.to_sniff(results, "name"), start_only=True).where("body is not null").select("name", "rank", F.col("url").alias("page"), acquire.sniff(F.col("body")).alias("html"))
    on_pages = html_links(sniffed.withColumn("k", F.concat_ws("\n", "name", "rank", "page")), "k").where(F.endswith(F.lower("href"), F.lit(".pdf")))
    first = on_pages.groupBy("k").agg(F.min_by("href", "pos").alias("href")).withColumn("p", F.split("k", "\n"))
    first = absolutised(first.select(F.get("p", F.lit(0)).alias("name"), F.get("p", F.lit(1)).cast("int").alias("rank"), F.get("p", F.lit(2)).alias("page"), "href"), "page").select("name", "rank", "url")
    found = checkpoint(acquire.fetched(acquire.candidates(results, first, "name"), "name", "urls", _body(tools.fetch))).where("content is not null")

    missed = refs.join(found.select("name"), "name", "left_anti").where(F.coalesce("source_url", F.lit("")) != "").select("name", F.col("source_url").alias("url"))
    pages = checkpoint(tools.pages(missed))
    parsed = _parsed(pages)
    linked = links(parsed, "name").join(pages.select("name", F.col("url").alias("page")), "name")
    own = absolutised(linked.where(F.endswith(F.lower("href"), F.lit(".pdf"))), "page").groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "url"))), lambda x: x["url"]).alias("urls"))
    own = own.withColumn("urls", F.col("urls") if style == "tables" else F.slice("urls", 1, 1))  # tables try all of a page's documents
    found = found.unionByName(checkpoint(acquire.fetched(own, "name", "urls", _body(tools.fetch))).where("content is not null"))

    read = acquire.pages_of(found, "name", "content", tools.read, tools.ocr)
    label = structure.page_method(F.col("text"), F.col("ocr"), label_blank=style != "tables")
    read = read.select("name", "page", F.when(F.col("ocr").isNotNull(), F.col("ocr")).otherwise(F.col("text")).alias("text"), label.alias("label"))
    documents = checkpoint(read).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("page", "text", "label"))).alias("x"))
    documents = documents.select("name", F.transform("x", lambda x: x["text"]).alias("pages"), structure.method(F.transform("x", lambda x: x["label"])).alias("method"))
    documents = documents.join(found.select("name", F.col("url").alias("pdf_url"), F.md5("content").alias("pdf_checksum")), "name")

    rest = refs.join(documents.select("name"), "name", "left_anti")
    unread = rest.join(pages.select("name"), "name", "left_anti").where(F.coalesce("source_url", F.lit("")) != "").select("name", F.col("source_url").alias("url"))
    late = _parsed(tools.pages(unread))  # entries whose document could not be read
    late = late.repartition(max(1, late.rdd.getNumPartitions()))  # a kept table claims partitions by key that it need not have, and a union would pair them
    texts = _page_texts(parsed.unionByName(late).join(rest.select("name"), "name", "left_semi"), extra).select("name", F.col("texts").alias("pages"), F.lit("webpage").alias("method"))
    done = documents.unionByName(texts, allowMissingColumns=True)
    if style == "tables":
        bare = refs.join(done.select("name"), "name", "left_anti")
        said = structure.minimal_pages(F.col("name"), *[(label, F.col(c)) for label, c in (("Launch Date", "launch_date"), ("Launch Vehicle", "launch_vehicle"), ("Remarks", "remarks")) if c in refs.columns])
        done = done.unionByName(bare.select("name", said.alias("pages"), F.lit("table_only").alias("method")), allowMissingColumns=True)
    now = timestamp_text(clock if clock is not None else F.current_timestamp())
    entries = refs.join(done, "name").withColumns({"mission_name": F.col("name"), "org": F.lit(org), "scraped_at": now})
    records = structure.records(entries.drop("name"), style)
    status = refs.select("name").join(records.select(F.col("mission_name").alias("name"), F.col("extraction.method").alias("method"), F.col("data_source").alias("source")), "name", "left")
    return records, status.select("name", F.when(F.col("method").isNull(), "failed").otherwise("ok").alias("status"), F.coalesce("method", F.lit("no_data")).alias("method"), F.coalesce("source", F.lit("")).alias("source"))


def generate_chains(sources: list[tuple[str, DataFrame]], done: DataFrame, complete: Callable[[pd.Series], list[str]], pos: str = "pos", keys: tuple[str, ...] = ("mission_name",)) -> DataFrame:
    """Results for the records that aren't done, in the order of the sources; append them to what `done` came from."""
    rows = relational.not_done(relational.union_sources(sources), done, list(keys), ["src_pos", pos])
    parts = {k: F.col(f"structured.{k}") for k in structure.SECTIONS}
    context = structure.context(F.col("mission_name"), parts, F.col("extraction.full_text"))
    wanted = rows.select(F.col("org").alias("organisation"), F.coalesce("mission_name", F.lit("Unknown")).alias("mission_name"), F.coalesce("source_url", F.lit("")).alias("source_url"), F.coalesce("scraped_at", F.lit("")).alias("scraped_at"), context.alias("context"))
    return generate.chains(wanted, complete)


def dataset(results: DataFrame, pos: str = "pos") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(samples with split, assignment, accounting) of nested results."""
    flat = checkpoint(samples.flatten(results, pos))
    found = split.chains(flat, "chain_id", ["organization", "mission_name"], ["sample_id"])
    assigned = split.assign(found, org="organization").drop("first")
    ordered = split.attach(flat, assigned).withColumn("level", split.difficulty_order(F.col("difficulty")))
    return ordered, assigned, samples.accounting(results, pos)


def training(samples_: DataFrame, tokenizer: Callable[[pd.Series], list[list[int]]] = prepare.word_tokens, batch: int = prepare.BATCH) -> DataFrame:
    """Padded batches of `batch` examples of about equal length; an error if no sample can be used."""
    rows = checkpoint(prepare.examples(samples_, "sample_id", tokenizer=tokenizer))
    if rows.isEmpty():
        raise ValueError("no usable sample")
    return prepare.padded(prepare.batched(rows, "sample_id", batch), "batch")


__all__ = ["Tools", "dataset", "generate_chains", "scrape", "training"]
