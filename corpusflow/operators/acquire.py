"""Choosing an entry's document: candidates in order, the first that is valid, and what to fall back on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_document_url

RESULTS, SNIFFED, SNIFF_BYTES = 15, 6, 80_000
#: Tiers in order.
TIERS = ("search_document", "page_document", "page_text", "table_only")


def query(org: str, name: Column) -> Column:
    return F.concat(F.lit(f"{org} mission Report pdf "), name)


def candidates(results: DataFrame, sniffed: DataFrame, key: str) -> DataFrame:
    """(key, urls) from search results (key, rank, url) and links found on result pages (key, rank, url): documents in the order of the
    results, then links that are not among them in the order of the pages; a link found twice stays twice."""
    top = results.where(F.col("rank") < RESULTS)
    direct = top.where(is_document_url(F.col("url"))).select(key, F.lit(0).alias("late"), "rank", "url")
    late = sniffed.join(direct.select(key, "url").distinct(), [key, "url"], "left_anti").select(key, F.lit(1).alias("late"), "rank", "url")
    all_ = direct.unionByName(late)
    return all_.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("late", "rank", "url"))), lambda x: x["url"]).alias("urls"))


def to_sniff(results: DataFrame, key: str) -> DataFrame:
    """The first pages among the results that are no documents themselves."""
    pages = results.where((F.col("rank") < RESULTS) & ~is_document_url(F.col("url")) & (F.col("url") != ""))
    return pages.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("rank"))).where(F.col("n") <= SNIFFED).drop("n")


def sniff(body: Column) -> Column:
    """The part of a page in which a link is looked for."""
    return F.substring(body, 1, SNIFF_BYTES).cast("string")


def first_document(links: DataFrame, key: str) -> DataFrame:
    """(key, url): the first link of (key, pos, href, url) to a document."""
    return links.where(F.endswith(F.lower("href"), F.lit(".pdf"))).groupBy(key).agg(F.min_by("url", "pos").alias("url"))


def first_valid(blobs: DataFrame, key: str, rank: str, valid: Column) -> DataFrame:
    """The valid row of least rank of each key, of documents that are there already."""
    row = F.struct(*blobs.columns)
    return blobs.where(valid).groupBy(key).agg(F.min_by(row, rank).alias("r")).select("r.*")


def fetched(entries: DataFrame, key: str, urls: str, fetch: Callable[[str], bytes | None]) -> DataFrame:
    """(key, url, content): the first URL of each entry whose bytes are a document; later ones are never asked for. Entries that got none
    have null. The caller's fetch() decides on retries and limits; an error counts as nothing."""
    kind = entries.schema[key].dataType.simpleString()

    def one(urls_: list[str] | None) -> tuple[str | None, bytes | None]:
        for url in urls_ if urls_ is not None else []:
            try:
                data = fetch(url)
            except Exception:
                continue
            if data and len(data) <= 60_000_000 and data[:4] == b"%PDF":
                return url, data
        return None, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, us in zip(batch[key], batch[urls]):  # a document can be large: it is handed over before the next is fetched
                url, content = one(us)
                yield pd.DataFrame({key: [k], "url": [url], "content": [content]})

    return entries.select(key, urls).repartition(key).mapInPandas(run, f"{key} {kind}, url string, content binary")


def tiers(entries: DataFrame, found: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """entries with `tier` and `value`: the value of the first tier (name, (key, value)) that has one; without any the tier is no_data."""
    rows = entries
    for i, (_, table) in enumerate(found):
        rows = rows.join(table.select(key, F.col("value").alias(f"__v{i}")), key, "left")
    tier = F.coalesce(*[F.when(F.col(f"__v{i}").isNotNull(), name) for i, (name, _) in enumerate(found)], F.lit("no_data"))
    value = F.coalesce(*[F.col(f"__v{i}") for i in range(len(found))])
    return rows.withColumns({"tier": tier, "value": value}).drop(*[f"__v{i}" for i in range(len(found))])


def pages_of(documents: DataFrame, key: str, content: str, read: Callable[[bytes], list[str]], ocr: Callable[[bytes, int], str] | None = None, least: int = 50) -> DataFrame:
    """(key, page, text, ocr): pages of documents by an injected reader; OCR, if there is one, for pages with little text."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, data in zip(batch[key], batch[content]):
                try:
                    texts = [t.strip() for t in read(data)]
                except Exception:
                    continue
                rows = [(k, i, t, ocr(data, i) if ocr and len(t) < least else None) for i, t in enumerate(texts)]
                yield pd.DataFrame(rows, columns=[key, "page", "text", "ocr"])

    return documents.select(key, content).mapInPandas(run, f"{key} {kind}, page int, text string, ocr string")
