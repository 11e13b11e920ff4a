"""Records out of extracted texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import FIELDS
from ..functions.text import first_match, head, or_empty, present, strip

STORED = 60_000
SECTIONS = ("objective", "summary", "launch_date", "end_date", "agency", "spacecraft", "orbit", "instruments")


def summary(pages: Column, least: int = 100, most: int = 500) -> Column:
    """The first page of at least `least` characters, cut; '' without one."""
    return F.coalesce(head(F.get(F.filter(pages, lambda p: F.length(p) >= least), F.lit(0)), most), F.lit(""))


def page_method(text: Column, ocr: Column | None = None, least: int = 50, label_blank: bool = True) -> Column:
    """How a page was read: its own text if long enough, else OCR if that gave a text, else `text` or, where blank pages are not labelled, null."""
    other = F.lit("text") if label_blank else F.lit(None).cast("string")
    read = F.when(ocr.isNotNull(), "ocr").otherwise(other) if ocr is not None else other
    return F.when(F.length(text) >= least, "text").otherwise(read)


def method(labels: Column) -> Column:
    """Of a document from its pages' labels: none, the one there is, or mixed."""
    kinds = F.array_distinct(F.filter(labels, lambda x: x.isNotNull()))
    return F.when(F.size(kinds) == 0, "none").when(F.size(kinds) == 1, F.get(kinds, F.lit(0))).otherwise("mixed")


def extraction(pages: Column, labels: Column) -> Column:
    return F.struct(pages.alias("pages"), method(labels).alias("method"), F.size(pages).alias("page_count"))


def full_text(pages: Column) -> Column:
    return F.array_join(pages, "\n")


def fields(text: Column, style: str, overrides: dict[str, Column] | None = None) -> dict[str, Column]:
    """Each field's value in the untruncated text; a value of the entry's table comes first where there is one."""
    out = {k: first_match(text, patterns) for k, patterns in FIELDS[style].items()}
    return out | {k: or_empty(v, out[k]) for k, v in (overrides or {}).items()}


def records(entries: DataFrame, style: str) -> DataFrame:
    """Mission records from (mission_name, pdf_url, pages, method, scraped_at, and what else a source has).

    Where data come from follows from the tier that was used: `pdf` with a document URL, else `webpage`.
    """
    text = full_text(F.col("pages"))
    table = {c: F.col(c) for c in ("launch_date", "orbit") if style == "tables" and c in entries.columns}
    found = fields(F.col("__text"), style, table)
    structured = F.struct(*[v.alias(k) for k, v in found.items()], summary(F.col("pages")).alias("summary"))
    stored = F.struct(F.col("method"), F.size("pages").alias("page_count"), head(F.col("__text"), STORED).alias("full_text"))
    url = F.coalesce(F.col("pdf_url"), F.lit(""))
    rows = entries.withColumn("__text", text)
    rows = rows.withColumns({"extraction": stored, "structured": structured, "data_source": F.when(url != "", "pdf").otherwise("webpage"), "pdf_url": url})
    return rows.drop("__text", "pages", "method")


def minimal_pages(name: Column, *labelled: tuple[str, Column]) -> Column:
    """Pages of an entry of which only its table row is known: one line for each field."""
    return F.array(F.concat(F.lit("Mission: "), name), *[F.concat(F.lit(f"{label}: "), F.coalesce(x, F.lit(""))) for label, x in labelled])


def context(name: Column, parts: dict[str, Column], text: Column, least: int = 50, most: int = 2000) -> Column:
    """What a model is told of an entry: its name, a titled line for each field there is, and the head of a longer text."""
    lines = [F.concat(F.lit("Mission: "), F.coalesce(name, F.lit("Unknown")))]
    lines += [F.concat(F.lit(f"{k.replace('_', ' ').title()}: "), present(v)) for k, v in parts.items()]
    lines.append(F.when(F.length(text) > least, F.concat(F.lit("Details:\n"), strip(head(text, most)))))
    return F.concat_ws("\n", *lines)
