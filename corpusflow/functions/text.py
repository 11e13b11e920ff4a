"""Text expressions with the rules of Python's str methods, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every code point that Python's isspace() holds for.
SPACE = r"\p{Z}\s\x1c-\x1f\x85"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def squeeze(x: Column) -> Column:
    """Runs of white space become one blank, ends lose theirs."""
    return strip(F.regexp_replace(x, rf"[{SPACE}]+", " "))


def present(x: Column) -> Column:
    """Null for the empty string, so that coalesce() works as `or`."""
    return F.nullif(x, F.lit(""))


def or_empty(*xs: Column) -> Column:
    return F.coalesce(*[present(x) for x in xs], F.lit(""))


def head(x: Column, n: int) -> Column:
    return F.substring(x, 1, n)


def holds(x: Column, part: str) -> Column:
    """Whether a literal occurs, whatever the case; `%` and `_` mean themselves."""
    return F.contains(F.lower(x), F.lower(F.lit(part)))


def slug(*xs: Column) -> Column:
    """ASCII letters and digits of each, joined by underscores. Not injective: `A-B` and `AB` are equal."""
    return F.concat_ws("_", *[F.regexp_replace(F.coalesce(x, F.lit("")), "[^A-Za-z0-9]", "") for x in xs])


def chain_id(source_id: Column, position: Column) -> Column:
    """position counts from 0; three digits at least."""
    return F.concat(source_id, F.lit("_"), F.format_string("%03d", position + 1))


def sample_id(number: Column, prefix: str = "SPC") -> Column:
    """Six digits at least."""
    return F.format_string(f"{prefix}_%06d", number)


def after_reasoning(x: Column) -> Column:
    """What follows the first closing tag where both tags of a reasoning block occur."""
    close = "</think>"
    tail = F.substr(x, F.locate(close, x) + len(close))
    return F.when(F.contains(x, F.lit("<think>")) & F.contains(x, F.lit(close)), strip(tail)).otherwise(x)


def first_match(x: Column, patterns: list[str], limit: int = 300) -> Column:
    """Group 1 of the first pattern that matches, even if nothing is left of it; '' without a match."""
    out = None
    for p in patterns:
        value = head(squeeze(F.regexp_extract(x, p, 1)), limit)
        out = F.when(x.rlike(p), value) if out is None else out.when(x.rlike(p), value)
    return F.coalesce(out.otherwise(F.lit("")), F.lit("")) if out is not None else F.lit("")


def timestamp_text(x: Column) -> Column:
    """ISO-8601 with microseconds and offset."""
    return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def is_document_url(url: Column) -> Column:
    """Whether a URL points at a PDF: by its path's end, a /pdf directory, or its query."""
    parts = r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)(?:\?([^#]*))?"
    path = F.lower(F.regexp_replace(F.regexp_extract(url, parts, 1), ";[^/]*$", ""))
    query = F.lower(F.regexp_extract(url, parts, 2))
    by_path = F.endswith(path, F.lit(".pdf")) | (F.contains(path, F.lit("/pdf")) & F.endswith(path, F.lit("/")))
    return F.coalesce(by_path | F.contains(query, F.lit("format=pdf")) | F.contains(query, F.lit("type=pdf")), F.lit(False))


def is_document(content: Column, content_type: Column | None = None, most: int = 60_000_000) -> Column:
    """Whether bytes are a PDF of bounded size; a type that says html and not pdf rules it out."""
    fine = (F.octet_length(content) <= most) & (F.substring(content, 1, 4) == F.lit(b"%PDF"))
    if content_type is not None:
        kind = F.lower(F.coalesce(content_type, F.lit("")))
        fine &= ~(F.contains(kind, F.lit("html")) & ~F.contains(kind, F.lit("pdf")))
    return F.coalesce(fine, F.lit(False))


def duration(seconds: Column) -> Column:
    """`<n>s` below a minute, else H:MM."""
    whole = F.floor(seconds)
    long = F.concat(F.floor(whole / 3600).cast("string"), F.lit(":"), F.format_string("%02d", F.floor(whole % 3600 / 60)))
    return F.when(whole < 60, F.concat(whole.cast("string"), F.lit("s"))).otherwise(long)
