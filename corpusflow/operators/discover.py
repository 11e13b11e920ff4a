"""Entries named on index pages: in links, cards, tables or headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..sources.html import CARD, CELL, LINK, absolutised, cards_of, cells, cells_of, has, headings_of, html_links, html_nodes, links_of, rows_of
from .numbering import checkpoint
from .relational import fallback, keep_first

# Fields by a cell's CSS class, and by position for each number of columns.
CLASS_FIELDS = {
    "SatelliteName": "name",
    "MissionName": "name",
    "Mission_Name": "name",
    "LaunchVehicle": "launch_vehicle",
    "Date_of_Launch": "launch_date",
    "Date_Of_Launch": "launch_date",
    "LaunchDate": "launch_date",
    "Launch_Date": "launch_date",
    "Country": "country",
    "Mass_Kg": "mass_kg",
    "Mass": "mass_kg",
    "Launch_Vehicle": "launch_vehicle",
    "LaunchVehicleName": "launch_vehicle",
    "Orbit": "orbit",
    "Remarks": "remarks",
    "Remark": "remarks",
    "counter": "_sl",
    "SNo": "_sl",
}
LAYOUTS = {
    2: ["_sl", "name"],
    3: ["_sl", "name", "launch_date"],
    4: ["_sl", "name", "launch_date", "remarks"],
    5: ["_sl", "name", "launch_date", "launch_vehicle", "remarks"],
    6: ["_sl", "name", "country", "launch_date", "mass_kg", "launch_vehicle"],
}
NOTHING = ("", "-", "–", "N/A", "NA")
SECTIONS = r"(?i)/(?:Applications|Science_Exploration|Enabling_Support|Observing_the_Earth)/"
RELATED = r"(?i)mission|satellite|spacecraft|launch"
TABLE_FIELDS = ("launch_date", "launch_vehicle", "country", "mass_kg", "orbit", "remarks")


def layout(n_cols: Column) -> Column:
    """The number of columns whose layout is nearest."""
    return F.least(F.greatest(n_cols, F.lit(min(LAYOUTS))), F.lit(max(LAYOUTS)))


def _literal(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def listed(pages: DataFrame, key: str, url: str, html: str = "html") -> DataFrame:
    """(key, pos, name, href) of the first link of each paragraph whose address matches `url`; names of 3 characters at least, the first of each."""
    rows = html_links(pages, key, html, within="p").select(key, "pos", strip(F.col("text")).alias("name"), "href")
    rows = rows.where(F.col("href").rlike(url) & (F.length("name") >= 3))
    return keep_first(rows, [F.col(key), F.lower("name")], ["pos"])


def carded(pages: DataFrame, key: str, base: str, html: str = "html", sections: str = SECTIONS) -> DataFrame:
    """(key, pos, name, source_url, description, pillar) of cards; of links into `sections` on pages without any card."""
    shown = lambda rows: keep_first(rows.where(F.length("name") >= 2), [F.col(key), F.lower("name")], ["pos"])
    url = F.when(F.startswith("href", F.lit("http")), F.col("href")).otherwise(F.concat(F.lit(base), F.col("href")))
    kept = checkpoint(html_nodes(pages, key, html).select(key, cards_of().alias("cards"), links_of().alias("links")))
    primary = rows_of(kept, key, F.col("cards"), *CARD).select(key, "pos", strip(F.col("name")).alias("name"), url.alias("source_url"), "description", "pillar")
    second = rows_of(kept, key, F.col("links"), *LINK).where(F.col("href").rlike(sections))
    second = second.select(key, "pos", strip(F.col("text")).alias("name"), url.alias("source_url"), F.lit("").alias("description"), F.lit("").alias("pillar"))
    return fallback(shown(primary), shown(second), key)


def tabled(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """rows_of_tables() of pages."""
    return rows_of_tables(cells(html_nodes(pages, key, html), key), key)


def rows_of_tables(found: DataFrame, key: str) -> DataFrame:
    """(key, tbl, row, href, fields: map) of the table rows of cells that have a name of 2 characters at least.

    A cell's field is that of its first known class; a later cell of the same field wins. Rows without any known class go by
    position, surplus cells are col_<i>. Cells that say nothing are left out.
    """
    known = _literal(CLASS_FIELDS)
    field = F.get(F.filter(F.transform("classes", lambda c: F.try_element_at(known, c)), lambda f: f.isNotNull()), F.lit(0))
    place = F.array(*[F.array(*map(F.lit, LAYOUTS[n])) for n in sorted(LAYOUTS)])
    by_place = F.coalesce(F.get(F.get(place, layout(F.col("n_cols")) - 2), F.col("col")), F.concat(F.lit("col_"), F.col("col").cast("string")))
    shown = found.select(key, "tbl", "row", "col", "text", "href", field.alias("by_class"), by_place.alias("by_place"))
    rows = shown.groupBy(key, "tbl", "row").agg(
        F.array_sort(F.collect_list(F.when(F.col("by_class").isNotNull() & (F.col("by_class") != "_sl"), F.struct("col", F.col("by_class").alias("field"), "text")))).alias("classed"),
        F.array_sort(F.collect_list(F.when(F.col("by_place") != "_sl", F.struct("col", F.col("by_place").alias("field"), "text")))).alias("placed"),
        F.min_by(F.when(F.col("href") != "", F.col("href")), F.when(F.col("href") != "", F.col("col"))).alias("href"),
    )
    chosen = F.when(F.size("classed") > 0, F.col("classed")).otherwise(F.col("placed"))
    last = F.aggregate(chosen, F.expr("cast(map() as map<string,string>)"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, v: k != x["field"]), F.create_map(x["field"], strip(x["text"]))))
    said = F.map_filter(last, lambda k, v: ~v.isin(*NOTHING))
    return rows.select(key, "tbl", "row", "href", said.alias("fields")).where(F.length(F.try_element_at("fields", F.lit("name"))) >= 2)


def in_categories(pages: DataFrame, key: str, category: str, base: str, html: str = "html") -> DataFrame:
    """(category, pos, name, source_url, table fields, extra): rows of a page's tables; its links where it has no table; its headings
    where it has neither. A page with tables that give no row has none. The first of each name and category stays."""
    names = ["name", *TABLE_FIELDS]
    get = lambda k: F.coalesce(F.try_element_at("fields", F.lit(k)), F.lit("")).alias(k)
    extra = F.map_filter("fields", lambda k, v: ~k.isin(*names))
    # each page is parsed once, and only what can be an entry is kept: an unclosed heading holds the rest of its page
    entry = lambda x, i, href: F.struct(i.alias("row"), href.alias("href"), strip(x["text"]).alias("name"))
    linked = F.filter(F.transform(links_of(), lambda x, i: entry(x, i, x["href"])), lambda x: x["href"].rlike(RELATED) & (F.length(x["name"]) >= 3))
    bold = F.filter(F.transform(headings_of(), lambda x, i: entry(x, i, F.lit(""))), lambda x: F.length(x["name"]).between(4, 120))
    kept = html_nodes(pages, key, html).select(key, cells_of().alias("cells"), linked.alias("links"), bold.alias("headings"), has("table").alias("table"))
    kept = checkpoint(kept)
    first = rows_of_tables(rows_of(kept, key, F.col("cells"), *CELL), key).select(key, F.struct("tbl", "row").alias("at"), F.coalesce("href", F.lit("")).alias("href"), *[get(k) for k in names], extra.alias("extra"))
    with_tables = kept.where("table").select(key).union(pages.where(F.lower(html).contains("<table")).select(key)).distinct()
    plain = kept.join(with_tables, key, "left_anti")
    at = F.struct(F.lit(0).alias("tbl"), "row").alias("at")
    linked, bold = (rows_of(plain, key, F.col(c), "row", "href", "name").select(key, at, "href", "name") for c in ("links", "headings"))
    linked = keep_first(linked, [F.col(key), F.lower("name")], ["at"])
    found = first.unionByName(fallback(linked, bold, key), allowMissingColumns=True)
    found = found.join(pages.select(key, category, base), key)
    found = keep_first(found, [F.lower("name"), F.col(category)], [key, "at"])
    resolved = absolutised(found, base).withColumn("source_url", F.when(F.col("href") != "", F.col("url")).otherwise(""))
    return resolved.drop("url", "href", base)
