"""Operators on entries whatever their source: keep-first, filters, difference, upsert, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import holds
from .numbering import number


def keep_first(rows: DataFrame, keys: list[Column], pos: list[str]) -> DataFrame:
    """The first row by `pos` of each key, as a min_by over the key: partial minima before the shuffle, no window."""
    names = [f"__k{i}" for i in range(len(keys))]
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    named = rows.select(*[k.alias(n) for k, n in zip(keys, names)], row.alias("__row"), F.struct(*pos).alias("__pos"))
    return named.groupBy(*names).agg(F.min_by("__row", "__pos").alias("__row")).select("__row.*")


def pick(rows: DataFrame, pos: str, name: str = "name", like: str = "", category: str = "", skip: int = 0, limit: int = 0) -> DataFrame:
    """Category filter, then name filter (literal parts, any case), then skip, then limit, in the order of `pos`; a limit of 0 is none."""
    if category:
        rows = rows.where(holds(F.col("category"), category))
    if like:
        rows = rows.where(holds(F.col(name), like))
    if skip or limit:
        rows = rows.orderBy(pos)
        rows = rows.offset(skip) if skip else rows
        rows = rows.limit(limit) if limit else rows
    return rows


def not_done(rows: DataFrame, done: DataFrame, keys: list[str], pos: list[str]) -> DataFrame:
    """Rows whose key isn't done, the first of each key."""
    return keep_first(rows.join(done.select(*keys).distinct(), keys, "left_anti"), [F.col(k) for k in keys], pos)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by `order`, new ones after old ones."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    row = F.struct(*[c for c in both.columns if c != "__new"])
    return both.groupBy(*keys).agg(F.max_by(row, F.struct("__new", *order)).alias("__row")).select("__row.*")


def merge_fields(rows: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """For each key the last value that isn't null of each field, by `order`: an absent field leaves the old value, '' replaces it."""
    at = F.struct(*order)
    return rows.groupBy(*keys).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields])


def saved(status: DataFrame, store: DataFrame, name: str = "name", category: str = "") -> DataFrame:
    """Records of a keyed store (key, fields) for the entries of status that went well, by name or by `category::name`."""
    key = F.concat_ws("::", category, name) if category else F.col(name)
    return store.join(status.where(F.col("status") == "ok").select(key.alias("key")).distinct(), "key", "left_semi")


def union_sources(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Bag union in order, with `org` and `src_pos`; columns that a source lacks are null."""
    out = None
    for i, (org, rows) in enumerate(sources):
        rows = rows.withColumn("org", F.lit(org)).withColumn("src_pos", F.lit(i))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def fallback(primary: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """primary, and for keys that it lacks the rows of second."""
    return primary.unionByName(second.join(primary.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def report(rows: DataFrame, dims: list[str], pos: str) -> DataFrame:
    """(dim, value, n, rank): counts of each dimension by falling count, ties by first appearance."""
    out = None
    for d in dims:
        one = rows.groupBy(F.col(d).cast("string").alias("value")).agg(F.count("*").alias("n"), F.min(pos).alias("first")).select(F.lit(d).alias("dim"), "*")
        out = one if out is None else out.unionByName(one)
    return number(out.withColumn("__fall", -F.col("n")), ["__fall", "first"], ["dim"], "rank").drop("first", "__fall")


def run_summary(status: DataFrame) -> DataFrame:
    """(total, ok_document, ok_other, failed) of (name, status, method, source); failures() names what failed."""
    ok = F.col("status") == "ok"
    return status.agg(F.count("*").alias("total"), F.count_if(ok & (F.col("source") == "pdf")).alias("ok_document"), F.count_if(ok & (F.col("source") != "pdf")).alias("ok_other"), F.count_if(~ok).alias("failed"))


def failures(status: DataFrame) -> DataFrame:
    """(n, name): the entries that failed, by name, numbered from 1."""
    return number(status.where(F.col("status") != "ok").select("name"), ["name"]).select("n", "name")


def run_report(status: DataFrame) -> DataFrame:
    """(total, ok_document, ok_other, failed, n, failed_name): run_summary() beside each of failures(); one row without a name if nothing failed."""
    counts = run_summary(status)
    named = failures(status).select("n", F.col("name").alias("failed_name")).crossJoin(F.broadcast(counts)).select(*counts.columns, "n", "failed_name")
    return named.unionByName(counts.where("failed = 0"), allowMissingColumns=True)


def listing(rows: DataFrame, category: str, name: str, pos: str) -> DataFrame:
    """(category, n, name): names in order of appearance, numbered from 1 in each category."""
    return number(rows.select(category, name, pos), [pos], [category]).select(category, "n", name)


def progress(durations: DataFrame, pos: str, seconds: str, total: int, block: int = 1 << 16) -> DataFrame:
    """With `index`, and `eta`: the mean of all durations before, times what is left; null at first. Null durations count as none.

    Rows are added up within blocks of the index, and the blocks' sums, of which there are few, before them.
    """
    rows = number(durations, [pos], into="index").withColumn("__block", F.floor((F.col("index") - 1) / block))
    sums = rows.groupBy("__block").agg(F.sum(seconds).alias("s"), F.count(seconds).alias("n"))
    earlier = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__block", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("__s"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__n"))
    within = Window.partitionBy("__block").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    s = F.col("__s") + F.coalesce(F.sum(seconds).over(within), F.lit(0))
    n = F.col("__n") + F.count(seconds).over(within)
    rows = rows.join(sums, "__block").withColumn("eta", F.try_divide(s, n) * (F.lit(total) - F.col("index") + 1))
    return rows.select(*durations.columns, "index", "eta")
