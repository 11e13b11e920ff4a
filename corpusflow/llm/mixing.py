"""Mixing sources to target weights by Pfair scheduling, in built-in functions only.

A source's documents, in the order of the md5 of their ids, form blocks of `block` documents. Target weights are whole parts of a period of
slots: a source with p of P parts has its j-th block (from 1) released at slot floor((j-1)P/p) and due at ceil(jP/p). Earliest
deadline first (ties: the alphabetically first source) gives each slot one block; as the parts add up to the period, every slot is filled,
no deadline is missed, and after t slots each source has had more than tp/P - 1 and less than tp/P + 1 blocks, however large t is. After a
period all are even, so the schedule repeats: it is made for one period, and each document computes its slot from it.

Given weights are taken exactly, as the decimal numbers that they are written as; where these need more than MAX_PERIOD parts an error says
so. Without weights a source's target is its share of size**alpha in `period` parts, by largest remainders, one part at least. No row is
dropped or repeated: once a source has run out its slots stay empty, the others keep their order. A source that is not among the given
weights, or has weight 0, has no slots: its rows follow after all others and have no slot.

A document's rank in its source is its rank in one range of the md5 plus the sizes of the ranges before. There are 256 ranges at least and
as many more as keep a range at about PER_RANGE documents, so a source with most of the rows is spread over as many tasks as any.

Edge cases: a null source is a source of its own, a null id sorts as an empty one; repeated ids are ordered by the other columns that can
be ordered, so only equal rows are interchangeable; an empty table gives no rows; columns of any name are carried along.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, ALPHA, PERIOD, MAX_PERIOD = 16, 0.5, 4000, 1 << 16
#: Most sources: one period is one row of the plan.
MAX_SOURCES = 1000
PER_RANGE = 16_384
_PLACES, _STRETCH = 1 << 10, 128  # more than sources; slots of a fold within the fold


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source.cast("string")))


def exact_parts(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in the very proportion of the weights, as small as can be."""
    exact = {k: Fraction(str(w)) for k, w in weights.items()}
    if any(w < 0 for w in exact.values()):
        raise ValueError("a weight is negative")
    scale = math.lcm(*(w.denominator for w in exact.values()))
    whole = {k: int(w * scale) for k, w in exact.items()}
    most = max(1, math.gcd(*whole.values()))
    whole = {k: n // most for k, n in whole.items()}
    if sum(whole.values()) > MAX_PERIOD:
        raise ValueError(f"the weights need a period of {sum(whole.values())} slots, more than {MAX_PERIOD}: write them with fewer digits")
    return whole


def shares(sizes: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, period: int = PERIOD) -> DataFrame:
    """(all: array<struct<key, parts>> by key, one row) from (key, n): each source with its whole parts of the period."""
    one = sizes.agg(F.array_sort(F.collect_list(F.struct("key", "n"))).alias("rows")).where(F.size("rows") > 0)
    if weights is not None:
        given = exact_parts(weights)
        table = F.create_map(*[x for k, n in given.items() for x in (F.lit(f"1{k}"), F.lit(n).cast("bigint"))]) if given else F.lit(None).cast("map<string,bigint>")
        parts = F.filter(F.transform("rows", lambda r: F.struct(r["key"].alias("key"), F.coalesce(F.try_element_at(table, r["key"]), F.lit(0).cast("bigint")).alias("parts"))), lambda x: x["parts"] > 0)
    else:
        size = lambda r: F.sqrt(r["n"].cast("double")) if alpha == 0.5 else F.pow(r["n"].cast("double"), F.lit(alpha))
        one = one.withColumn("total", F.aggregate("rows", F.lit(0.0), lambda a, r: a + size(r)))
        # one part each, the rest of the period by the share of size**alpha, what rounding leaves to the largest remainders
        one = one.withColumn("x", F.transform("rows", lambda r: F.struct(r["key"].alias("key"), (size(r) / F.col("total") * (F.lit(period) - F.size("rows"))).alias("share"))))
        left = (F.lit(period) - F.size("rows") - F.aggregate("x", F.lit(0).cast("bigint"), lambda a, r: a + F.floor(r["share"]))).cast("int")
        order = F.transform(F.array_sort(F.transform("x", lambda r: F.struct((F.floor(r["share"]) - r["share"]).alias("less"), r["key"].alias("key")))), lambda r: r["key"])
        one = one.withColumn("more", F.slice(order, F.lit(1), F.greatest(left, F.lit(0))))
        parts = F.transform("x", lambda r: F.struct(r["key"].alias("key"), (1 + F.floor(r["share"]) + F.array_contains(F.col("more"), r["key"]).cast("bigint")).alias("parts")))
    many = F.raise_error(F.lit(f"more than {MAX_SOURCES} sources"))
    return one.select(F.when(F.size("rows") > MAX_SOURCES, many).otherwise(parts).alias("all")).where(F.size("all") > 0)


def schedule(all_shares: DataFrame) -> DataFrame:
    """(key, parts, period, turn, slot): the slot of each of a source's blocks within one period, earliest deadline first."""
    total = F.aggregate("all", F.lit(0).cast("bigint"), lambda a, x: a + x["parts"])
    rows = all_shares.withColumn("period", total)
    # One number orders sources: the deadline, then the place in the list; sources whose next block is not yet released are out.
    none = F.transform("all", lambda x: F.lit(0).cast("bigint"))

    def step(acc: Column, t: Column) -> Column:
        period = F.col("period")

        def due(i: Column) -> Column:
            had, parts = F.get(acc["had"], i), F.get(F.col("all"), i)["parts"]
            # whole numbers throughout: floor(had * period / parts) <= t, and ceil((had + 1) * period / parts)
            return F.when(had * period < (t + 1) * parts, F.call_function("div", (had + 1) * period + parts - 1, parts) * _PLACES + i)

        pick = F.pmod(F.array_min(F.transform(F.sequence(F.lit(0), F.size("all") - 1), due)), F.lit(_PLACES)).cast("int")
        had = lambda p: F.transform(acc["had"], lambda h, i: F.when(i == p, h + 1).otherwise(h))
        # an array of one, so that the pick is made once a slot and not once a source
        return F.get(F.transform(F.array(pick), lambda p: F.struct(had(p).alias("had"), F.concat(acc["picks"], F.array(p)).alias("picks"))), F.lit(0))

    def stretch(acc: Column, first: Column) -> Column:
        """The slots of a stretch, appended as one array: no step copies all picks that went before."""
        empty = F.struct(acc["had"].alias("had"), F.array().cast("array<int>").alias("picks"))
        slots = F.sequence(first, F.least(first + _STRETCH, F.col("period")) - 1)
        return F.aggregate(slots, empty, step, lambda a: F.struct(a["had"].alias("had"), F.concat(acc["picks"], F.array(a["picks"])).alias("picks")))

    start = F.struct(none.alias("had"), F.array().cast("array<array<int>>").alias("picks"))
    picks = F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.col("period") - 1, F.lit(_STRETCH).cast("bigint")), start, stretch, lambda acc: F.flatten(acc["picks"]))
    slots = rows.select("all", "period", F.posexplode(picks).alias("slot", "i"))
    one = slots.select(F.get("all", "i").alias("x"), "period", F.col("slot").cast("bigint").alias("slot"))
    turn = (F.row_number().over(Window.partitionBy("key").orderBy("slot")) - 1).cast("bigint")
    return one.select("x.key", "x.parts", "period", "slot").withColumn("turn", turn)


def _ordered(docs: DataFrame) -> list[Column]:
    """The columns of docs that can be ordered."""
    plain = [f.name for f in docs.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    return [F.col(f"row.`{c}`") for c in plain]


def mix(docs: DataFrame, source: str = "source", id_col: str = "doc_id", weights: dict[str, float] | None = None, alpha: float = ALPHA, block: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """(row, block, slot, position, weight): `row` is the whole row of docs; rows sorted by `position` are the mixture."""
    if weights is not None:
        exact_parts(weights)
    digits = max(2, math.ceil(math.log(max(1, docs.count() / PER_RANGE), 16)))
    md5 = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _key(F.col(source)).alias("key"), md5.alias("md5"))
    rows = rows.withColumn("range", F.substring("md5", 1, digits))
    keys = docs.select(_key(F.col(source)).alias("key"), F.substring(md5, 1, digits).alias("range"))
    sizes = keys.groupBy("key", "range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    all_shares = shares(sizes.groupBy("key").agg(F.sum("n").alias("n")), weights, alpha, period)
    plan, parts = schedule(all_shares), all_shares.select(F.explode("all").alias("x"), F.aggregate("all", F.lit(0).cast("bigint"), lambda a, x: a + x["parts"]).alias("period")).select("x.*", "period")
    ranked = rows.join(sizes.select("key", "range", before.alias("before")), ["key", "range"])
    place = F.row_number().over(Window.partitionBy("key", "range").orderBy("md5", *_ordered(docs))) - 1 + F.col("before")
    ranked = ranked.withColumn("rank", place).withColumn("block", F.floor(F.col("rank") / block))
    turned = ranked.join(F.broadcast(parts), "key", "left").withColumn("turn", F.col("block") % F.col("parts"))
    # one row for each slot of a period, which has MAX_PERIOD slots at most
    timed = turned.join(F.broadcast(plan.select("key", "turn", "slot")), ["key", "turn"], "left")
    slot = F.floor(F.col("block") / F.col("parts")) * F.col("period") + F.col("slot")
    # without a slot: behind every position of the others, source after source
    behind = F.lit(1 << 60) + F.pmod(F.xxhash64("key"), F.lit(1 << 20)) * (1 << 38) + F.col("rank")
    position = F.coalesce(slot * block + F.col("rank") % block, behind)
    return timed.select("row", "block", slot.alias("slot"), position.alias("position"), F.coalesce(F.col("parts") / F.col("period"), F.lit(0.0)).alias("weight"))
