"""Values of one large JSON list or object, read by many tasks.

Spark's text reader cuts a file behind every `}` and deals the pieces out by byte ranges, each of which one task reads. A first pass gives what each range does to
the state of a reader: whether it holds an odd number of quotes, and by how much the depth changes if it starts outside or inside a string. Sums over the ranges
before, one row each, give the state at each range's start. A second pass cuts the values at the wanted depth: those that lie in one range are rows at once, and
only the pieces of values that cross ranges are shuffled and joined. In a string nothing counts, and a quote behind an odd number of backslashes ends none.

A file counts only if its brackets close; a broken, empty or missing one has no values. Which bracket closes which, and what is in a value, is
left to whoever parses the values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.numbering import checkpoint

CUT = "}"
#: Ranges whose states are broadcast, some 100 bytes each; of more the states are joined by a shuffle.
MOST_BROADCAST = 500_000
_OPEN, _CLOSE, _COMMA = 1, -1, 2
_KIND = np.zeros(256, dtype=np.int8)
_KIND[[123, 91]], _KIND[[125, 93]], _KIND[44] = _OPEN, _CLOSE, _COMMA
_WHOLE, _HEAD, _TAIL, _HEADER = 0, 1, 2, 3


def pieces(spark: SparkSession, path: str) -> DataFrame | None:
    """(file, file_size, range, n, value): the text before each `}`, in the order of n within a range; None if there is no such file."""
    try:
        rows = spark.read.option("lineSep", CUT).text(path)
    except AnalysisException:
        return None
    m = "_metadata.file"
    return rows.select(F.col(f"{m}_path").alias("file"), F.col(f"{m}_size").alias("file_size"), F.col(f"{m}_block_start").alias("range"), F.monotonically_increasing_id().alias("n"), "value")


def marks(data: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """(places, kinds, depths after them) of brackets and commas outside strings, and whether the end is inside a string. Data end behind a `}`."""
    quote, slash = data == 34, np.flatnonzero(data == 92)
    if len(slash):
        begins = np.concatenate([[True], np.diff(slash) > 1])
        nth = np.arange(len(slash)) - np.maximum.accumulate(np.where(begins, np.arange(len(slash)), 0))
        quote[slash[nth % 2 == 0] + 1] = False  # what the first, third ... backslash of a run stands before
    within = (np.cumsum(quote) + inside) % 2 == 1
    found = _KIND[data]
    places = np.flatnonzero((found != 0) & ~within)
    kinds = found[places].astype(np.int64)
    return places, kinds, np.cumsum(np.where(kinds == _COMMA, 0, kinds)), bool(within[-1])


def _data(value: pa.StringScalar) -> np.ndarray:
    return np.frombuffer((value.as_py() or "").encode() + CUT.encode(), np.uint8)


def effects(rows: DataFrame) -> DataFrame:
    """For each range its size, whether it turns the state of strings, and for either state at its start the change of depth and the least depth; the file's first character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            for file, size, start, value in zip(*(batch.column(i) for i in range(4))):
                own = held.setdefault((file.as_py(), start.as_py()), [size.as_py(), 0, False, True, 0, 0, 0, 0, ""])
                data = _data(value)
                own[1] += len(data)
                own[8] = own[8] or (value.as_py() or "").lstrip()[:1]
                for s in (0, 1):
                    _, _, depth, own[2 + s] = marks(data, own[2 + s])
                    if len(depth):
                        own[6 + s] = min(own[6 + s], own[4 + s] + int(depth.min()))
                        own[4 + s] += int(depth[-1])
        found = [(f, r, *own) for (f, r), own in held.items()]
        columns = list(zip(*found)) or [()] * 11
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    names = ["file", "range", "file_size", "size", "odd", "odd_in", "depth_out", "depth_in", "least_out", "least_in", "root"]
    return rows.select("file", "file_size", "range", "value").mapInArrow(run, "file string, range long, file_size long, size long, odd boolean, odd_in boolean, depth_out long, depth_in long, least_out long, least_in long, root string")


def states(ranges: DataFrame) -> DataFrame:
    """(file, range, inside, depth, root) at the start of each range, of the files whose brackets close."""
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    rows = ranges.withColumn("inside", F.coalesce(F.sum(F.col("odd").cast("int")).over(before), F.lit(0)) % 2 == 1)
    mine = lambda name: F.when(F.col("inside"), F.col(f"{name}_in")).otherwise(F.col(f"{name}_out"))
    rows = rows.withColumn("change", mine("depth")).withColumn("least", mine("least"))
    rows = rows.withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
    # behind the last piece a `}` was put, which is the file's own only if that is how long the file is
    rows = rows.withColumn("put", F.sum("size").over(whole) - F.any_value("file_size").over(whole))
    closed = (F.sum("change").over(whole) == -F.col("put")) & (F.min(F.col("depth") + F.col("least")).over(whole) >= -F.col("put")) & (F.sum(F.col("odd").cast("int")).over(whole) % 2 == 0)
    rows = rows.withColumn("closed", closed).withColumn("root", F.first(F.when(F.col("root") != "", F.col("root")), True).over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return rows.where("closed").select("file", "range", "inside", "depth", "root")


def _cut(rows: DataFrame, depth: int) -> DataFrame:
    """(file, range, i, kind, header, text) of values at `depth`: whole ones, and pieces of those that cross ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, inside, level, i, mine, parts, header, heads, out = None, False, 0, 0, False, None, None, [], []

        def end() -> None:
            if at is not None and parts is not None:
                out.append((*at, i if mine else -1, _TAIL if mine else _HEAD, header if mine else None, b"".join(parts)))

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]
            fixed = [[x.decode("utf-8", "replace") if isinstance(x, bytes) else x for x in c] for c in columns]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(fixed, kinds)], ["file", "range", "i", "kind", "header", "text"])

        for batch in batches:
            for file, start, value, inside_, level_ in zip(*(batch.column(j) for j in range(5))):
                if (file.as_py(), start.as_py()) != at:
                    end()
                    at, inside, level, i, mine = (file.as_py(), start.as_py()), inside_.as_py(), level_.as_py(), -1, False
                    parts, header, heads = ([] if level >= depth else None), None, []
                data = _data(value)
                raw = data.tobytes()
                places, kinds, depths, inside = marks(data, inside)
                depths = depths + level
                level = int(depths[-1]) if len(depths) else level
                begun, head_from = 0, 0
                wanted = ((kinds != _CLOSE) & (depths == depth)) | ((kinds == _CLOSE) & (depths == depth - 1)) | ((kinds != _CLOSE) & (depths == depth - 1))
                for p, kind, d in zip(places[wanted].tolist(), kinds[wanted].tolist(), depths[wanted].tolist()):
                    if d == depth - 1 and kind != _CLOSE:  # a header may begin
                        heads, head_from = [], p + 1
                        continue
                    if kind == _OPEN:
                        header = (b"".join(heads) + raw[head_from : p + 1]).decode("utf-8", "replace")
                        out.append((*at, i + 1, _HEADER, header, None))
                    elif parts is not None:
                        parts.append(raw[begun:p])
                        out.append((*at, i if mine else -1, _WHOLE if mine else _HEAD, header if mine else None, b"".join(parts)))
                    if kind == _CLOSE:
                        parts = None
                        heads, head_from = [], p + 1
                    else:
                        parts, mine, begun, i = [], True, p + 1, i + 1
                if parts is not None:
                    parts.append(raw[begun:])
                else:
                    heads.append(raw[head_from:])
                if len(out) >= 4096:
                    yield batch_of()
        end()
        yield batch_of()

    return rows.select("file", "range", "value", "inside", "depth").mapInArrow(run, "file string, range long, i long, kind int, header string, text string")


def values(spark: SparkSession, path: str, depth: int = 1) -> DataFrame:
    """(file, root, pos, header, text): the values at `depth` of a file's list or object in order, as JSON text; a member of an object has its key before it.

    `pos` rises from 0. `header` is, for a depth of 2 or more, the text before the bracket in which the value stands, that bracket included; a list or object
    without values has a row of null text and pos. `root` is the first character of the file.
    """
    schema = "file string, root string, pos long, header string, text string"
    rows = pieces(spark, path)
    if rows is None:
        return spark.createDataFrame([], schema)
    known = checkpoint(states(effects(rows)))
    joined = rows.join(F.broadcast(known) if known.count() <= MOST_BROADCAST else known, ["file", "range"])
    laid = joined if known.count() <= MOST_BROADCAST else joined.repartition("file", "range").sortWithinPartitions("file", "range", "n")
    cut = checkpoint(_cut(laid, depth))
    order = Window.partitionBy("file").orderBy("range")
    # one row a range: how many values begin in it, and the header and range of the last value that began before it
    counts = cut.groupBy("file", "range").agg(F.count_if(F.col("kind").isin(_WHOLE, _TAIL)).alias("n"), F.max_by("header", F.when(F.col("kind") == _HEADER, F.col("i"))).alias("last"), F.max(F.when(F.col("kind") == _TAIL, F.lit(1))).alias("tail"))
    ranges = known.select("file", "range", "root").join(counts, ["file", "range"], "left")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    ranges = checkpoint(ranges.select(
        "file", "range", "root", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"), F.last("last", True).over(earlier).alias("known"),
        F.last(F.when(F.col("tail") == 1, F.col("range")), True).over(earlier).alias("owner"),
    ))
    rows = cut.join(F.broadcast(ranges) if known.count() <= MOST_BROADCAST else ranges, ["file", "range"])
    rows = rows.withColumn("header", F.coalesce("header", "known"))
    whole = rows.where(F.col("kind") == _WHOLE).select("file", "root", (F.col("base") + F.col("i")).alias("pos"), "header", "text")
    crossing = rows.where(F.col("kind").isin(_HEAD, _TAIL)).withColumn("owner", F.when(F.col("kind") == _TAIL, F.col("range")).otherwise(F.col("owner")))
    first = F.min_by(F.struct("root", (F.col("base") + F.col("i")).alias("pos"), "header"), F.when(F.col("kind") == _TAIL, F.col("range")))
    parts = F.array_sort(F.collect_list(F.struct("range", "kind", F.coalesce("text", F.lit("")).alias("text"))))
    stitched = crossing.groupBy("file", "owner").agg(first.alias("f"), parts.alias("p")).select("file", "f.root", "f.pos", "f.header", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))
    out = whole.unionByName(stitched).where(F.trim(F.translate("text", "\r\n\t", "   ")) != "")
    if depth > 1:
        empty = rows.where(F.col("kind") == _HEADER).select("file", "root", F.lit(None).cast("long").alias("pos"), "header", F.lit(None).cast("string").alias("text"))
        out = out.unionByName(empty)
    return out.select("file", "root", "pos", "header", "text")
