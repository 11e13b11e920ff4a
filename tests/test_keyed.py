"""The keyed store: snapshots, crashes, conflicts, what is written."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusflow.sources.keyed import Conflict, KeyedStore


def rows(spark, *found):
    return spark.createDataFrame([(k, v, n) for k, v, n in found], "k string, v string, n int")


def content(df):
    return sorted((r["k"] or "", r["v"], r["n"]) for r in df.collect()) if df is not None else []


def size(folder):
    return sum(f.stat().st_size for f in Path(folder).rglob("*.parquet"))


def test_upserts_keep_the_last_row_of_a_key(spark, tmp_path):
    s = KeyedStore(spark, str(tmp_path / "s"), ["k"], buckets=4)
    assert s.read() is None and s.version() == 0 and s.upsert(rows(spark).where("false"), ["n"]) == 0
    assert s.upsert(rows(spark, ("a", "x", 1), ("b", "x", 1), ("a", "y", 2), (None, "z", 1)), ["n"]) == 1
    assert content(s.read()) == [("", "z", 1), ("a", "y", 2), ("b", "x", 1)]
    assert s.upsert(rows(spark, ("b", "new", 0), ("c", "x", 5), (None, None, None)), ["n"]) == 2
    assert content(s.read()) == [("", None, None), ("a", "y", 2), ("b", "new", 0), ("c", "x", 5)]
    assert content(s.read(1)) == [("", "z", 1), ("a", "y", 2), ("b", "x", 1)]
    again = KeyedStore(spark, str(tmp_path / "s"), ["k"], buckets=4)
    assert again.version() == 2 and content(again.read()) == content(s.read())
    with pytest.raises(ValueError):
        KeyedStore(spark, str(tmp_path / "s"), ["k"], buckets=5)


def test_readers_keep_their_snapshot(spark, tmp_path):
    s = KeyedStore(spark, str(tmp_path / "s"), ["k"], buckets=2)
    s.upsert(rows(spark, *[(str(i), "old", i) for i in range(50)]), ["n"])
    before = s.read()
    s.upsert(rows(spark, *[(str(i), "new", i) for i in range(25)]), ["n"])
    s.compact(1)
    assert {r["v"] for r in before.collect()} == {"old"}
    assert sum(r["v"] == "new" for r in s.read().collect()) == 25 and s.read().count() == 50


def test_a_killed_write_leaves_the_old_version(spark, tmp_path):
    s = KeyedStore(spark, str(tmp_path / "s"), ["k"], buckets=2)
    s.upsert(rows(spark, ("a", "x", 1)), ["n"])
    bad = rows(spark, ("a", "bad", 2), ("b", "bad", 2)).withColumn("v", F.when(F.col("k") == "b", F.raise_error(F.lit("killed"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="killed"):
        s.upsert(bad, ["n"])
    s._write(rows(spark, ("a", "unpublished", 3)).withColumn("bucket", F.lit(0)), 2)  # killed between writing and renaming
    (tmp_path / "s" / "versions" / ".draft").write_text('{"keys"')
    assert s.version() == 1 and content(s.read()) == [("a", "x", 1)]
    assert s.upsert(rows(spark, ("b", "y", 1)), ["n"]) == 2 and content(s.read()) == [("a", "x", 1), ("b", "y", 1)]
    assert s.vacuum() >= 1 and content(s.read()) == [("a", "x", 1), ("b", "y", 1)]


def test_of_two_writers_the_second_fails(spark, tmp_path):
    s = KeyedStore(spark, str(tmp_path / "s"), ["k"])
    s.upsert(rows(spark, ("a", "x", 1)), ["n"])
    seen = s.version()
    s.upsert(rows(spark, ("a", "first", 2)), ["n"], on=seen)
    with pytest.raises(Conflict):
        s.upsert(rows(spark, ("a", "second", 2)), ["n"], on=seen)
    assert content(s.read()) == [("a", "first", 2)] and not [p for p in (tmp_path / "s" / "versions").glob(".*") if p.suffix != ".crc"]


def test_bytes_written_follow_the_change(spark, tmp_path):
    s = KeyedStore(spark, str(tmp_path / "s"), ["k"], buckets=8)
    s.upsert(spark.range(200_000).select(F.col("id").cast("string").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"), F.lit(1).alias("n")), ["n"])
    whole = size(tmp_path / "s")
    s.upsert(rows(spark, ("7", "x", 2)), ["n"])
    assert size(tmp_path / "s") - whole < whole / 100
    manifest = json.loads((tmp_path / "s" / "versions" / f"{2:020d}.json").read_text())
    assert len(manifest["parts"][1]["in"]) == 1
    plan = s.read()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 3  # buckets of one folder are read as they are
    assert s.read().count() == 200_000 and s.read().where("k = '7'").first()["v"] == "x"


def test_compaction_rewrites_full_buckets_only(spark, tmp_path):
    s = KeyedStore(spark, str(tmp_path / "s"), ["k"], buckets=4)
    s.upsert(rows(spark, *[(str(i), "0", i) for i in range(40)]), ["n"])
    for j in range(1, 4):
        s.upsert(rows(spark, ("1", str(j), j), ("3", str(j), j)), ["n"])
    want = content(s.read())
    version = s.compact(2)
    assert version == 5 and content(s.read()) == want and s.compact(2) == 5
    parts = json.loads((tmp_path / "s" / "versions" / f"{5:020d}.json").read_text())["parts"]
    assert sorted(b for p in parts for b in p["in"]) == [0, 1, 2, 3]
    s.vacuum()
    assert content(s.read()) == want and s.versions() == [5]
    s.upsert(rows(spark, ("1", "later", 9)), ["n"])
    assert ("1", "later", 9) in content(s.read())


def test_new_columns(spark, tmp_path):
    s = KeyedStore(spark, str(tmp_path / "s"), ["k"], buckets=1)
    s.upsert(rows(spark, ("a", "x", 1), ("b", "x", 1)), ["n"])
    s.upsert(spark.createDataFrame([("b", 2.5)], "k string, w double"), ["w"])
    assert sorted((r["k"], r["v"], r["w"]) for r in s.read().collect()) == [("a", "x", None), ("b", None, 2.5)]
