import datetime

from pyspark.sql import Row
from pyspark.sql import functions as F

from corpusflow.functions.text import duration, timestamp_text
from corpusflow.operators import acquire, generate
from corpusflow.operators.relational import progress, run_report
from corpusflow.plans.queries import QUERIES
from corpusflow.sources import files
from corpusflow.sources.http import store_sink
from corpusflow.streaming.resume import into_batches, process_new


def test_progress_against_a_loop(spark):
    data = [(i, None if i % 7 == 3 else float(i * i % 11)) for i in range(50)]
    rows = spark.createDataFrame(data, "pos int, sec double").repartition(5)
    got = {r["pos"]: (r["index"], r["eta"]) for r in progress(rows, "pos", "sec", 50, block=8).collect()}
    for i, _ in data:
        before = [s for _, s in data[:i] if s is not None]
        eta = sum(before) / len(before) * (50 - i) if before else None
        assert got[i][0] == i + 1 and (got[i][1] is None if eta is None else abs(got[i][1] - eta) < 1e-9)
    assert progress(rows.where("pos < 0"), "pos", "sec", 0).isEmpty()


def test_duration_and_timestamp(spark):
    rows = spark.createDataFrame([(0.4,), (59.9,), (60.0,), (3661.0,), (None,)], "s double")
    assert [r[0] for r in rows.select(duration(F.col("s"))).collect()] == ["0s", "59s", "0:01", "1:01", None]
    at = spark.createDataFrame([(datetime.datetime(2001, 5, 5, 1, 2, 3, 40),)], "t timestamp")
    assert at.select(F.date_format("t", "yyyy").alias("y"), timestamp_text(F.col("t")).alias("t")).first()["t"].startswith("2001-05-05T")


def test_first_document_valid_and_tiers(spark):
    links = spark.createDataFrame([("a", 1, "x.html", "u0"), ("a", 3, "z.PDF", "u2"), ("a", 2, "y.pdf", "u1"), ("b", 1, "n", "u3")], "k string, pos int, href string, url string")
    assert acquire.first_document(links, "k").collect() == [Row(k="a", url="u1")]
    blobs = spark.createDataFrame([("a", 0, "no"), ("a", 2, "ok"), ("a", 1, "ok"), ("b", 0, "no")], "k string, rank int, c string")
    assert acquire.first_valid(blobs, "k", "rank", F.col("c") == "ok").collect() == [Row(k="a", rank=1, c="ok")]
    entries = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    found = [(t, spark.createDataFrame(rows, "k string, value string")) for t, rows in (("one", [("a", "1"), ("b", None)]), ("two", [("a", "2"), ("b", "2")]))]
    assert sorted(map(tuple, acquire.tiers(entries, found, "k").collect())) == [("a", "one", "1"), ("b", "two", "2"), ("c", "no_data", None)]


def test_outcome(spark):
    rows = spark.createDataFrame([("c" * 49, 3), ("c" * 50, 0), ("c" * 50, None), ("c" * 50, 1)], "c string, n int")
    assert [r[0] for r in rows.select(generate.outcome(F.col("c"), F.col("n"))).collect()] == ["skipped", "failed", "failed", "done"]


def test_versions_and_done_names(spark, tmp_path):
    store = str(tmp_path / "store")
    assert files.done_names(spark, store).isEmpty()
    old = files.write_version(spark.createDataFrame([("a",)], "mission_name string"), store)
    new = files.write_version(spark.createDataFrame([("a",), ("b",), ("b",)], "mission_name string"), store)
    assert old != new and spark.read.parquet(old).count() == 1
    assert sorted(r[0] for r in files.done_names(spark, new).collect()) == ["a", "b"]


def test_batches_are_written_once(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "out")
    for n in (1, 2, 2):  # the last run finds nothing new
        if n == 1 or spark.read.parquet(source).count() == 5:
            spark.range(5).write.mode("append").parquet(source)
        process_new(spark, source, "id long", str(tmp_path / "state"), into_batches(store))
    assert spark.read.parquet(store).count() == 10


def test_store_sink(spark, tmp_path):
    folder = str(tmp_path)

    def upsert(rows):
        import json
        import pathlib

        for r in rows:
            pathlib.Path(folder, f"{r['k']}.json").write_text(json.dumps(r))
        return len(rows)

    spark.dataSource.register(store_sink(upsert, "k", "little_store"))
    for n in (1, 2):
        spark.createDataFrame([("a", n), ("b", n)], "k string, n int").write.format("little_store").mode("append").save()
    assert sorted(p.read_text() for p in tmp_path.glob("*.json")) == ['{"k": "a", "n": 2}', '{"k": "b", "n": 2}']


def test_run_report_names_every_failure(spark, sf):
    status = spark.createDataFrame([("e", "failed", ""), ("a", "ok", "pdf"), ("b", "ok", "webpage"), ("c", "failed", "")], "name string, status string, source string")
    assert sorted(tuple(r) for r in run_report(status).collect()) == [(4, 1, 1, 2, 1, "c"), (4, 1, 1, 2, 2, "e")]
    assert [tuple(r) for r in run_report(status.where("status = 'ok'")).collect()] == [(2, 1, 1, 0, None, None)]
    assert [tuple(r) for r in run_report(status.where("false")).collect()] == [(0, 0, 0, 0, None, None)]
    failed = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderstatus <> 'F'").count()
    assert QUERIES["run_summary"](spark, sf).where("failed_name is not null").count() == failed > 0
