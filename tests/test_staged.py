"""The committing sink over a small store in a file."""

import json
import sqlite3
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import Row
from pyspark.sql import functions as F

from corpusflow.sources.staged import Staged, _Batch, _Stream, staged_sink


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import a test


class Store:
    """Staged and visible documents in SQLite; as any client it is made anew in each process."""

    def __init__(self, path: str):
        self.db = sqlite3.connect(path, timeout=60)
        with self.db:
            self.db.execute("create table if not exists docs (k text primary key, body text)")
            self.db.execute("create table if not exists staged (token text, k text, body text)")
            self.db.execute("create table if not exists epochs (epoch text primary key)")

    def stage(self, token, rows):
        with self.db:
            self.db.executemany("insert into staged values (?, ?, ?)", [(token, str(r["k"]), json.dumps(r)) for r in rows])

    def promote(self, epoch, tokens, key):
        with self.db:
            if self.db.execute("insert or ignore into epochs values (?)", (epoch,)).rowcount:
                for t in tokens:
                    self.db.execute("insert or replace into docs select k, body from staged where token = ?", (t,))
        self.discard(tokens)

    def discard(self, tokens):
        with self.db:
            self.db.executemany("delete from staged where token = ?", [(t,) for t in tokens])

    def docs(self):
        return {k: json.loads(b)["v"] for k, b in self.db.execute("select * from docs")}

    def left(self):
        return self.db.execute("select count(*) from staged").fetchone()[0]


def rows(n, v, start=0):
    return [Row(k=i, v=v) for i in range(start, start + n)]


def test_a_task_that_fails_midway_and_is_repeated_leaves_each_key_once(tmp_path):
    path = str(tmp_path / "s")
    writer = _Batch(lambda: Store(path), "k", "e1")

    def failing():
        yield from rows(1200, "half")
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(failing())
    store = Store(path)
    store.stage("orphan", [{"k": 1, "v": "orphan"}])  # an executor that was lost before it could discard
    messages = [writer.write(iter(rows(1500, "whole"))), None]
    assert messages[0].rows == 1500 and store.docs() == {}  # not visible before the commit
    writer.commit(messages)
    assert store.docs() == {str(i): "whole" for i in range(1500)} and store.left() == 1
    writer.commit([writer.write(iter(rows(10, "again")))])  # the same epoch once more
    assert set(store.docs().values()) == {"whole"} and store.left() == 1


def test_abort_undoes(tmp_path):
    path = str(tmp_path / "s")
    writer = _Stream(lambda: Store(path), "k", "q")
    writer.commit([writer.write(iter(rows(5, "old")))], 0)
    writer.abort([writer.write(iter(rows(5, "new"))), None], 1)
    assert set(Store(path).docs().values()) == {"old"} and Store(path).left() == 0
    writer.commit([writer.write(iter(rows(3, "new"))), Staged("nothing", 0)], 1)
    assert sorted(Store(path).docs().values()) == ["new"] * 3 + ["old"] * 2


def test_batches(spark, tmp_path):
    path = str(tmp_path / "s")
    spark.dataSource.register(staged_sink(lambda: Store(path), "k", "docs_batch"))
    df = spark.range(2000).select(F.col("id").alias("k"), F.lit("a").alias("v")).repartition(4)
    df.write.format("docs_batch").mode("append").option("epoch", "1").save()
    bad = df.withColumn("v", F.when(F.col("k") == 1999, F.raise_error(F.lit("killed"))).otherwise(F.lit("bad")))
    with pytest.raises(Exception, match="killed"):
        bad.write.format("docs_batch").mode("append").option("epoch", "2").save()
    store = Store(path)
    assert len(store.docs()) == 2000 and set(store.docs().values()) == {"a"}
    df.limit(7).withColumn("v", F.lit("b")).write.format("docs_batch").mode("append").option("epoch", "2").save()
    df.withColumn("v", F.lit("c")).write.format("docs_batch").mode("append").option("epoch", "2").save()  # repeated by mistake
    assert sorted(store.docs().values()).count("b") == 7 and "c" not in store.docs().values()
    with pytest.raises(Exception, match="no column k"):
        df.drop("k").write.format("docs_batch").mode("append").save()


def test_streams(spark, tmp_path):
    path = str(tmp_path / "s")
    spark.dataSource.register(staged_sink(lambda: Store(path), "k", "docs_stream"))

    def follow(ck):
        stream = spark.readStream.schema("k long, v string").parquet(f"{tmp_path}/in")
        stream.writeStream.format("docs_stream").option("checkpointLocation", f"{tmp_path}/{ck}").option("query", "q").trigger(availableNow=True).start().awaitTermination()

    spark.range(100).select(F.col("id").alias("k"), F.lit("one").alias("v")).write.mode("append").parquet(f"{tmp_path}/in")
    follow("ck")
    spark.range(50, 150).select(F.col("id").alias("k"), F.lit("two").alias("v")).write.mode("append").parquet(f"{tmp_path}/in")
    follow("ck")
    docs = Store(path).docs()
    assert len(docs) == 150 and sum(v == "one" for v in docs.values()) == 50
    follow("lost")  # the checkpoint is lost: batch 0 comes again, with all rows, and was committed before
    assert Store(path).docs() == docs and Store(path).left() == 0
