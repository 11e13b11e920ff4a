"""A keyed store of rows as a folder of parquet that changes by snapshots.

`data` holds folders that are written once and never changed, each with its rows in folders by `bucket`, a hash of the keys. `versions` holds one small file a
version, which lists the folders that make up a snapshot, oldest first, and for each its buckets. An upsert writes the new rows alone, in a folder of its own, so what is written follows the change and not the store;
then it adds the version by renaming one file, which fails if that version is there already. So a reader sees one whole version, a writer that is killed leaves the old one, and of two
writers at a time the second fails and can try again. Reading takes the last row of a key among the folders; buckets that only one folder has are read as they are, without a shuffle.
compact() rewrites the buckets that many folders have, and vacuum() drops what no kept version names.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class Conflict(Exception):
    """Another writer made the version first."""


class KeyedStore:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS):
        """Opens a store, an empty one if there is nothing at `path`; keys and buckets must be those that it was begun with."""
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        found = self._manifest(self.version())
        if found["parts"] and (found["keys"], found["buckets"]) != (self.keys, buckets):
            raise ValueError(f"the store has keys {found['keys']} and {found['buckets']} buckets")

    # Versions

    def versions(self) -> list[int]:
        folder = self._hadoop.Path(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self) -> int:
        """The newest; 0 for an empty store."""
        return max(self.versions(), default=0)

    def _manifest(self, version: int) -> dict:
        if version == 0:
            return {"keys": self.keys, "buckets": self.buckets, "parts": []}
        stream = self._fs.open(self._hadoop.Path(f"{self.path}/versions/{version:020d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, version: int, parts: list[dict]) -> int:
        text = json.dumps({"keys": self.keys, "buckets": self.buckets, "parts": parts})
        drafted = self._hadoop.Path(f"{self.path}/versions/.{uuid.uuid4().hex}")
        stream = self._fs.create(drafted, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self._hadoop.FileContext.getFileContext(drafted.makeQualified(self._fs.getUri(), self._fs.getWorkingDirectory()).toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._sc._gateway.new_array(self._hadoop.Options.Rename, 0)
        try:
            context.rename(drafted, self._hadoop.Path(f"{self.path}/versions/{version:020d}.json"), options)
        except Exception as e:
            self._fs.delete(drafted, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {version} is there already") from e
            raise
        return version

    # Reading

    def _rows(self, parts: list[dict], buckets: set[int] | None = None) -> DataFrame | None:
        """Rows of the parts with `__seq`, the part's place, and `bucket`."""
        out = None
        for p in parts:
            wanted = sorted(b for b in p["in"] if buckets is None or b in buckets)
            if wanted:
                rows = self.spark.read.parquet(f"{self.path}/data/{p['folder']}").where(F.col("bucket").isin(wanted)).withColumn("__seq", F.lit(p["seq"]))
                out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def _merged(self, parts: list[dict], buckets: set[int] | None = None) -> DataFrame | None:
        """One row a key, with `bucket`: the last by part."""
        held: dict[int, int] = {}
        for p in parts:
            for b in p["in"]:
                held[b] = held.get(b, 0) + 1
        mine = {b for b in held if buckets is None or b in buckets}
        single = self._rows(parts, {b for b in mine if held[b] == 1})
        several = self._rows(parts, {b for b in mine if held[b] > 1})
        if several is not None:
            row = F.struct(*[F.col(f"`{c}`") for c in several.columns if c != "__seq"])
            several = several.groupBy(*self.keys).agg(F.max_by(row, "__seq").alias("__row")).select("__row.*")
        found = [x for x in (single.drop("__seq") if single is not None else None, several) if x is not None]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found) if found else None

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, the newest by default; None of an empty store. Later writes change nothing of it."""
        merged = self._merged(self._manifest(self.version() if version is None else version)["parts"])
        return merged.drop("bucket") if merged is not None else None

    # Writing

    def _write(self, rows: DataFrame, seq: int) -> dict | None:
        """A new folder of rows (with `bucket`), and which buckets it holds."""
        folder = uuid.uuid4().hex
        path = f"{self.path}/data/{folder}"
        rows.write.partitionBy("bucket").parquet(path)
        names = [s.getPath().getName() for s in self._fs.listStatus(self._hadoop.Path(path))]
        held = sorted(int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket="))  # as many as buckets at most
        return {"folder": folder, "seq": seq, "in": held} if held else None

    def upsert(self, rows: DataFrame, order: list[str], on: int | None = None) -> int:
        """The new version, in which rows replace those of their keys, of several of a key the last by `order`; no rows change nothing.

        `on` is the version that the caller has read: if another came since, Conflict is raised.
        """
        version = self.version() if on is None else on
        parts = self._manifest(version)["parts"]
        row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
        last = rows.groupBy(*self.keys).agg(F.max_by(row, F.struct(*order)).alias("__row")).select("__row.*")
        last = last.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
        part = self._write(last, version + 1)
        return self._publish(version + 1, [*parts, part]) if part else version

    def compact(self, most: int = 4) -> int:
        """A version in which buckets that more than `most` folders held are in one; the current one if there are none."""
        version = self.version()
        parts = self._manifest(version)["parts"]
        held: dict[int, int] = {}
        for p in parts:
            for b in p["in"]:
                held[b] = held.get(b, 0) + 1
        full = {b for b, n in held.items() if n > most}
        if not full:
            return version
        part = self._write(self._merged(parts, full), version + 1)
        rest = [p | {"in": [b for b in p["in"] if b not in full]} for p in parts]
        return self._publish(version + 1, [p for p in rest if p["in"]] + [part])

    def vacuum(self, keep: int = 1) -> int:
        """Drops all versions but the last `keep`, and folders that none of those names; returns how many folders. No writer may be at work."""
        versions = self.versions()
        kept = versions[-keep:] if keep else []
        named = {p["folder"] for v in kept for p in self._manifest(v)["parts"]}
        for v in versions:
            if v not in kept:
                self._fs.delete(self._hadoop.Path(f"{self.path}/versions/{v:020d}.json"), False)
        data = self._hadoop.Path(f"{self.path}/data")
        gone = [s.getPath() for s in self._fs.listStatus(data) if s.getPath().getName() not in named] if self._fs.exists(data) else []
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)
