"""Parquet tables of which a change replaces only the buckets that it touches.

Rows are dealt to `BUCKETS` buckets by a hash of their key. A version is a manifest, a small file
with a growing number that names the folder of each bucket; readers take the greatest one. A
change writes the new folders first and its manifest last, so a run that dies between leaves the
old version whole, and nothing is ever renamed.
"""

from __future__ import annotations

import json
import random
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 16
#: Versions that stay on disk, for readers that began before a change.
KEPT_VERSIONS = 2
#: How often a writer tries again behind others.
TRIES = 20


class Conflict(Exception):
    """Another writer made the next version first."""


def bucket(key: Column | str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


class BucketTable:
    """One table below `path`, with rows (schema) found by `key`."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str):
        self.spark, self.path, self.schema, self.key = spark, path, schema, key
        jvm = spark.sparkContext._jvm
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}" if name else path)
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        if not self._fs.exists(self._at("_manifests")):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at("_manifests"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _folders(self, version: int) -> dict[int, str]:
        text = self.spark.read.text(f"{self.path}/_manifests/{version:09d}.json", wholetext=True).first()["value"]
        return {int(k): v for k, v in json.loads(text).items()}

    def _current(self) -> tuple[int, dict[int, str]]:
        versions = self._versions()
        return (versions[-1], self._folders(versions[-1])) if versions else (0, {})

    def exists(self) -> bool:
        return bool(self._versions())

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        folders = [f for b, f in self._current()[1].items() if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in sorted(folders)]) if folders else self.spark.createDataFrame([], self.schema)

    def replace(self, rows: DataFrame, buckets: list[int] | None = None, of_version: int | None = None) -> None:
        """Make rows the content of these buckets (of all, if None); other buckets stay.

        Raises Conflict if another writer was first since then, or since `of_version`."""
        version, folders = self._current()
        if of_version is not None and of_version != version:
            raise Conflict(f"{self.path} was changed by another writer")
        run = f"run-{uuid.uuid4().hex[:12]}"
        fields = self.spark.createDataFrame([], self.schema).columns
        rows.select(*fields, bucket(self.key).alias("_bucket")).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{run}")
        written = [f.getPath().getName() for f in self._fs.listStatus(self._at(run)) if f.isDirectory()]
        kept = {} if buckets is None else {b: f for b, f in folders.items() if b not in buckets}
        now = kept | {int(n.split("=")[1]): f"{run}/{n}" for n in written}
        try:
            out = self._fs.create(self._at(f"_manifests/{version + 1:09d}.json"), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                self._fs.delete(self._at(run), True)
                raise Conflict(f"{self.path} was changed by another writer") from e
            raise
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        self._tidy()

    def _tidy(self) -> None:
        """Delete old versions with what only they name, and what runs that died left a day ago."""
        versions = self._versions()
        of = lambda vs: {f.split("/")[0] for v in vs for f in self._folders(v).values()}
        used, old = of(versions[-KEPT_VERSIONS:]), versions[:-KEPT_VERSIONS]
        gone = of(old) - used
        for v in old:
            self._fs.delete(self._at(f"_manifests/{v:09d}.json"), False)
        for f in self._fs.listStatus(self._at("")):
            name = f.getPath().getName()
            if name in gone or (name.startswith("run-") and name not in used and f.getModificationTime() < 1000 * (time.time() - 86_400)):
                self._fs.delete(f.getPath(), True)

    def upsert(self, rows: DataFrame) -> None:
        """Put rows in, in place of those with their keys; keys are unique in rows, which are written.

        Of several writers at once each puts its rows in, one after another."""
        touched = [r["b"] for r in rows.select(bucket(self.key).alias("b")).distinct().collect()]  # BUCKETS at most
        for _ in range(TRIES - 1):
            try:
                return self._put(rows, touched)
            except Conflict:
                time.sleep(random.random())
        return self._put(rows, touched)

    def _put(self, rows: DataFrame, touched: list[int]) -> None:
        version, _ = self._current()
        old = self.read(touched)
        self.replace(old.join(rows.select(self.key), self.key, "left_anti").unionByName(rows.select(old.columns)), touched, version)

    def drop(self) -> None:
        self._fs.delete(self._at(""), True)
