"""The index of a project: scan, difference, chunks, embeddings, upsert, state.

Tables are Parquet below one root, in buckets by path (tables.py). A run stages what it makes,
each content embedded once; then it replaces the touched buckets of the chunks, and the file state
last. A run that dies is repeated as a whole and finds the same differences again.
"""

from __future__ import annotations

import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import cache, changes, statistics
from tessera.operators.chunking import chunk_files
from tessera.functions import scoring, text
from tessera.sources import embedding, files
from tessera.sources.tables import BucketTable, bucket


@dataclass(frozen=True)
class Settings:
    """roots: directories that may be indexed (None: any); cached: keep vectors by content."""

    root: str
    dimension: int = 64
    model: str = "hash"
    roots: tuple[str, ...] | None = None
    cached: bool = True


class Index:
    """One folder of tables: chunks, file_state and metadata of each project, and the cache of vectors."""

    _CHUNKS = "id string, file_path string, start_line int, end_line int, content string, chunk_type string, embedding array<float>, norm double, last_modified timestamp"
    _STATE = "path string, content_hash string"
    _META = "key string, value string"
    _CACHE = "content_hash string, embedding_type string, model string, project string, embedding array<float>, created_at timestamp, last_accessed timestamp, access_count long"

    def __init__(self, spark: SparkSession, settings: Settings, provider: embedding.Provider | None = None):
        self.spark, self.settings = spark, settings
        self.provider = provider or embedding.HashEmbedder(settings.dimension)

    def _table(self, name: str, project: str) -> BucketTable:
        schema, key = {"chunks": (self._CHUNKS, "file_path"), "file_state": (self._STATE, "path"), "metadata": (self._META, "key")}[name]
        return BucketTable(self.spark, f"{self.settings.root}/{name}/project={files.project_name(project)}", schema, key)

    @property
    def _vectors(self) -> BucketTable:
        return BucketTable(self.spark, f"{self.settings.root}/embedding_cache", self._CACHE, "content_hash")

    def chunks(self, project: str) -> DataFrame:
        return self._table("chunks", project).read()

    def state(self, project: str) -> DataFrame:
        return self._table("file_state", project).read()

    def metadata(self, project: str, key: str) -> str | None:
        """The value of a project's key, or None."""
        row = self._table("metadata", project).read().where(F.col("key") == key).first()
        return row["value"] if row else None

    def set_metadata(self, project: str, key: str, value: str) -> None:
        self._table("metadata", project).upsert(self.spark.createDataFrame([(key, value)], self._META))

    def update(self, project: str, directory: str, force: bool = False) -> dict:
        """Bring a project's chunks up to date with a source tree; counts of what was done.

        Files of which some vector failed keep their old chunks and stay out of the state, so that
        the next run finds them changed.
        """
        if self.settings.roots is not None and not files.allowed(directory, list(self.settings.roots)):
            raise PermissionError(f"{directory} isn't in a directory that may be indexed")
        began = time.monotonic()
        stage = f"{self.settings.root}/_staging/{uuid.uuid4().hex[:12]}"

        def staged(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{stage}/{name}")
            return self.spark.read.schema(df.schema).parquet(f"{stage}/{name}")

        try:
            now = staged(files.scan(self.spark, directory), "files")
            old = self.spark.createDataFrame([], self._STATE) if force else self.state(project)
            changed = staged(changes.diff(old, now), "changes")
            counts = {"added": 0, "modified": 0, "removed": 0} | {r["change"]: r["n"] for r in changed.groupBy("change").agg(F.count("*").alias("n")).collect()}
            failed = made = 0
            if any(counts.values()) or force:
                todo = now.join(changed.where("change <> 'removed'").select("path"), "path", "left_semi")
                fresh = staged(self._embedded(chunk_files(todo), project, staged), "chunks")
                bad = staged(fresh.where("embedding IS NULL").select(F.col("file_path").alias("path")).distinct(), "failed")
                failed, made = bad.count(), fresh.count()
                done = changed.join(bad, "path", "left_anti")
                good = fresh.join(bad.withColumnRenamed("path", "file_path"), "file_path", "left_anti")
                # Of a path that changed in any way no old chunk stays, also if it counts as added.
                self._exchange("chunks", project, done.select(F.col("path").alias("file_path")), good, force)
                self._exchange("file_state", project, changed.select("path"), now.select("path", "content_hash").join(done.select("path"), "path", "left_semi"), force)
            seen = now.count()
            return counts | {"failed": failed, "files": seen, "skipped": seen - counts["added"] - counts["modified"], "made": made, "chunks": self.chunks(project).count(), "seconds": round(time.monotonic() - began, 3)}
        finally:
            BucketTable(self.spark, stage, self._META, "key").drop()

    def _exchange(self, name: str, project: str, gone: DataFrame, rows: DataFrame, force: bool) -> None:
        """Replace all rows whose key is in gone by rows, bucket by bucket; with force, the whole table."""
        to = self._table(name, project)
        if force:
            to.replace(rows)
            return
        touched = [r["b"] for r in gone.select(bucket(to.key).alias("b")).distinct().collect()]  # BUCKETS at most
        if touched:
            to.replace(changes.delete(to.read(touched), gone, to.key).unionByName(rows), touched)

    def verify(self, directories: dict[str, str], at_once: int = 4) -> dict[str, dict]:
        """Bring every project (name -> directory) up to date, as after a start; some at once."""
        with ThreadPoolExecutor(at_once) as pool:
            return dict(zip(directories, pool.map(self.update, directories, directories.values()), strict=True))

    def rescan(self, directories: dict[str, str], minutes: float = 30, rounds: int | None = None, wait=time.sleep) -> list[dict[str, dict]]:
        """Verify all projects every so many minutes, without end if rounds is None."""
        out: list[dict[str, dict]] = []
        k = 0
        while rounds is None or k < rounds:
            if k:
                wait(60 * minutes)
            out = [*out[-9:], self.verify(directories)]
            k += 1
        return out

    def _embedded(self, pieces: DataFrame, project: str, staged) -> DataFrame:
        """Chunks with their vectors: from the cache, or else made, each content once."""
        keyed = pieces.withColumn("content_hash", text.cache_key(F.col("content")))
        distinct = keyed.groupBy("content_hash").agg(F.min("content").alias("content"))
        wanted = distinct.select("content_hash", F.lit("document").alias("embedding_type"), F.lit(self.settings.model).alias("model"), F.lit(None).cast("string").alias("project"), "content")
        if self.settings.cached:
            asked = cache.look_up(wanted.drop("content"), self._vectors.read())
            hits = staged(asked.where("hit").select("content_hash", "embedding"), "hits")
            wanted = wanted.join(hits, "content_hash", "left_anti")
        made = staged(wanted.select("content_hash", embedding.embed(F.col("content"), self.provider, self.settings.dimension).alias("embedding")), "vectors")
        vectors = made
        if self.settings.cached:
            vectors = made.unionByName(hits)
            log = hits.select("content_hash", F.current_timestamp().alias("at"))
            used = cache.accessed(self._vectors.read().join(hits.select("content_hash"), "content_hash", "left_semi"), log)
            new = cache.entries(made.where("embedding IS NOT NULL"), self.settings.model, F.current_timestamp())
            rows = staged(used.unionByName(new), "cache")
            if not rows.isEmpty():
                self._vectors.upsert(rows)
        return keyed.join(vectors, "content_hash").select("id", "file_path", "start_line", "end_line", "content", "chunk_type", "embedding", scoring.norm(F.col("embedding")).alias("norm"), "last_modified")

    def query(self, queries: list[str]) -> DataFrame:
        """(query, query_embedding) of a few queries; blank ones are left out."""
        return self.spark.createDataFrame([(q, self.provider.query(q)) for q in queries if q.strip()], "query string, query_embedding array<float>")

    def clear(self, project: str) -> None:
        """Forget a project's chunks, state and metadata; other projects stay."""
        for name in ("chunks", "file_state", "metadata"):
            self._table(name, project).drop()

    def statistics(self, project: str) -> DataFrame:
        return statistics.index_stats(self.chunks(project))

    def directory(self, project: str) -> str | None:
        """The longest common directory of a project's files."""
        row = statistics.common_root(self.chunks(project).select(F.lit(0).alias("g"), F.col("file_path").alias("path")), "g", "path").first()
        return row["root"] if row else None

