"""The embedding cache: read-through look-up, access log, eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["content_hash", "embedding_type", "model", "project"]


def look_up(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """wanted (KEY columns) with `embedding` and `hit`; a null project matches a null project.

    Each key is asked once, however many rows want it."""
    asked = wanted.select(KEY).distinct().alias("w")
    held = cache.select(*KEY, "embedding").alias("c")
    same = F.col("w.content_hash") == F.col("c.content_hash")
    for k in KEY[1:]:
        same = same & F.col(f"w.{k}").eqNullSafe(F.col(f"c.{k}"))
    return asked.join(held, same, "left").select(*[F.col(f"w.{k}") for k in KEY], F.col("c.embedding").alias("embedding"), F.col("c.content_hash").isNotNull().alias("hit"))


def accessed(cache: DataFrame, log: DataFrame) -> DataFrame:
    """cache after the accesses in log (content_hash, at): times moved on, counts added up."""
    seen = log.groupBy("content_hash").agg(F.max("at").alias("_at"), F.count("*").alias("_n"))
    return (
        cache.join(seen, "content_hash", "left")
        .withColumn("last_accessed", F.greatest("last_accessed", "_at"))
        .withColumn("access_count", F.col("access_count") + F.coalesce("_n", F.lit(0)))
        .select(cache.columns)
    )


def entries(vectors: DataFrame, model: str, now: Column, kind: str = "document", project: str | None = None) -> DataFrame:
    """Cache rows of vectors (content_hash, embedding), used once so far; stored, they replace those of their keys."""
    given = {"embedding_type": F.lit(kind), "model": F.lit(model), "project": F.lit(project).cast("string"), "created_at": now, "last_accessed": now, "access_count": F.lit(1).cast("long")}
    return vectors.select("content_hash", "embedding", *[v.alias(k) for k, v in given.items()])


def evict_lru(cache: DataFrame, keep: int = 5000) -> DataFrame:
    """The `keep` entries used last (ties by key); a top-k, so nothing is sorted as a whole."""
    return cache.orderBy(F.desc("last_accessed"), "content_hash").limit(keep)


def purge(cache: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """Entries used within the last days."""
    return cache.where(F.col("last_accessed") >= as_of - F.expr(f"interval {days} days"))


def statistics(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum(4 * F.size("embedding")), F.lit(0)).cast("long").alias("embedding_bytes"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """How often each key is asked again: what a cache saves."""
    w = Window.partitionBy(key)
    return rows.withColumn("times", F.count("*").over(w))
