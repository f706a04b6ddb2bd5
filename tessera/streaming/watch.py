"""Change events: quiet periods end a burst, and each burst is one update.

Events are (project, path, change, ts). In a batch, session windows find the bursts; in a stream
the same windows close with the watermark, and `foreachBatch` hands each burst's files on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import fixed
from tessera.sources import files


def watched(path: Column, extensions: Iterable[str] = fixed.SOURCE_EXTENSIONS) -> Column:
    """Does a change of this path count: has it one of the extensions, in any case, and isn't it ignored."""
    return F.lower(F.element_at(F.split(path, r"\."), -1)).isin([e.lower() for e in extensions]) & path.contains(".") & ~files.ignored(path)


def renames(events: DataFrame) -> DataFrame:
    """(project, path, change, ts): a rename (with old_path) is a deletion and a creation."""
    gone = events.where("change = 'renamed'").select("project", F.col("old_path").alias("path"), F.lit("deleted").alias("change"), "ts")
    rest = events.select("project", "path", F.when(F.col("change") == "renamed", "created").otherwise(F.col("change")).alias("change"), "ts")
    return rest.unionByName(gone)


def to_projects(events: DataFrame, watched: DataFrame) -> DataFrame:
    """Events of directories (directory, ...) given to every project (project, directory) that watches one."""
    return events.join(F.broadcast(watched), "directory").drop("directory")


def bursts(events: DataFrame, key: str, gap: str, item: str) -> DataFrame:
    """(key, burst_start, burst_end, n_events, n_items): a burst ends after `gap` without an event."""
    session = events.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n_events"), F.count_distinct(item).alias("n_items"), F.max("ts").alias("burst_end"))
    return session.select(key, F.col("w.start").alias("burst_start"), "burst_end", "n_events", "n_items")


def changed_items(events: DataFrame, key: str, gap: str, item: str) -> DataFrame:
    """(key, burst_start, items): what changed in each burst, each once."""
    return events.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.array_sort(F.collect_set(item)).alias("items")).select(key, F.col("w.start").alias("burst_start"), "items")


def watch(events: DataFrame, apply: Callable[[DataFrame], None], checkpoint: str, gap: str = "60 seconds", late: str = "60 seconds", interval: str | None = None):
    """Start the stream: each closed burst's (project, burst_start, items) goes to `apply`.

    events is a streaming frame with a timestamp ts. Without an interval all that is there is
    worked off and the query ends. `apply` should be idempotent, as an index update by content
    hashes is: a burst may be handed on again after a failure.
    """
    closed = (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap).alias("w"), "project")
        .agg(F.collect_set("path").alias("items"))
        .select("project", F.col("w.start").alias("burst_start"), "items")
    )
    writer = closed.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: apply(df))
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
