"""Aggregates over chunks, memories, files and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def index_stats(chunks: DataFrame, metadata_bytes: int = 512) -> DataFrame:
    """Chunks, files and megabytes of a chunk table with file_path and embedding."""
    vector_mb = F.coalesce(F.sum(4 * F.size("embedding")), F.lit(0)) / 1048576
    metadata_mb = F.count("*") * metadata_bytes / 1048576
    return chunks.agg(
        F.count("*").alias("chunk_count"),
        F.count_distinct("file_path").alias("file_count"),
        vector_mb.alias("vector_mb"),
        metadata_mb.alias("metadata_mb"),
        (vector_mb + metadata_mb).alias("total_mb"),
    )


def extension_counts(files: DataFrame) -> DataFrame:
    return files.groupBy(F.lower(F.regexp_extract("file_path", r"\.([^./]+)$", 1)).alias("extension")).agg(F.count("*").alias("files"))


def type_distribution(chunks: DataFrame) -> DataFrame:
    n = F.count("*")
    counts = chunks.groupBy("chunk_type").agg(n.alias("chunks"))
    return counts.withColumn("percent", F.bround(100 * F.col("chunks") / F.sum("chunks").over(Window.partitionBy()), 1))


def tag_histogram(memories: DataFrame, most: int = 10) -> DataFrame:
    return memories.select(F.explode("tags").alias("t")).groupBy(F.lower("t").alias("tag")).agg(F.count("*").alias("uses")).orderBy(F.desc("uses"), "tag").limit(most)


def content_stats(memories: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return memories.agg(
        F.count("*").alias("memories"),
        F.bround(zero(F.sum("size_kb")), 2).alias("total_kb"),
        F.bround(zero(F.avg("size_kb")), 2).alias("average_kb"),
        F.coalesce(F.sum("lines_count"), F.lit(0)).cast("long").alias("total_lines"),
        F.bround(zero(F.avg("lines_count")), 1).alias("average_lines"),
    )


def graph_stats(memories: DataFrame) -> DataFrame:
    """How many memories have a parent, how many have children, and all links to existing parents."""
    links = memories.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("n_children"))
    return memories.join(links, "id", "left").agg(
        F.count_if(F.col("parent_id").isNotNull()).alias("with_parent"),
        F.count_if(F.col("n_children").isNotNull()).alias("with_children"),
        F.coalesce(F.sum("n_children"), F.lit(0)).alias("child_links"),
    )


def vector_stats(vectors: DataFrame) -> DataFrame:
    return vectors.agg(F.count("*").alias("vectors"), F.max(F.size("embedding")).alias("dimension"), (F.coalesce(F.sum(4 * F.size("embedding")), F.lit(0)) / 1048576).alias("vector_mb"))


def common_root(paths: DataFrame, group: str, path: str) -> DataFrame:
    """(group, root): the longest common run of leading segments of each group's directories."""
    folders = paths.select(group, F.regexp_replace(path, "/[^/]*$", "").alias("folder")).distinct()
    each = folders.select(group, F.posexplode(F.split("folder", "/")).alias("place", "segment"))
    sizes = folders.groupBy(group).agg(F.count("*").alias("n"))
    shared = each.groupBy(group, "place").agg(F.min("segment").alias("segment"), F.max("segment").alias("top"), F.count("*").alias("there"))
    shared = shared.join(sizes, group).where("segment = top AND there = n")
    # Of the shared places only the run from the first one on counts.
    lists = shared.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("place", "segment"))).alias("s"))
    run = F.filter("s", lambda x, i: x["place"] == i)
    return sizes.select(group).join(lists, group, "left").select(group, F.coalesce(F.array_join(F.transform(run, lambda x: x["segment"]), "/"), F.lit("")).alias("root"))


def shared_directories(projects: DataFrame) -> DataFrame:
    """Directories that several projects watch, from (project, directory)."""
    return projects.groupBy("directory").agg(F.array_sort(F.collect_set("project")).alias("projects")).where(F.size("projects") > 1)


def bench_stats(times: DataFrame, value: str = "value") -> DataFrame:
    v = F.col(value)
    return times.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), F.stddev_pop(v).alias("deviation"))


def type_names(chunks: DataFrame) -> DataFrame:
    """Names of classes, interfaces, records, structs and enums declared in chunks."""
    found = F.regexp_extract_all("content", F.lit(r"\b(?:class|interface|record|struct|enum)\s+([A-Za-z_][A-Za-z0-9_]*)"), 1)
    return chunks.select(F.explode(found).alias("name")).distinct().orderBy("name")


def islands(rows: DataFrame, group: str, order: str, gap_seconds: int) -> DataFrame:
    """Runs of rows without a gap of more than gap_seconds, numbered within their group."""
    w = Window.partitionBy(group).orderBy(order, "event_id")
    micros = F.unix_micros(F.col(order).cast("timestamp"))
    apart = F.coalesce(micros - F.lag(micros).over(w), F.lit(0)) > gap_seconds * 1_000_000
    return rows.withColumn("island", F.sum(apart.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
