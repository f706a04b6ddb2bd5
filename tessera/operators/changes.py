"""Change detection and mutations of tables, as joins of immutable frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) from two states (path, content_hash): added, removed or modified."""
    a, b = old.select("path", F.col("content_hash").alias("was")), new.select("path", F.col("content_hash").alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "modified")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where(F.col("change").isNotNull())


def last_writer(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with an equal key only the one with the greatest order."""
    place = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_place", F.row_number().over(place)).where("_place = 1").drop("_place")


def upsert(table: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """table with rows put in; the last of rows with an equal key counts."""
    newest = last_writer(rows, key, order).select(table.columns)
    return table.join(newest.select(key), key, "left_anti").unionByName(newest)


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def deleted(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows that `delete` takes away."""
    return table.join(keys.select(key).distinct(), key, "left_semi")


def apply_changes(table: DataFrame, changes: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunks after a change: those of removed and modified files go, fresh ones come."""
    gone = changes.where(F.col("change").isin("removed", "modified")).select(F.col("path").alias("file_path"))
    return delete(table, gone, "file_path").unionByName(fresh.select(table.columns))


def update_fields(table: DataFrame, updates: DataFrame, key: str, fields: list[str], now) -> DataFrame:
    """Partial update: fields of updates that aren't null replace those of the row with that key;
    updated_at moves on rows that change at all."""
    new = updates.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    joined = table.join(new, key, "left")
    any_new = F.lit(False)
    for f in fields:
        any_new = any_new | F.col(f"_{f}").isNotNull()
    out = joined
    for f in fields:
        out = out.withColumn(f, F.coalesce(F.col(f"_{f}"), F.col(f)))
    return out.withColumn("updated_at", F.when(any_new, now).otherwise(F.col("updated_at"))).select(table.columns)
