"""Markdown sections and their parents, as windows over lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HEADER = r"^(#+)\s+(.+)$"
LEVELS = 6


def sections(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, level, title, content): each header with the lines to the next one, trimmed.

    Text before the first header, and sections without content, are left out.
    """
    lines = documents.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("head", F.ltrim("line"))
    is_header = F.col("head").rlike(HEADER)
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = lines.withColumn("is_header", is_header).withColumn("section", F.sum(is_header.cast("int")).over(w)).where("section > 0")
    grouped = numbered.groupBy(key, "section").agg(
        F.max(F.when(F.col("is_header"), F.length(F.regexp_extract("head", HEADER, 1)))).alias("level"),
        F.max(F.when(F.col("is_header"), F.trim(F.regexp_extract("head", HEADER, 2)))).alias("title"),
        F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_header"), F.struct("pos", "line")))), lambda x: x["line"]), "\n"), r"^\s+|\s+$", "").alias("content"),
    )
    return grouped.where("content <> ''")


def parents(sections_table: DataFrame, key: str) -> DataFrame:
    """Adds parent: the latest section of the nearest smaller level that has come before; null: none."""
    w = Window.partitionBy(key).orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    levels = [F.last(F.when(F.col("level") == k, F.col("section")), ignorenulls=True).over(w) for k in range(1, LEVELS)]
    above = F.slice("_last", F.lit(1), F.least(F.col("level"), F.lit(LEVELS)) - 1)
    nearest = F.try_element_at(F.filter(above, lambda x: x.isNotNull()), F.lit(-1))
    out = sections_table.withColumn("_last", F.array(*levels)).withColumn("parent", nearest).drop("_last")
    # Sections below level 6 are rare; only they look for parents among the deep ones.
    deep = sections_table.where(F.col("level") > LEVELS).select(key, "section", "level")
    above = sections_table.where(F.col("level") >= LEVELS).select(key, F.col("section").alias("_section"), F.col("level").alias("_level"))
    found = deep.join(above, key).where("_section < section AND _level < level").groupBy(key, "section").agg(F.max(F.struct("_level", "_section")).alias("_above"))
    return out.join(found, [key, "section"], "left").withColumn("parent", F.coalesce("_above._section", "parent")).select(*sections_table.columns, "parent")
