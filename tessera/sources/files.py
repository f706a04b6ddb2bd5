"""Source trees and single files as DataFrames; paths are checked on the driver before any read."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import fixed, text

MAX_FILE_BYTES = 10 * 1024 * 1024


def ignored(relative: Column, length: Column | None = None, patterns: list[str] = fixed.IGNORED) -> Column:
    """Isn't the path (relative to the tree's base, with slashes) to be indexed."""
    out = F.lit(False)
    for p in patterns:
        if p.endswith("/"):
            name = p.rstrip("/")
            out = out | relative.contains(f"/{name}/") | relative.startswith(f"{name}/")
        elif p.startswith("*"):
            out = out | F.lower(relative).endswith(p[1:].lower())
        else:
            out = out | relative.contains(p)
    return out | (length > fixed.MAX_INDEXED_BYTES) if length is not None else out


def allowed(path: str, roots: list[str]) -> bool:
    """Is path one of the roots or below one, in any case; without roots nothing is allowed."""
    real = os.path.realpath(path).replace("\\", "/").lower() + "/"
    return any(real.startswith(os.path.realpath(r).replace("\\", "/").lower().rstrip("/") + "/") for r in roots)


def project_name(name: str) -> str:
    """A name that is safe in paths; raises if nothing is left of it."""
    out = re.sub(r"_+", "_", re.sub(r'[<>:"/\\|?*\x00-\x1f. ]', "_", name)).strip("_").lower()
    if not out:
        raise ValueError(f"no project name is left of {name!r}")
    return out


def scan(spark: SparkSession, base: str, extensions: list[str] = fixed.SOURCE_EXTENSIONS) -> DataFrame:
    """(path, length, modified, content, content_hash) of a tree's source files, path relative to it.

    A tree without such files, or that isn't there, gives no rows.
    """
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(base)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "path string, length long, modified timestamp, content string, content_hash string")
    glob = "*.{" + ",".join(extensions) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(base)
    prefix = F.lit(base.rstrip("/").removeprefix("file://") + "/")
    full = F.regexp_replace("path", "^[a-z]+:/+", "/")
    relative = F.when(F.startswith(full, prefix), F.substring(full, F.length(prefix) + 1, F.length(full))).otherwise(full)
    return files.select(relative.alias("path"), "length", F.col("modificationTime").alias("modified"), F.col("content")).where(~ignored(F.col("path"), F.col("length"))).select(
        "path", "length", "modified", F.decode("content", "UTF-8").alias("content"), text.content_hash(F.col("content")).alias("content_hash")
    )


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of one Markdown file; raises if it is missing or blank."""
    df = spark.read.text(path, wholetext=True).select(F.lit(path).alias("path"), F.col("value").alias("text"))
    if df.where(F.trim("text") != "").isEmpty():
        raise ValueError(f"{path} is empty")
    return df


def file_as_memory(spark: SparkSession, path: str, tags: list[str] = ()) -> DataFrame:
    """(name, text, tags, warn) of one file; its name and extension become tags. Raises above 10 MiB."""
    row = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    stem, ext = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"\.([^.]+)$", 1)
    own = F.array(F.concat(F.lit("file-"), F.lower(ext)), F.concat(F.lit("filename-"), F.lower(stem)))
    given = F.array(*[F.lit(t) for t in tags]).cast("array<string>")
    size = row.agg(F.max("length")).first()[0]
    if size is not None and size > MAX_FILE_BYTES:
        raise ValueError(f"{path} has {size} bytes, more than {MAX_FILE_BYTES}")
    return row.select(name.alias("name"), F.decode("content", "UTF-8").alias("text"), text.tag_union(given, own).alias("tags"), (F.col("length") > 1024 * 1024).alias("warn"))
