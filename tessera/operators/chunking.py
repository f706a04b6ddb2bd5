"""Source files to typed, overlapping chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import scoring
from tessera.operators import source_parsers
from tessera.operators.windows import without_contained

#: Types whose suffix follows from the chunk's content and place.
ENRICHED = ["class", "interface", "record", "method", "property", "enum", "local_function", "switch_expression", "global_usings"]

_SCHEMA = "file_path string, last_modified timestamp, ordinal int, content string, start_line int, end_line int, base_type string, name string"


def parse_files(files: DataFrame) -> DataFrame:
    """Pieces of files (path, modified, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, modified, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(path, modified, k, *piece) for k, piece in enumerate(source_parsers.pieces(path, content or ""))]
            names = ["file_path", "last_modified", "ordinal", "content", "start_line", "end_line", "base_type", "name"]
            kinds = [pa.string(), batch.column(1).type, pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return files.select("path", F.col("modified").cast("timestamp").alias("modified"), "content").mapInArrow(run, _SCHEMA)


def chunk_files(files: DataFrame, prefix: bool = False) -> DataFrame:
    """(id, file_path, start_line, end_line, content, chunk_type, last_modified) of files.

    Types of C# declarations get their suffix from content and place, types of C from the name.
    C# chunks that repeat or lie in another of their type are left out. With `prefix` the content
    begins with the file's path and directory, after the types are settled.
    """
    parsed = parse_files(files)
    lower = F.lower("file_path")
    is_c, is_razor = lower.rlike(r"\.(c|h)$"), lower.rlike(r"\.(razor|cshtml)$")
    kind = (
        F.when(is_c & F.col("base_type").isin("c-function", "c-struct", "c-enum", "c-typedef", "c-macro"), scoring.enrich_c_type(F.col("base_type"), F.col("name")))
        .when(~is_c & ~is_razor & F.col("base_type").isin(ENRICHED), scoring.enrich_type(F.col("base_type"), F.col("file_path"), F.col("content")))
        .otherwise(F.col("base_type"))
    )
    typed = parsed.withColumn("chunk_type", kind).withColumn("id", F.concat_ws(":", "file_path", "start_line", "base_type", "ordinal"))
    sharp = without_contained(typed.where(~is_c & ~is_razor))
    out = sharp.unionByName(typed.where(is_c | is_razor))
    if prefix:
        out = out.withColumn("content", F.concat(F.lit("// File: "), "file_path", F.lit("\n// Directory: "), scoring.file_name(scoring.directory(F.col("file_path"))), F.lit("\n"), "content"))
    return out.select("id", "file_path", "start_line", "end_line", "content", "chunk_type", "last_modified")
