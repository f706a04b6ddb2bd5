"""Greedy overlapping line windows over texts.

The walk is sequential within a text (a window's start depends on the one before), so it runs in
Arrow batches; texts are independent, so nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import fixed


def line_windows(lines: list[str], budget: int, share: float, overlap: float = fixed.OVERLAP, max_overlap: int = fixed.MAX_OVERLAP_LINES, breaks: str = "file") -> Iterator[tuple[int, int]]:
    """(first, end) of each window, end exclusive.

    A line costs its length and one. A window ends before a line that would exceed the budget if
    that line is a place to break or the window already holds more than share * budget; otherwise
    the line is taken in. It also ends once the budget is reached. The next window begins some
    lines before the end: overlap of the window, at most max_overlap lines.
    """
    is_break = re.compile(fixed.BREAKS[breaks]).search
    upto = [0, *accumulate(len(line) + 1 for line in lines)]
    n, start = len(lines), 0
    while start < n:
        end = start + 1
        while end < n:
            size = upto[end] - upto[start]
            if size >= budget:
                break
            if upto[end + 1] - upto[start] > budget:
                if size > share * budget or is_break(lines[end].strip()):
                    break
                end += 1
            else:
                # All lines that fit are taken at once.
                end = max(end + 1, min(n, bisect_right(upto, upto[start] + budget) - 1))
        yield start, end
        if end >= n:
            return
        start = max(end - min(int((end - start) * overlap), max_overlap), start + 1)


def c_windows(lines: list[str], budget: int, share: float, overlap: float = fixed.OVERLAP, max_overlap: int = fixed.MAX_OVERLAP_LINES, breaks: str = "c") -> Iterator[tuple[int, int]]:
    """As line_windows by the rule for C: a window ends behind a line that is a place to break, once
    it holds more than share * budget, or at the budget."""
    is_break = re.compile(fixed.BREAKS[breaks]).search
    n, start = len(lines), 0
    while start < n:
        end, size = start, 0
        while end < n and size < budget:
            size += len(lines[end]) + 1
            end += 1
            if size > share * budget and is_break(lines[end - 1].strip()):
                break
        yield start, end
        if end >= n:
            return
        start = max(end - min(int((end - start) * overlap), max_overlap), start + 1)


def window_table(texts: DataFrame, key: str, text: str, budget: int, share: float, overlap: float = fixed.OVERLAP, max_overlap: int = fixed.MAX_OVERLAP_LINES, breaks: str = "file", kind: str = "line") -> DataFrame:
    """(key, start_line, end_line, content), lines counted from 1; null and empty texts have no window."""
    walk = {"line": line_windows, "c": c_windows}[kind]
    key_type = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, first, last, content = [], [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not t:
                    continue
                lines = t.split("\n")
                for a, b in walk(lines, budget, share, overlap, max_overlap, breaks):
                    keys.append(k)
                    first.append(a + 1)
                    last.append(b)
                    content.append("\n".join(lines[a:b]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(content, pa.string())], names=[key, "start_line", "end_line", "content"])

    return texts.select(key, text).mapInArrow(run, f"{key} {key_type}, start_line int, end_line int, content string")


def without_contained(chunks: DataFrame, file: str = "file_path") -> DataFrame:
    """Chunks of a file without exact repeats and without those that lie in another of their type.

    Of equal contents, and of equal ranges, the first by (start, end descending, id) stays. Once
    ordered like that, a chunk lies in an earlier one just if that one's end isn't smaller, so a
    running maximum replaces the join of ranges.
    """
    order = [F.col("start_line"), F.desc("end_line"), F.col("id")]
    first = Window.partitionBy(file, "content").orderBy(*order)
    unique = chunks.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    before = Window.partitionBy(file, "chunk_type").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return unique.withColumn("_end", F.max("end_line").over(before)).where("_end IS NULL OR _end < end_line").drop("_end")


def statement_groups(statements: DataFrame, file: str = "file_path", gap: int = 2) -> DataFrame:
    """Statements (file, start_line, end_line) with the number of their group: a gap of more than
    two lines begins another."""
    w = Window.partitionBy(file).orderBy("start_line", "end_line")
    apart = F.coalesce(F.col("start_line") - F.lag("end_line").over(w), F.lit(0)) > gap
    return statements.withColumn("group", F.sum(apart.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
