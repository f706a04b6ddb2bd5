"""Bounded samples of labelled rows, on which models are fitted.

This is the one place where less than all rows is read: the bound is `per_class`, and the
choice is by a hash of doc_id, so it doesn't depend on how rows are dealt. Scores, counts and
decisions always cover every row.

The texts of a sample can be hundreds of megabytes. They are written, and come to the driver in
portions, so that it never holds them all.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import driver_memory
from tessera.llm.scratch import Scratch

HOLD_OUT = 5
#: Bytes of texts that come to the driver at once (or one text).
PORTION = 32 << 20

T = TypeVar("T")


def hold_out_column(doc_id: Column | str = "doc_id") -> Column:
    """True for rows whose crc32(doc_id as text) is divisible by 5; no label of theirs is learnt from."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % HOLD_OUT == 0


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % HOLD_OUT == 0


class Sample:
    """Rows (doc_id, text, y) in the order of their ids, which occur once; texts are read in portions, again for each pass."""

    def __init__(self, rows: DataFrame):
        self._scratch = Scratch(rows.sparkSession, "sample")
        self._kept = self._scratch.keep(rows.withColumn("n_bytes", F.octet_length("text")), "rows")
        table = self._kept.select("doc_id", "y", "n_bytes").toArrow()
        self._rows = table.take(pa.compute.sort_indices(table, [("doc_id", "ascending")]))
        ends, self._cuts = np.cumsum(self._rows["n_bytes"].to_numpy().astype(np.int64)), [0]
        while self._cuts[-1] < len(ends):
            at = self._cuts[-1]
            self._cuts.append(max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PORTION, "right"))))
        if len(self._cuts) > 2:  # so that a portion is read from a few files
            self._kept = self._scratch.keep(self._kept.orderBy("doc_id"), "ordered")
            self._scratch.drop("rows")

    def column(self, name: str) -> pa.ChunkedArray:
        """doc_id or y of all rows."""
        return self._rows.column(name)

    def to_batches(self) -> Iterator[pa.RecordBatch]:
        ids = self.column("doc_id")
        for at, to in zip(self._cuts[:-1], self._cuts[1:], strict=True):
            part = self._kept.where(F.col("doc_id").between(ids[at].as_py(), ids[to - 1].as_py())).select("doc_id", "text", "y").toArrow()
            yield from part.take(pa.compute.sort_indices(part, [("doc_id", "ascending")])).to_batches()

    def drop(self) -> None:
        self._scratch.drop()


def learn(fit: Callable[[Sample, dict[int, int]], T], documents: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[T, dict[int, int]]:
    """(what `fit` makes of a sample, all classes' sizes)."""
    table, sizes = sample(documents, labels, label, per_class)
    try:
        return fit(table, sizes), sizes
    finally:
        table.drop()
        driver_memory.give_back(documents.sparkSession)


def sample(documents: DataFrame, labels: DataFrame, label: str, per_class: int = 1000, max_chars: int = 200_000) -> tuple[Sample, dict[int, int]]:
    """At most `per_class` labelled rows of each class as (doc_id, text, y), and all classes' sizes.

    Rows that are held out, unlabelled, labelled both ways or longer than `max_chars` aren't
    learnt from. Repeated doc_ids count once (their least text).
    """
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~hold_out_column())
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"), F.max("y").alias("top"))
        .where("y = top")
        .select("doc_id", "y")
    )
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    rows = (
        documents.select("doc_id", "text")
        .where(F.length("text") <= max_chars)
        .join(F.broadcast(picked), "doc_id")  # 2 * per_class rows of two numbers at most
        .groupBy("doc_id", "y")
        .agg(F.min("text").alias("text"))
    )
    return Sample(rows.select("doc_id", "text", "y")), sizes
