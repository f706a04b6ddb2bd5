"""Concatenate and cut: documents become one stream of ids, cut into sequences of fixed length.

Method: the first pass encodes every document once and writes its ids with the number of its
task and its start within that task; a table of task totals (one row for each input split) is
summed up to give each task's offset in the stream. The second pass adds the two and cuts at
multiples of the sequence length; a document that crosses a cut gives boundary records, one
piece on each side. No row is shuffled.

The written table fixes which rows each task had, so a lost executor changes nothing.

Defined cases: null text counts as empty, and then only the separator is packed. Rows with equal
doc_id are packed one by one. Other columns are ignored. An empty table gives no pieces. All
sequences are full but the last, which needs padding to `length`.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe
from tessera.llm import text_arrays as ta
from tessera.llm import worker
from tessera.llm.scratch import Scratch

LENGTH = 1024
SEPARATOR = 0
#: Up to this many tasks (16 bytes each) the table of offsets is broadcast; beyond, it is joined.
BROADCAST_TASKS = 1_000_000

_ENCODED = "task int, start long, doc_id long, doc_tokens long, ids binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def encode(documents: DataFrame, tokenizer: str, separator: int | None = SEPARATOR) -> DataFrame:
    """Each row's ids, packed (bpe.id_type), with its task and its start there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.worker_copy(tokenizer)
        end = b"" if separator is None else encoder.packed([separator])
        width, task, at = np.dtype(encoder.kind).itemsize, TaskContext.get().partitionId(), 0
        for part in ta.blocks(batches, limit=bpe.WINDOW):
            n, ids = encoder.ids(ta.text_column(part))
            raw, ends = ids.tobytes(), (width * np.cumsum(n)).tolist()
            rows = [raw[a:b] + end for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            n = n + len(end) // width
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), task, np.int32)), pa.array(starts), part.column(0), pa.array(n), pa.array(rows, pa.binary())],
                names=["task", "start", "doc_id", "doc_tokens", "ids"],
            )

    return documents.select("doc_id", "text").mapInArrow(run, _ENCODED)


def with_stream_offsets(encoded: DataFrame) -> tuple[DataFrame, int]:
    """(encoded with its global `stream` offset, the stream's length)."""
    totals = encoded.groupBy("task").agg(F.sum("doc_tokens").alias("n")).collect()  # a row for each input split
    spark, at, rows = encoded.sparkSession, 0, []
    for r in sorted(totals, key=lambda r: r["task"]):
        rows.append((r["task"], at))
        at += r["n"]
    offsets = spark.createDataFrame(rows, "task int, base long")
    offsets = F.broadcast(offsets) if len(rows) <= BROADCAST_TASKS else offsets
    return encoded.join(offsets, "task").withColumn("stream", F.col("base") + F.col("start")).drop("base", "start", "task"), at


def cut(streamed: DataFrame, kind: str, length: int = LENGTH, with_ids: bool = True, slot: Callable[[np.ndarray], np.ndarray] | None = None, slots: tuple[int, int] | None = None) -> DataFrame:
    """Pieces of documents in sequences of `length`, whose ids are of type `kind`; with `slot` also what that gives for their
    numbers, then without checksums, and only pieces whose slot is in the range `slots`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        for batch in batches:
            doc, stream, n = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("doc_id", "stream", "doc_tokens"))
            null_ids = batch.column(batch.schema.get_field_index("doc_id"))
            first, last = stream // length, (stream + n - 1) // length
            pieces = last - first + 1
            row = np.repeat(np.arange(len(n)), pieces)
            seq = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            own = slot(seq) if slot else None
            if own is not None and slots is not None:
                inside = (own >= slots[0]) & (own < slots[1])
                row, seq, own = row[inside], seq[inside], own[inside]
            begin = np.maximum(seq * length, stream[row])
            end = np.minimum((seq + 1) * length, (stream + n)[row])
            ids = batch.column(batch.schema.get_field_index("ids"))
            wide = [np.frombuffer(x.as_buffer(), kind) for x in ids]
            parts = [wide[r][b:e] for r, b, e in zip(row.tolist(), (begin - stream[row]).tolist(), (end - stream[row]).tolist(), strict=True)]
            crc = pa.nulls(len(parts), pa.int64()) if slot else pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64())
            more = [pa.array(own)] if slot else []
            yield pa.RecordBatch.from_arrays(
                [
                    null_ids.take(pa.array(row)), pa.array(begin - stream[row]), pa.array(end - begin), crc, pa.array(n[row]), pa.array(seq), pa.array(begin - seq * length),
                    pa.array([p.tobytes() for p in parts] if with_ids else [None] * len(parts), pa.binary()), *more,
                ],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"] + ["slot"] * len(more),
            )

    return streamed.select("doc_id", "stream", "doc_tokens", "ids").mapInArrow(run, _PIECES + ", slot long" * (slot is not None))


def pack(spark: SparkSession, documents: DataFrame, tokenizer: str, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids).

    ids are little-endian unsigned numbers of 16 bits (32 for vocabularies above 65,536 ids);
    ids_crc32 is over the same ids in 32 bits.
    """
    encoded = Scratch(spark, "packing").keep(encode(documents, tokenizer), "encoded")
    return cut(with_stream_offsets(encoded)[0], bpe.id_type(tokenizer), length, with_ids)
