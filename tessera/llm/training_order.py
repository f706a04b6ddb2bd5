"""Training-order materialisation: sequences in a keyed random order, in shards of fixed stride.

Method. Documents are packed into sequences (packing.py). A keyed Feistel network permutes the
smallest power of four that holds all sequence numbers; numbers that fall outside are sent through
it again (cycle-walking) until they are inside. So every sequence has one slot of 0..n-1, found
from its number, the key and n alone, and the inverse tells which sequence a slot holds. A range
of `shard_rows` slots is one shard: pieces are dealt to their shard's partition, sorted by slot,
joined to records, and written as one file in which slot s begins at (s mod shard_rows) * stride.
A reader that stopped at a slot goes on there, with one seek and without any index.

A record is `length` little-endian unsigned ids (16 bits, 32 for vocabularies above 65,536 ids) and a line feed, which only ends the
record: Spark's own text writer puts the bytes down as they are, on any file system that Spark
writes. The last sequence is padded with the separator's id.

Shards are written in `waves`, so that shuffle files of no more than a wave are there at once.
Python workers get at most `BATCH_ROWS` rows at once while shards are written, as an executor's JVM
and both its workers hold whole batches, each in several copies.
A lost executor costs its tasks, which are made again from the written ids; the order doesn't
depend on tasks, tries or the number of executors.

Defined cases: null text counts as empty, and its document is the separator alone. Rows with equal
doc_id are packed one by one, other columns are ignored, long texts span many sequences. An empty
table has no sequences and no shards.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, packing
from tessera.llm import text_arrays as ta
from tessera.llm.scratch import Scratch

SHARD_ROWS = 8192
KEY = 0x5EED
ROUNDS = 6
WAVES = 2
BATCH_ROWS = 1000
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Permutation:
    """A keyed permutation of 0..n-1 and its inverse, over arrays."""

    def __init__(self, n: int, key: int = KEY, rounds: int = ROUNDS):
        self.n = n
        self._half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
        self._mask = np.uint64((1 << int(self._half)) - 1)
        self._keys = ta.mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + ta.mix(np.array([key], np.uint64)))

    def _once(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        left, right = x >> self._half, x & self._mask
        for k in keys:
            left, right = right, left ^ (ta.mix(right ^ k) & self._mask)
        return right << self._half | left

    def _walk(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        out = self._once(np.asarray(x).astype(np.uint64), keys)
        outside = np.flatnonzero(out >= self.n)
        while len(outside):
            out[outside] = self._once(out[outside], keys)
            outside = outside[out[outside] >= self.n]
        return out.astype(np.int64)

    def slots(self, sequences: np.ndarray) -> np.ndarray:
        return self._walk(sequences, self._keys)

    def sequences(self, slots: np.ndarray) -> np.ndarray:
        """With the halves exchanged at the end, the inverse is the same network, keys backwards."""
        return self._walk(slots, self._keys[::-1])


def _join_pieces(record: int, shard_rows: int):
    """Records of so many bytes (shard, record) of pieces (slot, offset, ids) that come in that order."""
    end = b"\n"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, parts = None, []

        def done() -> bytes:
            return b"".join(parts).ljust(record, b"\0") + end

        for batch in batches:
            shards, records = [], []
            for s, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if s != slot:
                    if parts:
                        shards.append(slot // shard_rows)
                        records.append(done())
                    slot, parts = s, []
                parts.append(ids)
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(records, pa.binary())], names=["shard", "record"])
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([slot // shard_rows], pa.int64()), pa.array([done()], pa.binary())], names=["shard", "record"])

    return run


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings are these meanwhile, and then what they were."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def write_shards(spark: SparkSession, documents: DataFrame, tokenizer: str, folder: str, length: int = packing.LENGTH, shard_rows: int = SHARD_ROWS, key: int = KEY, waves: int = WAVES) -> int:
    """Write all shards below folder; returns the number of sequences."""
    own = int(spark.conf.get(_BATCH))  # 0 or less: no bound
    with _settings(spark, {_CLEAN: "true", _BATCH: str(min(own, BATCH_ROWS) if own > 0 else BATCH_ROWS)}):
        return _write(spark, documents, tokenizer, folder, length, shard_rows, key, waves)


def _write(spark: SparkSession, documents: DataFrame, tokenizer: str, folder: str, length: int, shard_rows: int, key: int, waves: int) -> int:
    scratch = Scratch(spark, "training-order")
    encoded = scratch.keep(packing.encode(documents, tokenizer), "encoded")
    streamed, ids = packing.with_stream_offsets(encoded)
    n = -(-ids // length)
    if not n:
        return 0
    order = Permutation(n, key)
    kind = bpe.id_type(tokenizer)
    record = np.dtype(kind).itemsize * length
    shards = -(-n // shard_rows)
    per_wave = -(-shards // waves)
    for first in range(0, shards, per_wave):
        last = min(first + per_wave, shards)
        pieces = packing.cut(streamed, kind, length, slot=order.slots, slots=(first * shard_rows, last * shard_rows))
        own = pieces.select("slot", "offset", "ids", F.expr(f"cast(slot div {shard_rows} as int)").alias("part"))
        dealt = own.repartitionById(last - first, F.col("part") - first).sortWithinPartitions("slot", "offset")
        records = dealt.select("slot", "offset", "ids").mapInArrow(_join_pieces(record, shard_rows), "shard long, record binary")
        # Spark's text writer ends a record with the line separator, which is the record's own.
        text = records.select("shard", F.expr(f"cast(substring(record, 1, {record}) as string)").alias("value"))
        text.write.partitionBy("shard").option("lineSep", "\n").option("compression", "none").mode("append").text(folder)
    scratch.drop()
    return n


def read_shards(spark: SparkSession, folder: str, n: int, length: int = packing.LENGTH, shard_rows: int = SHARD_ROWS, key: int = KEY, after_slot: int = -1, kind: str = "<u2") -> DataFrame:
    """(slot, sequence_id, shard, byte_offset, ids_crc32, ids) of all slots behind after_slot.

    The shard and place follow from the slot, so shards before it aren't opened.
    """
    stride = np.dtype(kind).itemsize * length + 1
    order = Permutation(n, key) if n else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = int(re.search(r"/shard=(\d+)/", path).group(1))
                data = np.frombuffer(content.as_buffer(), np.uint8).reshape(-1, stride)
                slots = shard * shard_rows + np.arange(len(data))
                for at in range(max(0, after_slot + 1 - shard * shard_rows), len(data), 1024):
                    some, own = data[at : at + 1024, :-1], slots[at : at + 1024]
                    rows = [x.tobytes() for x in some]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(own), pa.array(order.sequences(own)), pa.array(np.full(len(own), shard)), pa.array((own - shard * shard_rows) * stride),
                            pa.array([zlib.crc32(np.frombuffer(r, kind).astype("<u4").tobytes()) for r in rows], pa.int64()), pa.array(rows, pa.binary()),
                        ],
                        names=["slot", "sequence_id", "shard", "byte_offset", "ids_crc32", "ids"],
                    )

    schema = "slot long, sequence_id long, shard long, byte_offset long, ids_crc32 long, ids binary"
    if not n:
        return spark.createDataFrame([], schema)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(folder)
    wanted = F.regexp_extract("path", r"/shard=(\d+)/", 1).cast("long") >= (after_slot + 1) // shard_rows
    return found.where(wanted).select("path", "content").mapInArrow(run, schema)
