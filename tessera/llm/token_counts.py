"""Token counts of whole texts, without keeping any ids.

Method: Arrow functions encode and return lengths only; rows are taken in blocks of equal
bytes, and long texts are cut at safe boundaries (see bpe.py), so that memory follows neither
the length of a text's encoding nor the number of rows in an Arrow batch.

Files with the ending .json are read as byte-level BPE, .model files by sentencepiece.

Defined cases: null text counts as empty (0 bytes, 0 tokens). Rows with equal doc_id are counted
one by one; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tessera.llm import bpe
from tessera.llm import text_arrays as ta
from tessera.llm import worker

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class PieceCounter:
    """Numbers of pieces of a sentencepiece model, texts encoded whole."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)

    def counts(self, texts: pa.Array) -> np.ndarray:
        return np.array([len(x) for x in self._model.encode(texts.to_pylist(), num_threads=1)], np.int64)


def token_counts(documents: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = tokenizer.endswith(".model")
        counter = worker.hold(("pieces", tokenizer), lambda: PieceCounter(tokenizer)) if pieces else bpe.worker_copy(tokenizer)
        for part in ta.blocks(batches, limit=bpe.WINDOW):
            texts = ta.text_column(part)
            n = counter.counts(texts)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(n), pa.array(n > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)
