"""The corpus pipeline: quality rules, quality classifier, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but
the last return the columns of documents. Models of the two quality stages are learnt from the
labelled rows of the documents table itself, as an earlier stage has taken away the examples of
what to reject. Near-duplicates are judged by five-word shingles at a similarity of 0.8 or more.

A task that reads and writes whole texts holds a row group of each table, a batch of the reader
and one of Arrow's. `BATCHES` bounds them for texts; a session's own settings of these stand.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import near_dedup, quality_classifier, quality_rules
from tessera.llm.packing import pack
from tessera.llm.pii import redact
from tessera.llm.queries import tokenizer
from tessera.llm.scratch import Scratch

TOKENIZER = "byte_bpe_50k.json"

#: Bytes of a row group, rows that the reader takes at once, rows that a Python worker gets at once. No result depends on them.
BATCHES = {"parquet.block.size": 8 << 20, "spark.sql.parquet.columnarReaderBatchSize": 512, "spark.sql.execution.arrow.maxRecordsPerBatch": 2000}


def _in_small_batches(stage):
    """The stage, in a session with `BATCHES`; what it returns is read and written later, so they stay set."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for key, value in BATCHES.items():
            if spark.conf.get(key, None) is None:
                spark.conf.set(key, str(value))
        return stage(spark, docs, sf_dir)

    return run_stage


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@_in_small_batches
def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the rules' model keep."""
    return quality_rules.keep_rows(docs, _labels(spark, sf_dir), learn_from=_source(spark, sf_dir))


@_in_small_batches
def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of the threshold or more."""
    return quality_classifier.keep_rows(docs, _labels(spark, sf_dir), learn_from=_source(spark, sf_dir))


@_in_small_batches
def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that with the least doc_id. Documents without an id all stay."""
    return near_dedup.keep_rows(spark, docs, n=5)


@_in_small_batches
def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by marks."""
    return redact(docs)


@_in_small_batches
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 ids, with the ids."""
    return pack(spark, docs, tokenizer(TOKENIZER))


STAGES = [
    ("quality rules", quality_rules_stage),
    ("quality classifier", quality_classifier_stage),
    ("near-duplicates", near_dedup_stage),
    ("personal data", pii_stage),
    ("packing", packing_stage),
]

#: Learnt models and encoders can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = _source(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
