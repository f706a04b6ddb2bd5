"""Exact scoring in two ways, to compare their throughput."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import search


def random_vectors(spark: SparkSession, rows: int, width: int, queries: int, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """(corpus (id, embedding), queries), all of unit length."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            v = np.stack([np.random.default_rng([seed, int(i)]).normal(size=width) for i in ids]) if len(ids) else np.zeros((0, width))
            v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, width, dtype=np.int32)), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "embedding"])

    q = np.random.default_rng(seed).normal(size=(queries, width))
    return spark.range(rows).mapInArrow(make, "id long, embedding array<float>"), q / np.linalg.norm(q, axis=1, keepdims=True)


def queries_of(spark: SparkSession, queries: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(f"q{i}", [float(x) for x in q]) for i, q in enumerate(queries)], "query string, query_embedding array<double>")


def every_score(corpus: DataFrame, queries: np.ndarray, k: int) -> DataFrame:
    """The way of ranked searches: a score for each chunk and query, then the best of each query."""
    place = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("id"))
    return search.scored(corpus, queries_of(corpus.sparkSession, queries)).select("query", "id", "score").withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def best_scores(corpus: DataFrame, queries: np.ndarray, k: int) -> DataFrame:
    """The way of searches by score alone: each batch hands on its best."""
    return search.best_by_score(corpus, queries_of(corpus.sparkSession, queries), k)
