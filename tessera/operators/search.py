"""Exact vector search over chunks: scan, ranking, filters, batches and cross references.

A corpus has the columns id, file_path, chunk_type, content, embedding, last_modified, and may
have more columns. Queries are few (their number is checked) and go along with the tasks, so the
corpus is scanned once and never shuffled; what leaves a task is its top rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scoring, text

#: At most so many queries in a batch.
MAX_QUERIES = 10
#: At most so many queries are scored in one pass; more are an error.
MAX_BATCH = 1000
LOW_CONFIDENCE = 0.45


def parse_queries(queries: str) -> list[str]:
    """A comma list: trimmed, without blanks and repeats; one to ten are allowed."""
    out = list(dict.fromkeys(q.strip() for q in queries.split(",") if q.strip()))
    if not 1 <= len(out) <= MAX_QUERIES:
        raise ValueError(f"1 to {MAX_QUERIES} queries are allowed, not {len(out)}")
    return out


def _asked(queries: DataFrame) -> tuple[list[str], np.ndarray]:
    """Names and vectors (rows) of a batch of queries; raises if there are too many, or of unequal dimensions."""
    rows = queries.select("query", "query_embedding").limit(MAX_BATCH + 1).collect()
    if len(rows) > MAX_BATCH:
        raise ValueError(f"at most {MAX_BATCH} queries are searched at once")
    widths = {len(r["query_embedding"]) for r in rows}
    if len(widths) > 1:
        raise ValueError(f"queries of {len(widths)} dimensions")
    return [r["query"] for r in rows], np.array([r["query_embedding"] for r in rows], float)


def _cosines(column: pa.Array, queries: np.ndarray) -> np.ndarray:
    """(vectors, queries): cosine similarities of a batch, as one product of matrices; 0 for zero vectors."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n, width = len(column), queries.shape[1]
    odd = np.flatnonzero(pc.list_value_length(column).to_numpy(zero_copy_only=False) != width)
    if len(odd):
        raise ValueError(f"a vector of {len(column[int(odd[0])])} components and a query of {width}")
    v = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, width)
    size = np.sqrt(np.einsum("ij,ij->i", v, v))[:, None] * np.sqrt(np.einsum("ij,ij->i", queries, queries))
    return np.divide(v @ queries.T, size, out=np.zeros((n, len(queries))), where=size > 0)


def scored(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """Every chunk with its cosine `score` for every query (query, query_embedding).

    Only vectors go to Python, a batch of them as one matrix. A vector of another dimension than
    the queries' is an error; chunks without one give no row.
    """
    names, matrix = _asked(queries)
    if not names:
        return corpus.limit(0).withColumn("query", F.lit("")).withColumn("score", F.lit(0.0))

    @F.arrow_udf("array<double>")
    def scores(vectors: pa.Array) -> pa.Array:
        found = _cosines(vectors, matrix)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, len(names), dtype=np.int32)), pa.array(found.ravel()))

    each = corpus.where(F.col("embedding").isNotNull()).select("*", F.posexplode(scores("embedding")).alias("_q", "score"))
    return each.withColumn("query", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_q") + 1)).drop("_q")


def best_by_score(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, id, score, rank): the k nearest vectors (id, embedding) of each query, ties by id.

    Each batch hands on its k best, so no score of another vector leaves it.
    """
    names, matrix = _asked(queries)
    kind = vectors.select("id").schema[0].dataType.simpleString()
    if not names:
        return vectors.sparkSession.createDataFrame([], f"query string, id {kind}, score double, rank int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = _cosines(batch.column(1), matrix).T
            least = np.partition(found, -k, axis=1)[:, -k] if batch.num_rows > k else np.full(len(names), -np.inf)
            query, at = np.nonzero(found >= least[:, None])
            ids = batch.column(0).take(pa.array(at))
            table = pa.table({"query": query, "id": ids, "score": found[query, at]})
            order = pc.sort_indices(table, [("query", "ascending"), ("score", "descending"), ("id", "ascending")])
            table = table.take(order).combine_chunks()
            query = table.column("query").to_numpy()
            near = np.arange(len(query)) - np.searchsorted(query, query) < k
            yield from table.filter(pa.array(near)).combine_chunks().to_batches()

    hits = vectors.where(F.col("embedding").isNotNull()).select("id", "embedding").mapInArrow(run, f"query long, id {kind}, score double")
    place = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("id"))
    best = hits.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return best.withColumn("query", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("query").cast("int") + 1)).select("query", "id", "score", "rank")


def weighed(corpus: DataFrame, as_of: Column) -> DataFrame:
    """Adds importance and recency, which depend on a chunk alone, once for all queries."""
    return corpus.withColumn("importance", scoring.file_importance(F.col("file_path"), F.col("chunk_type"), F.col("content"))).withColumn("recency", scoring.recency(F.col("last_modified"), as_of))


def ranked(corpus: DataFrame, queries: DataFrame, as_of: Column) -> DataFrame:
    """Every chunk for every query with score, importance, recency and combined, by which results are ordered."""
    return scored(weighed(corpus, as_of), queries).withColumn("combined", scoring.combined(F.col("score"), F.col("importance"), F.col("recency")))


def top(hits: DataFrame, k: int, by: str = "combined") -> DataFrame:
    """The k best; equal ones in order of id."""
    return hits.orderBy(F.desc(by), F.asc("id")).limit(k)


def search(corpus: DataFrame, query: DataFrame, as_of: Column, limit: int = 5, file_types: str = "", chunk_types: str = "", prefilter: bool = False) -> DataFrame:
    """The best chunks of one query.

    Filters work on the best max(3 * limit, 20) rows, so fewer than `limit` may pass; with
    `prefilter` they work on the corpus, before anything is scored.
    """
    keep = text.extension_filter(F.col("file_path"), file_types) & text.type_filter(F.col("chunk_type"), chunk_types)
    if not file_types.strip() and not chunk_types.strip():
        return top(ranked(corpus, query, as_of), limit)
    if prefilter:
        return top(ranked(corpus.where(keep), query, as_of), limit)
    return top(top(ranked(corpus, query, as_of), max(3 * limit, 20)).where(keep), limit)


def batch_search(corpus: DataFrame, queries: DataFrame, as_of: Column, per_query: int = 3) -> DataFrame:
    """The best chunks of each query, with their rank."""
    order = Window.partitionBy("query").orderBy(F.desc("combined"), F.asc("id"))
    hits = ranked(corpus, queries, as_of)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= min(max(per_query, 1), 5))


def batch_summary(hits: DataFrame, queries: DataFrame) -> DataFrame:
    found = hits.groupBy("query").agg(F.count("*").alias("n"))
    return queries.select("query").join(found, "query", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_results"),
        F.count_if(F.col("n").isNotNull()).alias("queries_with_results"),
        F.count_if(F.col("n").isNull()).alias("queries_without_results"),
    )


def cross_reference(hits: DataFrame, most: int = 10) -> DataFrame:
    """Files with more than one result, by their number of queries, then their best score."""
    return (
        hits.groupBy("file_path")
        .agg(F.count("*").alias("results"), F.count_distinct("query").alias("n_queries"), F.max("score").alias("max_score"), F.array_sort(F.collect_set("query")).alias("queries"))
        .where("results > 1")
        .orderBy(F.desc("n_queries"), F.desc("max_score"), "file_path")
        .limit(most)
    )


def with_context(hits: DataFrame, files: DataFrame, lines: int = 15) -> DataFrame:
    """Hits with the lines around them, from files (file_path, text).

    `lines` is held between 1 and 20; at 15 each chunk's type decides. Hits without valid line
    numbers, or whose file isn't there, show their own content.
    """
    lines = min(max(lines, 1), 20)
    around = scoring.context_lines(F.col("chunk_type")) if lines == 15 else F.lit(lines)
    every = F.split("text", "\n")
    valid = F.col("text").isNotNull() & (F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line")) & (F.col("end_line") <= F.size(every))
    first = F.greatest(F.lit(1), F.col("start_line") - around)
    last = F.least(F.size(every), F.col("end_line") + around)
    return (
        hits.join(files, "file_path", "left")
        .withColumn("context_start", F.when(valid, first))
        .withColumn("context_end", F.when(valid, last))
        .withColumn("context", F.when(valid, F.array_join(F.slice(every, first, last - first + 1), "\n")).otherwise(F.col("content")))
        .drop("text")
    )


def low_confidence(best: DataFrame) -> DataFrame:
    """Adds a flag to all results: the best score is below 0.45."""
    return best.withColumn("low_confidence", F.max("score").over(Window.partitionBy(F.lit(0))) < LOW_CONFIDENCE)


def empty_results(spark: SparkSession) -> DataFrame:
    """What an empty query gives."""
    return spark.createDataFrame([], "query string, id string, file_path string, chunk_type string, content string, score double, combined double")


def filter_help() -> str:
    """What the filters of `search` take."""
    return (
        "file_types: extensions, separated by commas (cs,razor,cshtml,c,h), in any case.\n"
        "chunk_types: whole types, separated by commas: class, interface, record, method, property, enum, local_function, switch_expression, global_usings, "
        "top_level_statements, sliding_window, generated, file, razor-code, razor-html, c-function, c-struct, c-enum, c-typedef, c-macro; "
        "declarations may end in -auth, -security, -config, and classes in -controller, -service."
    )
