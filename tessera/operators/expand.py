"""Query expansion by synonyms, as joins with a small table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import fixed


def synonym_rows(groups: list[list[str]] = fixed.SYNONYM_GROUPS) -> list[tuple[str, str, int, int]]:
    """(term, synonym, place in the group, place of the term); of a term in several groups only
    the last group counts, but its place stays that of its first registration."""
    of: dict[str, list[str]] = {}
    for group in groups:
        for term in group:
            of[term.lower()] = group
    return [(term, s, k, place) for place, (term, group) in enumerate(of.items()) for k, s in enumerate(group)]


def synonyms(spark: SparkSession, groups: list[list[str]] = fixed.SYNONYM_GROUPS) -> DataFrame:
    return spark.createDataFrame(synonym_rows(groups), "term string, synonym string, ord int, term_ord int")


def expand(queries: DataFrame, table: DataFrame) -> DataFrame:
    """(query, expanded): `query (a OR b ...)`, or the query itself if nothing is known of it.

    Synonyms come in the order of the query's words, then of multi-word terms that are part of
    the query; each is used once, and never if it is the whole query. Queries that repeat are
    expanded once.
    """
    asked = queries.select("query").distinct()
    word = F.regexp_extract_all("query", F.lit(r"(?U)\b\w+\b"), 0)
    small = F.broadcast(table)  # a few hundred rows of fixed values
    by_word = asked.select("query", F.posexplode(word).alias("place", "word")).join(small, F.lower("word") == F.col("term")).select("query", F.lit(0).alias("round"), "place", "ord", "synonym")
    by_part = asked.join(small, F.col("term").contains(" ") & F.contains(F.lower("query"), F.col("term"))).select("query", F.lit(1).alias("round"), F.col("term_ord").alias("place"), "ord", "synonym")
    found = by_word.unionByName(by_part).where(F.lower("synonym") != F.lower("query"))
    first = found.groupBy("query", F.lower("synonym").alias("s")).agg(F.min(F.struct("round", "place", "ord", "synonym")).alias("f"))
    lists = first.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["synonym"]), " OR ").alias("more"))
    return asked.join(lists, "query", "left").select("query", F.when(F.col("more").isNull(), F.col("query")).otherwise(F.concat("query", F.lit(" ("), "more", F.lit(")"))).alias("expanded"))
