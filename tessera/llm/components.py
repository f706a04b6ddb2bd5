"""Connected components of an edge table, by alternating star contractions.

Every round replaces edges by edges to smaller nodes: first each node's larger neighbours are
linked to its least neighbour, then the same the other way round. The edge table never grows
beyond the nodes plus the edges, and a chain of n nodes needs about log(n) rounds. Tables are
written to the shared folder each round, so lineage stays short and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """(a, b), a > b: each node's neighbours (for large: only those larger than it) to its least."""
    both = edges.select("a", "b")
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the component's least node, which
    isn't listed itself."""
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = scratch.keep(now, "edges-0")
    previous = None
    for k in range(1, MAX_ROUNDS):
        now = scratch.keep(_star(_star(now, True), False), f"edges-{k}")
        scratch.drop(f"edges-{k - 1}")
        # Done when all edges lead to roots, which have no edge of their own, and each node has one.
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if previous == (state["n"], state["h"]):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        previous = (state["n"], state["h"])
    raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
