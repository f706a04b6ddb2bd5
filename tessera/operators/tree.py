"""The memory forest: depth-limited traversal, counts and renderings.

Each level is one equi-join with the node table; depth is bounded by max_depth, so is the plan.
Only paths from the chosen roots are followed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def traverse(nodes: DataFrame, max_depth: int = 5, root: int | None = None) -> DataFrame:
    """(id, parent_id, name, depth, path, sort_path, circular) in depths 0 to max_depth.

    nodes: (id, parent_id, name). Roots have no parent, or are the chosen node. A node that is
    on its own path is listed as circular and not followed.
    """
    start = nodes.where(F.col("id") == root if root is not None else F.col("parent_id").isNull())
    key = lambda: F.struct(F.col("name"), F.col("id"))
    level = start.select("id", "parent_id", "name", F.lit(0).alias("depth"), F.array("id").alias("path"), F.array(key()).alias("sort_path"), F.lit(False).alias("circular"))
    out = level
    kids = nodes.select(F.col("id").alias("c_id"), F.col("parent_id").alias("c_parent"), F.col("name").alias("c_name"))
    for depth in range(1, max_depth + 1):
        joined = level.where("NOT circular").join(kids, F.col("id") == F.col("c_parent"))
        level = joined.select(
            F.col("c_id").alias("id"),
            F.col("c_parent").alias("parent_id"),
            F.col("c_name").alias("name"),
            F.lit(depth).alias("depth"),
            F.array_append("path", F.col("c_id")).alias("path"),
            F.array_append("sort_path", F.struct(F.col("c_name").alias("name"), F.col("c_id").alias("id"))).alias("sort_path"),
            F.array_contains("path", F.col("c_id")).alias("circular"),
        )
        out = out.unionByName(level)
    return out


def node_count(nodes: DataFrame, max_depth: int = 5, root: int | None = None) -> DataFrame:
    return traverse(nodes, max_depth, root).agg(F.count_distinct("id").alias("nodes"), F.max("depth").alias("deepest"))


def ascii_lines(nodes: DataFrame, max_depth: int = 5, root: int | None = None) -> DataFrame:
    """(sort_path, line): the drawing's lines; in order of sort_path they are the tree."""
    walked = traverse(nodes, max_depth, root)
    parent = F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(1)))
    last = (F.col("depth") == 0) | F.lead("id").over(Window.partitionBy("depth", parent).orderBy("sort_path")).isNull()
    marked = walked.withColumn("last", last)
    # Which ancestors were the last of their siblings decides the bars before a line.
    ancestors = marked.select(F.col("path").alias("a_path"), F.col("last").alias("a_last"), F.col("depth").alias("a_depth"))
    up = marked.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.struct(k.alias("k"), F.slice("path", 1, k).alias("part")))).alias("p")).where((F.col("p.k") > 1) & (F.col("p.k") < F.size("path")))
    bars = up.join(ancestors, F.col("p.part") == F.col("a_path")).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a_depth", "a_last"))), lambda a: F.when(a["a_last"], "    ").otherwise("│   ")), "").alias("bars"))
    branch = F.when(F.col("depth") == 0, "").when(F.col("last"), "└── ").otherwise("├── ")
    label = F.when(F.col("circular"), F.concat(F.lit("[CIRCULAR REFERENCE: #"), F.col("id").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("[#"), F.col("id").cast("string"), F.lit("] "), F.col("name")))
    return marked.join(bars, "path", "left").select("sort_path", F.concat(F.coalesce("bars", F.lit("")), branch, label).alias("line"))


def markdown_lines(nodes: DataFrame, body: Column, max_depth: int = 10, root: int | None = None) -> DataFrame:
    """(sort_path, block): a heading of each node, as deep as the node but six at most, and its body.

    nodes has what `body` reads, beside (id, parent_id, name). One level less than `traverse`.
    """
    walked = traverse(nodes, max_depth - 2, root).where("NOT circular")
    rest = nodes.select("id", body.alias("body"))
    head = F.concat(F.repeat(F.lit("#"), F.least(F.col("depth") + 1, F.lit(6))), F.lit(" "), F.col("name"))
    return walked.join(rest, "id").select("sort_path", F.concat_ws("\n\n", head, "body").alias("block"))


def nested(nodes: DataFrame, max_depth: int = 5, root: int | None = None) -> list[dict]:
    """The traversal as nested dicts, for one export; built on the driver, as its depth isn't fixed."""
    by_path: dict[tuple, dict] = {}
    top: list[dict] = []
    for r in traverse(nodes, max_depth, root).orderBy("sort_path").toLocalIterator():
        item = {"id": r["id"], "name": r["name"], "children": []} if not r["circular"] else {"id": r["id"], "circular": True}
        by_path[tuple(r["path"])] = item
        (by_path[tuple(r["path"][:-1])]["children"] if r["depth"] else top).append(item)
        if r["depth"] == max_depth:
            item["childrenOmitted"] = True
    return top
