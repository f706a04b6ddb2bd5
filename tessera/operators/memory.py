"""Memories: tagged documents in a forest, their upkeep and their search.

A memory has project, id, name, alias, tags, text, timestamp, parent_id, lines_count, size_kb;
its vector is in a second table by memory_id. Children are derived from parent_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import changes, markdown
from tessera.operators import search as nearest


def resolve(memories: DataFrame, id_or_alias: str) -> DataFrame:
    """The memory with that id if the text is a whole number, else with that alias."""
    try:
        return memories.where(F.col("id") == int(id_or_alias))
    except ValueError:
        return memories.where(F.col("alias") == id_or_alias)


def unique_aliases(titles: DataFrame, id_column: str = "id", title: str = "name") -> DataFrame:
    """(id, alias) in order of id: `base`, then `base-1`, `base-2`, ... where a base repeats.

    A generated alias may be another title's own base (`a-b-1`); such bases keep their alias and
    the generated one counts on. That needs a second look only at titles whose alias is taken.
    """
    base = F.when(text.alias_of(F.col(title)) == "", "memory").otherwise(text.alias_of(F.col(title)))
    place = Window.partitionBy("base").orderBy(id_column)
    named = titles.select(id_column, base.alias("base")).withColumn("n", F.row_number().over(place) - 1)
    named = named.withColumn("alias", F.when(F.col("n") == 0, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col("n").cast("string"))))
    taken = named.where("n = 0").select(F.col("base").alias("alias"), F.lit(1).alias("taken"))
    clash = named.where("n > 0").join(taken, "alias", "left_semi").select("base").distinct()
    steps = Window.partitionBy("base").orderBy("n")
    # Bases with a clash: their repeats take the first free numbers.
    hit = named.join(clash, "base", "left_semi")
    wanted = hit.groupBy("base").agg(F.max("n").alias("most"), F.count("*").alias("own"))
    # Each taken alias of a base uses up one number, so that so many more are always enough.
    used = taken.select(F.regexp_extract("alias", "^(.*)-[0-9]+$", 1).alias("base")).groupBy("base").agg(F.count("*").alias("used"))
    wanted = wanted.join(used, "base", "left")
    numbers = wanted.select("base", F.explode(F.sequence(F.lit(1), F.col("most") + F.coalesce("used", F.lit(0)))).alias("number"))
    free = numbers.withColumn("alias", F.concat("base", F.lit("-"), F.col("number").cast("string"))).join(taken, "alias", "left_anti").withColumn("n", F.row_number().over(Window.partitionBy("base").orderBy("number"))).select("base", "n", F.col("alias").alias("free"))
    fixed = named.join(free, ["base", "n"], "left").withColumn("alias", F.coalesce("free", "alias"))
    return fixed.select(id_column, "base", "alias")


def add(memories: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """memories with new ones (project, name, text, tags, parent_id, seq): ids go on from the
    greatest one, a parent's tags are inherited, aliases are generated."""
    top = memories.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    numbered = new.withColumn("id", F.row_number().over(Window.orderBy("seq"))).crossJoin(F.broadcast(top)).withColumn("id", (F.col("id") + F.col("top")).cast("int")).drop("top")
    parents = memories.select(F.col("id").alias("parent_id"), F.col("tags").alias("parent_tags"))
    rows = numbered.join(parents, "parent_id", "left").withColumn("tags", text.tag_union(F.col("parent_tags"), F.col("tags")))
    aliases = unique_aliases(memories.select("id", "name").unionByName(rows.select("id", "name")))
    made = (
        rows.join(aliases.select("id", "alias"), "id")
        .withColumn("timestamp", now)
        .withColumn("lines_count", text.lines_count(F.col("text")))
        .withColumn("size_kb", text.size_kb(F.col("text")))
    )
    return memories.unionByName(made.select(memories.columns))


def _base(title: Column) -> Column:
    return F.when(text.alias_of(title) == "", "memory").otherwise(text.alias_of(title))


def new_aliases(renamed: DataFrame, held: DataFrame) -> DataFrame:
    """(id, alias) for renamed (id, name) in order of id: the first of `base`, `base-1`, `base-2`, ...
    that isn't among held (alias), is no other name's own base, and goes to no smaller id."""
    bases = renamed.select("id", _base(F.col("name")).alias("base"))
    asked = bases.withColumn("place", F.row_number().over(Window.partitionBy("base").orderBy("id")))
    own = bases.select(F.col("base").alias("alias")).distinct()
    occupied = held.select("alias").where("alias IS NOT NULL").unionByName(own).distinct()
    # Each taken alias of a base uses up one number, so that so many more always leave enough.
    stems = occupied.select(F.regexp_extract("alias", "^(.*)-[0-9]+$", 1).alias("base")).groupBy("base").agg(F.count("*").alias("used"))
    sizes = asked.groupBy("base").agg(F.count("*").alias("own")).join(stems, "base", "left")
    numbers = sizes.select("base", F.explode(F.sequence(F.lit(0), F.col("own") + F.coalesce("used", F.lit(0)))).alias("number"))
    numbers = numbers.withColumn("alias", F.when(F.col("number") == 0, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col("number").cast("string"))))
    taken = occupied.join(held.select("alias").distinct().withColumn("held", F.lit(True)), "alias", "left")
    free = numbers.join(taken.withColumn("there", F.lit(True)), "alias", "left").where("there IS NULL OR (number = 0 AND held IS NULL)")
    free = free.withColumn("place", F.row_number().over(Window.partitionBy("base").orderBy("number")))
    return asked.join(free.select("base", "place", "alias"), ["base", "place"]).select("id", "alias")


def update(memories: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """memories after a partial update by updates (id, name, text, tags), one row for each id.

    Fields that aren't null replace those of the memory. A new name makes a new alias against all
    other memories (those renamed with it give up their old ones); a new text new sizes.
    """
    named = updates.where("name IS NOT NULL").join(memories.select("id"), "id", "left_semi").select("id", "name")
    held = memories.join(named.select("id"), "id", "left_anti").select("alias")
    aliases = new_aliases(named, held).withColumnRenamed("alias", "_alias")
    written = updates.where("text IS NOT NULL").select("id", F.lit(True).alias("_written"))
    changed = changes.update_fields(memories, updates, "id", ["name", "text", "tags"], now).join(aliases, "id", "left").join(written, "id", "left")
    out = changed.withColumn("alias", F.coalesce("_alias", "alias"))
    for column, value in (("lines_count", text.lines_count(F.col("text"))), ("size_kb", text.size_kb(F.col("text")))):
        out = out.withColumn(column, F.when(F.col("_written"), value).otherwise(F.col(column)))
    return out.select(memories.columns)


def children(memories: DataFrame, most: int = 10) -> DataFrame:
    """(parent_id, children): each parent's latest children."""
    place = Window.partitionBy("parent_id").orderBy(F.desc("timestamp"), F.desc("id"))
    kept = memories.where("parent_id IS NOT NULL").withColumn("place", F.row_number().over(place)).where(F.col("place") <= most)
    return kept.groupBy("parent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda c: c["id"]).alias("children"))


def relations(memories: DataFrame, most: int = 10) -> DataFrame:
    """(id, parent_name, children) of each memory."""
    parent = memories.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name"))
    kids = children(memories, most).withColumnRenamed("parent_id", "id")
    return memories.join(parent, "parent_id", "left").join(kids, "id", "left").select("id", "parent_id", "parent_name", F.coalesce("children", F.array().cast("array<long>")).alias("children"))


def list_memories(memories: DataFrame, tags: list[str] | None = None) -> DataFrame:
    """Newest first; only those with one of the tags, if any are given."""
    kept = memories.where(text.has_tag(F.col("tags"), tags)) if tags else memories
    return kept.orderBy(F.desc("timestamp"), F.desc("id"))


def search(memories: DataFrame, vectors: DataFrame, query_embedding: list[float], as_of: Column, k: int = 3, snippet_lines: int = 10, tags: list[str] | None = None, older_than_days: int | None = None, has_children: bool | None = None, min_score: float = 0.0) -> DataFrame:
    """The k nearest memories; filters work on those k, so fewer may be left."""
    query = memories.sparkSession.createDataFrame([("", [float(x) for x in query_embedding])], "query string, query_embedding array<double>")
    near = nearest.best_by_score(vectors.select(F.col("memory_id").alias("id"), "embedding"), query, k)
    best = near.where(F.col("score") >= min_score).select(F.col("id").alias("memory_id"), "score")
    found = F.broadcast(best).join(memories, F.col("memory_id") == F.col("id"))  # k rows
    if tags:
        found = found.where(text.has_tag(F.col("tags"), tags))
    if older_than_days is not None:
        found = found.where(F.col("timestamp") <= as_of - F.expr(f"interval {older_than_days} days"))
    if has_children is not None:
        parents = memories.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("id")).distinct()
        found = found.join(parents, "id", "left_semi" if has_children else "left_anti")
    return found.select("id", "name", "tags", F.bround("score", 4).alias("score"), text.snippet(F.col("text"), snippet_lines).alias("snippet")).orderBy(F.desc("score"), "id")


def append(memories: DataFrame, parent: str, child: DataFrame, now: Column) -> DataFrame:
    """memories with child (name, text, tags) below the memory with that id or alias, whose tags it
    inherits; without such a memory nothing is added."""
    above = resolve(memories, parent).select(F.col("id").alias("parent_id"))
    rows = child.crossJoin(F.broadcast(above.limit(1))).withColumn("seq", F.lit(1))
    return add(memories, rows, now)


def import_markdown(memories: DataFrame, document: DataFrame, now: Column, parent_id: int | None = None, tags: list[str] = ()) -> DataFrame:
    """memories with one for each section of a document (path, text).

    A section is below the one that `markdown.parents` gives, or else below parent_id; tags tell
    the file, the import and the level.
    """
    found = markdown.parents(markdown.sections(document, "path", "text"), "path")
    top = memories.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    order = Window.partitionBy("path").orderBy("section")  # the sections of one document
    numbered = found.withColumn("place", F.row_number().over(order)).crossJoin(F.broadcast(top)).withColumn("id", (F.col("top") + F.col("place")).cast("int"))
    places = numbered.select(F.col("path").alias("p_path"), F.col("section").alias("p_section"), F.col("id").alias("p_id"))
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    own = F.array(*[F.lit(t) for t in tags], F.concat(F.lit("imported-from-"), stem), F.lit("imported-markdown"), F.concat(F.lit("level-"), F.col("level").cast("string")))
    rows = numbered.join(places, (F.col("path") == F.col("p_path")) & (F.col("parent") == F.col("p_section")), "left").select(
        "id", F.col("title").alias("name"), F.col("content").alias("text"), own.alias("tags"), F.coalesce("p_id", F.lit(parent_id).cast("int")).alias("parent_id")
    )
    aliases = unique_aliases(memories.select("id", "name").unionByName(rows.select("id", "name"))).select("id", "alias")
    made = rows.join(aliases, "id").withColumn("timestamp", now).withColumn("lines_count", text.lines_count(F.col("text"))).withColumn("size_kb", text.size_kb(F.col("text")))
    return memories.unionByName(made.select(memories.columns))
