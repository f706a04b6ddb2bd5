"""Queries over the driver's tables, one for each operator that tables can show, and their SQL.

The tables stand in for the engine's own: documents are chunks and memories, embeddings are their
vectors, conversations are a forest, events are changes, pages are paths.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import fixed, scoring, text
from tessera.operators import cache, changes, expand, markdown, memory, search, statistics, tree, windows
from tessera.plans import structures
from tessera.sources import embedding, files
from tessera.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

AS_OF = "2024-06-30 00:00:00"
FOLDERS = ["controllers", "services", "models", "tests", "components", "lib", "identity", "handlers"]
ENDINGS = [".cs", ".razor", ".c", ".h", ".generated.cs"]
TYPES = ["class", "method", "interface", "property", "sliding_window", "generated", "enum", "method-auth", "class-security", "class-config"]


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def days_before(days: Column) -> Column:
    return F.timestamp_add("DAY", -days.cast("int"), as_of())


def pick(values: list[str], key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def pick_sql(values: list[str], key: str) -> str:
    return f"(ARRAY[{', '.join(repr(v) for v in values)}])[({key}) % {len(values)} + 1]"


def with_paths(documents: DataFrame) -> DataFrame:
    d = F.col("doc_id")
    return documents.withColumn("file_path", F.concat(F.lit("src/"), pick(FOLDERS, d), F.lit("/"), "lang", d.cast("string"), pick(ENDINGS, d)))


PATH_SQL = f"'src/' || {pick_sql(FOLDERS, 'doc_id')} || '/' || lang || doc_id || {pick_sql(ENDINGS, 'doc_id')}"


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return (
        with_paths(table(spark, sf, "documents"))
        .join(vectors, F.col("doc_id") == F.col("vec_id"))
        .select(F.col("doc_id").alias("id"), "file_path", pick(TYPES, F.col("label")).alias("chunk_type"), F.col("text").alias("content"), "embedding", days_before(F.col("doc_id") % 120).alias("last_modified"))
    )


CORPUS_SQL = f"""corpus AS (
  SELECT doc_id AS id, {PATH_SQL} AS file_path, {pick_sql(TYPES, 'label')} AS chunk_type, text AS content, embedding::DOUBLE[] AS v,
    TIMESTAMP '{AS_OF}' - to_days((doc_id % 120)::INT) AS last_modified
  FROM documents JOIN embeddings ON doc_id = vec_id)"""


def one_query(spark: SparkSession, sf: str, ids: tuple[int, ...] = (0,)) -> DataFrame:
    """The vectors with these ids as queries (a stated few)."""
    return table(spark, sf, "embeddings").where(F.col("vec_id").isin(*ids)).select(F.concat(F.lit("q"), F.col("vec_id").cast("string")).alias("query"), F.col("embedding").alias("query_embedding"))


def _cos(a: str, b: str) -> str:
    return f"list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})))"


def _like(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


NAME_SQL, DIR_SQL = "lower(regexp_extract(file_path, '[^/]*$'))", "lower(regexp_replace(file_path, '/[^/]*$', ''))"
IMPORTANCE_SQL = f"""CASE
  WHEN {_like(NAME_SQL, fixed.AUTH_FILE_WORDS)} OR {_like(DIR_SQL, fixed.AUTH_DIRECTORY_WORDS)} OR {_like('lower(content)', fixed.AUTH_WORDS)} THEN 1.5
  WHEN {_like(NAME_SQL, ['program.cs', 'startup.cs'])} THEN 1.4 WHEN {_like(NAME_SQL, ['appsettings', 'config'])} THEN 1.3
  WHEN contains({DIR_SQL}, 'controllers') OR contains({NAME_SQL}, 'controller') THEN 1.2
  WHEN {_like(DIR_SQL, ['services', 'handlers'])} THEN 1.15 WHEN {_like(DIR_SQL, ['models', 'entities'])} THEN 1.1
  WHEN ends_with({NAME_SQL}, '.razor') OR contains({DIR_SQL}, 'components') THEN 1.1
  WHEN {_like(DIR_SQL, ['test', 'spec'])} THEN 0.8
  WHEN ends_with({NAME_SQL}, '.generated.cs') OR contains({NAME_SQL}, '.designer.cs') THEN 0.7
  WHEN chunk_type IN ('class-auth', 'method-auth', 'interface-auth', 'property-auth') THEN 1.5
  WHEN chunk_type IN ('class-security', 'method-security') THEN 1.4 WHEN chunk_type IN ('class-config', 'method-config') THEN 1.3
  WHEN chunk_type = 'class-controller' THEN 1.2 WHEN chunk_type = 'class-service' THEN 1.15
  WHEN chunk_type = 'class' AND contains(lower(content), 'controller') THEN 1.2
  WHEN chunk_type IN ('class', 'interface') THEN 1.1
  WHEN chunk_type = 'method' AND {_like('lower(content)', fixed.AUTH_METHOD_WORDS)} THEN 1.3
  WHEN chunk_type = 'method' THEN 1.05 WHEN chunk_type IN ('property', 'namespace') THEN 1.0
  WHEN chunk_type = 'sliding_window' THEN 0.9 WHEN chunk_type = 'generated' THEN 0.8
  WHEN ends_with(chunk_type, '-auth') THEN 1.4 WHEN ends_with(chunk_type, '-security') THEN 1.3 WHEN ends_with(chunk_type, '-config') THEN 1.2
  ELSE 1.0 END::DOUBLE"""
RECENCY_SQL = f"CASE WHEN last_modified >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY THEN 1.1 WHEN last_modified >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY THEN 1.05 WHEN last_modified >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY THEN 1.0 ELSE 0.95 END::DOUBLE"


def ranked_sql(ids: str = "0", where: str = "true") -> str:
    """CTEs up to `ranked`: every chunk with score and combined for each query."""
    return f"""WITH {CORPUS_SQL}, q AS (SELECT 'q' || vec_id AS query, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id IN ({ids})),
scored AS (SELECT *, {_cos('v', 'qv')} AS score, {IMPORTANCE_SQL} AS importance, {RECENCY_SQL} AS recency FROM corpus, q WHERE {where}),
ranked AS (SELECT *, score * 0.7::DOUBLE + score * importance * 0.2::DOUBLE + score * recency * 0.1::DOUBLE AS combined FROM scored)"""


# Search ---------------------------------------------------------------------------------------


@query(f"WITH {CORPUS_SQL}, q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0) SELECT id, round({_cos('v', 'qv')}, 9) AS score FROM corpus, q ORDER BY {_cos('v', 'qv')} DESC, id LIMIT 10")
def cosine_topk(spark, sf):
    return search.best_by_score(corpus(spark, sf), one_query(spark, sf), 10).select("id", F.round("score", 9).alias("score"))


@query(f"SELECT a.vec_id, 'q' || b.vec_id AS query, round({_cos('a.embedding::DOUBLE[]', 'b.embedding::DOUBLE[]')}, 9) AS score FROM embeddings a, (SELECT * FROM embeddings WHERE vec_id IN (0, 1, 2, 3, 4)) b WHERE {_cos('a.embedding::DOUBLE[]', 'b.embedding::DOUBLE[]')} >= 0.25")
def cosine_threshold(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("id", F.col("vec_id"))
    hits = search.scored(rows, one_query(spark, sf, (0, 1, 2, 3, 4))).where(F.col("score") >= 0.25)
    return hits.select("vec_id", "query", F.round("score", 9).alias("score"))


@query(f"{ranked_sql()} SELECT id, file_path, chunk_type, round(score, 9) AS score, importance, recency, round(combined, 9) AS combined FROM ranked")
def rerank_scores(spark, sf):
    hits = search.ranked(corpus(spark, sf), one_query(spark, sf), as_of())
    return hits.select("id", "file_path", "chunk_type", F.round("score", 9).alias("score"), "importance", "recency", F.round("combined", 9).alias("combined"))


@query(f"{ranked_sql()} SELECT id, round(score, 9) AS score, round(combined, 9) AS combined, max(score) OVER () < 0.45 AS low_confidence FROM (SELECT * FROM ranked ORDER BY combined DESC, id LIMIT 5)")
def rerank_topk(spark, sf):
    best = search.search(corpus(spark, sf), one_query(spark, sf), as_of(), 5)
    return search.low_confidence(best).select("id", F.round("score", 9).alias("score"), F.round("combined", 9).alias("combined"), "low_confidence")


_FILTER_SQL = "(ends_with(lower(file_path), '.cs') OR ends_with(lower(file_path), '.razor')) AND lower(chunk_type) IN ('class', 'method', 'interface')"


@query(f"{ranked_sql()} SELECT id, file_path, chunk_type, round(combined, 9) AS combined FROM (SELECT * FROM ranked ORDER BY combined DESC, id LIMIT 20) WHERE {_FILTER_SQL} ORDER BY combined DESC, id LIMIT 5")
def filtered_search_post(spark, sf):
    best = search.search(corpus(spark, sf), one_query(spark, sf), as_of(), 5, "cs, razor", "class,Method,interface")
    return best.select("id", "file_path", "chunk_type", F.round("combined", 9).alias("combined"))


@query(f"{ranked_sql(where=_FILTER_SQL)} SELECT id, file_path, chunk_type, round(combined, 9) AS combined FROM ranked ORDER BY ranked.combined DESC, id LIMIT 5")
def filtered_search_pre(spark, sf):
    best = search.search(corpus(spark, sf), one_query(spark, sf), as_of(), 5, "cs, razor", "class,Method,interface", prefilter=True)
    return best.select("id", "file_path", "chunk_type", F.round("combined", 9).alias("combined"))


_BATCH = (0, 1, 2, 3, 4)
_BATCH_SQL = f"{ranked_sql('0, 1, 2, 3, 4')}, hits AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY combined DESC, id) AS rank FROM ranked QUALIFY rank <= 5)"


def _batch(spark, sf):
    return search.batch_search(corpus(spark, sf), one_query(spark, sf, _BATCH), as_of(), 5)


@query(f"{_BATCH_SQL} SELECT query, rank::INT AS rank, id, round(score, 9) AS score FROM hits")
def batch_search(spark, sf):
    return _batch(spark, sf).select("query", "rank", "id", F.round("score", 9).alias("score"))


@query(f"{_BATCH_SQL}, found AS (SELECT query, count(*) AS n FROM hits WHERE score >= 0.45 GROUP BY query) SELECT coalesce(sum(n), 0)::BIGINT AS total_results, count(n) AS queries_with_results, count(*) FILTER (n IS NULL) AS queries_without_results FROM q LEFT JOIN found USING (query)")
def batch_summary(spark, sf):
    return search.batch_summary(_batch(spark, sf).where(F.col("score") >= 0.45), one_query(spark, sf, _BATCH))


@query(f"{_BATCH_SQL} SELECT regexp_replace(file_path, '/[^/]*$', '') AS file_path, count(*) AS results, count(DISTINCT query) AS n_queries, round(max(score), 9) AS max_score FROM hits GROUP BY 1 HAVING count(*) > 1 ORDER BY count(DISTINCT query) DESC, max(score) DESC, 1 LIMIT 10")
def batch_cross_reference(spark, sf):
    hits = _batch(spark, sf).withColumn("file_path", scoring.directory(F.col("file_path")))
    return search.cross_reference(hits).select("file_path", "results", "n_queries", F.round("max_score", 9).alias("max_score"))


_LINES_SQL = "string_split(content, chr(10))"


@query(f"""{ranked_sql()}, best AS (SELECT *, len({_LINES_SQL}) AS n FROM ranked ORDER BY combined DESC, id LIMIT 10),
placed AS (SELECT *, least(3, n) AS s, least(5, n) AS e, CASE WHEN contains(chunk_type, 'method') OR contains(chunk_type, 'function') THEN 18 WHEN contains(chunk_type, 'class') THEN 20 WHEN contains(chunk_type, 'property') THEN 10
  WHEN contains(chunk_type, 'interface') THEN 15 WHEN contains(chunk_type, 'enum') THEN 8 WHEN contains(chunk_type, 'auth') OR contains(chunk_type, 'security') THEN 20 ELSE 15 END AS k FROM best)
SELECT id, greatest(1, s - k)::INT AS context_start, least(n, e + k)::INT AS context_end, array_to_string({_LINES_SQL}[greatest(1, s - k):least(n, e + k)], chr(10)) AS context FROM placed""")
def context_lines(spark, sf):
    best = search.search(corpus(spark, sf), one_query(spark, sf), as_of(), 10)
    n = F.size(F.split("content", "\n"))
    hits = best.withColumn("start_line", F.least(F.lit(3), n)).withColumn("end_line", F.least(F.lit(5), n))
    source = with_paths(table(spark, sf, "documents")).select("file_path", "text")
    return search.with_context(hits, source).select("id", "context_start", "context_end", "context")


# Classification and rendering --------------------------------------------------------------------


@query(f"""WITH {CORPUS_SQL} SELECT id, CASE WHEN {_like('lower(content)', fixed.AUTH_WORDS + fixed.AUTH_TYPE_WORDS)} OR {_like(NAME_SQL, fixed.AUTH_FILE_WORDS)} OR {_like(DIR_SQL, fixed.AUTH_DIRECTORY_WORDS)} THEN chunk_type || '-auth'
  WHEN {_like('lower(content)', fixed.SECURITY_WORDS)} THEN chunk_type || '-security' WHEN {_like(NAME_SQL, ['program.cs', 'startup.cs'])} THEN chunk_type || '-config'
  WHEN chunk_type = 'class' AND (contains(lower(content), 'controller') OR contains({NAME_SQL}, 'controller')) THEN 'class-controller'
  WHEN chunk_type = 'class' AND (contains(lower(content), 'service') OR contains({DIR_SQL}, 'services')) THEN 'class-service' ELSE chunk_type END AS chunk_type,
  CASE WHEN {_like('lower(content)', fixed.C_NAME_WORDS['-auth'])} THEN 'c-function-auth' WHEN {_like('lower(content)', fixed.C_NAME_WORDS['-security'])} THEN 'c-function-security'
  WHEN {_like('lower(content)', fixed.C_NAME_WORDS['-config'])} THEN 'c-function-config' ELSE 'c-function' END AS c_type FROM corpus""")
def chunk_types(spark, sf):
    return corpus(spark, sf).select("id", scoring.enrich_type(F.col("chunk_type"), F.col("file_path"), F.col("content")).alias("chunk_type"), scoring.enrich_c_type(F.lit("c-function"), F.col("content")).alias("c_type"))


@query(f"""WITH d AS (SELECT *, TIMESTAMP '{AS_OF}' - to_days((doc_id % 9)::INT) AS stored, trim(string_split(text, chr(10))[1], ' ') AS first FROM documents)
SELECT doc_id, CASE WHEN doc_id % 9 < 1 THEN 'Stored today' WHEN doc_id % 9 < 2 THEN 'Stored 1 day ago' ELSE 'Stored ' || (doc_id % 9) || ' days ago' END AS age,
  CASE WHEN doc_id % 9 = 0 THEN 'just now' WHEN doc_id % 9 = 1 THEN '1 day ago' WHEN doc_id % 9 < 7 THEN (doc_id % 9) || ' days ago' ELSE '' END AS relative,
  len(list_filter(regexp_split_to_array(text, '[\\n\\r]'), lambda x: x <> ''))::INT AS lines_count, round(octet_length(encode(text)) / 1024.0::DOUBLE, 9) AS size_kb,
  CASE WHEN length(first) > 80 THEN first[1:77] || '...' ELSE first END AS preview, array_to_string(string_split(text, chr(10))[1:10], chr(10)) AS snippet FROM d""")
def text_scalars(spark, sf):
    t, stored = F.col("text"), days_before(F.col("doc_id") % 9)
    return table(spark, sf, "documents").select(
        "doc_id",
        text.age_display(stored, as_of()).alias("age"),
        text.relative_time(stored, as_of()).alias("relative"),
        text.lines_count(t).alias("lines_count"),
        F.round(text.size_kb(t), 9).alias("size_kb"),
        text.preview(t).alias("preview"),
        text.snippet(t, 10).alias("snippet"),
    )


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), e AS (SELECT doc_id, list_transform(lines, lambda x, i: CASE WHEN i < 10000 THEN lpad(i::VARCHAR, 4, ' ') ELSE i::VARCHAR END || ': ' || x) AS n FROM l)
SELECT doc_id, array_to_string(CASE WHEN len(n) > 40 THEN n[1:20] || ['... (' || (len(n) - 40) || ' lines not shown) ...'] || n[len(n) - 19:] ELSE n END, chr(10)) AS rendered FROM e""")
def numbered_lines(spark, sf):
    lines = text.numbered(F.split("text", "\n"), F.lit(1))
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.elided(lines, 40, 20), "\n").alias("rendered"))


@query("SELECT doc_id, rtrim(translate(to_base64(from_hex(sha256(text))), '+/', '-_'), '=') AS cache_key, to_base64(from_hex(sha256(text))) AS content_hash FROM documents")
def hash_keys(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.cache_key(F.col("text")).alias("cache_key"), text.content_hash(F.col("text")).alias("content_hash"))


_SHORT_SQL = "CASE WHEN length(p) > 20 AND len(s) > 4 THEN s[1] || '/.../' || array_to_string(s[len(s) - 2:], '/') ELSE p END"


@query(f"WITH u AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS p, string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS s FROM pages) SELECT page_id, s[len(s)] AS name, CASE WHEN contains(p, '/') THEN regexp_replace(p, '/[^/]*$', '') ELSE '' END AS directory, {_SHORT_SQL} AS short FROM u")
def path_parts(spark, sf):
    p = F.regexp_replace("url", "^[a-z]+://", "")
    return table(spark, sf, "pages").select("page_id", scoring.file_name(p).alias("name"), scoring.directory(p).alias("directory"), text.shorten_path(p, 20).alias("short"))


@query(f"""WITH p AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'bin/' || lang || '.cs' WHEN 1 THEN 'a/mybin/' || doc_id || '.cs' WHEN 2 THEN 'x/obj/' || doc_id || '.h' WHEN 3 THEN 'Bin/' || doc_id || '.DLL' WHEN 4 THEN 'lib/' || doc_id || '.min.js'
  WHEN 5 THEN 'app/Connected Services/' || doc_id || '.cs' ELSE 'app/' || doc_id || '.cs' END AS path, n_chars * 40 AS length FROM documents)
SELECT doc_id, path, ({' OR '.join(f"contains(path, '/{x}') OR starts_with(path, '{x}')" if x.endswith('/') else f"ends_with(lower(path), '{x[1:]}')" for x in fixed.IGNORED)}) OR length > 1048576 AS ignored FROM p""")
def ignore_predicate(spark, sf):
    d, name = F.col("doc_id"), F.col("doc_id").cast("string")
    path = (
        F.when(d % 7 == 0, F.concat(F.lit("bin/"), "lang", F.lit(".cs"))).when(d % 7 == 1, F.concat(F.lit("a/mybin/"), name, F.lit(".cs"))).when(d % 7 == 2, F.concat(F.lit("x/obj/"), name, F.lit(".h")))
        .when(d % 7 == 3, F.concat(F.lit("Bin/"), name, F.lit(".DLL"))).when(d % 7 == 4, F.concat(F.lit("lib/"), name, F.lit(".min.js"))).when(d % 7 == 5, F.concat(F.lit("app/Connected Services/"), name, F.lit(".cs"))).otherwise(F.concat(F.lit("app/"), name, F.lit(".cs")))
    )
    return table(spark, sf, "documents").select("doc_id", path.alias("path"), files.ignored(path, F.col("n_chars") * 40).alias("ignored"))


# Statistics ----------------------------------------------------------------------------------------


@query(f"WITH {CORPUS_SQL} SELECT count(*) AS chunk_count, count(DISTINCT file_path) AS file_count, round(sum(4 * len(v)) / 1048576.0::DOUBLE, 9) AS vector_mb, round(count(*) * 512 / 1048576.0::DOUBLE, 9) AS metadata_mb, round(sum(4 * len(v)) / 1048576.0::DOUBLE + count(*) * 512 / 1048576.0::DOUBLE, 9) AS total_mb FROM corpus")
def index_stats(spark, sf):
    s = statistics.index_stats(corpus(spark, sf))
    return s.select("chunk_count", "file_count", *[F.round(c, 9).alias(c) for c in ("vector_mb", "metadata_mb", "total_mb")])


@query(f"SELECT lower(regexp_extract(file_path, '\\.([^./]+)$', 1)) AS extension, count(*) AS files FROM (SELECT {PATH_SQL} AS file_path FROM documents) GROUP BY 1")
def extension_counts(spark, sf):
    return statistics.extension_counts(with_paths(table(spark, sf, "documents")))


@query(f"WITH {CORPUS_SQL} SELECT chunk_type, count(*) AS chunks, round_even(100 * count(*) / sum(count(*)) OVER (), 1) AS percent FROM corpus GROUP BY chunk_type")
def chunk_type_distribution(spark, sf):
    return statistics.type_distribution(corpus(spark, sf))


@query("SELECT source AS project, count(DISTINCT doc_id) AS n_files, round(sum(octet_length(encode(text))) / 1048576.0::DOUBLE, 9) AS size_mb FROM documents GROUP BY 1")
def project_catalog(spark, sf):
    return table(spark, sf, "documents").groupBy(F.col("source").alias("project")).agg(F.count_distinct("doc_id").alias("n_files"), F.round(F.sum(F.octet_length("text")) / 1048576, 9).alias("size_mb"))


@query(f"WITH {CORPUS_SQL}, q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0), s AS (SELECT {_cos('v', 'qv')} AS x FROM corpus, q) SELECT count(*) AS n, round(avg(x), 9) AS mean, round(min(x), 9) AS least, round(max(x), 9) AS most, round(stddev_pop(x), 9) AS deviation FROM s")
def bench_stats(spark, sf):
    s = statistics.bench_stats(search.scored(corpus(spark, sf), one_query(spark, sf)), "score")
    return s.select("n", *[F.round(c, 9).alias(c) for c in ("mean", "least", "most", "deviation")])


@query("""WITH f AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/[^/]*$', '') AS folder FROM pages),
n AS (SELECT host, count(*) AS n FROM f GROUP BY host), s AS (SELECT host, unnest(string_split(folder, '/')) AS seg, generate_subscripts(string_split(folder, '/'), 1) AS pos FROM f),
c AS (SELECT host, pos, min(seg) AS seg FROM s JOIN n USING (host) GROUP BY host, pos, n HAVING count(DISTINCT seg) = 1 AND count(*) = n),
r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY pos) AS k FROM c)
SELECT n.host, coalesce(string_agg(seg, '/' ORDER BY pos) FILTER (pos = k), '') AS root FROM n LEFT JOIN r USING (host) GROUP BY n.host""")
def common_root(spark, sf):
    host, path = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1), F.regexp_replace("url", "^[a-z]+://", "")
    return statistics.common_root(table(spark, sf, "pages").select(host.alias("host"), path.alias("path")), "host", "path")


# Changes and cache -----------------------------------------------------------------------------------


def _states(spark, sf) -> tuple[DataFrame, DataFrame]:
    d = with_paths(table(spark, sf, "documents"))
    new = d.select(F.col("file_path").alias("path"), text.content_hash(F.col("text")).alias("content_hash"))
    was = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    old = d.where(F.col("doc_id") % 7 != 0).select(F.col("file_path").alias("path"), text.content_hash(was).alias("content_hash"))
    ghosts = d.where(F.col("doc_id") % 11 == 0).select(F.concat(F.lit("gone/"), "file_path").alias("path"), F.lit("x").alias("content_hash"))
    return old.unionByName(ghosts), new


_STATES_SQL = f"""WITH d AS (SELECT *, {PATH_SQL} AS path FROM documents), new AS (SELECT path, to_base64(from_hex(sha256(text))) AS h FROM d),
old AS (SELECT path, to_base64(from_hex(sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END))) AS h FROM d WHERE doc_id % 7 <> 0 UNION ALL SELECT 'gone/' || path, 'x' FROM d WHERE doc_id % 11 = 0),
diff AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' WHEN o.h <> n.h THEN 'modified' END AS change FROM old o FULL JOIN new n ON o.path = n.path)"""


@query(f"{_STATES_SQL} SELECT path, change FROM diff WHERE change IS NOT NULL")
def change_detection(spark, sf):
    return changes.diff(*_states(spark, sf))


@query(f"{_STATES_SQL} SELECT path, h AS content_hash FROM old WHERE path NOT IN (SELECT path FROM diff WHERE change IN ('removed', 'modified')) UNION ALL SELECT path, h FROM new WHERE path IN (SELECT path FROM diff WHERE change IN ('added', 'modified'))")
def incremental_apply(spark, sf):
    old, new = _states(spark, sf)
    changed = changes.diff(old, new)
    fresh = new.join(changed.where("change <> 'removed'"), "path", "left_semi")
    as_file = lambda df: df.withColumnRenamed("path", "file_path")
    return changes.apply_changes(as_file(old), changed, as_file(fresh)).withColumnRenamed("file_path", "path")


_UP_SQL = "SELECT doc_id // 2 AS id, doc_id AS seq, lang AS value FROM documents"


@query(f"WITH t AS (SELECT doc_id AS id, 0::BIGINT AS seq, source AS value FROM documents), r AS ({_UP_SQL}), w AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1) SELECT * FROM t WHERE id NOT IN (SELECT id FROM w) UNION ALL SELECT * FROM w")
def incremental_upsert(spark, sf):
    d = table(spark, sf, "documents")
    old = d.select(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("seq"), F.col("source").alias("value"))
    new = d.select(F.floor(F.col("doc_id") / 2).alias("id"), F.col("doc_id").alias("seq"), F.col("lang").alias("value"))
    return changes.upsert(old, new, "id", "seq")


@query("SELECT doc_id, source FROM documents WHERE source NOT IN (SELECT DISTINCT source FROM documents WHERE n_chars > 12000)")
def delete_by_path(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return changes.delete(d, d.where("n_chars > 12000"), "source").select("doc_id", "source")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def lookup_by_ids(spark, sf):
    return changes.deleted(table(spark, sf, "documents"), table(spark, sf, "labels").where("toxic = 1"), "doc_id").select("doc_id", "source")


@query(f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new ' || source ELSE source END AS name, CASE WHEN doc_id % 4 = 0 THEN 'xx' ELSE lang END AS lang,
  CASE WHEN doc_id % 3 = 0 OR doc_id % 4 = 0 THEN TIMESTAMP '{AS_OF}' ELSE TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY END AS updated_at FROM documents""")
def memory_update(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("name"), "lang", days_before(F.lit(30)).alias("updated_at"))
    new = d.where("doc_id % 3 = 0 OR doc_id % 4 = 0 OR doc_id % 5 = 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("new "), "name")).alias("name"), F.when(F.col("doc_id") % 4 == 0, "xx").alias("lang"))
    return changes.update_fields(d, new, "doc_id", ["name", "lang"], as_of())


_CACHE_SQL = "WITH w AS (SELECT DISTINCT rtrim(translate(to_base64(from_hex(sha256(text))), '+/', '-_'), '=') AS content_hash, CASE WHEN lang = 'en' THEN NULL ELSE lang END AS project FROM documents), c AS (SELECT DISTINCT rtrim(translate(to_base64(from_hex(sha256(text))), '+/', '-_'), '=') AS content_hash, CASE WHEN lang = 'en' THEN NULL ELSE lang END AS project, 'x' AS h FROM documents WHERE source < 'src5')"


def _cache_rows(d: DataFrame) -> DataFrame:
    return d.select(text.cache_key(F.col("text")).alias("content_hash"), F.lit("document").alias("embedding_type"), F.lit("m").alias("model"), F.when(F.col("lang") != "en", F.col("lang")).alias("project")).distinct()


@query(f"{_CACHE_SQL} SELECT w.content_hash, w.project, c.h IS NOT NULL AS hit FROM w LEFT JOIN c ON w.content_hash = c.content_hash AND w.project IS NOT DISTINCT FROM c.project")
def embedding_cache_lookup(spark, sf):
    d = table(spark, sf, "documents")
    held = _cache_rows(d.where("source < 'src5'")).withColumn("embedding", F.array(F.lit(1.0)))
    return cache.look_up(_cache_rows(d), held).select("content_hash", "project", "hit")


_LOG_SQL = f"SELECT user_id::VARCHAR AS content_hash, max(ts) AS last_accessed, 1 + count(*) AS access_count FROM events GROUP BY 1"


def _used(spark, sf) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("content_hash"), F.col("ts").alias("at"))
    held = e.select("content_hash").distinct().select("content_hash", F.lit("2020-01-01").cast("timestamp_ntz").alias("last_accessed"), F.lit(1).cast("long").alias("access_count"), F.array(F.lit(1.0).cast("float")).alias("embedding"))
    return cache.accessed(held, e)


@query(f"SELECT content_hash, last_accessed, access_count FROM ({_LOG_SQL}) ORDER BY last_accessed DESC, content_hash LIMIT 50")
def cache_lru(spark, sf):
    return cache.evict_lru(_used(spark, sf), 50).select("content_hash", "last_accessed", "access_count")


@query(f"SELECT content_hash, last_accessed, access_count FROM ({_LOG_SQL}) WHERE last_accessed >= TIMESTAMP '{AS_OF}' - INTERVAL 152 DAY")
def cache_purge(spark, sf):
    return cache.purge(_used(spark, sf), as_of(), 152).select("content_hash", "last_accessed", "access_count")


@query("SELECT count(*) AS entries, (sum(4 * len(embedding)))::BIGINT AS embedding_bytes FROM embeddings")
def cache_stats(spark, sf):
    return cache.statistics(table(spark, sf, "embeddings"))


# Expansion, aliases, tags --------------------------------------------------------------------------

_SYN_SQL = "(VALUES " + ", ".join(f"('{t}', '{s}', {k}, {p})" for t, s, k, p in expand.synonym_rows()) + ") AS syn(term, synonym, ord, place)"
_SEED_TERMS = ["auth", "refresh token", "Config", "user query", "save the File", "nothing here", "unit test error", "http request", "find", "Environment Variable"]


@query(f"""WITH q AS (SELECT DISTINCT t || ' ' || coalesce(split_part(text, ' ', 1), '') AS query FROM benchmark, (SELECT unnest([{', '.join(repr(t) for t in _SEED_TERMS)}]) AS t) UNION SELECT unnest([{', '.join(repr(t) for t in _SEED_TERMS)}])),
syn AS (SELECT * FROM {_SYN_SQL}), w AS (SELECT query, unnest(regexp_extract_all(query, '[\\p{{L}}\\p{{N}}_]+')) AS word, generate_subscripts(regexp_extract_all(query, '[\\p{{L}}\\p{{N}}_]+'), 1) AS k FROM q),
f AS (SELECT query, 0 AS r, k AS p, ord, synonym FROM w JOIN syn ON lower(word) = term UNION ALL SELECT query, 1, place, ord, synonym FROM q JOIN syn ON contains(term, ' ') AND contains(lower(query), term)),
u AS (SELECT * FROM f WHERE lower(synonym) <> lower(query) QUALIFY row_number() OVER (PARTITION BY query, lower(synonym) ORDER BY r, p, ord) = 1),
m AS (SELECT query, string_agg(synonym, ' OR ' ORDER BY r, p, ord) AS more FROM u GROUP BY query)
SELECT q.query, CASE WHEN more IS NULL THEN q.query ELSE q.query || ' (' || more || ')' END AS expanded FROM q LEFT JOIN m USING (query)""")
def query_expansion(spark, sf):
    seeds = F.array(*[F.lit(t) for t in _SEED_TERMS])
    b = table(spark, sf, "benchmark").select(F.explode(seeds).alias("t"), "text")
    q = b.select(F.concat("t", F.lit(" "), F.coalesce(F.substring_index("text", " ", 1), F.lit(""))).alias("query")).unionByName(spark.createDataFrame([(t,) for t in _SEED_TERMS], "query string"))
    return expand.expand(q, expand.synonyms(spark))


def alias_sql(title: str) -> str:
    t = f"lower({title})"
    for c in fixed.ALIAS_TO_SPACE:
        t = f"replace({t}, '{c}', ' ')"
    for c in fixed.ALIAS_DROPPED:
        t = f"replace({t}, '{c if c != chr(39) else chr(39) * 2}', '')"
    for c, w in fixed.ALIAS_WORDS.items():
        t = f"replace({t}, '{c}', '{w}')"
    words = f"list_filter(regexp_split_to_array({t}, '[ _-]'), lambda x: x <> '')[1:3]"
    return f"regexp_replace(regexp_replace(regexp_replace(array_to_string({words}, '-'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')"


@query(f"SELECT doc_id, {alias_sql('text')} AS alias FROM documents")
def alias_of(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.alias_of(F.col("text")).alias("alias"))


@query(f"""WITH b AS (SELECT p_partkey AS id, CASE WHEN {alias_sql('p_name')} = '' THEN 'memory' ELSE {alias_sql('p_name')} END AS base FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY id) - 1 AS n FROM b),
free AS (SELECT base, k, row_number() OVER (PARTITION BY base ORDER BY k) AS n FROM (SELECT base, unnest(range(1, (2 * max(n) + 2)::BIGINT)) AS k FROM n GROUP BY base) WHERE base || '-' || k NOT IN (SELECT base FROM b))
SELECT id, CASE WHEN n.n = 0 THEN n.base ELSE n.base || '-' || k END AS alias FROM n LEFT JOIN free ON n.base = free.base AND n.n = free.n""")
def alias_unique(spark, sf):
    return memory.unique_aliases(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))).select("id", "alias")


@query("SELECT doc_id, array_to_string(CASE WHEN lower(source) = lower(lang) THEN [upper(lang), 'x'] ELSE [upper(lang), 'x', source] END, '|') AS tags FROM documents")
def tag_union(spark, sf):
    parent, own = F.array(F.upper("lang"), F.lit("x")), F.array(F.col("lang"), F.col("source"), F.lit("X"), F.upper("source"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.tag_union(parent, own), "|").alias("tags"))


# Chunk windows and sections ------------------------------------------------------------------------------

_BREAK_SQL = "regexp_matches(trim(line, ' ' || chr(9) || chr(13)), '" + fixed.BREAKS["file"].replace("'", "''") + "')"


@query(f"""WITH RECURSIVE l AS MATERIALIZED (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p FROM documents WHERE text <> ''),
s AS MATERIALIZED (SELECT doc_id, p, length(line) + 1 AS len, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY p) - length(line) - 1 AS pre, {_BREAK_SQL} AS brk, count(*) OVER (PARTITION BY doc_id) AS n FROM l),
nx AS MATERIALIZED (SELECT a.doc_id, a.p AS s, a.n, coalesce(min(b.p), a.n) AS e FROM s a LEFT JOIN s b ON a.doc_id = b.doc_id AND b.p > a.p AND (b.pre - a.pre >= 2000 OR (b.pre - a.pre + b.len > 2000 AND (b.brk OR b.pre - a.pre > 1000.0))) GROUP BY a.doc_id, a.p, a.n),
walk AS (SELECT doc_id, s, e, n FROM nx WHERE s = 0 UNION ALL SELECT nx.doc_id, nx.s, nx.e, nx.n FROM walk JOIN nx ON nx.doc_id = walk.doc_id AND nx.s = greatest(walk.e - least(floor((walk.e - walk.s) * 0.15)::BIGINT, 10), walk.s + 1) WHERE walk.e < walk.n)
SELECT walk.doc_id, (s + 1)::INT AS start_line, e::INT AS end_line, array_to_string(string_split(text, chr(10))[s + 1:e], chr(10)) AS content FROM walk JOIN documents USING (doc_id)""")
def line_window_chunks(spark, sf):
    return windows.window_table(table(spark, sf, "documents"), "doc_id", "text", fixed.ULTRA_CHUNK, 0.5)


_C_BREAK_SQL = "regexp_matches(trim(line, ' ' || chr(9) || chr(13)), '" + fixed.BREAKS["c_ultra"].replace("'", "''") + "')"


@query(f"""WITH RECURSIVE l AS MATERIALIZED (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p FROM documents WHERE text <> ''),
s AS MATERIALIZED (SELECT doc_id, p, length(line) + 1 AS len, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY p) - length(line) - 1 AS pre, {_C_BREAK_SQL} AS brk, count(*) OVER (PARTITION BY doc_id) AS n FROM l),
nx AS MATERIALIZED (SELECT a.doc_id, a.p AS s, a.n, coalesce(min(b.p) + 1, a.n) AS e FROM s a LEFT JOIN s b ON a.doc_id = b.doc_id AND b.p >= a.p AND (b.pre + b.len - a.pre >= {fixed.ULTRA_CHUNK - 100} OR (b.pre + b.len - a.pre > {0.7 * (fixed.ULTRA_CHUNK - 100)} AND b.brk)) GROUP BY a.doc_id, a.p, a.n),
walk AS (SELECT doc_id, s, e, n FROM nx WHERE s = 0 UNION ALL SELECT nx.doc_id, nx.s, nx.e, nx.n FROM walk JOIN nx ON nx.doc_id = walk.doc_id AND nx.s = greatest(walk.e - least(floor((walk.e - walk.s) * 0.15)::BIGINT, 10), walk.s + 1) WHERE walk.e < walk.n)
SELECT walk.doc_id, (s + 1)::INT AS start_line, e::INT AS end_line, array_to_string(string_split(text, chr(10))[s + 1:e], chr(10)) AS content FROM walk JOIN documents USING (doc_id)""")
def c_window_chunks(spark, sf):
    return windows.window_table(table(spark, sf, "documents"), "doc_id", "text", fixed.ULTRA_CHUNK - 100, 0.7, breaks="c_ultra", kind="c")


@query(f"""WITH c AS (SELECT source AS file_path, lang AS chunk_type, doc_id AS id, doc_id % 40 AS start_line, doc_id % 40 + doc_id % 13 AS end_line, text AS content FROM documents),
u AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY file_path, content ORDER BY start_line, end_line DESC, id) = 1)
SELECT a.id, a.start_line, a.end_line FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.file_path = a.file_path AND b.chunk_type = a.chunk_type AND b.id <> a.id AND b.start_line <= a.start_line AND b.end_line >= a.end_line AND (b.start_line, -b.end_line, b.id) < (a.start_line, -a.end_line, a.id))""")
def chunk_dedupe(spark, sf):
    d = F.col("doc_id")
    c = table(spark, sf, "documents").select(F.col("source").alias("file_path"), F.col("lang").alias("chunk_type"), d.alias("id"), (d % 40).alias("start_line"), (d % 40 + d % 13).alias("end_line"), F.col("text").alias("content"))
    return windows.without_contained(c).select("id", "start_line", "end_line")


@query("""WITH e AS (SELECT user_id, event_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 14400000000 THEN 1 ELSE 0 END AS apart FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, sum(apart) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM e""")
def segment_islands(spark, sf):
    return statistics.islands(table(spark, sf, "events"), "user_id", "ts", 4 * 3600).select("user_id", "event_id", "island")


@query("""SELECT l_orderkey, l_linenumber, sum(apart) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS UNBOUNDED PRECEDING)::BIGINT AS "group" FROM (
  SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY l_orderkey ORDER BY s, e) > 2 THEN 1 ELSE 0 END AS apart FROM (SELECT l_orderkey, l_linenumber, l_linenumber * 4 + l_partkey % 3 AS s, l_linenumber * 4 + l_partkey % 3 + l_suppkey % 4 AS e FROM lineitem))""")
def statement_groups(spark, sf):
    start = F.col("l_linenumber") * 4 + F.col("l_partkey") % 3
    s = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file_path"), "l_linenumber", start.alias("start_line"), (start + F.col("l_suppkey") % 4).alias("end_line"))
    return windows.statement_groups(s).select(F.col("file_path").alias("l_orderkey"), "l_linenumber", "group")


def _markdown(spark, sf) -> DataFrame:
    turn = F.concat(F.repeat(F.lit("#"), (F.pmod(F.col("turn"), F.lit(4)) + 1).cast("int")), F.lit(" "), "role", F.lit("\n"), F.when(F.col("turn") % 5 == 4, F.lit("  ")).otherwise(F.col("text")))
    rows = table(spark, sf, "conversations").select("conv_id", F.struct("turn", turn.alias("t")).alias("s"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["t"]), "\n").alias("text"))


_SECTIONS_SQL = """WITH m AS (SELECT conv_id, string_agg(repeat('#', (turn % 4 + 1)::INT) || ' ' || role || chr(10) || CASE WHEN turn % 5 = 4 THEN '  ' ELSE text END, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
l AS (SELECT conv_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM m),
h AS (SELECT *, regexp_matches(ltrim(line), '^(#+)\\s+(.+)$') AS is_header FROM l), n AS (SELECT *, sum(is_header::INT) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS section FROM h),
s AS (SELECT conv_id, section, max(length(regexp_extract(ltrim(line), '^(#+)\\s+(.+)$', 1))) FILTER (is_header)::INT AS level, max(trim(regexp_extract(ltrim(line), '^(#+)\\s+(.+)$', 2))) FILTER (is_header) AS title,
  regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT is_header), ''), '^\\s+|\\s+$', '', 'g') AS content FROM n WHERE section > 0 GROUP BY conv_id, section), k AS (SELECT * FROM s WHERE content <> '')"""


@query(f"{_SECTIONS_SQL} SELECT conv_id, section, level, title, content FROM k")
def markdown_sections(spark, sf):
    return markdown.sections(_markdown(spark, sf), "conv_id", "text")


@query(f"""{_SECTIONS_SQL} SELECT a.conv_id, a.section, a.level, (SELECT max_by(b.section, (b.level, b.section)) FROM k b WHERE b.conv_id = a.conv_id AND b.section < a.section AND b.level < a.level) AS parent FROM k a""")
def markdown_hierarchy(spark, sf):
    return markdown.parents(markdown.sections(_markdown(spark, sf), "conv_id", "text"), "conv_id").select("conv_id", "section", "level", "parent")


# Memories and the forest ------------------------------------------------------------------------------


def _memories(spark, sf) -> DataFrame:
    """Documents as memories: parents are doc_id / 3, and 0 is the root."""
    d = F.col("doc_id")
    return table(spark, sf, "documents").select(
        d.alias("id"), F.concat("lang", F.lit("-"), "source").alias("name"), F.array("lang", F.upper("source")).alias("tags"), "text",
        days_before(d % 50).alias("timestamp"), F.when(d > 0, F.floor(d / 3)).alias("parent_id"),
        text.lines_count(F.col("text")).alias("lines_count"), text.size_kb(F.col("text")).alias("size_kb"),
    )


_MEM_SQL = f"""mem AS (SELECT doc_id AS id, lang || '-' || source AS name, lang, upper(source) AS tag2, text, TIMESTAMP '{AS_OF}' - to_days((doc_id % 50)::INT) AS ts, CASE WHEN doc_id > 0 THEN doc_id // 3 END AS parent_id,
  len(list_filter(regexp_split_to_array(text, '[\\n\\r]'), lambda x: x <> '')) AS lines, octet_length(encode(text)) / 1024.0::DOUBLE AS kb FROM documents)"""


@query(f"""WITH {_MEM_SQL}, q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0), b AS (SELECT vec_id, {_cos('embedding::DOUBLE[]', 'qv')} AS score FROM embeddings, q ORDER BY 2 DESC, 1 LIMIT 40)
SELECT id, name, round_even(score, 4) AS score, array_to_string(string_split(text, chr(10))[1:10], chr(10)) AS snippet FROM b JOIN mem ON vec_id = id
WHERE score >= 0.05 AND (lang = 'en' OR tag2 = 'SRC3') AND ts <= TIMESTAMP '{AS_OF}' - INTERVAL 5 DAY AND id IN (SELECT parent_id FROM mem)""")
def memory_search(spark, sf):
    q = [float(x) for x in table(spark, sf, "embeddings").where("vec_id = 0").first()["embedding"]]
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("memory_id"), "embedding")
    return memory.search(_memories(spark, sf), vectors, q, as_of(), 40, 10, ["EN", "src3"], 5, True, 0.05).select("id", "name", "score", "snippet")


@query(f"WITH {_MEM_SQL} SELECT id, name, ts AS timestamp FROM mem WHERE lang = 'fr' OR tag2 = 'SRC7'")
def memory_list(spark, sf):
    return memory.list_memories(_memories(spark, sf), ["FR", "src7"]).select("id", "name", "timestamp")


@query(f"WITH {_MEM_SQL} SELECT tag, count(*) AS uses FROM (SELECT lower(lang) AS tag FROM mem UNION ALL SELECT lower(tag2) FROM mem) GROUP BY tag ORDER BY uses DESC, tag LIMIT 10")
def tag_histogram(spark, sf):
    return statistics.tag_histogram(_memories(spark, sf))


@query(f"WITH {_MEM_SQL} SELECT count(*) AS memories, round_even(sum(kb), 2) AS total_kb, round_even(avg(kb), 2) AS average_kb, sum(lines)::BIGINT AS total_lines, round_even(avg(lines), 1) AS average_lines FROM mem")
def content_stats(spark, sf):
    return statistics.content_stats(_memories(spark, sf))


@query(f"WITH {_MEM_SQL}, c AS (SELECT parent_id, count(*) AS n FROM mem WHERE parent_id IS NOT NULL GROUP BY 1) SELECT count(mem.parent_id) AS with_parent, count(n) AS with_children, sum(n)::BIGINT AS child_links FROM mem LEFT JOIN c ON c.parent_id = id")
def graph_stats(spark, sf):
    return statistics.graph_stats(_memories(spark, sf))


@query("SELECT count(*) AS vectors, max(len(embedding))::INT AS dimension, sum(4 * len(embedding)) / 1048576.0::DOUBLE AS vector_mb FROM embeddings")
def memory_vector_stats(spark, sf):
    return statistics.vector_stats(table(spark, sf, "embeddings"))


def _turns(spark, sf) -> DataFrame:
    """Turns as memories; each answers the conversation's first turn."""
    c = table(spark, sf, "conversations")
    at = F.timestamp_add("MINUTE", F.col("turn").cast("int"), as_of())
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("name"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000).alias("parent_id"), at.alias("timestamp"))


@query("WITH t AS (SELECT conv_id * 1000 + turn AS id, turn, CASE WHEN turn > 0 THEN conv_id * 1000 END AS parent_id FROM conversations), r AS (SELECT * FROM t WHERE parent_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY parent_id ORDER BY turn DESC, id DESC) <= 5) SELECT parent_id, string_agg(id::VARCHAR, ',' ORDER BY turn DESC, id DESC) AS children FROM r GROUP BY parent_id")
def children_latest(spark, sf):
    return memory.children(_turns(spark, sf), 5).select("parent_id", F.array_join(F.transform("children", lambda x: x.cast("string")), ",").alias("children"))


@query("WITH t AS (SELECT conv_id * 1000 + turn AS id, turn, role, CASE WHEN turn > 0 THEN conv_id * 1000 END AS parent_id FROM conversations), r AS (SELECT * FROM t WHERE parent_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY parent_id ORDER BY turn DESC, id DESC) <= 10), k AS (SELECT parent_id AS id, string_agg(id::VARCHAR, ',' ORDER BY turn DESC, id DESC) AS children FROM r GROUP BY 1) SELECT t.id, t.parent_id, p.role AS parent_name, coalesce(children, '') AS children FROM t LEFT JOIN t p ON t.parent_id = p.id LEFT JOIN k ON k.id = t.id")
def memory_relations(spark, sf):
    r = memory.relations(_turns(spark, sf), 10)
    return r.select("id", "parent_id", "parent_name", F.array_join(F.transform("children", lambda x: x.cast("string")), ",").alias("children"))


_TREE_SQL = f"""WITH RECURSIVE {_MEM_SQL}, walk AS (SELECT id, parent_id, name, 0 AS depth, [id] AS path, [(name, id)] AS sort FROM mem WHERE parent_id IS NULL
  UNION ALL SELECT m.id, m.parent_id, m.name, depth + 1, list_append(path, m.id), list_append(sort, (m.name, m.id)) FROM walk JOIN mem m ON m.parent_id = walk.id WHERE depth < 5 AND NOT list_contains(path, m.id))"""


@query(f"{_TREE_SQL} SELECT id, parent_id, depth, array_to_string(path, '/') AS path FROM walk")
def memory_tree(spark, sf):
    return tree.traverse(_memories(spark, sf), 5).where("NOT circular").select("id", "parent_id", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"))


@query(f"{_TREE_SQL} SELECT count(DISTINCT id) AS nodes, max(depth) AS deepest FROM walk")
def memory_tree_counts(spark, sf):
    return tree.node_count(_memories(spark, sf), 5)


@query(f"""{_TREE_SQL}, w AS (SELECT *, path[1:len(path) - 1] AS up, depth = 0 OR lead(id) OVER (PARTITION BY depth, path[1:len(path) - 1] ORDER BY sort) IS NULL AS last FROM walk),
b AS (SELECT x.path, string_agg(CASE WHEN a.last THEN '    ' ELSE '│   ' END, '' ORDER BY a.depth) AS bars FROM w x JOIN w a ON a.depth > 0 AND a.depth < x.depth AND x.path[1:a.depth + 1] = a.path GROUP BY x.path)
SELECT array_to_string(w.path, '/') AS path, coalesce(bars, '') || CASE WHEN depth = 0 THEN '' WHEN last THEN '└── ' ELSE '├── ' END || '[#' || id || '] ' || name AS line FROM w LEFT JOIN b ON b.path = w.path""")
def memory_tree_lines(spark, sf):
    lines = tree.ascii_lines(_memories(spark, sf), 5)
    return lines.select(F.array_join(F.transform("sort_path", lambda x: x["id"].cast("string")), "/").alias("path"), "line")


@query(f"{_TREE_SQL} SELECT array_to_string(path, '/') AS path, repeat('#', least(depth + 1, 6)) || ' ' || name || chr(10) || chr(10) || text AS block FROM walk JOIN mem USING (id) WHERE depth <= 4".replace("walk JOIN mem USING (id)", "(SELECT id, depth, path, name FROM walk) w JOIN (SELECT id, text FROM mem) m USING (id)"))
def memory_export_markdown(spark, sf):
    blocks = tree.markdown_lines(_memories(spark, sf), F.col("text"), 6)
    return blocks.select(F.array_join(F.transform("sort_path", lambda x: x["id"].cast("string")), "/").alias("path"), "block")


@query(f"""WITH {_MEM_SQL}, b AS (SELECT item_id, text, 3 * row_number() OVER (ORDER BY item_id) AS parent, row_number() OVER (ORDER BY item_id) AS k FROM benchmark)
SELECT (SELECT max(id) FROM mem) + k AS id, 'item' || item_id AS name, CASE WHEN lang IS NULL THEN NULL ELSE b.parent END AS parent_id, array_to_string(list_filter([lang, CASE WHEN lower(tag2) <> lower(lang) THEN tag2 END, 'New'], lambda x: x IS NOT NULL), '|') AS tags FROM b LEFT JOIN mem ON mem.id = b.parent""")
def memory_add(spark, sf):
    m = _memories(spark, sf).withColumn("alias", F.lit(None).cast("string"))
    b = table(spark, sf, "benchmark").withColumn("seq", F.row_number().over(Window.orderBy("item_id")))
    new = b.select("seq", F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("name"), "text", F.array(F.lit("New"), F.lower(F.lit("NEW"))).alias("tags"), (F.col("seq") * 3).cast("long").alias("parent_id"))
    top = m.agg(F.max("id").alias("top"))
    return memory.add(m, new, as_of()).crossJoin(F.broadcast(top)).where("id > top").select(F.col("id").cast("long").alias("id"), "name", "parent_id", F.array_join("tags", "|").alias("tags"))


@query("SELECT source AS directory, string_agg(DISTINCT lang, ',' ORDER BY lang) AS projects FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1")
def shared_directories(spark, sf):
    d = table(spark, sf, "documents").select(F.col("lang").alias("project"), F.col("source").alias("directory"))
    return statistics.shared_directories(d).select("directory", F.array_join("projects", ",").alias("projects"))


@query("SELECT e.event_id, e.user_id::VARCHAR AS directory, n_name AS project FROM events e JOIN nation ON n_nationkey % 5 = e.user_id % 5 AND n_nationkey < 10")
def change_fan_out(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("directory"), (F.col("user_id") % 5).alias("k"))
    watched = table(spark, sf, "nation").where("n_nationkey < 10").select(F.col("n_name").alias("project"), (F.col("n_nationkey") % 5).cast("long").alias("k"))
    return watch.to_projects(e.select("event_id", F.col("directory").alias("name"), F.col("k").alias("directory")), watched.withColumnRenamed("k", "directory")).select("event_id", F.col("name").alias("directory"), "project")


# Streaming's batch twins ------------------------------------------------------------------------------

_BURST_SQL = """WITH e AS (SELECT user_id, event_id, event_type, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 14400000000 THEN 1 ELSE 0 END AS apart FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(apart) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM e)"""


def _changes(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select("user_id", "event_type", "ts")


@query(f"{_BURST_SQL} SELECT user_id, min(ts) AS burst_start, max(ts) AS burst_end, count(*) AS n_events, count(DISTINCT event_type) AS n_items FROM s GROUP BY user_id, burst")
def debounce_sessions(spark, sf):
    return watch.bursts(_changes(spark, sf), "user_id", "4 hours", "event_type")


@query(f"{_BURST_SQL} SELECT user_id, min(ts) AS burst_start, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS items FROM s GROUP BY user_id, burst")
def debounce_changed_files(spark, sf):
    return watch.changed_items(_changes(spark, sf), "user_id", "4 hours", "event_type").select("user_id", "burst_start", F.array_join("items", ",").alias("items"))


# Parsers (no SQL) ---------------------------------------------------------------------------------------


@query()
def razor_chunks(spark, sf):
    from tessera.operators.chunking import chunk_files

    p = table(spark, sf, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".razor")).alias("path"), as_of().alias("modified"), F.col("html").alias("content"))
    return chunk_files(p).select("id", "file_path", "start_line", "end_line", "chunk_type", "content")


@query()
def source_chunks(spark, sf):
    from tessera.operators.chunking import chunk_files

    d = with_paths(table(spark, sf, "documents")).select(F.col("file_path").alias("path"), as_of().alias("modified"), F.col("text").alias("content"))
    return chunk_files(d).select("id", "file_path", "start_line", "end_line", "chunk_type", "content")


@query(structures.sql())
def source_structure(spark, sf):
    """C#, C and Razor files with declarations, one of them generated, through the whole chunker."""
    from tessera.operators.chunking import chunk_files

    f = spark.createDataFrame(list(structures.FILES.items()), "path string, content string").withColumn("modified", as_of())
    return chunk_files(f).select("file_path", "start_line", "end_line", "chunk_type", "content")


# The index itself ----------------------------------------------------------------------------------


@query(f"SELECT DISTINCT file_path FROM (SELECT {PATH_SQL} AS file_path FROM documents) WHERE regexp_matches(lower(file_path), '[.](cs|razor)$') AND NOT ({' OR '.join(f"contains(file_path, '/{x}') OR starts_with(file_path, '{x}')" if x.endswith('/') else f"ends_with(lower(file_path), '{x[1:]}')" for x in fixed.IGNORED)})")
def watch_filter(spark, sf):
    """Changes that a watcher of two extensions hands on."""
    p = with_paths(table(spark, sf, "documents")).select("file_path").distinct()
    return p.where(watch.watched(F.col("file_path"), ["cs", "RAZOR"]))


@query("SELECT p_brand AS key, arg_max(p_type, p_partkey) AS value FROM part GROUP BY p_brand UNION ALL SELECT n_name, 'nation' FROM nation")
def metadata_upsert(spark, sf):
    """Key and value rows, of which later ones replace those of their key."""
    p = table(spark, sf, "part").select(F.col("p_brand").alias("key"), F.col("p_type").alias("value"), F.col("p_partkey").alias("seq"))
    held = table(spark, sf, "nation").select(F.col("n_name").alias("key"), F.lit("nation").alias("value"), F.lit(0).cast("long").alias("seq"))
    return changes.upsert(held.unionByName(p.where("seq % 2 = 0")), p, "key", "seq").select("key", "value")


@query(f"""SELECT user_id::VARCHAR AS content_hash, 'document' AS embedding_type, CASE WHEN user_id % 3 = 0 THEN TIMESTAMP '{AS_OF}' ELSE max(ts) END AS last_accessed, CASE WHEN user_id % 3 = 0 THEN 1 ELSE 1 + count(*) END AS access_count FROM events GROUP BY user_id""")
def embedding_cache_store(spark, sf):
    """A vector stored again counts as used once."""
    held = _used(spark, sf).select("content_hash", "embedding", F.lit("document").alias("embedding_type"), F.lit("m").alias("model"), F.lit(None).cast("string").alias("project"), F.col("last_accessed").alias("created_at"), "last_accessed", "access_count")
    new = cache.entries(held.where("content_hash % 3 = 0").select("content_hash", "embedding"), "m", as_of())
    return changes.upsert(held, new, "content_hash", "last_accessed").select("content_hash", "embedding_type", "last_accessed", "access_count")


@query("SELECT DISTINCT unnest(['T' || (doc_id % 7), 'I' || lang]) AS name FROM documents WHERE doc_id % 2 = 0")
def type_names(spark, sf):
    d = F.col("doc_id")
    content = F.when(d % 2 == 0, F.concat(F.lit("public class T"), (d % 7).cast("string"), F.lit(" { }\npublic interface I"), "lang", F.lit(" { }"))).otherwise(F.lit("subclass X, classes of record"))
    return statistics.type_names(table(spark, sf, "documents").select(content.alias("content")))


@query("SELECT doc_id AS id, 'a' || doc_id AS alias, 'by ' || CASE WHEN doc_id = 7 THEN 'id' ELSE 'alias' END AS how FROM documents WHERE doc_id IN (7, 12)")
def memory_resolve(spark, sf):
    """A memory by its number, and one by its alias."""
    m = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("alias"))
    return memory.resolve(m, "7").withColumn("how", F.lit("by id")).unionByName(memory.resolve(m, "a12").withColumn("how", F.lit("by alias")))


@query("SELECT vec_id, round(list_sum(embedding)::DOUBLE, 5) AS total, len(embedding)::INT AS width FROM embeddings")
def vector_bytes(spark, sf):
    """Vectors packed as bytes and read again."""
    packed = F.udf(lambda v: bytearray(embedding.to_bytes(v)), "binary")
    v = table(spark, sf, "embeddings").select("vec_id", embedding.from_bytes(packed("embedding")).alias("v"))
    return v.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.size("v").alias("width"))


@query("SELECT vec_id FROM embeddings")
def half_precision(spark, sf):
    """Vectors that 16 bits change by no more than one part in 2048, and change at all."""
    e = table(spark, sf, "embeddings").withColumn("half", embedding.rounded_to_half(F.col("embedding")))
    near = F.forall(F.zip_with("embedding", "half", lambda a, b: F.abs(a - b) <= F.greatest(F.abs(a) / 2048, F.lit(1e-7))), lambda x: x)
    return e.where(near & F.exists(F.zip_with("embedding", "half", lambda a, b: a != b), lambda x: x)).select("vec_id")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return batch_search(spark, sf)
