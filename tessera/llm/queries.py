"""The subpackage's queries: thin digests of the operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing import pack

    return pack(spark, _table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), with_ids=False).drop("ids")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality_rules import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.chat_format import digests, format_examples

    extra = spark.sql("SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(turn, role)")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(format_examples(rows))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality_classifier import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.scratch import Scratch
    from tessera.llm.training_order import read_shards, write_shards

    folder = Scratch(spark, "shards").path("written")
    n = write_shards(spark, _table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), folder)
    return read_shards(spark, folder, n).drop("ids")


def op7_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.merge_dropout import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op8_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.vector_search import nearest

    return nearest(spark, _table(spark, sf_dir, "embeddings"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.near_dedup import near_duplicates

    return near_duplicates(spark, _table(spark, sf_dir, "documents"), n=2)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest tell of the base spans, which the contract fixes; `all_<kind>` count the field's spans too."""
    from tessera.llm.pii import KINDS, find_pii

    found = find_pii(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[F.col(f"base_{k}").alias(f"n_{k}") for k in KINDS], "base_sha256", "spans", *[F.col(f"n_{k}").alias(f"all_{k}") for k in KINDS])


def text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2 says of texts without its model."""
    return op2_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op10 says of texts without its model."""
    return op10_pii(spark, sf_dir).select("doc_id", "base_sha256")


def text_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4 says of texts without its encoder."""
    return op4_token_counts(spark, sf_dir).select("doc_id", "n_bytes")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_quality_rules, op3_chat_format, op4_token_counts, op5_quality_classifier, op6_training_order, op7_merge_dropout, op8_vector_search, op9_near_dedup, op10_pii, text_statistics, pii_base, text_bytes)}


_WORDS = r"list_filter(regexp_split_to_array({}, '[ \t\n\x0b\f\r]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: What DuckDB says of the same tables; operators that learn or encode have none. That of op8 is
#: exhaustive search, to which the operator comes where its windows hold all vectors (500 of them).
ORACLES: dict[str, str] = {
    "text_statistics": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
t AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS three, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2),
twice AS (SELECT doc_id, i FROM t QUALIFY count(*) OVER (PARTITION BY doc_id, three) > 1),
marked AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM d),
again AS (SELECT doc_id FROM l WHERE regexp_matches(line, '[^ \t\n\x0b\f\r]') QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY place) > 1),
dup AS (SELECT doc_id, count(*) AS n FROM again GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(marked.n, 0)::BIGINT AS n_repeat_words,
  len(w) < 50 OR 100 * coalesce(marked.n, 0) > 50 * len(w) AS base_failed
FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN marked USING (doc_id)
""",
    "text_bytes": "SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes FROM documents",
    # Matches are put between two control characters, so that the lengths of what lies between give their places.
    "pii_base": r"""
WITH kind(k, name) AS (VALUES (0, 'email'), (1, 'ip'), (2, 'card'), (3, 'phone')),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
cut AS (SELECT r, k, string_split(CASE k
    WHEN 0 THEN regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+', chr(1) || '\0' || chr(2), 'g')
    WHEN 1 THEN regexp_replace(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)', chr(1) || '\0' || chr(2), 'g')
    WHEN 2 THEN regexp_replace(text, '[0-9]([ -]?[0-9])+', chr(1) || '\0' || chr(2), 'g')
    ELSE regexp_replace(text, '\+[0-9][ ().0-9-]+[0-9]', chr(1) || '\0' || chr(2), 'g') END, chr(1)) AS p FROM d, kind),
part AS (SELECT r, k, unnest(p) AS part, generate_subscripts(p, 1) AS i FROM cut WHERE len(p) > 1),
placed AS (SELECT r, k, i, split_part(part, chr(2), 1) AS m, sum(length(part)) OVER (PARTITION BY r, k ORDER BY i) - length(part) - (i - 2) AS start FROM part),
digits AS (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS g FROM placed WHERE i > 1),
fine AS (SELECT r, start, k, name || ':' || start::BIGINT || ':' || (start + length(m))::BIGINT AS span FROM digits JOIN kind USING (k) WHERE CASE k
    WHEN 0 THEN true
    WHEN 1 THEN list_bool_and(list_transform(string_split(m, '.'), lambda x: coalesce(try_cast(x AS BIGINT) <= 255, false)))
    WHEN 2 THEN length(g) BETWEEN 12 AND 19 AND list_sum(list_transform(range(length(g)), lambda i: CASE WHEN i % 2 = 0 THEN substr(g, (length(g) - i)::BIGINT, 1)::INT ELSE (2 * substr(g, (length(g) - i)::BIGINT, 1)::INT - 1) % 9 + 1 END)) % 10 = 0
    ELSE length(g) BETWEEN 9 AND 15 END),
spans AS (SELECT r, string_agg(span, ',' ORDER BY start, k) AS s FROM fine GROUP BY r)
SELECT doc_id, sha256(coalesce(s, '')) AS base_sha256 FROM d LEFT JOIN spans USING (r)
""",
    "op8_vector_search": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda x: x[1] * x[2]), lambda a, b: a + b) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM p QUALIFY rank <= 20
""",
    "op9_near_dedup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS s FROM d),
u AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT a, b FROM shared JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 80 * (len(x.s) + len(y.s) - n)),
edge AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON edge.a = reach.other)
SELECT doc_id, any_value(len(s.s))::BIGINT AS n_shingles, min(other) AS component_id, min(other) = doc_id AS kept FROM reach JOIN s USING (doc_id) GROUP BY doc_id
""",
    "op3_chat_format": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM rows
), formatted AS (
  SELECT *, '<|turn|>' || regexp_replace(role, e, r, 'g') || '<|says|>' || regexp_replace(text, e, r, 'g') || '<|end|>' AS piece
  FROM ranked, (SELECT '(<|\[)(\\*)(/?s>|\|[a-z_]+\|>|/?INST\]|</?SYS>>)' AS e, '\1\\\2\3' AS r)
), sized AS (
  SELECT *, sum(length(piece)) OVER (PARTITION BY conv_id ORDER BY k) AS upto,
    max(k) OVER (PARTITION BY conv_id) AS last FROM formatted
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR k = last)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
