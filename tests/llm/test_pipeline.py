"""The pipeline's stages against plain versions, each on its own input."""

import corpus_pipeline
import pytest

from tessera.llm import pii, quality_rules
from tessera.llm.scratch import Scratch


@pytest.fixture(scope="module")
def stages(spark, sf):
    scratch = Scratch(spark, "test-pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(scratch.keep(stage(spark, out[-1], sf), f"stage-{k}"))
    yield out
    scratch.drop()


def test_columns(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_filters_keep_whole_rows(stages):
    before = {r["doc_id"]: r for r in stages[0].collect()}
    for df in stages[1:4]:
        rows = df.collect()
        assert 0 < len(rows) < len(before) or df is not stages[1]
        assert all(before[r["doc_id"]] == r for r in rows)


def test_rules(stages):
    import pyarrow as pa

    rows = stages[1].collect()
    block = quality_rules.analyse(pa.array([r["text"] for r in rows], pa.large_string()))
    assert not quality_rules.base_failed(block).any()


def test_near_duplicates(stages):
    from test_near_dedup import brute

    roots, _ = brute({r["doc_id"]: r["text"] for r in stages[2].collect()}, 5)
    assert sorted(r["doc_id"] for r in stages[3].collect()) == sorted(i for i, root in roots.items() if i == root)


def test_near_duplicates_with_null_and_repeated_ids(spark, hard, sf):
    from test_near_dedup import brute

    long = " ".join(f"w{k}" for k in range(60))
    more = [(50, long), (60, long + " near"), (60, "another text of one id, copied nowhere"), (70, "twice the same row and the same id")]
    more += [(70, "twice the same row and the same id"), (80, long.upper()), (50, long + " near too"), (None, long), (None, long), (None, None), (90, ""), (90, "")]
    rows = [(r["doc_id"], r["text"]) for r in hard.collect()] + more
    df = spark.createDataFrame([(i, t, k, True) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k long, once boolean").repartition(3)
    got = corpus_pipeline.near_dedup_stage(spark, df, sf)
    assert got.columns == df.columns
    got = [r["k"] for r in got.collect()]
    roots, sizes = brute({k: t for k, (i, t) in enumerate(rows) if i is not None}, 5)
    free = {k for k, (i, _) in enumerate(rows) if i is None or not sizes[k]}
    assert free <= set(got) and len(got) == len(set(got))
    classes = {}
    for k, root in roots.items():
        classes.setdefault(root, []).append(k)
    left = [k for k in got if k not in free]
    assert sorted(roots[k] for k in left) == sorted(root for root in classes if root not in free)
    assert all(rows[k][0] == min(rows[m][0] for m in classes[roots[k]]) for k in left)


def test_personal_data(stages):
    before = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    after = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    assert set(before) == set(after)
    for d, text in before.items():
        assert (after[d] == text) == (not pii.all_spans(pii.train(), [text])[0][1])
        assert not pii.base_spans(after[d])


def test_packing(stages):
    pieces = stages[5].collect()
    assert {p["doc_id"] for p in pieces} == {r["doc_id"] for r in stages[4].collect()}
    total = sum(p["length"] for p in pieces)
    assert total == sum({p["doc_id"]: p["doc_tokens"] for p in pieces}.values())
    assert max(p["sequence_id"] for p in pieces) == (total - 1) // 1024


def test_run(spark, sf, stages):
    assert corpus_pipeline.run(spark, sf).count() == stages[5].count()


def test_tables_between_stages_have_small_row_groups(spark, tmp_path):
    """A task holds a row group of what it reads and of what it writes; with those of 128 MB, eight tasks exceeded 1 GB."""
    import glob

    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    letters = F.translate(F.sha2(F.col("id").cast("string"), 512), "0123456789", "ghijklmnop")
    docs = spark.range(0, 400_000, 1, 1).select((F.col("id") / 1000).cast("long").alias("doc_id"), letters.alias("t")).groupBy("doc_id").agg(F.array_join(F.collect_list("t"), " ").alias("text")).coalesce(1)
    corpus_pipeline.pii_stage(spark, docs, "").write.parquet(f"{tmp_path}/kept")
    (file,) = glob.glob(f"{tmp_path}/kept/*.parquet")
    told = pq.ParquetFile(file).metadata
    sizes = [told.row_group(k).total_byte_size for k in range(told.num_row_groups)]
    assert told.num_rows == 400 and sum(sizes) > 40e6 and max(sizes) < 30e6
