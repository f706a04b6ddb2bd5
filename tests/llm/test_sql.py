"""Every query of the subpackage that has SQL gives DuckDB's rows on the smallest tables."""

import glob
import os

import pytest

from tessera.llm import queries

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(repr(round(float(v), 8)) if isinstance(v, (int, float)) else str(v) for v in r) for r in frame[names].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    assert rows(queries.queries()[name](spark, SF).toPandas()) == rows(con.execute(queries.ORACLES[name]).fetchdf())


def test_base_spans_of_planted_data(spark, tmp_path):
    """The SQL of the base spans sees each kind, and what fails a kind's check."""
    texts = ["a.b@c.de x@y 1.2.3.4 1.2.3.256 9.9.9.9.9.9.9.9", "4111 1111 1111 1111, 4111 1111 1111 1112", "+49 (30) 1234-567 é +1 2", None, "é😀 a@b.co +1.2.3.4.555.666.7"]
    folder = str(tmp_path)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    for name in ("pii_base", "text_bytes"):
        assert rows(queries.queries()[name](spark, folder).toPandas()) == rows(con.execute(queries.ORACLES[name]).fetchdf())
