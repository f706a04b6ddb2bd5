"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import glob
import os

import numpy as np
import pandas as pd
import pytest

from tessera.plans import queries as engine

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def rows(frame):
    def text(v):
        if isinstance(v, (list, np.ndarray, tuple)):
            return str([text(x) for x in v])
        if pd.isna(v):
            return "null"
        number = isinstance(v, (float, int, np.floating, np.integer)) and not isinstance(v, bool) and abs(v) < 1 << 53
        return repr(round(float(v), 8)) if number else str(v)

    names = sorted(frame.columns)
    return names, sorted(tuple(text(v) for v in r) for r in frame[names].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(engine.SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    assert rows(engine.QUERIES[name](spark, SF).toPandas()) == rows(con.execute(engine.SQL[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(engine.QUERIES) - set(engine.SQL)))
def test_runs(spark, name):
    assert engine.QUERIES[name](spark, SF).count() > 0
