"""Nearest neighbours: recall against brute force, copies, ties and odd vectors."""

import numpy as np

from tessera.llm import vector_search


def brute(ids, x, k):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if j != i][:k]
        out[ids[i]] = [(int(ids[j]), s[j]) for j in order]
    return out


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(c) for c in v], 7) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, rank int")


def test_recall(spark, sf):
    rows = spark.read.parquet(sf.replace("sf0.01", "sf0.1") + "/embeddings.parquet")
    p = rows.toPandas().sort_values("vec_id")
    want = brute(p.vec_id.values, np.stack(p.embedding).astype(float), 20)
    got = {}
    for r in vector_search.nearest(spark, rows).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    found = sum(len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert found / (20 * len(want)) >= 0.9
    for hits in got.values():
        hits.sort()
        assert [h[0] for h in hits] == list(range(1, 21)) and all((-a[2], a[1]) < (-b[2], b[1]) for a, b in zip(hits, hits[1:], strict=False))


def test_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(60, 4)), 2)
    x[10:50] = x[10]
    ids = np.arange(60)
    odd = [(100, None, 1), (120, [0.0] * 4, 1), (140, [1.0, None, 0.0, 0.0], 1), (160, [float("nan")] * 4, 1), (180, [float("inf"), 0.0, 0.0, 0.0], 1), (200, [1.0], 1), (None, [1.0] * 4, 1)]
    df = frame(spark, ids, x).unionByName(spark.createDataFrame(odd, "vec_id long, embedding array<float>, rank int"))
    got = {}
    for r in vector_search.nearest(spark, df, k=15).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = brute(ids, x.astype(np.float32).astype(float), 15)
    assert got == {q: [v for v, _ in hits] for q, hits in want.items()}


def test_thousands_of_ties(spark):
    """Unequal vectors with one inner product: the smallest ids win, however many there are."""
    rng = np.random.default_rng(1)
    x = np.concatenate([np.zeros((3000, 1)), rng.integers(-50, 50, (3000, 3))], 1)
    x[:, 0] = 8
    x[0] = [1, 0, 0, 0]
    got = vector_search.nearest(spark, frame(spark, np.arange(3000), x).repartition(4), share=1.0).where("query_id = 0").orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(i, 8.0) for i in range(1, 21)]


def test_near_copies_fill_one_range(spark, monkeypatch):
    """Keys that half of all vectors share: their range is cut into parts, and nothing is lost."""
    monkeypatch.setattr(vector_search, "QUERY_ROWS", 32)
    monkeypatch.setattr(vector_search, "STRETCH", 100)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 8))
    x[:1000] = x[0] + 1e-9 * rng.normal(size=(1000, 8))
    x = x.astype(np.float32).astype(float)
    ids = np.arange(2000)
    want = brute(ids, x, 20)
    got = {}
    for r in vector_search.nearest(spark, frame(spark, ids, x), share=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for q in want:
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12) and len({v for v, _ in got[q]}) == 20


def test_few_vectors(spark):
    one = frame(spark, [0], np.ones((1, 3)))
    assert vector_search.nearest(spark, one).count() == 0
    two = vector_search.nearest(spark, frame(spark, [0, 1], np.eye(2))).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in two] == [(0, 1, 1, 0.0)]
    assert vector_search.nearest(spark, one.where("vec_id > 5")).count() == 0


def test_hilbert_curve_is_one_path():
    points = np.array([(x, y, z) for x in range(4) for y in range(4) for z in range(4)])
    keys = vector_search.hilbert_keys(points, 2)
    assert sorted(keys.tolist()) == list(range(64))
    walk = points[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()
