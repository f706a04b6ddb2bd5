"""Near-duplicate classes against all pairs."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import near_dedup
from tessera.llm import text_arrays as ta
from tessera.llm.components import connected_components
from tessera.llm.scratch import Scratch

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(zip(*(w[k:] for k in range(n)), strict=False)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, n):
    """doc_id -> least doc_id of its class, by all pairs."""
    ids = sorted(rows)
    sets = {i: shingles(rows[i], n) for i in ids}
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def corpus(seed=1, groups=25, singles=60, big=110):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 5)))
    texts = [" ".join(word() for _ in range(r.randint(3, 80))) for _ in range(singles)]

    def change(t, share):
        w = t.split()
        for _ in range(max(1, int(len(w) * share))):
            w[r.randrange(len(w))] = word()
        return " ".join(w)

    for _ in range(groups):
        base = " ".join(word() for _ in range(r.randint(20, 120)))
        texts += [base] + [change(base, r.choice([0.01, 0.04, 0.06, 0.1])) for _ in range(r.randint(1, 5))]
    base = " ".join(word() for _ in range(150))  # one group larger than a node
    texts += [change(base, r.choice([0.01, 0.02, 0.04, 0.08])) for _ in range(big)] + [base.upper()] * 5
    texts += [None, "", "  ", "x", "X", "x y", "x y z"]
    r.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize(("n", "component", "node"), [(2, 4_000_000, 1024), (5, 4_000_000, 24), (2, 4_000, 24)])
def test_all_pairs(spark, monkeypatch, n, component, node):
    monkeypatch.setattr(near_dedup, "NODE", node)
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows.items()], "doc_id long, text string, component_id string").repartition(5)
    got = near_dedup.near_duplicates(spark, df, n=n, component_shingles=component).collect()
    roots, sizes = brute(rows, n)
    assert {r["doc_id"]: r["component_id"] for r in got} == roots
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_documents_that_collide_modulo_powers_of_two(spark):
    words = ["".join("ab"[(bin(k).count("1") + d) % 2] for k in range(2048)) for d in (0, 1)]
    df = spark.createDataFrame([(k, f"t {w}") for k, w in enumerate(words)], "doc_id long, text string")
    assert all(r["kept"] for r in near_dedup.near_duplicates(spark, df, n=2).collect())


@pytest.mark.parametrize("n", [2, 5])
def test_sets_of_long_texts_by_windows(monkeypatch, n):
    texts = [t or "" for t in corpus().values()]
    sets, offsets = near_dedup.shingle_sets(pa.array(texts, pa.large_string()), n)
    monkeypatch.setattr(ta, "BLOCK_BYTES", 32)
    monkeypatch.setattr(near_dedup, "SET_BLOCK", 7)
    for k, t in enumerate(texts):
        own, _ = near_dedup.shingle_sets(pa.array([t], pa.large_string()), n)
        assert own.tolist() == sets[offsets[k] : offsets[k + 1]].tolist() and len(own) == len(shingles(t, n))


def test_edges(spark, hard, no_documents):
    got = near_dedup.near_duplicates(spark, hard, n=2).collect()
    assert len(got) == hard.count()
    same = {r["doc_id"]: r["component_id"] for r in got}
    assert same[9] == same[10] == 9  # equal texts
    assert all(r["kept"] for r in got if r["n_shingles"] == 0)
    assert near_dedup.near_duplicates(spark, no_documents).count() == 0
    nulls = spark.createDataFrame([(1, "same text"), (None, "same text"), (None, "same text")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in near_dedup.near_duplicates(spark, nulls, n=2).collect()) == [(0, 0, True), (0, 0, True), (1, 1, True)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 102), (101, 102), (7, 7)]
    df = spark.createDataFrame(chain, "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(df, Scratch(spark, "test")).collect()}
    assert got == {i: 0 for i in range(1, 51)} | {101: 100, 102: 100}
    assert connected_components(df.where(F.lit(False)), Scratch(spark, "test")).count() == 0
