"""Exact statistics against plain Python, and models by held-out accuracy."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.llm import quality_classifier, quality_rules
from tessera.llm import text_arrays as ta
from tessera.llm.labelled import held_out

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    w = WORD.findall(text)
    seen3 = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    marked = {k + d for k in range(len(w) - 2) if seen3[tuple(w[k : k + 3])] >= 2 for d in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab é\n\t|*\r\x1c中", max_size=60), max_size=6))
def test_statistics(texts):
    b = quality_rules.analyse(pa.array(texts, pa.large_string()))
    got = list(zip(*(x.tolist() for x in (b.n_words, b.word_chars, b.n_symbols, b.n_dup_lines, b.n_repeat_words)), strict=True))
    assert got == [plain(t) for t in texts]


def statistics(texts):
    b = quality_rules.analyse(pa.array(texts, pa.large_string()))
    return list(zip(*(x.tolist() for x in (b.n_words, b.word_chars, b.n_symbols, b.n_dup_lines, b.n_repeat_words)), strict=True))


@settings(max_examples=200, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text("ab é\n\t|*\r\x1c中", max_size=300))
def test_statistics_of_long_texts_by_windows(monkeypatch, text):
    with monkeypatch.context() as m:
        m.setattr(ta, "BLOCK_BYTES", 16)
        m.setattr(quality_rules, "_STEP", 8)
        assert statistics([text]) == [plain(text)]


def thue_morse(bits):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(1 << bits)), "".join("ba"[bin(k).count("1") % 2] for k in range(1 << bits))


def test_lines_that_collide_modulo_powers_of_two():
    a, b = thue_morse(11)
    text = f"x {a}\nx {b}\nx {a}"
    assert statistics([text, text]) == [plain(text)] * 2 and plain(text)[3] == 1


def model_of(sample):
    table = pa.table({"doc_id": range(len(sample)), "text": [t for t, _ in sample], "y": [y for _, y in sample]})
    sizes = {0: sum(y == 0 for _, y in sample), 1: sum(y == 1 for _, y in sample)}
    return quality_rules.fit(table, sizes, steps=20), quality_classifier.fit(table, sizes, steps=20)


def some_texts(n, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé中#4B") for _ in range(r.randint(1, 9)))
    return [r.choice([" ", "\n", "  "]).join(word() for _ in range(r.randint(0, 200))) for _ in range(n)]


def test_scores_do_not_depend_on_blocks_or_windows(monkeypatch):
    rules, classifier = model_of([(t, k % 2) for k, t in enumerate(some_texts(40, 1))])
    texts = some_texts(20, 2) + ["", "x", "y" * 300]
    column = pa.array(texts, pa.large_string())
    together = rules.probability(quality_rules.analyse(column)), classifier.probability(quality_classifier.pool(column, classifier.words, classifier.makes))
    monkeypatch.setattr(ta, "BLOCK_BYTES", 64)
    monkeypatch.setattr(quality_rules, "_STEP", 16)
    monkeypatch.setattr(quality_classifier, "_POOL_WORDS", 10)
    for k in range(len(texts)):
        if len(texts[k]) == 300:  # a word beyond a window has a hash of another kind
            continue
        one = column.slice(k, 1)
        assert np.isclose(rules.probability(quality_rules.analyse(one))[0], together[0][k], rtol=1e-9)
        assert np.isclose(classifier.probability(quality_classifier.pool(one, classifier.words, classifier.makes))[0], together[1][k], rtol=1e-5)


def test_pooling_by_plain_loops():
    """The classifier's score of each text from its own tables, word by word."""
    _, m = model_of([(t, k % 2) for k, t in enumerate(some_texts(40, 1))])
    texts = some_texts(15, 3) + [""]
    got = m.probability(quality_classifier.pool(pa.array(texts, pa.large_string()), m.words, m.makes))
    for text, score in zip(texts, got, strict=True):
        w = WORD.findall(text)
        v = []
        for x in w:
            raw = np.frombuffer(x.encode(), np.uint8)
            word, make = (f[0][0] for f in [[quality_classifier._words(pa.array([x], pa.large_string()))[k]] for k in (0, 1)])
            assert len(raw) and make < len(m.makes)
            v.append(np.concatenate([m.words[word], m.makes[make]]).astype(float))
        dims = m.words.shape[1] + m.makes.shape[1]
        mean = np.mean(v, 0) if v else np.zeros(dims)
        steps = sum((np.abs(b - a) for a, b in zip(v, v[1:], strict=False)), np.zeros(dims)) / max(len(v), 1)
        later = sum(x in w[:k] for k, x in enumerate(w)) / max(len(w), 1)
        same = sum(a == b for a, b in zip(w, w[1:], strict=False)) / max(len(w), 1)
        pooled = np.concatenate([mean, steps, [later, same, np.log1p(len(w)) / 10]])
        z = (pooled - m.mean) / m.scale * (len(w) / (len(w) + 8))
        hidden = np.tanh(z @ m.w1 + m.b1)
        want = 1 / (1 + np.exp(-np.clip((hidden @ m.w2 + m.b2) / m.temperature + m.shift, -40, 40)))
        assert abs(score - want) < 1e-4


def test_without_a_model_both_ways_agree(spark, no_labels):
    docs = spark.createDataFrame([(i, "some text", "x") for i in range(20)], "doc_id long, text string, score string")
    for labels, kept in ((no_labels, 20), (spark.createDataFrame([(i, 0, 0) for i in range(20)], "doc_id long, quality int, toxic int"), 0)):
        assert {r["predicted"] for r in quality_classifier.quality_scores(docs, labels).collect()} == {int(kept > 0)}
        assert quality_classifier.keep_rows(docs, labels).count() == kept


def test_edges(spark, hard, no_documents, no_labels):
    rows = quality_rules.quality_rules(hard, no_labels).collect()
    want = sorted(plain(r["text"] or "") for r in hard.collect())
    assert sorted((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows) == want
    assert all(r["kept"] == (not r["base_failed"]) for r in rows)
    assert quality_rules.quality_rules(no_documents, no_labels).count() == 0
    scores = quality_classifier.quality_scores(hard, no_labels).collect()
    assert len(scores) == hard.count() and {r["score"] for r in scores} == {0.5}
    assert quality_classifier.quality_scores(no_documents, no_labels).count() == 0
    assert quality_rules.keep_rows(hard, no_labels).columns == hard.columns
    assert quality_classifier.keep_rows(hard, no_labels).count() == hard.count()


@pytest.mark.parametrize("module", ["rules", "classifier"])
def test_held_out_accuracy(spark, sf, module):
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    if module == "rules":
        verdict = {r["doc_id"]: r["probability"] >= quality_rules.THRESHOLD for r in quality_rules.quality_rules(documents, labels).collect()}
    else:
        rows = quality_classifier.quality_scores(documents, labels).collect()
        assert all(0 <= r["score"] <= 1 and r["held_out"] == held_out(r["doc_id"]) for r in rows)
        verdict = {r["doc_id"]: r["predicted"] == 1 for r in rows}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect() if held_out(r["doc_id"])}
    good, bad = [verdict[d] for d, q in truth.items() if q == 1], [not verdict[d] for d, q in truth.items() if q == 0]
    assert sum(good) / len(good) >= 0.95 and sum(bad) / len(bad) >= 0.75


def test_labels_of_held_out_rows_are_not_learnt(spark, sf):
    """Turning all held-out labels over changes no score."""
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    from tessera.llm.labelled import hold_out_column
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(hold_out_column(), 1 - F.col("quality")).otherwise(F.col("quality")).cast("int"))
    a, b = (sorted(map(tuple, quality_classifier.quality_scores(documents, x).collect())) for x in (labels, turned))
    assert a == b


def test_samples_come_in_portions(spark, monkeypatch):
    from tessera.llm import labelled

    rows = [(k, t + " bad" * (k % 2 * 9), 1 - k % 2) for k, t in enumerate(some_texts(300, 8))]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, quality int")
    wanted = model_of([(t, y) for k, t, y in rows if not held_out(k)])
    monkeypatch.setattr(labelled, "PORTION", 20_000, raising=False)
    monkeypatch.setattr(quality_rules, "FEATURES", 5_000, raising=False)
    sizes, collect = [], type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda df: sizes.append((out := collect(df)).nbytes) or out)
    models = []
    for module in (quality_rules, quality_classifier):
        fit = module.fit
        monkeypatch.setattr(module, "fit", lambda table, sizes, fit=fit: models.append(fit(table, sizes, steps=20)) or models[-1])
    quality_rules.quality_rules(docs, labels)
    quality_classifier.quality_scores(docs, labels)
    assert sum(sizes) > 10 * 20_000 and max(sizes) < 2 * 20_000
    assert np.allclose(models[0].tables, wanted[0].tables, atol=1e-6) and np.allclose(models[0].dense, wanted[0].dense)
    assert np.allclose(models[1].w1, wanted[1].w1, atol=1e-4) and np.allclose(models[1].words, wanted[1].words, atol=1e-5)


def test_learning_holds_few_features():
    """The features of the sample wait in a file, and the model doesn't depend on how many are held."""
    import tracemalloc

    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 9000, 400)) + " bad" * (k % 2 * 9) for k in range(400)]
    table = pa.table({"text": pa.array(texts), "y": pa.array([1 - k % 2 for k in range(400)])})
    tracemalloc.start()
    got = quality_rules.fit(table, {0: 1, 1: 1}, steps=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    features = 400 * 4 * 500
    assert peak < 80 * features
    held, quality_rules.FEATURES = quality_rules.FEATURES, 1 << 30
    try:
        want = quality_rules.fit(table, {0: 1, 1: 1}, steps=3)
    finally:
        quality_rules.FEATURES = held
    assert np.array_equal(got.tables, want.tables) and np.array_equal(got.dense, want.dense) and got.bias == want.bias


def test_learning_gives_memory_back(spark):
    """What learning has freed between objects that stay goes back to the system."""
    import re
    from pathlib import Path

    from tessera.llm import labelled

    if not hasattr(__import__("ctypes").CDLL(None), "malloc_trim"):
        pytest.skip("not glibc")
    own = lambda: int(re.search(r"\nAnonymous:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024
    held = []

    def fit(table, sizes):
        some = [np.ones(12_000) for _ in range(1500)]  # 96 kB each, below the size that malloc maps by itself
        held.append(own())
        held.append(some[::50] + some[-1:])
        return None

    docs = spark.createDataFrame([(k, "text") for k in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int")
    labelled.learn(fit, docs, labels, "quality", 10)
    assert held[0] - own() > 100


def test_written_tables_give_memory_back(spark, monkeypatch):
    """The driver's JVM too is asked, after each table that an operator writes."""
    from tessera.llm import driver_memory
    from tessera.llm.scratch import Scratch

    answers, give_back = [], driver_memory.give_back
    monkeypatch.setattr(driver_memory, "give_back", lambda session: answers.append(give_back(session)))
    scratch = Scratch(spark, "test-memory")
    scratch.keep(spark.range(3), "three")
    scratch.drop()
    version = spark.sparkContext._jvm.java.lang.System.getProperty("java.version")
    assert answers == [True] if version.startswith("17.0.19") else len(answers) == 1
