"""Index runs over a source tree, providers, and a stream that equals its batch twin."""

import pytest
from pyspark.sql import functions as F

from tessera.plans.index import Index, Settings
from tessera.sources import embedding, files
from tessera.streaming import watch


def test_index_run(spark, tmp_path):
    tree, root = tmp_path / "tree", tmp_path / "tables"
    (tree / "src").mkdir(parents=True)
    (tree / "src/a.cs").write_text("class A { void F() { login(); } }")
    (tree / "src/b.c").write_text("int f(int a)\n{\n return a;\n}\n")
    (tree / "bin").mkdir()
    (tree / "bin/x.cs").write_text("class X { }")
    index = Index(spark, Settings(str(root)))
    first = index.update("P", str(tree))
    assert (first["added"], first["modified"], first["removed"], first["failed"]) == (2, 0, 0, 0) and first["chunks"] > 1
    again = index.update("P", str(tree))
    assert {k: again[k] for k in ("added", "modified", "removed", "failed", "chunks", "files", "skipped", "made")} == {"added": 0, "modified": 0, "removed": 0, "failed": 0, "chunks": first["chunks"], "files": 2, "skipped": 2, "made": 0}
    (tree / "src/a.cs").write_text("class B { }")
    (tree / "src/b.c").unlink()
    second = index.update("P", str(tree))
    assert (second["added"], second["modified"], second["removed"]) == (0, 1, 1)
    assert {r["file_path"] for r in index.chunks("P").collect()} == {"src/a.cs"}
    assert index.directory("P") == "src" and index.statistics("P").first()["file_count"] == 1
    index.clear("P")
    assert index.chunks("P").count() == 0


def test_failures_stay_out_of_the_state(spark, tmp_path):
    class Broken:  # in here, it is pickled by value
        def documents(self, texts):
            raise embedding.HttpError(500)

    tree = tmp_path / "tree"
    tree.mkdir()
    (tree / "a.cs").write_text("class A { }")
    broken = Index(spark, Settings(str(tmp_path / "t")), Broken())
    assert broken.update("p", str(tree))["failed"] == 1
    assert Index(spark, Settings(str(tmp_path / "t"))).update("p", str(tree))["added"] == 1


def test_partial_failures_are_repeated_whole(spark, tmp_path):
    """Failing texts: what a later run leaves is what a clean run leaves, each content embedded once."""
    log = str(tmp_path / "log")

    class Flaky(embedding.HashEmbedder):
        batch_texts = 1  # so that a file fails in part

        def documents(self, texts):
            import os

            with open(log, "a") as f:
                f.writelines(t.replace("\n", " ") + "\n" for t in texts)
            if any("poison" in t for t in texts) and not os.path.exists(log + ".cured"):
                raise embedding.HttpError(500)
            return super().documents(texts)

    tree = tmp_path / "tree"
    tree.mkdir()
    body = lambda k, word: f"class A{k} {{ void F() {{ int {word}{k} = 1; }} void G() {{ int b{k} = 2; }} }}"
    for k in range(4):
        (tree / f"f{k}.cs").write_text(body(k, "a"))
    (tree / "bad.cs").write_text(body(9, "poison"))
    index = Index(spark, Settings(str(tmp_path / "t")), Flaky())
    first = index.update("p", str(tree))
    assert (first["added"], first["failed"]) == (5, 1) and "bad.cs" not in {r["file_path"] for r in index.chunks("p").collect()}
    (tmp_path / "log.cured").write_text("")
    second = index.update("p", str(tree))
    assert (second["added"], second["failed"]) == (1, 0)
    clean = Index(spark, Settings(str(tmp_path / "clean"), cached=False))
    clean.update("p", str(tree))
    rows = lambda i: sorted(map(str, i.chunks("p").drop("last_modified").collect()))
    assert rows(index) == rows(clean) and sorted(map(tuple, index.state("p").collect())) == sorted(map(tuple, clean.state("p").collect()))
    texts = (tmp_path / "log").read_text().splitlines()
    assert all(texts.count(t) == 1 or "poison" in t for t in texts)
    used = len(texts)
    assert index.update("p", str(tree), force=True)["made"] == second["chunks"] and len((tmp_path / "log").read_text().splitlines()) == used
    assert rows(index) == rows(clean)


def test_metadata_roots_and_rescans(spark, tmp_path):
    tree = tmp_path / "tree"
    tree.mkdir()
    (tree / "a.cs").write_text("class A { }")
    index = Index(spark, Settings(str(tmp_path / "t"), roots=(str(tree),)))
    assert index.metadata("p", "dir") is None
    for value in ("x", "y"):
        index.set_metadata("p", "dir", value)
    index.set_metadata("p", "other", "z")
    assert (index.metadata("p", "dir"), index.metadata("p", "other")) == ("y", "z")
    with pytest.raises(PermissionError):
        index.update("p", str(tmp_path))
    waits = []
    rounds = index.rescan({"p": str(tree), "q": str(tree)}, minutes=30, rounds=2, wait=waits.append)
    assert [[r["added"] for r in done.values()] for done in rounds] == [[1, 1], [0, 0]] and waits == [1800]
    assert index.query([" ", "x"]).count() == 1
    index.clear("p")
    assert index.metadata("p", "dir") is None and index.chunks("q").count() == 1
    assert files.scan(spark, str(tmp_path / "nowhere")).count() == 0
    paths = spark.createDataFrame([("a.cs",), ("b.TXT",), ("bin/c.cs",), ("D.RAZOR",), ("cs",)], "path string")
    assert sorted(r["path"] for r in paths.where(watch.watched(F.col("path"))).collect()) == ["D.RAZOR", "a.cs"]


def test_batches_and_retries():
    assert [len(b) for b in embedding.packed(["x"] * 120)] == [50, 50, 20]
    assert [len(b) for b in embedding.packed(["x" * 200_000, "y" * 100_000, "z" * 300_000, "w"])] == [1, 1, 1, 1]
    calls, waits = [], []

    def transport(url, headers, body):
        calls.append((url, body))
        if len(calls) < 3:
            raise embedding.HttpError(429)
        return {"data": [{"embedding": [1.0], "index": i} for i, _ in enumerate(body["input"])]}

    def call():
        return transport("u", {}, {"input": ["a"]})

    assert embedding.with_retries(call, sleep=waits.append)["data"] and waits == [1.0, 2.0]
    with pytest.raises(embedding.HttpError):
        embedding.with_retries(lambda: (_ for _ in ()).throw(embedding.HttpError(401)), sleep=waits.append)
    calls[:] = [None] * 3
    p = embedding.OpenAiStyle("http://x/", "m", instruction="find", transport=transport)
    assert p.query("q") == [1.0] and calls[-1] == ("http://x/v1/embeddings", {"model": "m", "input": ["Instruct: find\nQuery: q"]})
    v = embedding.VoyageStyle("http://x", "m", transport=transport)
    assert v.documents(["a", "b"]) == [[1.0], [1.0]] and calls[-1][1]["input_type"] == "document"


def test_vector_bytes(spark):
    data = embedding.to_bytes([1.5, -2.0])
    df = spark.createDataFrame([(bytearray(data),), (None,)], "b binary")
    assert [r[0] for r in df.select(embedding.from_bytes(F.col("b"))).collect()] == [[1.5, -2.0], None]
    half = spark.createDataFrame([([0.1],)], "v array<float>").select(embedding.rounded_to_half(F.col("v"))).first()[0]
    assert half == [pytest.approx(0.0999755859375)]


def test_sources(spark, tmp_path):
    (tmp_path / "n.md").write_text("# A\nx")
    assert files.read_markdown(spark, str(tmp_path / "n.md")).first()["text"] == "# A\nx"
    (tmp_path / "e.md").write_text(" ")
    with pytest.raises(ValueError):
        files.read_markdown(spark, str(tmp_path / "e.md"))
    assert files.file_as_memory(spark, str(tmp_path / "n.md"), ["FILE-md"]).first()["tags"] == ["FILE-md", "filename-n"]


def test_stream_equals_batch(spark, tmp_path):
    events = [("p", "a", 0), ("p", "b", 30), ("p", "a", 80), ("p", "c", 300), ("q", "a", 10), ("z", "end", 100_000)]
    df = spark.createDataFrame([(p, f, s) for p, f, s in events], "project string, path string, s long").select("project", "path", F.timestamp_seconds("s").alias("ts"))
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    out = []
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    watch.watch(stream, lambda b: out.extend((r["project"], tuple(sorted(r["items"]))) for r in b.collect()), str(tmp_path / "cp")).awaitTermination()
    batch = {(r["project"], tuple(r["items"])) for r in watch.changed_items(df, "project", "60 seconds", "path").where("project <> 'z'").collect()}
    assert set(out) - {("z", ("end",))} == batch == {("p", ("a", "b")), ("p", ("c",)), ("q", ("a",))}


def test_fan_out_and_renames(spark):
    e = spark.createDataFrame([("d", "new", "old", "renamed", 1), ("d", "x", None, "changed", 2)], "directory string, path string, old_path string, change string, ts long")
    watched = spark.createDataFrame([("p", "d"), ("q", "d")], "project string, directory string")
    got = sorted((r["project"], r["path"], r["change"]) for r in watch.renames(watch.to_projects(e, watched)).collect())
    assert got == sorted([(p, *x) for p in ("p", "q") for x in (("new", "created"), ("old", "deleted"), ("x", "changed"))])
