"""Operators on small frames."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import cache, changes, expand, markdown, memory, search, source_parsers, statistics, tree, windows
from tessera.operators.chunking import chunk_files

NOW = dt.datetime(2024, 6, 30)


def corpus(spark):
    rows = [(1, "a/x.cs", "class", "c", [1.0, 0.0]), (2, "a/x.cs", "method", "c", [0.9, 0.1]), (3, "b/y.razor", "razor-html", "c", [0.0, 1.0]), (4, "b/z.c", "c-function", "c", [0.0, 0.0]), (5, "b/z.c", "c-function", "c", [1.0, 0.0])]
    return spark.createDataFrame([(*r, NOW) for r in rows], "id long, file_path string, chunk_type string, content string, embedding array<double>, last_modified timestamp")


def queries(spark, *vectors):
    return spark.createDataFrame([(f"q{i}", list(v)) for i, v in enumerate(vectors)], "query string, query_embedding array<double>")


def test_search_orders_ties_by_id(spark):
    got = search.search(corpus(spark), queries(spark, [1.0, 0.0]), F.lit(NOW), 3)
    assert [r["id"] for r in got.collect()] == [1, 2, 5]  # 2 is nearly as near as 5, and a method counts more
    twins = corpus(spark).withColumn("id", F.col("id") + 10).unionByName(corpus(spark))
    assert [r["id"] for r in search.search(twins, queries(spark, [1.0, 0.0]), F.lit(NOW), 4).collect()] == [1, 11, 2, 12]
    assert [r["id"] for r in search.best_by_score(twins, queries(spark, [0.0, 1.0]), 3).orderBy("rank").collect()] == [3, 13, 2]


def test_search_refuses_what_it_cannot_answer(spark):
    with pytest.raises(Exception, match="2 components and a query of 3"):
        search.scored(corpus(spark), queries(spark, [1.0, 0.0, 0.0])).collect()
    with pytest.raises(ValueError, match="2 dimensions"):
        search.scored(corpus(spark), queries(spark, [1.0], [1.0, 2.0]))
    with pytest.raises(ValueError, match="at most 1000"):
        search.scored(corpus(spark), queries(spark, *[[1.0, 0.0]] * 1001))
    none = queries(spark, [1.0, 0.0]).where("false")
    assert search.search(corpus(spark), none, F.lit(NOW)).count() == 0 and search.best_by_score(corpus(spark), none, 3).count() == 0


def test_filters_after_and_before(spark):
    q = queries(spark, [1.0, 0.0])
    assert [r["id"] for r in search.search(corpus(spark), q, F.lit(NOW), 5, "razor,c").collect()] == [5, 3, 4]
    assert [r["id"] for r in search.search(corpus(spark), q, F.lit(NOW), 1, "", "RAZOR-HTML", prefilter=True).collect()] == [3]


def test_batches(spark):
    q = queries(spark, [1.0, 0.0], [0.0, 1.0])
    hits = search.batch_search(corpus(spark), q, F.lit(NOW), 2).cache()
    assert hits.count() == 4
    files = {r["file_path"]: r["results"] for r in search.cross_reference(hits).collect()}
    assert all(n > 1 for n in files.values())
    assert search.batch_summary(hits, q).first()["queries_with_results"] == 2
    assert search.parse_queries(" a, b,,a ") == ["a", "b"]
    for bad in (" ,", ",".join(map(str, range(11)))):
        with pytest.raises(ValueError):
            search.parse_queries(bad)


def test_context(spark):
    hits = spark.createDataFrame([("f", "enum", "own", 5, 6), ("g", "enum", "own", 1, 1), ("f", "enum", "own", 0, 1)], "file_path string, chunk_type string, content string, start_line int, end_line int")
    source = spark.createDataFrame([("f", "\n".join(map(str, range(1, 31))))], "file_path string, text string")
    got = [r["context"] for r in search.with_context(hits, source, 2).orderBy("start_line").collect()]
    assert sorted(got) == sorted(["\n".join(map(str, range(3, 9))), "own", "own"])


def test_diff_round_trip(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, content_hash string")
    new = spark.createDataFrame([("b", "1"), ("c", "2"), ("d", "1")], "path string, content_hash string")
    assert {tuple(r) for r in changes.diff(old, new).collect()} == {("a", "removed"), ("c", "modified"), ("d", "added")}
    assert changes.diff(new, new).count() == 0


def test_upsert(spark):
    t = spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], "id int, seq int, v string")
    rows = spark.createDataFrame([(2, 1, "x"), (2, 2, "y"), (3, 1, "z")], "id int, seq int, v string")
    assert {tuple(r) for r in changes.upsert(t, rows, "id", "seq").collect()} == {(1, 0, "a"), (2, 2, "y"), (3, 1, "z")}


def test_cache(spark):
    schema = "content_hash string, embedding_type string, model string, project string"
    wanted = spark.createDataFrame([("h", "document", "m", None), ("h", "query", "m", None), ("h", "document", "m", "p")], schema)
    held = spark.createDataFrame([("h", "document", "m", None, [1.0])], schema + ", embedding array<double>")
    assert sorted((r["embedding_type"], r["project"] or "", r["hit"]) for r in cache.look_up(wanted, held).collect()) == [("document", "", True), ("document", "p", False), ("query", "", False)]


def test_expansion(spark):
    asked = ["auth", "refresh token", "Auth", "zzz", "identity", "setup"]
    got = {r["query"]: r["expanded"] for r in expand.expand(spark.createDataFrame([(a,) for a in asked], "query string"), expand.synonyms(spark)).collect()}
    assert got["auth"] == "auth (authentication OR authorization OR login OR signin OR credential OR identity)"
    assert got["Auth"] == "Auth (authentication OR authorization OR login OR signin OR credential OR identity)"
    assert got["refresh token"] == "refresh token (token OR jwt OR bearer OR access token)"
    assert got["zzz"] == "zzz"
    assert got["identity"] == "identity (user OR account OR member OR principal)"
    assert got["setup"] == "setup (init OR initialize OR initialise OR startup OR bootstrap)"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("a; }", max_size=30), min_size=1, max_size=40), st.integers(1, 120), st.sampled_from(["file", "method", "ultra"]), st.sampled_from(["line", "c"]))
def test_windows_cover_all_lines(lines, budget, breaks, kind):
    walk = windows.line_windows if kind == "line" else windows.c_windows
    found = list(walk(lines, budget, 0.5, breaks=breaks))
    assert found[0][0] == 0 and found[-1][1] == len(lines)
    for (a, b), (c, d) in zip(found, found[1:], strict=False):
        assert a < c <= b < d or (a < c <= b and d >= b)
        assert b - c <= 10


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("a;}/ ", max_size=20), min_size=1, max_size=30), st.integers(1, 90))
def test_windows_match_the_plain_rule(lines, budget):
    import re

    is_break = re.compile(windows.fixed.BREAKS["file"]).search
    start, want = 0, []
    while start < len(lines):
        size, end = 0, start
        while end < len(lines) and (end == start or size < budget):
            cost = len(lines[end]) + 1
            if end > start and size + cost > budget and (is_break(lines[end].strip()) or size > 0.5 * budget):
                break
            size += cost
            end += 1
        want.append((start, end))
        if end >= len(lines):
            break
        start = max(end - min(int((end - start) * 0.15), 10), start + 1)
    assert list(windows.line_windows(lines, budget, 0.5)) == want


def test_markdown(spark):
    doc = "intro\n# A\ntext\n#tag line\n## B\nb\n## Empty\n\n#### D\nd\n# E\ne\n### F\nf"
    s = markdown.sections(spark.createDataFrame([(1, doc)], "k int, t string"), "k", "t")
    got = [tuple(r)[2:] for r in s.orderBy("section").collect()]
    assert got == [(1, "A", "text\n#tag line"), (2, "B", "b"), (4, "D", "d"), (1, "E", "e"), (3, "F", "f")]
    assert [r["parent"] for r in markdown.parents(s, "k").orderBy("section").collect()] == [None, 1, 2, None, 2]


def forest(spark):
    rows = [(1, None, "root"), (2, 1, "b"), (3, 1, "a"), (4, 3, "leaf"), (5, None, "other"), (6, 99, "orphan"), (7, 8, "loop"), (8, 7, "loop2")]
    return spark.createDataFrame(rows, "id int, parent_id int, name string")


def test_tree(spark):
    got = [(r["id"], r["depth"]) for r in tree.traverse(forest(spark), 5).orderBy("sort_path").collect()]
    assert got == [(5, 0), (1, 0), (3, 1), (4, 2), (2, 1)]
    assert [r["line"] for r in tree.ascii_lines(forest(spark), 5, 1).orderBy("sort_path").collect()] == ["[#1] root", "├── [#3] a", "│   └── [#4] leaf", "└── [#2] b"]
    assert [r["circular"] for r in tree.traverse(forest(spark), 5, 7).orderBy("depth").collect()] == [False, False, True]
    assert tree.nested(forest(spark), 1, 1) == [{"id": 1, "name": "root", "children": [{"id": 3, "name": "a", "children": [], "childrenOmitted": True}, {"id": 2, "name": "b", "children": [], "childrenOmitted": True}]}]
    assert tree.node_count(forest(spark), 0).first()["nodes"] == 2


def memories(spark):
    rows = [(1, "One thing", "one-thing", ["A"], "t1", NOW, None, 1, 0.1), (2, "Two", "two", ["b"], "t2\nx", NOW - dt.timedelta(days=9), 1, 2, 0.2)]
    return spark.createDataFrame(rows, "id int, name string, alias string, tags array<string>, text string, timestamp timestamp, parent_id int, lines_count int, size_kb double")


def test_memory(spark):
    m = memories(spark)
    assert memory.resolve(m, "2").first()["name"] == "Two" and memory.resolve(m, "one-thing").first()["id"] == 1
    new = spark.createDataFrame([(1, "Two", "body", ["a", "c"], 1), (2, "Two", "body", None, None)], "seq int, name string, text string, tags array<string>, parent_id int")
    got = {r["id"]: r for r in memory.add(m, new, F.lit(NOW)).collect()}
    assert got[3]["alias"] == "two-1" and got[4]["alias"] == "two-2" and got[3]["tags"] == ["A", "c"] and got[4]["tags"] == []
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6])], "memory_id int, embedding array<double>")
    assert [r["id"] for r in memory.search(m, vectors, [1.0, 0.0], F.lit(NOW)).collect()] == [1, 2]
    assert [r["id"] for r in memory.search(m, vectors, [1.0, 0.0], F.lit(NOW), tags=["B"], older_than_days=5, has_children=False, min_score=0.5).collect()] == [2]
    assert memory.search(m, vectors, [1.0, 0.0], F.lit(NOW), k=1, tags=["b"]).count() == 0
    assert memory.children(m).first()["children"] == [2]


def test_alias_clash(spark):
    titles = spark.createDataFrame([(1, "x"), (2, "x 1"), (3, "x"), (4, "x"), (5, "!")], "id int, name string")
    assert [r["alias"] for r in memory.unique_aliases(titles).orderBy("id").collect()] == ["x", "x-1", "x-2", "x-3", "memory"]


def test_statistics(spark):
    assert statistics.common_root(spark.createDataFrame([("g", "/a/b/x.cs"), ("g", "/a/b/c/y.cs"), ("h", "/z/q.cs"), ("k", "/a/p"), ("k", "/b/p")], "g string, p string"), "g", "p").orderBy("g").collect()[0]["root"] == "/a/b"
    assert statistics.shared_directories(spark.createDataFrame([("p", "d"), ("q", "d"), ("r", "e")], "project string, directory string")).first()["projects"] == ["p", "q"]
    assert [r["name"] for r in statistics.type_names(spark.createDataFrame([("class A : B {} enum C",)], "content string")).collect()] == ["A", "C"]
    empty = spark.createDataFrame([], "id int, parent_id int, tags array<string>, size_kb double, lines_count int")
    assert statistics.content_stats(empty).first()["total_kb"] == 0 and statistics.graph_stats(empty).first()["child_links"] == 0


CSHARP = '''using System;
namespace N {
/// <summary>A { brace</summary>
public class Foo : Base {
    private readonly string s = "class Fake { }";
    public int Y { get; set; } = 4;
    public string Z => "a{b";
    public Foo() { }
    public int Add(int a) {
        int Local(int q) { return q; }
        return a switch { 1 => 2, _ => 3 };
    }
    public int Sub(int a) => a - 1;
}
public interface IThing { void Go(); }
public record Pt(int X);
public enum E { A, B }
}
'''


def test_csharp():
    found = source_parsers.csharp("a/Foo.cs", CSHARP)
    assert [(k, name) for _, _, _, k, name in found] == [("class", "Foo"), ("property", ""), ("property", ""), ("method", "Add"), ("local_function", "Local"), ("switch_expression", "Add"), ("method", "Sub"), ("interface", "IThing"), ("record", "Pt"), ("enum", "E")]
    assert found[3][1:3] == (9, 12) and found[3][0].startswith("// In class Foo\n")
    assert [p[3] for p in source_parsers.csharp("Program.cs", "var b = 1;\nb.Run();\n\n\n\n\nfoo(x => { y(); });\n")] == ["top_level_statements"] * 2
    assert source_parsers.csharp("x.cs", "class A { void F() {")[0][3] == "file"
    assert "generated" in [p[3] for p in source_parsers.csharp("x.g.cs", "class A { }")]
    long = "class A {\n void F() {\n" + "  x = 1;\n" * 2000 + " }\n}\n"
    kinds = [p[3] for p in source_parsers.csharp("x.cs", long)]
    assert kinds.count("method") == 1 and "method-body" in kinds and "method-ultra" in kinds


def test_c_and_razor():
    c = source_parsers.c_source("x.c", '#define MAX 3\ntypedef int foo_t;\nstruct S { int a; };\nstatic int add(int a)\n{\n  return a; // }\n}\n')
    assert [(p[3], p[4]) for p in c] == [("c-macro", "MAX"), ("c-typedef", "foo_t"), ("c-struct", "S"), ("c-function", "add")]
    assert source_parsers.c_source("x.h", "int add(int a);\n")[0][3:] == ("c-function", "add")
    r = source_parsers.razor("@using A\n<div>" + "x" * 120 + "</div>\n\n@code {\n  void F() { a = 1; }\n}\n")
    assert [p[3] for p in r] == ["razor-html", "razor-code"]
    assert source_parsers.razor("x")[0][3] == "razor-file"


def test_aliases_with_many_taken_numbers(spark):
    titles = spark.createDataFrame(list(enumerate(["a b", "a b", "a b 1", "a b 2", "a b 3"])), "id int, name string")
    assert {r["id"]: r["alias"] for r in memory.unique_aliases(titles).collect()} == {0: "a-b", 1: "a-b-4", 2: "a-b-1", 3: "a-b-2", 4: "a-b-3"}


def test_memory_update(spark):
    old = NOW - dt.timedelta(days=3)
    m = memories(spark).withColumn("updated_at", F.lit(old))
    more = [(3, "Two", "two-1", [], "t", NOW, None, 1, 0.1, old), (4, "Four", "four", ["x"], "t", NOW, None, 1, 0.1, old), (5, "Five", "five", [], "t", NOW, None, 1, 0.1, old)]
    m = m.unionByName(spark.createDataFrame(more, m.schema))
    new = [(1, "TWO", None, None), (2, None, "a\n\nb\nc" + "é" * 1021, None), (4, "Two", None, ["y"]), (5, "Five", None, None), (9, "Two", "none", None)]
    got = {r["id"]: r for r in memory.update(m, spark.createDataFrame(new, "id int, name string, text string, tags array<string>"), F.lit(NOW)).collect()}
    assert {i: r["alias"] for i, r in got.items()} == {1: "two-2", 2: "two", 3: "two-1", 4: "two-3", 5: "five"}
    assert (got[2]["lines_count"], got[2]["size_kb"]) == (3, (6 + 2 * 1021) / 1024) and got[2]["name"] == "Two"
    assert (got[1]["lines_count"], got[1]["size_kb"]) == (1, 0.1) and got[4]["tags"] == ["y"] and got[1]["tags"] == ["A"]
    assert [got[i]["updated_at"] for i in (1, 2, 3, 4, 5)] == [NOW, NOW, old, NOW, NOW]
    renamed = memory.update(m, spark.createDataFrame([(1, "Four 1", None, None), (2, "Four", None, None), (3, "Four", None, None)], "id int, name string, text string, tags array<string>"), F.lit(NOW))
    assert {r["id"]: r["alias"] for r in renamed.collect()} == {1: "four-1", 2: "four-2", 3: "four-3", 4: "four", 5: "five"}
    assert memory.resolve(renamed, "four-1").first()["id"] == 1


def test_c_files_with_unmatched_braces_stay_whole():
    good = lambda k: f"int f{k}(int a)\n{{\n  return {k};\n}}\n"
    text = "#define MAX 3\nstruct S { int a; };\n" + good(1) + "int bad(int a)\n{\n#if X\n  if (a) {\n#else\n  if (!a) {\n#endif\n  }\n}\n" + "".join(good(k) for k in range(2, 900))
    found = source_parsers.c_source("x.c", text)
    assert {p[4] for p in found if p[3] == "c-function"} == {f"f{k}" for k in range(1, 900)}
    assert {"c-macro", "c-struct"} <= {p[3] for p in found}
    plain = "\n".join(f"word {k}" for k in range(5000))
    for source in (text, plain):
        lines, covered = source.split("\n"), set()
        for content, a, b, kind, _ in source_parsers.c_source("x.c", source):
            if kind == "c-file":
                assert content == "\n".join(lines[a - 1 : b])
                covered |= set(range(a, b + 1))
        assert covered == set(range(1, len(lines) + 1))
    assert source_parsers.c_source("x.c", "no code")[0] == ("no code", 1, 1, "c-file", "")


def test_chunk_files(spark):
    rows = [("a/Login.cs", NOW, CSHARP), ("b/x.c", NOW, "int check_login(int a)\n{\n return 1;\n}\n"), ("c/empty.cs", NOW, ""), ("d/none.cs", NOW, None)]
    got = chunk_files(spark.createDataFrame(rows, "path string, modified timestamp, content string")).collect()
    kinds = {(r["file_path"], r["chunk_type"]) for r in got}
    assert ("a/Login.cs", "class-auth") in kinds and ("b/x.c", "c-function-auth") in kinds
    assert {r["file_path"] for r in got} == {"a/Login.cs", "b/x.c"} and len({r["id"] for r in got}) == len(got)


def test_contained_chunks_go(spark):
    rows = [("f", "m", 1, 1, 10, "a"), ("f", "m", 2, 2, 5, "b"), ("f", "n", 3, 2, 5, "c"), ("f", "m", 4, 12, 13, "a"), ("f", "m", 5, 1, 10, "d")]
    c = spark.createDataFrame(rows, "file_path string, chunk_type string, id int, start_line int, end_line int, content string")
    assert sorted(r["id"] for r in windows.without_contained(c).collect()) == [1, 3]


def test_import_and_append(spark):
    m = memories(spark)
    doc = spark.createDataFrame([("x/notes.md", "# A\na\n## B\nb\n# C\nc")], "path string, text string")
    got = {r["id"]: r for r in memory.import_markdown(m, doc, F.lit(NOW), 2, ["t"]).collect()}
    assert [(got[i]["name"], got[i]["parent_id"]) for i in (3, 4, 5)] == [("A", 2), ("B", 3), ("C", 2)]
    assert got[4]["tags"] == ["t", "imported-from-notes", "imported-markdown", "level-2"]
    child = spark.createDataFrame([("Kid", "k", ["B", "z"])], "name string, text string, tags array<string>")
    kid = next(r for r in memory.append(m, "two", child, F.lit(NOW)).collect() if r["id"] == 3)
    assert kid["parent_id"] == 2 and kid["tags"] == ["b", "z"]
    assert memory.append(m, "none", child, F.lit(NOW)).count() == 2


def test_parents_of_any_level(spark):
    levels = [1, 6, 7, 9, 8, 7, 2, 8, 3, 12, 13, 12]
    text = "\n".join(f"{'#' * level} t{k}\nx" for k, level in enumerate(levels))
    df = spark.createDataFrame([("d", text)], "path string, text string")
    got = {r["section"]: r["parent"] for r in markdown.parents(markdown.sections(df, "path", "text"), "path").collect()}
    want = {}
    for k, level in enumerate(levels):
        before = [(x, j) for j, x in enumerate(levels[:k]) if x < level]
        want[k + 1] = max(before)[1] + 1 if before else None
    assert got == want
