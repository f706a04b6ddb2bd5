"""Columns against hand-derived rows."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import scoring, text
from tessera.sources import files


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in rows.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]


def test_alias(spark):
    titles = ["API Design Decisions", "Breakthrough: Tier 3 Ultra-Granular Chunking Success", "Authentication Flow Implementation Details", "C# & Java + x", "  ", "'quoted' (a)", "a--b__c d", "50% off"]
    assert column(spark, titles, text.alias_of) == ["api-design-decisions", "breakthrough-tier-3", "authentication-flow-implementation", "cnumber-and-java", "", "quoted-a", "a-b-c", "50percent-off"]
    assert column(spark, ["a-b", "-a", "a-", "A", "", "a1"], text.is_alias) == [True, False, False, False, False, True]


@pytest.mark.parametrize(
    ("path", "kind", "content", "factor"),
    [
        ("a/AuthService.cs", "class", "", 1.5), ("identity/x.cs", "class", "", 1.5), ("a/x.cs", "class", "uses a JWT here", 1.5), ("Program.cs", "file", "", 1.4), ("a/appsettings.json", "file", "", 1.3),
        ("Controllers/X.cs", "class", "", 1.2), ("a/HomeController.cs", "method", "", 1.2), ("Services/X.cs", "class", "", 1.15), ("models/X.cs", "class", "", 1.1), ("a/X.razor", "razor-html", "", 1.1),
        ("tests/X.cs", "class", "", 0.8), ("a/X.generated.cs", "class", "", 0.7), ("a/X.cs", "class", "a Controller", 1.2), ("a/X.cs", "class", "", 1.1), ("a/X.cs", "interface", "", 1.1), ("a/X.cs", "method", "", 1.05),
        ("a/X.cs", "sliding_window", "", 0.9), ("a/X.cs", "generated", "", 0.8), ("a/X.cs", "enum-auth", "", 1.4), ("a/X.cs", "enum-security", "", 1.3), ("a/X.cs", "enum-config", "", 1.2), ("a/X.cs", "enum", "", 1.0),
        ("services/tests/X.cs", "class", "", 1.15), ("tests/config.cs", "class", "", 1.3),
    ],
)
def test_importance(spark, path, kind, content, factor):
    row = spark.createDataFrame([(path, kind, content)], "p string, k string, c string")
    assert row.select(scoring.file_importance(F.col("p"), F.col("k"), F.col("c"))).first()[0] == factor


def test_recency(spark):
    now = dt.datetime(2024, 6, 30)
    ages = [0, 7, 7.01, 30, 30.01, 90, 90.01]
    got = column(spark, [now - dt.timedelta(days=a) for a in ages], lambda c: scoring.recency(c, F.lit(now)), "timestamp")
    assert got == [1.1, 1.1, 1.05, 1.05, 1.0, 1.0, 0.95]


def test_types(spark):
    rows = spark.createDataFrame([("class", "a/Login.cs", ""), ("method", "a/x.cs", "AES"), ("method", "Startup.cs", ""), ("class", "a/x.cs", "controller"), ("class", "a/x.cs", "service"), ("enum", "a/x.cs", "service")], "k string, p string, c string")
    assert [r[0] for r in rows.select(scoring.enrich_type(F.col("k"), F.col("p"), F.col("c"))).collect()] == ["class-auth", "method-security", "method-config", "class-controller", "class-service", "enum"]
    assert column(spark, ["check_login", "hash_it", "set_option", "go"], lambda c: scoring.enrich_c_type(F.lit("c-function"), c)) == ["c-function-auth", "c-function-security", "c-function-config", "c-function"]


def test_cosine(spark):
    vectors = [[1.0, 0.0, 0.0], [2.0, 0.0, 0.0], [0.0, 0.0, 0.0], [-1.0, 0.0, 0.0], [1.0, 1.0, 0.0]]
    got = column(spark, vectors, lambda c: scoring.cosine(c, F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))), "array<double>")
    assert got == pytest.approx([1, 1, 0, -1, 2**-0.5])


def test_rendering(spark):
    assert column(spark, ["a\n\nb\r\nc", "", "\n"], text.lines_count) == [3, 0, 0]
    assert column(spark, ["x" * 90, " ab \nc"], text.preview) == ["x" * 77 + "...", "ab"]
    lines = spark.createDataFrame([(["a", "b"],)], "l array<string>")
    assert lines.select(text.numbered(F.col("l"), F.lit(9))).first()[0] == ["   9: a", "  10: b"]
    assert len(spark.range(1).select(text.elided(F.transform(F.sequence(F.lit(1), F.lit(300)), lambda x: x.cast("string")))).first()[0]) == 201
    now = dt.datetime(2024, 6, 30)
    times = [now - dt.timedelta(seconds=s) for s in (5, 180, 3600, 3 * 86400, 8 * 86400)]
    assert column(spark, times, lambda c: text.relative_time(c, F.lit(now)), "timestamp") == ["just now", "3 min ago", "1 hour ago", "3 days ago", ""]


def test_tags(spark):
    row = spark.createDataFrame([(["A", "b"], ["a", "C", "c"])], "p array<string>, o array<string>")
    assert row.select(text.tag_union(F.col("p"), F.col("o"))).first()[0] == ["A", "b", "C"]
    assert row.select(text.has_tag(F.col("p"), ["B"]), text.has_tag(F.col("p"), ["x"])).first()[:] == (True, False)


def test_ignored(spark):
    paths = ["bin/a.cs", "src/bin/a.cs", "Bin/a.cs", "mybin/a.cs", "a/x.DLL", "a/x.min.js", "a/Connected Services/x.cs", "a/x.cs", "_ReSharper*/x", "_ReSharper1/x"]
    assert column(spark, paths, files.ignored) == [True, True, False, False, True, True, True, False, True, False]
    sizes = spark.createDataFrame([("a.cs", 1024 * 1024), ("a.cs", 1024 * 1024 + 1)], "p string, n long")
    assert [r[0] for r in sizes.select(files.ignored(F.col("p"), F.col("n"))).collect()] == [False, True]


def test_paths_and_projects(tmp_path):
    assert files.allowed(str(tmp_path / "x"), [str(tmp_path)]) and not files.allowed(str(tmp_path) + "x", [str(tmp_path)]) and not files.allowed("/etc", [])
    assert files.project_name("My.Project  1") == "my_project_1"
    with pytest.raises(ValueError):
        files.project_name("...")


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text("ab\n /é", max_size=12), min_size=1, max_size=4))
def test_snippet_is_a_prefix(spark, texts):
    for t, s in zip(texts, column(spark, texts, lambda c: text.snippet(c, 2)), strict=True):
        assert s == "\n".join(t.split("\n")[:2])
