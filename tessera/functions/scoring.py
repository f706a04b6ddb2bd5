"""Columns that score and classify chunks. All are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import fixed


def _any(column: Column, words: list[str]) -> Column:
    """Is one of the words a part of the (lower-case) column."""
    out = column.contains(words[0])
    for w in words[1:]:
        out = out | column.contains(w)
    return out


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, added from the first component on."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0 if a vector is zero. Norms may be given, to be computed once."""
    size = (norm_a if norm_a is not None else norm(a)) * (norm_b if norm_b is not None else norm(b))
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """What stands before the last slash; empty if there is none."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def file_importance(path: Column, chunk_type: Column, content: Column) -> Column:
    """The factor by which a file's place and kind raise or lower its chunks; first match wins."""
    name, folder, text = F.lower(file_name(path)), F.lower(directory(path)), F.lower(content)
    auth = _any(name, fixed.AUTH_FILE_WORDS) | _any(folder, fixed.AUTH_DIRECTORY_WORDS) | _any(text, fixed.AUTH_WORDS)
    return (
        F.when(auth, 1.5)
        .when(_any(name, ["program.cs", "startup.cs"]), 1.4)
        .when(_any(name, ["appsettings", "config"]), 1.3)
        .when(folder.contains("controllers") | name.contains("controller"), 1.2)
        .when(_any(folder, ["services", "handlers"]), 1.15)
        .when(_any(folder, ["models", "entities"]), 1.1)
        .when(name.endswith(".razor") | folder.contains("components"), 1.1)
        .when(_any(folder, ["test", "spec"]), 0.8)
        .when(name.endswith(".generated.cs") | name.contains(".designer.cs"), 0.7)
        .otherwise(chunk_type_importance(chunk_type, text))
    )


def chunk_type_importance(chunk_type: Column, text: Column) -> Column:
    return (
        F.when(chunk_type.isin("class-auth", "method-auth", "interface-auth", "property-auth"), 1.5)
        .when(chunk_type.isin("class-security", "method-security"), 1.4)
        .when(chunk_type.isin("class-config", "method-config"), 1.3)
        .when(chunk_type == "class-controller", 1.2)
        .when(chunk_type == "class-service", 1.15)
        .when((chunk_type == "class") & text.contains("controller"), 1.2)
        .when(chunk_type.isin("class", "interface"), 1.1)
        .when((chunk_type == "method") & _any(text, fixed.AUTH_METHOD_WORDS), 1.3)
        .when(chunk_type == "method", 1.05)
        .when(chunk_type.isin("property", "namespace"), 1.0)
        .when(chunk_type == "sliding_window", 0.9)
        .when(chunk_type == "generated", 0.8)
        .when(chunk_type.endswith("-auth"), 1.4)
        .when(chunk_type.endswith("-security"), 1.3)
        .when(chunk_type.endswith("-config"), 1.2)
        .otherwise(1.0)
    )


def recency(modified: Column, as_of: Column) -> Column:
    """1.1 up to 7 days of age, 1.05 up to 30, 1.0 up to 90, then 0.95."""
    days = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(modified.cast("timestamp"))) / F.lit(86_400_000_000.0)
    return F.when(days <= 7, 1.1).when(days <= 30, 1.05).when(days <= 90, 1.0).otherwise(0.95)


def combined(score: Column, importance: Column, fresh: Column) -> Column:
    """The rank's score: 70 % similarity, 20 % weighted by importance, 10 % by recency."""
    return score * 0.7 + score * importance * 0.2 + score * fresh * 0.1


def enrich_type(chunk_type: Column, path: Column, content: Column) -> Column:
    """A C# chunk's type with its suffix; the first of the cascade wins."""
    name, folder, text = F.lower(file_name(path)), F.lower(directory(path)), F.lower(content)
    auth = _any(text, fixed.AUTH_WORDS + fixed.AUTH_TYPE_WORDS) | _any(name, fixed.AUTH_FILE_WORDS) | _any(folder, fixed.AUTH_DIRECTORY_WORDS)
    is_class = chunk_type == "class"
    return (
        F.when(auth, F.concat(chunk_type, F.lit("-auth")))
        .when(_any(text, fixed.SECURITY_WORDS), F.concat(chunk_type, F.lit("-security")))
        .when(_any(name, ["program.cs", "startup.cs"]), F.concat(chunk_type, F.lit("-config")))
        .when(is_class & (text.contains("controller") | name.contains("controller")), "class-controller")
        .when(is_class & (text.contains("service") | folder.contains("services")), "class-service")
        .otherwise(chunk_type)
    )


def enrich_c_type(base: Column, name: Column) -> Column:
    """A C chunk's type with the suffix that its name gives."""
    out = None
    for suffix, words in fixed.C_NAME_WORDS.items():
        hit = _any(F.lower(name), words)
        value = F.concat(base, F.lit(suffix))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(base)


def context_lines(chunk_type: Column) -> Column:
    """How many lines around a chunk of that type are shown."""
    t = F.lower(chunk_type)
    return (
        F.when(_any(t, ["method", "function"]), 18)
        .when(t.contains("class"), 20)
        .when(t.contains("property"), 10)
        .when(t.contains("interface"), 15)
        .when(t.contains("enum"), 8)
        .when(_any(t, ["auth", "security"]), 20)
        .otherwise(15)
    )
