"""Text, path, hash and rendering columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import fixed


def alias_of(title: Column) -> Column:
    """The slug of a title: its first three words, in lower case, joined by hyphens; may be empty."""
    t = F.lower(title)
    t = F.translate(t, fixed.ALIAS_TO_SPACE, " " * len(fixed.ALIAS_TO_SPACE))
    t = F.translate(t, fixed.ALIAS_DROPPED, "")
    for c, word in fixed.ALIAS_WORDS.items():
        t = F.replace(t, F.lit(c), F.lit(word))
    words = F.slice(F.filter(F.split(t, "[ _-]"), lambda w: w != ""), 1, 3)
    slug = F.regexp_replace(F.array_join(words, "-"), "[^a-z0-9-]", "")
    return F.regexp_replace(F.regexp_replace(slug, "-+", "-"), "^-|-$", "")


def is_alias(alias: Column) -> Column:
    return alias.rlike("^[a-z0-9]([a-z0-9-]*[a-z0-9])?$")


def snippet(text: Column, lines: int) -> Column:
    """The first lines of a text."""
    return F.array_join(F.slice(F.split(text, "\n"), 1, lines), "\n")


def lines_count(text: Column) -> Column:
    """Pieces between line feeds and carriage returns that aren't empty."""
    return F.size(F.filter(F.split(text, "[\n\r]"), lambda p: p != ""))


def size_kb(text: Column) -> Column:
    return F.octet_length(text) / F.lit(1024.0)


def preview(text: Column, length: int = 80) -> Column:
    """The first line, trimmed, and shortened with three dots."""
    first = F.trim(F.substring_index(text, "\n", 1))
    return F.when(F.length(first) > length, F.concat(F.substring(first, 1, length - 3), F.lit("..."))).otherwise(first)


def numbered(lines: Column, start: Column) -> Column:
    """Lines with their numbers, right-aligned in four places."""
    number = lambda i: (i + start).cast("string")
    return F.transform(lines, lambda line, i: F.concat(F.when(F.length(number(i)) < 4, F.lpad(number(i), 4, " ")).otherwise(number(i)), F.lit(": "), line))


def elided(lines: Column, most: int = 200, ends: int = 100) -> Column:
    """Long lists of lines keep their first and last `ends` around a banner."""
    gone = (F.size(lines) - 2 * ends).cast("string")
    banner = F.array(F.concat(F.lit("... ("), gone, F.lit(" lines not shown) ...")))
    return F.when(F.size(lines) > most, F.concat(F.slice(lines, 1, ends), banner, F.slice(lines, -ends, ends))).otherwise(lines)


def cache_key(text: Column) -> Column:
    """SHA-256 in URL-safe base64 without padding."""
    return F.rtrim(F.translate(F.base64(F.unhex(F.sha2(text, 256))), "+/", "-_"), F.lit("="))


def content_hash(content: Column) -> Column:
    """SHA-256 in base64."""
    return F.base64(F.unhex(F.sha2(content, 256)))


def age_display(stored: Column, as_of: Column) -> Column:
    days = F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(stored.cast("timestamp"))) / 86_400_000_000)
    return F.when(days < 1, "Stored today").when(days < 2, "Stored 1 day ago").otherwise(F.concat(F.lit("Stored "), days.cast("string"), F.lit(" days ago")))


def relative_time(at: Column, as_of: Column) -> Column:
    minutes = F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 60_000_000)
    plural = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    return F.when(minutes < 1, "just now").when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min ago"))).when(hours < 24, plural(hours, "hour")).when(days < 7, plural(days, "day")).otherwise("")


def shorten_path(path: Column, most: int = 80) -> Column:
    """Long paths keep their first directory, their last two and the file name."""
    parts = F.split(path, "/")
    short = F.concat_ws("/", F.element_at(parts, 1), F.lit("..."), F.array_join(F.slice(parts, -3, 3), "/"))
    return F.when((F.length(path) > most) & (F.size(parts) > 4), short).otherwise(path)


def tag_union(parent: Column, own: Column) -> Column:
    """Parent's tags, then own ones not there yet in any case; first spelling and order are kept."""
    empty = F.array().cast("array<string>")
    return F.aggregate(
        F.concat(F.coalesce(parent, empty), F.coalesce(own, empty)),
        empty,
        lambda acc, tag: F.when(F.exists(acc, lambda x: F.lower(x) == F.lower(tag)), acc).otherwise(F.array_append(acc, tag)),
    )


def has_tag(tags: Column, wanted: list[str]) -> Column:
    """Does any tag equal any wanted one, in any case."""
    return F.arrays_overlap(F.transform(tags, lambda t: F.lower(t)), F.array(*[F.lit(w.lower()) for w in wanted]))


def extension_filter(path: Column, extensions: str) -> Column:
    """Comma list of extensions, in any case; an empty list lets all pass."""
    names = [e.strip().lower().lstrip(".") for e in extensions.split(",") if e.strip()]
    out = F.lit(not names)
    for e in names:
        out = out | F.lower(path).endswith("." + e)
    return out


def type_filter(chunk_type: Column, types: str) -> Column:
    """Comma list of whole types, in any case; an empty list lets all pass."""
    names = [t.strip().lower() for t in types.split(",") if t.strip()]
    return F.lower(chunk_type).isin(names) if names else F.lit(True)
