"""Structure of C#, Razor and C sources, found by a scanner of strings, comments and braces.

There is no compiler behind this: text in strings and comments is blanked out, braces are matched,
and what stands before a brace says what it opens. That finds the declarations of well-formed
sources; a C# file in which braces don't match becomes windows of lines. In a C file only the
declarations whose braces don't match are left out, and windows over the whole file are added.

A piece is (content, first line, last line, type, name); lines count from 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from tessera.functions import fixed
from tessera.operators.windows import c_windows, line_windows

Piece = tuple[str, int, int, str, str]

MAX_CHUNK = 20_000

_NOISE = re.compile(
    r'//[^\n]*|/\*.*?\*/|"""(?:.|\n)*?"""|\$?@\$?"(?:[^"]|"")*"|\$?"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'',
    re.DOTALL,
)
_TYPE = re.compile(r"\b(class|interface|struct|enum|record(?:\s+(?:class|struct))?)\s+(\w+)")
_CALL = re.compile(r"([\w~]+)\s*(?:<[^<>()]*>)?\s*\(")
_LOCAL = re.compile(r"^[ \t]*(?:static\s+|async\s+|unsafe\s+)*(?!return\b|new\b|else\b|await\b|throw\b|using\b|case\b|in\b)[\w<>\[\],.?]+\s+(\w+)\s*(?:<[^<>()]*>)?\s*\([^;{}]*\)\s*\{", re.M)
_SWITCH = re.compile(r"\bswitch\s*\{")
_GENERATED_NAME = re.compile(r"(?i)(\.designer\.cs|\.g\.cs|\.g\.i\.cs)$|assemblyinfo\.cs|assemblyattributes\.cs")
_GENERATED_TEXT = re.compile(r"<auto-generated|This code was generated|do not modify|autogenerated")


def blanked(source: str) -> str:
    """The source with strings and comments as spaces; line breaks stay."""
    return _NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), source)


def closing(masked: str, opening: int) -> int:
    """Index of the brace that closes the one at `opening`; raises if there is none."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(masked, opening):
        depth += 1 if m.group() == "{" else -1
        if depth == 0:
            return m.start()
    raise ValueError("braces don't match")


def line_of(source: str, at: int) -> int:
    return source.count("\n", 0, at) + 1


def members(masked: str, start: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(start, head end, end) of the members in [start, end): each ends with ; or a block, and an
    expression body or initialiser behind a block belongs to it."""
    at = start
    while True:
        while at < end and (masked[at].isspace() or masked[at] in ";,"):
            at += 1
        if at >= end:
            return
        stop = re.compile(r"[;{]").search(masked, at, end)
        if stop is None:
            yield at, end, end
            return
        head = stop.start()
        arrow = masked.find("=>", at, head)
        equals = re.compile(r"(?<![=!<>])=(?![=>])").search(masked, at, head)
        if stop.group() == "{" and (arrow >= 0 or equals):
            # A lambda or initialiser with blocks: it ends with the ; at this depth.
            depth, k = 0, head
            for m in re.compile(r"[{};]").finditer(masked, head, end):
                depth += (m.group() == "{") - (m.group() == "}")
                k = m.end()
                if m.group() == ";" and depth == 0:
                    break
            yield at, arrow if arrow >= 0 else equals.start(), k
            at = k
        elif stop.group() == "{":
            close = closing(masked, head)
            if close >= end:
                raise ValueError("braces don't match")
            k = close + 1
            follow = re.compile(r"\s*=[^;]*;").match(masked, k, end)
            if follow:
                k = follow.end()
            yield at, head, k
            at = k
        else:
            yield at, arrow if arrow >= 0 else head, stop.end()
            at = stop.end()


def tiers(body: str, first: int, name: str, head: str, kinds: tuple[str, str, str], breaks: tuple[str, str], shares: tuple[float, float]) -> Iterator[Piece]:
    """The three tiers of a long unit: itself (shortened to whole lines), windows of the target
    size, and small windows."""
    last = first + body.count("\n")
    whole = head + body
    if len(whole) > MAX_CHUNK:
        kept = whole[: MAX_CHUNK - 200]
        whole = kept[: kept.rfind("\n")] + "\n// ... truncated"
    yield whole, first, last, kinds[0], name
    lines = body.split("\n")
    if len(body) > fixed.TARGET_CHUNK:
        for a, b in line_windows(lines, fixed.TARGET_CHUNK - len(head), shares[0], breaks=breaks[0]):
            yield head + "\n".join(lines[a:b]), first + a, first + b - 1, kinds[1], name
    if len(body) > 2 * fixed.ULTRA_CHUNK:
        for a, b in line_windows(lines, fixed.ULTRA_CHUNK - len(head), shares[1], breaks=breaks[1]):
            yield head + "\n".join(lines[a:b]), first + a, first + b - 1, kinds[2], name


def nested_tiers(text: str, first: int, kinds: tuple[str, str, str], breaks: str) -> Iterator[Piece]:
    """Tiers of text without structure: whole if it fits, else windows, else small windows too."""
    lines = text.split("\n")
    if len(text) <= fixed.TARGET_CHUNK:
        yield text, first, first + len(lines) - 1, kinds[0], ""
        return
    for kind, budget in ((kinds[1], fixed.TARGET_CHUNK), (kinds[2], fixed.ULTRA_CHUNK)):
        for a, b in line_windows(lines, budget, 0.5, breaks=breaks):
            yield "\n".join(lines[a:b]), first + a, first + b - 1, kind, ""


_METHOD = ("method", "method-body", "method-ultra")
_LOCAL_KINDS = ("local_function", "local-function-body", "local-function-ultra")
_FILE = ("file", "sliding_window", "sliding_window_ultra")
_TOP = ("top_level_statements", "top_level_statements_body", "top_level_statements_ultra")


def _with_doc(source: str, start: int) -> int:
    """Where the comment lines and attributes straight above begin."""
    at = source.rfind("\n", 0, start) + 1
    while at > 0:
        before = source.rfind("\n", 0, at - 1) + 1
        if not re.match(r"\s*(///|//|\[)", source[before:at]):
            break
        at = before
    return at


def is_generated(path: str, source: str) -> bool:
    return bool(_GENERATED_NAME.search(path.rpartition("/")[2]) or _GENERATED_TEXT.search("\n".join(source.split("\n")[:10])))


def _summary(source: str, masked: str, head: str, usings: list[str], space: str, body: tuple[int, int], own_name: str) -> str:
    """A class in outline: usings, namespace, declaration and the signatures of its members."""
    groups: dict[str, list[str]] = {"fields": [], "properties": [], "methods": []}
    for a, h, b in members(masked, *body):
        signature = " ".join(source[a:h].split()).rstrip(" =")
        if _TYPE.search(masked, a, h):
            continue
        if _CALL.search(masked, a, h) and "=" not in masked[a:h]:
            groups["methods"].append(signature)
        elif masked[h : h + 1] == "{" or masked.startswith("=>", h):
            groups["properties"].append(signature)
        else:
            groups["fields"].append(signature)
    out = usings[:10] + ([f"namespace {space}"] if space else []) + [head.rstrip(), "{"]
    any_member = False
    for label, found in groups.items():
        out += [f"    {s};" for s in found[:10]]
        any_member |= bool(found)
        if len(found) > 10:
            out.append(f"    // ... and {len(found) - 10} more {label}")
    return "\n".join(out + ([] if any_member else ["    // Members..."]) + ["}"])


def csharp(path: str, source: str) -> list[Piece]:
    """Typed pieces of a C# file; windows if it has no structure or its braces don't match."""
    try:
        out = list(_csharp(source))
    except (ValueError, RecursionError):
        return list(nested_tiers(source, 1, _FILE, "file"))
    if is_generated(path, source):
        out.append((source[:MAX_CHUNK], 1, source.count("\n") + 1, "generated", ""))
    return out or list(nested_tiers(source, 1, _FILE, "file"))


def _csharp(source: str) -> Iterator[Piece]:
    masked = blanked(source)
    usings = [m.group().strip() for m in re.finditer(r"^[ \t]*using\s+[^;(]+;", masked, re.M)]
    global_usings = [m for m in re.finditer(r"^[ \t]*global\s+using\s+[^;]+;", masked, re.M)]
    if global_usings:
        a, b = global_usings[0].start(), global_usings[-1].end()
        yield source[a:b], line_of(source, a), line_of(source, b), "global_usings", ""
    yield from _scope(source, masked, 0, len(source), usings, "", "", "")


def _scope(source: str, masked: str, start: int, end: int, usings: list[str], space: str, owner: str, owner_kind: str) -> Iterator[Piece]:
    loose: list[tuple[int, int]] = []
    for a, head, b in members(masked, start, end):
        text = masked[a:head]
        if re.match(r"\s*(global\s+)?using\s+[^(]*$", text) and masked[head : head + 1] == ";":
            continue
        named = re.match(r"\s*namespace\s+([\w.]+)", text)
        if named:
            if masked[head : head + 1] == "{":
                yield from _scope(source, masked, head + 1, b - 1, usings, named.group(1), owner, owner_kind)
            continue
        begin = _with_doc(source, a)
        first, last = line_of(source, a), line_of(source, b - 1)
        of_type = _TYPE.search(text)
        if of_type and "(" not in text[: of_type.start()]:
            kind, name = of_type.group(1).split()[0], of_type.group(2)
            block = masked[head : head + 1] == "{"
            if kind == "class":
                yield _summary(source, masked, source[begin:head], usings, space, (head + 1, b - 1) if block else (b, b), name), first, last, "class", name
            elif kind == "interface" and block:
                inner = [" ".join(source[x:z].split()) for x, _, z in members(masked, head + 1, b - 1)]
                yield "\n".join([source[begin:head].rstrip(), "{", *(f"    {s}" for s in inner[:20]), *([f"    // ... and {len(inner) - 20} more"] if len(inner) > 20 else []), "}"]), first, last, "interface", name
            elif kind == "record":
                yield (source[begin:b] if b - begin < MAX_CHUNK // 2 else source[begin:head].rstrip()), first, last, "record", name
            elif kind == "enum":
                yield source[begin:b], first, last, "enum", name
            if block and kind != "enum" and kind != "interface":
                yield from _scope(source, masked, head + 1, b - 1, usings, space, name, kind)
        elif owner:
            call = _CALL.search(text)
            prefix = f"// In {owner_kind} {owner}\n"
            if call and not re.search(r"(?<![=!<>])=(?![=>])", text):
                if call.group(1).lstrip("~") != owner and (masked[head : head + 1] == "{" or masked.startswith("=>", head)):
                    yield from tiers(source[a:b], first, call.group(1), prefix, _METHOD, ("method", "ultra"), (0.8, 0.75))
                    yield from _inside(source, masked, head, b, call.group(1))
            elif masked[head : head + 1] == "{" or masked.startswith("=>", head):
                yield prefix + source[begin:b], first, last, "property", ""
        else:
            loose.append((a, b))
    if not owner and loose:
        yield from _top_level(source, loose)


def _inside(source: str, masked: str, start: int, end: int, name: str) -> Iterator[Piece]:
    """Local functions and switch expressions of a method body."""
    for m in _LOCAL.finditer(masked, start + 1, end):
        b = closing(masked, m.end() - 1) + 1
        a = m.start() + len(m.group()) - len(m.group().lstrip())
        yield from tiers(source[a:b], line_of(source, a), m.group(1), f"// In method {name}\n", _LOCAL_KINDS, ("method", "ultra"), (0.8, 0.75))
    for m in _SWITCH.finditer(masked, start, end):
        b = closing(masked, m.end() - 1) + 1
        a = source.rfind("\n", 0, m.start()) + 1
        yield source[a:b].strip(), line_of(source, m.start()), line_of(source, b), "switch_expression", name


def _top_level(source: str, parts: list[tuple[int, int]]) -> Iterator[Piece]:
    """Groups of top-level statements; a gap of more than two lines parts them."""
    group: list[tuple[int, int]] = []
    for a, b in [*parts, (-1, -1)]:
        if group and (a < 0 or line_of(source, a) - line_of(source, group[-1][1] - 1) > 2):
            x, y = group[0][0], group[-1][1]
            yield from nested_tiers(source[x:y], line_of(source, x), _TOP, "top_level")
            group = []
        group.append((a, b))


# Razor ----------------------------------------------------------------------------------------


def razor(source: str) -> list[Piece]:
    """Code blocks and stretches of markup of a Razor page."""
    lines = source.split("\n")
    out: list[Piece] = []
    k, n = 0, len(lines)
    while k < n:
        line = lines[k].strip()
        if re.match(r"@(code|functions)\b", line):
            depth, end, seen = 0, k, False
            while end < n:
                m = blanked(lines[end])
                depth += m.count("{") - m.count("}")
                seen |= "{" in m
                if seen and depth <= 0:
                    break
                end += 1
            end = min(end, n - 1)
            out += _razor_code("\n".join(lines[k : end + 1]), k + 1)
            k = end + 1
        elif not line or line.startswith("@using"):
            k += 1
        else:
            end = k
            while end < n and lines[end].strip() and not re.match(r"\s*@(code|functions)\b", lines[end]) and end - k < 50:
                end += 1
            text = "\n".join(x for x in lines[k:end] if not x.strip().startswith("@using"))
            if len(text) > 100:
                out += _razor_markup(text, k + 1)
            k = end
    return out or [(source, 1, n, "razor-file", "")]


def _razor_code(text: str, first: int) -> Iterator[Piece]:
    lines = text.split("\n")
    whole = text
    if len(text) > MAX_CHUNK:
        cut = text[: MAX_CHUNK - 200]
        at = cut.rfind("\n")
        whole = (cut[:at] if at >= 0.8 * len(cut) else cut) + "\n// ... truncated"
    yield whole, first, first + len(lines) - 1, "razor-code", ""
    masked = blanked(text)
    for m in _LOCAL.finditer(masked):
        try:
            b = closing(masked, m.end() - 1) + 1
        except ValueError:
            break
        a = m.start() + len(m.group()) - len(m.group().lstrip())
        if b - a > fixed.TARGET_CHUNK:
            body, at = text[a:b].split("\n"), first + line_of(text, a) - 1
            yield text[a:b][:MAX_CHUNK], at, at + len(body) - 1, "razor-method", m.group(1)
            for x, y in line_windows(body, fixed.TARGET_CHUNK, 0.8, breaks="razor"):
                yield "\n".join(body[x:y]), at + x, at + y - 1, "razor-method-body", m.group(1)
    if len(text) > fixed.TARGET_CHUNK:
        for x, y in line_windows(lines, fixed.TARGET_CHUNK, 0.8, breaks="razor"):
            yield "\n".join(lines[x:y]), first + x, first + y - 1, "razor-code-body", ""


def _razor_markup(text: str, first: int) -> Iterator[Piece]:
    lines = text.split("\n")
    if len(text) <= fixed.TARGET_CHUNK:
        yield text, first, first + len(lines) - 1, "razor-html", ""
        return
    for x, y in line_windows(lines, fixed.TARGET_CHUNK, 0.8, breaks="html"):
        yield "\n".join(lines[x:y]), first + x, first + y - 1, "razor-html", ""


# C --------------------------------------------------------------------------------------------

_C_STRUCT = re.compile(r"^[ \t]*(?:typedef\s+)?(struct|enum|union)\b[^;{}()]*\{", re.M)
_C_FUNCTION = re.compile(r"^(?![ \t]*(?:#|//|else\b|if\b|for\b|while\b|switch\b|return\b|typedef\b|struct\b|enum\b))[ \t]*[A-Za-z_][\w \t*]*?\b(\w+)\s*\([^;{}]*\)\s*\{", re.M)


def c_source(path: str, source: str) -> list[Piece]:
    """Functions of a C file, or declarations of a header, with structs, enums, typedefs and macros.

    Windows of lines over the whole file follow where braces don't match (as in the branches of an
    #if), and stand alone where nothing is found.
    """
    masked = blanked(source)
    out: list[Piece] = []
    # Where braces stand that are closed nowhere.
    opened: list[int] = []
    stray = False
    for m in re.finditer(r"[{}]", masked):
        if m.group() == "{":
            opened.append(m.start())
        elif opened:
            opened.pop()
        else:
            stray = True
    unclosed = set(opened)
    for m in _C_STRUCT.finditer(masked):
        if m.end() - 1 in unclosed:
            continue
        b = closing(masked, m.end() - 1) + 1
        tail = re.compile(r"[^;\n]*;?").match(masked, b)
        out.append((source[m.start() : tail.end()], line_of(source, m.start()), line_of(source, tail.end()), "c-enum" if m.group(1) == "enum" else "c-struct", " ".join(masked[m.start() : m.end() - 1].split()[-1:])))
    for m in re.finditer(r"^[ \t]*typedef\s+[^;{}]+;", masked, re.M):
        out.append((source[m.start() : m.end()].strip(), line_of(source, m.start()), line_of(source, m.end()), "c-typedef", re.split(r"\W+", masked[m.start() : m.end() - 1].strip(" )"))[-1]))
    for m in re.finditer(r"^[ \t]*#[ \t]*define[ \t]+(\w+)(?:[^\n]*\\\n)*[^\n]*", source, re.M):
        out.append((m.group().strip(), line_of(source, m.start()), line_of(source, m.end()), "c-macro", m.group(1)))
    for m in _C_FUNCTION.finditer(masked):
        if m.end() - 1 in unclosed:
            continue
        b = closing(masked, m.end() - 1) + 1
        out += _c_function(source[m.start() : b].lstrip("\n"), line_of(source, m.start() + len(m.group()) - len(m.group().lstrip("\n"))), m.group(1))
    if path.lower().endswith(".h"):
        for k, line in enumerate(source.split("\n")):
            t = line.strip()
            if "(" in t and ")" in t and t.endswith(";") and not t.startswith(("//", "#", "typedef")):
                out.append((t, k + 1, k + 1, "c-function", (_CALL.search(t) or [None, ""])[1]))
    out.sort(key=lambda p: (p[1], -p[2]))
    return out + list(_c_file(source)) if unclosed or stray or not out else out


def _c_file(source: str) -> Iterator[Piece]:
    """The whole file, as windows if it is long."""
    lines = source.split("\n")
    if len(source) <= MAX_CHUNK:
        yield source, 1, len(lines), "c-file", ""
        return
    for a, b in c_windows(lines, fixed.TARGET_CHUNK, 0.8):
        yield "\n".join(lines[a:b]), a + 1, b, "c-file", ""


def _c_function(body: str, first: int, name: str) -> Iterator[Piece]:
    lines = body.split("\n")
    whole = body
    if len(body) > MAX_CHUNK:
        kept, size = [], 0
        for line in lines[:50]:
            if size + len(line) + 1 > 0.9 * MAX_CHUNK:
                break
            kept.append(line)
            size += len(line) + 1
        whole = "\n".join(kept) + "\n// ... truncated"
    yield whole, first, first + len(lines) - 1, "c-function", name
    for limit, kind, budget, share, breaks in (
        (fixed.TARGET_CHUNK, "c-function-body", fixed.TARGET_CHUNK, 0.8, "c"),
        (2 * fixed.ULTRA_CHUNK, "c-function-ultra", fixed.ULTRA_CHUNK - 100, 0.7, "c_ultra"),
    ):
        if len(body) > limit:
            for a, b in c_windows(lines, budget, share, breaks=breaks):
                yield "\n".join(lines[a:b]), first + a, first + b - 1, kind, name


def pieces(path: str, source: str) -> list[Piece]:
    """Pieces of a file by its extension; an empty file has none."""
    if not source.strip():
        return []
    ext = path.rpartition(".")[2].lower()
    if ext in ("c", "h"):
        return c_source(path, source)
    if ext in ("razor", "cshtml"):
        return razor(source)
    return csharp(path, source)
