"""Syntax-aware chunks, definitions and call sites without a grammar library.

A file is read by one of three small block parsers: by braces, by indentation, or by
closing keywords. Strings and comments are blanked first, in a copy of equal length, so
that the parsers see structure only. The result is an outline: nested spans with the
declaration that each one starts, and comments as spans of their own.

Chunks are made from the outline: a span that fits is a window, a larger one is opened,
and neighbours are joined again while they fit. Everything works on one file at a time,
and files are bounded by the size limit of the index, so a batch needs memory for its
largest file only.

Defined results: null and empty texts have no chunks; unbalanced code is cut where the
text ends; languages without a parser, and files without any span, fall back to lines
where ``LINE_LANGUAGES`` has them and give no chunks otherwise; offsets are code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunking import MAX_VISIBLE, chunk_table

#: Visible characters below which a window is tiny, and of the overlap; characters of a chunk with all white space.
LEAST_VISIBLE, OVERLAP, MOST_RAW = 50, 40, 4 * MAX_VISIBLE
#: Share of the budgets for windows of different declarations, and how far a tiny window may exceed it.
APART, TINY_EXCESS = 0.7, 1.5
MOST_NAME = 200
#: Languages whose files are cut by lines when they have no outline.
LINE_LANGUAGES = ("python", "go", "rust", "java", "markdown", "json", "ruby", "php", "kotlin", "swift", "lua", "shell")

_NAME = r"([A-Za-z_$][\w$]*)"


@dataclass(frozen=True)
class Language:
    """How a language is read: its blocks, comments, strings, and (pattern of a header, label, kind) per declaration."""

    blocks: str  # braces, indent or end
    comments: tuple[str, ...]  # patterns
    strings: tuple[str, ...]
    declarations: tuple[tuple[str, str, str], ...]
    newline_ends: bool = False
    methods: bool = False  # a bare ``name(...) {`` inside a type is a method
    members: str = "name"  # what a call of ``a.b()`` is called: its name, or the whole chain


_SLASHES = (r"//[^\n]*", r"/\*.*?(?:\*/|\Z)")
_HASH = (r"#[^\n]*",)
_DOUBLE, _SINGLE = r'"(?:\\.|[^"\\\n])*"?', r"'(?:\\.|[^'\\\n])*'?"
_TICK = r"`(?:\\.|[^`\\])*`?"
_TRIPLE = (r'"""(?:\\.|.)*?(?:"""|\Z)', r"'''(?:\\.|.)*?(?:'''|\Z)")
_RUST_CHAR = r"'(?:\\[^\n]{1,8}?|[^'\\\n])'"

#: Labels that breadcrumbs give to declarations, by language.
LANGUAGES: dict[str, Language] = {
    "typescript": Language(
        "braces", _SLASHES, (_TICK, _DOUBLE, _SINGLE),
        ((rf"\babstract\s+class\s+{_NAME}", "abstract class ", "class"), (rf"\bclass\s+{_NAME}", "class ", "class"), (rf"\binterface\s+{_NAME}", "interface ", "interface"), (rf"\bfunction\s*\*\s*{_NAME}", "fn* ", "function"), (rf"\bfunction\s+{_NAME}", "fn ", "function"), (rf"\b(?:const|let|var)\s+{_NAME}\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)[^=]*=>", "", "function")),
        newline_ends=True, methods=True,
    ),
    "javascript": Language(
        "braces", _SLASHES, (_TICK, _DOUBLE, _SINGLE),
        ((rf"\bclass\s+{_NAME}", "class ", "class"), (rf"\bfunction\s*\*\s*{_NAME}", "fn* ", "function"), (rf"\bfunction\s+{_NAME}", "fn ", "function"), (rf"\b(?:const|let|var)\s+{_NAME}\s*=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*=>", "", "function")),
        newline_ends=True, methods=True,
    ),
    "python": Language("indent", _HASH, (*_TRIPLE, _DOUBLE, _SINGLE), ((rf"^(?:async\s+)?def\s+{_NAME}", "def ", "function"), (rf"^class\s+{_NAME}", "class ", "class")), members="chain"),
    "go": Language(
        "braces", _SLASHES, (_TICK, _DOUBLE, _SINGLE),
        ((rf"^func\s+(?:\([^)]*\)\s*)?{_NAME}", "func ", "function"), (rf"^type\s+{_NAME}\s+struct\b", "type ", "class"), (rf"^type\s+{_NAME}\s+interface\b", "type ", "interface"), (rf"^type\s+{_NAME}", "type ", "type")),
        newline_ends=True, members="chain",
    ),
    "rust": Language(
        "braces", _SLASHES, (r'r(#*)".*?"\1', _DOUBLE, _RUST_CHAR),
        ((rf"\bfn\s+{_NAME}", "fn ", "function"), (rf"\bstruct\s+{_NAME}", "struct ", "class"), (rf"\benum\s+{_NAME}", "enum ", "enum"), (rf"\btrait\s+{_NAME}", "trait ", "interface"), (rf"^(?:unsafe\s+)?impl\b(?:\s*<[^>]*>)?\s*(?:[\w:<>, ]+\s+for\s+)?{_NAME}", "impl ", "impl"), (rf"\bmod\s+{_NAME}", "mod ", "module"), (rf"\btype\s+{_NAME}", "type ", "type")),
        members="chain",
    ),
    "java": Language(
        "braces", _SLASHES, (*_TRIPLE[:1], _DOUBLE, _SINGLE),
        ((rf"@interface\s+{_NAME}", "@interface ", "interface"), (rf"\bclass\s+{_NAME}", "class ", "class"), (rf"\binterface\s+{_NAME}", "interface ", "interface"), (rf"\benum\s+{_NAME}", "enum ", "enum"), (rf"\brecord\s+{_NAME}", "record ", "class")),
        methods=True,
    ),
    "c": Language(
        "braces", (*_SLASHES, r"(?m:^[ \t]*#(?:[^\n\\]|\\.)*)"), (_DOUBLE, _SINGLE),
        ((rf"^(?:static\s+)?struct\s+{_NAME}\s*$", "struct ", "class"), (rf"^(?:static\s+)?union\s+{_NAME}\s*$", "union ", "class"), (rf"^(?:static\s+)?enum\s+{_NAME}\s*$", "enum ", "enum"), (rf"^typedef\b.*?{_NAME}\s*;?\s*$", "typedef ", "type"), (rf"^[\w\s*]*?\b{_NAME}\s*\([^;]*\)\s*$", "", "function")),
        members="chain",
    ),
    "cpp": Language(
        "braces", (*_SLASHES, r"(?m:^[ \t]*#(?:[^\n\\]|\\.)*)"), (r'R"(\w*)\(.*?\)\2"', _DOUBLE, _SINGLE),
        ((rf"^(?:inline\s+)?namespace\s+{_NAME}", "namespace ", "module"), (rf"\benum\s+(?:class\s+)?{_NAME}", "enum ", "enum"), (rf"\bclass\s+{_NAME}", "class ", "class"), (rf"\bstruct\s+{_NAME}", "struct ", "class"), (rf"\bunion\s+{_NAME}", "union ", "class"), (rf"^typedef\b.*?{_NAME}\s*;?\s*$", "typedef ", "type"), (r"^[\w\s*&:<>,~]*?\b((?:[A-Za-z_]\w*::)*~?[A-Za-z_]\w*)\s*\([^;]*\)[^;=]*$", "", "function")),
        members="chain",
    ),
    "c_sharp": Language(
        "braces", _SLASHES, (r'@"(?:""|[^"])*"?', _DOUBLE, _SINGLE),
        ((rf"\bnamespace\s+([\w.]+)", "namespace ", "module"), (rf"\brecord\s+(?:struct\s+|class\s+)?{_NAME}", "record ", "class"), (rf"\bclass\s+{_NAME}", "class ", "class"), (rf"\binterface\s+{_NAME}", "interface ", "interface"), (rf"\bstruct\s+{_NAME}", "struct ", "class"), (rf"\benum\s+{_NAME}", "enum ", "enum")),
        methods=True, members="chain",
    ),
    "ruby": Language("end", _HASH, (_DOUBLE, _SINGLE), ((r"^module\s+([\w:]+)", "module ", "module"), (r"^class\s+<<\s*(\w+)", "class ", "class"), (r"^class\s+([\w:]+)", "class ", "class"), (r"^def\s+(?:self\.)?([\w]+[?!=]?)", "def ", "function"))),
    "php": Language(
        "braces", (*_SLASHES, r"#(?!\[)[^\n]*"), (_DOUBLE, _SINGLE),
        ((r"\bnamespace\s+([\w\\]+)", "namespace ", "module"), (rf"\bclass\s+{_NAME}", "class ", "class"), (rf"\binterface\s+{_NAME}", "interface ", "interface"), (rf"\btrait\s+{_NAME}", "trait ", "class"), (rf"\benum\s+{_NAME}", "enum ", "enum"), (rf"\bfunction\s+&?{_NAME}", "function ", "function")),
    ),
    "kotlin": Language("braces", _SLASHES, (*_TRIPLE[:1], _DOUBLE, _SINGLE), ((rf"\b(?:class|interface)\s+{_NAME}", "class ", "class"), (rf"\bobject\s+{_NAME}", "object ", "class"), (rf"\bfun\s+(?:<[^>]*>\s*)?(?:[\w.]+\.)?{_NAME}", "fun ", "function")), newline_ends=True),
    "swift": Language("braces", _SLASHES, (*_TRIPLE[:1], _DOUBLE), ((rf"\bprotocol\s+{_NAME}", "protocol ", "interface"), (rf"\b(?:class|struct|enum|actor|extension)\s+{_NAME}", "type ", "class"), (rf"\bfunc\s+{_NAME}", "func ", "function"), (r"\b(init)\s*[?!]?\s*\(", "init ", "function")), newline_ends=True),
    "lua": Language("end", (r"--\[\[.*?(?:\]\]|\Z)", r"--[^\n]*"), (r"\[\[.*?(?:\]\]|\Z)", _DOUBLE, _SINGLE), ((r"^(?:local\s+)?function\s+([\w.:]+)", "function ", "function"), (r"^(?:local\s+)?([\w.]+)\s*=\s*function\b", "function ", "function"))),
    "shell": Language("braces", (r"(?<![\w$\\{])#[^\n]*",), (r'"(?:\\.|[^"\\])*"?', r"'[^']*'?"), ((r"^function\s+([\w-]+)", "function ", "function"), (r"^([\w-]+)\s*\(\s*\)", "function ", "function")), newline_ends=True),
}
#: Words before a parenthesis or block that are no names.
_WORDS = frozenset("if else for while switch do try catch finally return match loop unsafe when guard defer synchronized using lock foreach fixed with elif elseif unless until case yield await new throw typeof sizeof not and or in is assert del print lambda function fn func fun def class super".split())
_METHOD = re.compile(r"^(?:@[\w.]+(?:\([^)]*\))?\s*)*(?:(?:[\w$]+(?:<[^()]*>)?(?:\[\])*[?]?)\s+)*[*#]?" + _NAME + r"\s*(?:<[^()]*>)?\s*\([^;]*\)[^;=]*$", re.S)
#: Words that open a block that ``end`` (or ``until``) closes, at the start of a statement, and in the middle of one.
_OPENERS = {
    "ruby": re.compile(r"(?:^|;|=)[ \t]*(?:module|class|def|if|unless|while|until|case|for|begin)\b|\bdo\b", re.M),
    "lua": re.compile(r"\b(?:function|if|for|while|repeat)\b|(?<!\w)do\b"),
}
_CLOSERS = {"ruby": re.compile(r"\bend\b"), "lua": re.compile(r"\b(?:end|until)\b")}


@dataclass
class Span:
    """A stretch of code: the declaration it starts (if any), and the spans inside it."""

    start: int
    end: int
    label: str | None = None
    name: str = ""
    kind: str = ""
    comment: bool = False
    inner: list[Span] = field(default_factory=list)


# --- reading ---------------------------------------------------------------------------


@cache
def _masker(language: str) -> re.Pattern:
    spec = LANGUAGES[language]
    return re.compile("|".join([*(f"(?P<c{i}>{p})" for i, p in enumerate(spec.comments)), *(f"(?:{p})" for p in _renumbered(spec))]), re.S)


def _renumbered(spec: Language) -> list[str]:
    """String patterns with their own back-references, which count the groups before them."""
    out, groups = [], len(spec.comments)
    for p in spec.strings:
        out.append(re.sub(r"\\[12]", lambda m, n=groups + 1: f"\\{n}", p))
        groups += re.compile(re.sub(r"\\[12]", "", p)).groups
    return out


def masked(text: str, language: str) -> tuple[str, list[tuple[int, int]]]:
    """The text with strings and comments blanked (line ends stay), and the spans of its comments."""
    comments: list[tuple[int, int]] = []

    def blank(m: re.Match) -> str:
        if m.lastgroup:
            comments.append(m.span())
            return re.sub(r"[^\n]", " ", m[0])
        return re.sub(r"[^\n]", "_", m[0])

    return _masker(language).sub(blank, text), comments


def outline(text: str, language: str) -> list[Span]:
    """Top-level spans of a text, in order, without overlap; comments between them are spans too."""
    code, comments = masked(text, language)
    spec = LANGUAGES[language]
    if spec.blocks == "indent":
        found = _by_indent(code, 0, len(code), spec)
    elif spec.blocks == "end":
        found = _by_end(code, language, 0, len(code))
    else:
        found = _by_braces(code, 0, len(code), spec, False)
    return _with_comments(found, comments, 0, len(text))


def _with_comments(spans: list[Span], comments: list[tuple[int, int]], start: int, end: int) -> list[Span]:
    """Adds the comments that stand between spans, at every depth."""
    out: list[Span] = []
    own = [c for c in comments if start <= c[0] and c[1] <= end]
    at = 0
    for span in spans:
        while at < len(own) and own[at][1] <= span.start:
            out.append(Span(*own[at], comment=True))
            at += 1
        inside = at
        while at < len(own) and own[at][0] < span.end:
            at += 1
        if span.inner and at > inside:
            span.inner = _with_comments(span.inner, own[inside:at], span.start, span.end)
        out.append(span)
    return out + [Span(*c, comment=True) for c in own[at:]]


def _declared(header: str, spec: Language, in_type: bool) -> tuple[str | None, str, str]:
    """Label, name and kind of the declaration that a header makes; the label is None without one."""
    head = " ".join(header.split())
    for pattern, label, kind in spec.declarations:
        if (m := re.search(pattern, head)) and (label or m[m.lastindex] not in _WORDS):
            return label, m[m.lastindex], kind
    if spec.methods and in_type and (m := _METHOD.match(head)) and m[1] not in _WORDS:
        return "", m[1], "method"
    return None, "", ""


_BRACKETS = re.compile(r"[{}()\[\];\n]")


def _by_braces(code: str, start: int, end: int, spec: Language, in_type: bool) -> list[Span]:
    """Statements between ``start`` and ``end``, each with the statements of its blocks."""
    out: list[Span] = []
    at = start
    while (at := _skip_space(code, at, end)) < end:
        depth, block, blocks, stop = 0, -1, [], end
        for m in _BRACKETS.finditer(code, at, end):
            c, i = m[0], m.start()
            if c in "([":
                depth += 1
            elif c in ")]":
                depth = max(0, depth - 1)
            elif c == "{":
                if depth == 0 and block < 0:
                    block, nested = i, 1
                elif block >= 0 and depth == 0:
                    nested += 1
                else:
                    depth += 1
            elif c == "}":
                if block < 0:
                    depth = max(0, depth - 1)
                    continue
                if depth:
                    depth -= 1
                    continue
                nested -= 1
                if nested == 0:
                    blocks.append((block, i))
                    block = -1
                    if not _goes_on(code, i + 1, end) and not code.startswith("typedef", at):
                        stop = i + 1
                        break
            elif block < 0 and depth == 0 and (c == ";" or (c == "\n" and spec.newline_ends and not _goes_on(code, i, end) and not code[at:i].rstrip().endswith((",", "=", "(", "=>", "&&", "||", "+", "\\", "|")))):
                stop = i + (c == ";")
                break
        stop = max(_trimmed(code, at, stop), at + 1)
        out.append(_block_span(code, at, stop, blocks, spec, in_type))
        at = stop
    return out


def _block_span(code: str, start: int, end: int, blocks: list[tuple[int, int]], spec: Language, in_type: bool) -> Span:
    first = blocks[0][0] if blocks else end
    header = code[start:first]
    if header.startswith("typedef"):  # its name follows the block
        header = " ".join(code[a:b] for a, b in zip([start, *(b[1] + 1 for b in blocks)], [*(b[0] for b in blocks), end], strict=True))
    label, name, kind = _declared(header, spec, in_type) if blocks or not in_type else (None, "", "")
    span = Span(start, end, label, name, kind)
    at = start
    for low, high in blocks:
        span.inner.append(Span(at, low + 1))
        span.inner += _by_braces(code, low + 1, high, spec, kind in ("class", "interface", "enum", "impl"))
        at = high
    if blocks:
        span.inner.append(Span(at, end))
    return span


_CONTINUES = re.compile(r"\s*(?:else\b|catch\b|finally\b|while\b(?=[^{\n]*;)|[.,;)\]}?:=+*/&|]|->)|[ \t]*\n[ \t]*\{")
_SAME_LINE = re.compile(r"[ \t]*(?:[\w(\[]|\n[ \t]*(?:else|catch|finally)\b)")


def _goes_on(code: str, at: int, end: int) -> bool:
    """Whether a statement continues after ``at``."""
    m = _CONTINUES.match(code, at, end)
    return bool(m) and code[m.end() - 1] not in "}])" and not m[0].lstrip().startswith(("*", "/"))


def _skip_space(code: str, at: int, end: int) -> int:
    while at < end and code[at] in " \t\r\n;":
        at += 1
    return at


def _trimmed(code: str, start: int, end: int) -> int:
    while end > start and code[end - 1] in " \t\r\n":
        end -= 1
    return end


def _by_indent(code: str, start: int, end: int, spec: Language) -> list[Span]:
    """Logical lines between ``start`` and ``end``; a line that opens a deeper block holds it."""
    lines = _logical_lines(code, start, end)
    return _nested_lines(code, lines, 0, len(lines), spec)


def _logical_lines(code: str, start: int, end: int) -> list[tuple[int, int, int]]:
    """(start, end, indent) of lines, joined while brackets are open or a backslash ends them."""
    out, at = [], start
    while at < end:
        depth, stop = 0, at
        while True:
            newline = code.find("\n", stop, end)
            line_end = newline if newline >= 0 else end
            part = code[stop:line_end]
            depth = max(0, depth + sum(part.count(c) for c in "([{") - sum(part.count(c) for c in ")]}"))
            if newline < 0 or (not depth and not part.rstrip().endswith("\\")):
                break
            stop = newline + 1
        begin = _skip_space(code, at, line_end)
        if begin < line_end:
            indent = len(code[code.rfind("\n", 0, begin) + 1 : begin].expandtabs(8))
            out.append((begin, _trimmed(code, begin, line_end), indent))
        at = line_end + 1
    return out


def _nested_lines(code: str, lines: list[tuple[int, int, int]], low: int, high: int, spec: Language) -> list[Span]:
    out: list[Span] = []
    at, decorated = low, -1
    while at < high:
        begin, stop, indent = lines[at]
        if code[begin] == "@":
            decorated = begin if decorated < 0 else decorated
            at += 1
            continue
        inside = at + 1
        while inside < high and lines[inside][2] > indent:
            inside += 1
        label, name, kind = _declared(code[begin:stop], spec, False)
        span = Span(decorated if decorated >= 0 else begin, lines[inside - 1][1], label, name, kind)
        if inside > at + 1:
            span.inner = [Span(span.start, stop), *_nested_lines(code, lines, at + 1, inside, spec)]
        out.append(span)
        at, decorated = inside, -1
    if decorated >= 0:
        out.append(Span(decorated, lines[high - 1][1]))
    return out


def _by_end(code: str, language: str, start: int, end: int) -> list[Span]:
    """Lines between ``start`` and ``end``; one that opens more blocks than it closes holds the lines up to its end."""
    spec, opens, closes = LANGUAGES[language], _OPENERS[language], _CLOSERS[language]

    def change(low: int, high: int) -> int:
        line = code[low:high].strip()
        loops = len(re.findall(r"\b(?:while|for|until)\b.*\bdo\b", line))  # ``while x do`` opens one block
        return len(opens.findall(line)) - loops - len(closes.findall(line))

    out: list[Span] = []
    at = start
    while (at := _skip_space(code, at, end)) < end:
        newline = code.find("\n", at, end)
        line_end = newline if newline >= 0 else end
        depth, head_end, body = change(at, line_end), line_end, line_end
        last = at
        while depth > 0 and line_end < end:
            last = line_end + 1
            newline = code.find("\n", last, end)
            line_end = newline if newline >= 0 else end
            depth += change(last, line_end)
        stop = _trimmed(code, at, line_end)
        label, name, kind = _declared(code[at:head_end].lstrip(), spec, False)
        span = Span(at, stop, label, name, kind)
        if last > at:
            span.inner = [Span(at, _trimmed(code, at, head_end)), *_by_end(code, language, body, last), Span(_skip_space(code, last, stop), stop)]
        out.append(span)
        at = max(stop, at + 1)
    return out


# --- chunks ------------------------------------------------------------------------------


@dataclass
class Window:
    """Neighbouring spans that may become a chunk; ``about`` is the chain of declarations they stand in."""

    spans: list[Span]
    about: tuple[str, ...]
    visible: int

    @property
    def start(self) -> int:
        return self.spans[0].start

    @property
    def end(self) -> int:
        return self.spans[-1].end


class Chunker:
    """Windows and chunks of one text."""

    def __init__(self, text: str, most: int = MAX_VISIBLE, least: int = LEAST_VISIBLE, overlap: int = OVERLAP, most_raw: int | None = None):
        self.text, self.most, self.least, self.overlap = text, most, least, overlap
        self.most_raw = 4 * most if most_raw is None else most_raw
        dark = ~np.isin(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4"), [32, 9, 10, 13])
        self.sums = np.concatenate([[0], np.cumsum(dark)])

    def visible(self, start: int, end: int) -> int:
        return int(self.sums[end] - self.sums[start]) if end > start else 0

    def windows(self, span: Span, about: tuple[str, ...]) -> list[Window]:
        """The span as one window if it fits or cannot be opened, else the joined windows of what is in it."""
        if span.label is not None:
            about = (*about, span.label + span.name)
        size = self.visible(span.start, span.end)
        if size <= self.most or not span.inner:
            return [Window([span], about, size)]
        return self.joined([w for inner in span.inner for w in self.windows(inner, about)])

    def joined(self, windows: list[Window]) -> list[Window]:
        """Neighbours are joined while both budgets allow; comments at the end of one move to the next."""
        out: list[Window] = []
        for following in windows:
            if not out:
                out.append(following)
                continue
            self._hand_over(out[-1], following)
            if not out[-1].spans:
                out[-1] = following
            elif (together := self._fit(out[-1], following)) is not None:
                out[-1] = together
            else:
                out.append(following)
        return out

    def _hand_over(self, before: Window, after: Window) -> None:
        keep = len(before.spans)
        while keep and before.spans[keep - 1].comment:
            keep -= 1
        moved = before.spans[keep:]
        if moved:
            size = sum(self.visible(s.start, s.end) for s in moved)
            before.visible -= size
            after.visible += size + self.visible(moved[-1].end, after.start)
            before.spans, after.spans = before.spans[:keep], [*moved, *after.spans]

    def _fit(self, a: Window, b: Window) -> Window | None:
        short = min(len(a.about), len(b.about))
        share = 1.0 if a.about[:short] == b.about[:short] else APART
        size = a.visible + self.visible(a.end, b.start) + b.visible
        budget = self.most * share
        fits = size <= budget or (a.visible < self.least and size < budget * TINY_EXCESS)
        if not fits or b.end - a.start > self.most_raw * share:
            return None
        return Window([*a.spans, *b.spans], max(a.about, b.about, key=len) if len(b.about) > len(a.about) else a.about, size)

    def overlap_start(self, start: int) -> int:
        """Latest place with ``overlap`` visible characters up to ``start``; ``start`` itself where it is too far or there are too few."""
        target = self.sums[start] - self.overlap
        if target < 0 or not self.overlap:
            return start
        place = int(np.searchsorted(self.sums, target, side="right")) - 1
        return place if start - place <= self.most_raw // 4 else start

    def chunks(self, path: str, spans: list[Span]) -> list[dict]:
        made = self.joined([w for span in spans for w in self.windows(span, (path,))])
        out = []
        before = 0
        for i, w in enumerate(made):
            raw_end = len(self.text) if i == len(made) - 1 else w.end
            out.append({"chunk_index": i, "start": w.start, "end": w.end, "raw_start": before, "raw_end": raw_end, "vector_start": self.overlap_start(w.start) if i else w.start, "nws": w.visible, "breadcrumb": " > ".join(w.about)})
            before = w.end
        return out


_CHUNKS = "path string, hash string, chunk_index int, start int, end int, raw_start int, raw_end int, vector_start int, nws int, breadcrumb string"


def syntax_chunks(files: DataFrame, most: int = MAX_VISIBLE) -> DataFrame:
    """Chunks of the files (path, hash, language, content) that have a parser and an outline."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, hash_, language, content in frame.itertuples(index=False):
                if content:
                    rows += [{"path": path, "hash": hash_, **c} for c in Chunker(content, most).chunks(path, outline(content, language))]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in _CHUNKS.split(", ")])

    return files.where(F.col("language").isin(*LANGUAGES)).select("path", "hash", "language", "content").mapInPandas(cut, _CHUNKS)


def chunks_of(files: DataFrame, most: int = MAX_VISIBLE) -> DataFrame:
    """One row per chunk: by syntax where there is a parser, by lines for the other languages that allow it.

    ``chunk_id`` is ``path#hash#index``; columns as those of ``chunk_table`` and ``vector_start``.
    """
    by_syntax = syntax_chunks(files, most)
    #: A text that a parser finds nothing in has no visible character, or only blanked ones.
    lines = chunk_table(files.where(F.col("language").isin(*[x for x in LINE_LANGUAGES if x not in LANGUAGES])), most)
    lines = lines.withColumn("vector_start", F.col("start"))
    columns = [f.split()[0] for f in _CHUNKS.split(", ")]
    every = by_syntax.unionByName(lines.select(*columns))
    return every.withColumn("chunk_id", F.concat_ws("#", "path", "hash", "chunk_index"))


# --- definitions and calls -----------------------------------------------------------------


def _declarations(spans: list[Span]) -> Iterator[Span]:
    for span in spans:
        if span.label is not None and span.name and len(span.name) <= MOST_NAME and span.kind != "impl":
            yield span
        yield from _declarations(span.inner)


def definitions_in(text: str, language: str) -> list[tuple[str, str, int, int]]:
    """(name, kind, first line, last line) of the declarations of a text, in order."""
    return [(s.name, s.kind, text.count("\n", 0, s.start) + 1, text.count("\n", 0, max(s.start, s.end - 1)) + 1) for s in _declarations(outline(text, language))]


_CALLEE = {
    "name": re.compile(r"(?<![\w$])([A-Za-z_$][\w$]*)\s*(?:<[\w\s,<>]*>)?\("),
    "chain": re.compile(r"(?<![\w$.])([A-Za-z_$][\w$]*(?:(?:\.|::|->)[A-Za-z_$][\w$]*)*)\s*\("),
}


def calls_in(text: str, language: str) -> list[tuple[str, int]]:
    """(callee, line) of the calls of a text; headers of declarations and keywords are none."""
    code, _ = masked(text, language)
    spec = LANGUAGES[language]
    headers = set()
    for s in _declarations(outline(text, language)):
        head = s.inner[0] if s.inner else s
        if m := re.compile(rf"(?<![\w$]){re.escape(re.split('[.:]', s.name)[-1])}\s*\(").search(code, head.start, head.end):
            headers.add(m.end())
    found = [m for m in _CALLEE[spec.members].finditer(code) if m[1] not in _WORDS and m.end() not in headers]
    return [(m[1], text.count("\n", 0, m.start(1)) + 1) for m in found]


def _explode(files: DataFrame, columns: str, each) -> DataFrame:
    """Rows of ``each`` (text, language) for the files that have a parser."""
    names = [f.split()[0] for f in columns.split(", ")]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(path, hash_, language, *row) for path, hash_, language, content in frame.itertuples(index=False) if content for row in each(content, language)]
            yield pd.DataFrame(rows, columns=names)

    return files.where(F.col("language").isin(*LANGUAGES)).select("path", "hash", "language", "content").mapInPandas(work, columns)


def symbols_of(files: DataFrame) -> DataFrame:
    """Definitions of files: path, hash, language, name, kind, start_line, end_line (G1)."""
    return _explode(files, "path string, hash string, language string, name string, kind string, start_line int, end_line int", definitions_in)


def calls_of(files: DataFrame) -> DataFrame:
    """Call sites of files: path, hash, language, callee, line."""
    return _explode(files, "path string, hash string, language string, callee string, line int", calls_in)


def breadcrumb_tail(breadcrumb: Column) -> Column:
    """The last part of a breadcrumb."""
    return F.trim(F.element_at(F.split(breadcrumb, ">"), -1))
