"""Scalar text functions as Column expressions (SC1-SC18) and driver-side pattern builders."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word boundary over [A-Za-z0-9_] only; Java's own one follows Unicode.
ASCII_BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
_REGEX_CHARS = set("\\^$.|?*+()[]{}")


def quote(text: str) -> str:
    """A regex that matches ``text`` literally, in Java and RE2 alike (SC5)."""
    return "".join("\\" + c if c in _REGEX_CHARS else c for c in text)


def glob_to_regex(glob: str) -> str:
    """Anchored regex of a path glob: ``**/`` any folders, ``**`` anything, ``*`` within a folder, ``?`` one character."""
    rules = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    pieces = re.split(r"(\*\*/|\*\*|\*|\?)", glob.replace("\\", "/"))
    return "^" + "".join(rules.get(p) or quote(p) for p in pieces) + "$"


def path_filter_to_like(path_filter: str) -> str:
    """LIKE pattern of a symbol path filter: ``*`` crosses folders, otherwise a prefix (F8)."""
    return path_filter.replace("*", "%") if "*" in path_filter else f"{path_filter}%"


def normalised(text: Column) -> Column:
    """White space collapsed, trimmed, lower case (SC2)."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def snake_case(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(text, "([a-z])([A-Z])", "$1_$2"), "([A-Z]+)([A-Z][a-z])", "$1_$2"))


def camel_case(text: Column) -> Column:
    parts = F.split(F.lower(text), "_(?=[a-z])")
    tail = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30)))
    return F.concat(F.element_at(parts, 1), F.array_join(tail, ""))


def clamp_slice(text: Column, start: Column, end: Column) -> Column:
    """Text of a span whose ends are clamped to the text; null text is empty (SC11)."""
    text = F.coalesce(text, F.lit(""))
    first = F.greatest(F.lit(0), F.least(start, F.length(text)))
    last = F.greatest(first, F.least(end, F.length(text)))
    return F.substring(text, first + 1, last - first)


def visible_length(text: Column) -> Column:
    """Characters other than space, tab, CR and LF (SC15)."""
    return F.length(F.translate(text, " \t\r\n", ""))


def line_of(text: Column, offset: Column) -> Column:
    """One-based line number of a character offset (SC10, W10)."""
    return F.regexp_count(F.substring(text, F.lit(1), offset), F.lit("\n")) + 1


def truncate_middle(text: Column, most: int) -> Column:
    half = (most - 3) // 2
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, half), F.lit("..."), F.right(text, F.lit(half))))


def truncate_head_tail(text: Column, most: int, ratio: float = 0.67) -> Column:
    head = int(most * ratio)
    tail = most - head - 3
    cut = F.substring(text, 1, most) if tail <= 0 else F.concat(F.substring(text, 1, head), F.lit("..."), F.right(text, F.lit(tail)))
    return F.when(F.length(text) <= most, text).otherwise(cut)


def parent_breadcrumb(breadcrumb: Column, separator: str = " > ") -> Column:
    """The breadcrumb without its last part; a single part is its own parent (SC12)."""
    parts = F.split(breadcrumb, quote(separator))
    return F.when(F.size(parts) <= 1, breadcrumb).otherwise(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), separator))


def common_segments(a: Column, b: Column) -> Column:
    """Number of leading path segments that two paths share (SC13)."""
    same = F.zip_with(F.split(a, "/"), F.split(b, "/"), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first_false = F.array_position(same, False)
    return F.when(first_false == 0, F.size(same)).otherwise(first_false - 1).cast("int")


def resolve_path(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments resolved (SC16)."""
    nothing = F.array().cast("array<string>")

    def step(acc: Column, part: Column) -> Column:
        up = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when((part == ".") | (part == ""), acc).when(part == "..", up).otherwise(F.concat(acc, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), nothing, step), "/")


def human_size(size: Column) -> Column:
    """B, KB or MB with one decimal (SC6)."""
    return F.when(size < 1024, F.format_string("%d B", size)).when(size < 1048576, F.format_string("%.1f KB", size / 1024)).otherwise(F.format_string("%.1f MB", size / 1048576))


def utf16_offset(text: Column, offset: Column) -> Column:
    """Code-point offset as UTF-16 units: characters beyond the basic plane count twice (SC14)."""
    return offset + F.regexp_count(F.substring(text, F.lit(1), offset), F.lit(r"[\x{10000}-\x{10FFFF}]"))


def overlap_score(text: Column, tokens: list[str]) -> Column:
    """1 for each token that occurs as a whole word of the lower-cased text, 0.5 for one inside a word (QK8)."""
    low = F.lower(text)
    parts = [F.when(~low.contains(t), 0.0).when(low.rlike(ASCII_BOUNDARY + quote(t) + ASCII_BOUNDARY), 1.0).otherwise(0.5) for t in tokens]
    return sum(parts, F.lit(0.0))
