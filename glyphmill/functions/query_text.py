"""Query-side text work (QK1, QK2, QK14, QK17, SC20): once per query, on the driver."""

from __future__ import annotations

import hashlib
import json
import re
from collections import OrderedDict

#: Characters that the search syntax reserves, and its keywords.
_RESERVED = re.compile(r"[():\"*^./\\@#$%&=+\[\]{}<>|~`!?,;]")
_KEYWORDS = re.compile(r"\b(?:AND|OR|NOT|NEAR)\b", re.I)
#: Connectives that part clauses. Boundaries are ASCII ones: the last four part next to Latin letters only.
_CONNECTIVES = "and or with plus then after before 与 和 以及 然后".split()
_CLAUSE = re.compile(rf"(?a:\b)(?:{'|'.join(_CONNECTIVES)})(?a:\b)|[,;，；]", re.I)
_CJK = re.compile(r"[㐀-鿿]+")


def _distinct(values: list[str]) -> list[str]:
    return list(dict.fromkeys(v for v in values if v))


def variants_of(token: str) -> list[str]:
    """Spellings of a token: lower case, without separators, snake case of camel case, camel case of snake case."""
    low = token.lower()
    out = [low, re.sub(r"[._-]", "", token).lower()]
    if re.search("[a-z][A-Z]", token):
        out.append(re.sub("([A-Z]+)([A-Z][a-z])", r"\1_\2", re.sub("([a-z])([A-Z])", r"\1_\2", token)).lower())
    if "_" in token:
        head, *tail = re.split("_(?=[a-z])", low)
        out.append(head + "".join(t[:1].upper() + t[1:] for t in tail))
    return _distinct(out)


def tokens_of(query: str) -> list[str]:
    """Search tokens of a query: code-like words as they stand, then its words, each with its variants.

    CJK runs are cut into pairs of characters where no dictionary segmenter is at hand.
    """
    words = [w for w in query.split() if re.search(r"[._/]", w) or re.search("[a-z][A-Z]", w)]
    plain = _KEYWORDS.sub(" ", _RESERVED.sub(" ", query))
    for word in re.findall(r"[^\W_]+(?:_[^\W_]+)*", plain):
        run = _CJK.fullmatch(word)
        words += [word[i : i + 2] for i in range(max(1, len(word) - 1))] if run else [word]
    return _distinct([v for w in words for v in variants_of(w)])


def query_variants(query: str, terms: list[str] | None = None, enabled: bool = True, most: int = 4) -> list[str]:
    """The query, the query behind its technical terms, and its longer clauses; at most ``most`` distinct ones."""
    tidy = lambda s: " ".join(s.split())
    base = tidy(query)
    if not enabled:
        return [base] if base else []
    found = [base]
    first = {t.lower(): t for t in reversed([tidy(t) for t in terms or [] if tidy(t)])}
    if first:
        ordered = list(dict.fromkeys(tidy(t).lower() for t in terms or [] if tidy(t)))
        found.append(" ".join([*(first[t] for t in ordered), base]))
    found += [c.strip() for c in _CLAUSE.split(base) if len(c.strip()) >= 8]
    seen: dict[str, str] = {}
    for v in found:
        if tidy(v):
            seen.setdefault(tidy(v).lower(), tidy(v))
    return list(seen.values())[:most]


def fingerprint_of(config: dict) -> str:
    """Digest of a configuration, independent of key order (SC20)."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


class ResultCache:
    """Least-recently-used results by (query, project, index version, configuration) (QK17).

    The query keeps its letter case, because tokens depend on it.
    """

    def __init__(self, size: int = 50):
        self.size, self._held = size, OrderedDict()

    @staticmethod
    def key(query: str, project: str, version: int, config: dict) -> str:
        return hashlib.sha256("\x1f".join([" ".join(query.split()), project, str(version), fingerprint_of(config)]).encode()).hexdigest()

    def get(self, key: str):
        if key in self._held:
            self._held.move_to_end(key)
        return self._held.get(key)

    def put(self, key: str, value) -> None:
        self._held[key] = value
        self._held.move_to_end(key)
        while len(self._held) > self.size:
            self._held.popitem(last=False)
