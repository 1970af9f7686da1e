"""Search settings with bounds, from a mapping of overrides (S14, SC17, SC18, QK18)."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class SearchConfig:
    vector_top_k: int = 80
    vector_top_m: int = 60
    lexical_total: int = 40
    rrf_k0: int = 20
    w_vec: float = 0.6
    w_lex: float = 0.4
    fused_top_m: int = 60
    rerank_top_n: int = 10
    max_rerank_chars: int = 1000
    neighbor_hops: int = 2
    breadcrumb_limit: int = 3
    import_files: int = 3
    callsite_chunks: int = 2
    max_segments: int = 3
    max_chars: int = 48000
    ratio: float = 0.5
    delta: float = 0.25
    floor: float = 0.25
    min_k: int = 2
    max_k: int = 8


#: Least and most of each setting that can be overridden.
BOUNDS = {
    "vector_top_k": (1, 200), "vector_top_m": (1, 200), "lexical_total": (1, 200), "rrf_k0": (1, 200), "w_vec": (0.0, 1.0), "w_lex": (0.0, 1.0), "fused_top_m": (1, 200),
    "rerank_top_n": (1, 50), "max_rerank_chars": (200, 4000), "neighbor_hops": (0, 5), "breadcrumb_limit": (0, 10), "import_files": (0, 10), "callsite_chunks": (0, 10), "max_segments": (1, 10),
    "max_chars": (4000, 200000), "ratio": (0.0, 1.0), "delta": (0.0, 1.0), "floor": (0.0, 1.0), "min_k": (1, 10), "max_k": (1, 15),
}
#: Presets of the retrieval modes.
MODES = {
    "quick": {"vector_top_k": 40, "vector_top_m": 30, "lexical_total": 20, "fused_top_m": 30, "rerank_top_n": 5, "max_k": 5, "import_files": 0},
    "balanced": {},
    "deep": {"vector_top_k": 120, "vector_top_m": 80, "lexical_total": 60, "fused_top_m": 80, "rerank_top_n": 15, "max_k": 12, "import_files": 5},
}


def load_config(overrides: Mapping[str, object] | None = None, mode: str = "balanced") -> SearchConfig:
    """Mode preset, then overrides clamped to their bounds; unreadable values are ignored; one weight implies the other."""
    values: dict[str, object] = dict(MODES[mode])
    for name, raw in (overrides or {}).items():
        if name not in BOUNDS:
            continue
        try:
            number = float(str(raw))
        except ValueError:
            continue
        if number != number:
            continue
        low, high = BOUNDS[name]
        number = min(max(number, low), high)
        values[name] = round(number) if isinstance(low, int) else number
    if ("w_vec" in values) != ("w_lex" in values):
        given, other = ("w_vec", "w_lex") if "w_vec" in values else ("w_lex", "w_vec")
        values[other] = round(1 - float(values[given]), 6)
    return replace(SearchConfig(), **values)


def masked_secret(value: str) -> str:
    """A secret as it may be shown: its first and last four characters, stars between; only stars if it is short (SC19)."""
    ends = value[:4], value[-4:]
    return "*" * len(value) if len(value) <= 8 else ("*" * (len(value) - 8)).join(ends)
