"""Rerank text and scoring (QK11, QK12, SC7-SC9, S10, S11, X2) with pluggable models.

A scorer or embedder is any function over pandas series; the defaults are deterministic
and local. A scorer that fails leaves the candidates as they were.
"""

from __future__ import annotations

import hashlib
import time
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import overlap_score, truncate_middle


def hit_window(text: str, tokens: list[str], most: int, head_ratio: float = 0.67) -> str:
    """The lines around the line with the most distinct tokens that fit ``most`` characters; head and tail without a hit."""
    if len(text) <= most:
        return text
    lines = text.split("\n")
    hits = [sum(t in line.lower() for t in tokens) for line in lines]
    if not any(hits):
        head = int(most * head_ratio)
        tail = most - head - 3
        return text[:most] if tail <= 0 else f"{text[:head]}...{text[-tail:]}"
    first = last = int(np.argmax(hits))
    room = most - len(lines[first])
    grew = True
    while grew and room > 0:
        grew = False
        if first > 0 and len(lines[first - 1]) + 1 <= room:
            first, room, grew = first - 1, room - len(lines[first - 1]) - 1, True
        if last + 1 < len(lines) and len(lines[last + 1]) + 1 <= room:
            last, room, grew = last + 1, room - len(lines[last + 1]) - 1, True
    return ("..." if first > 0 else "") + "\n".join(lines[first : last + 1]) + ("..." if last + 1 < len(lines) else "")


def rerank_text(breadcrumb: Column, code: Column, tokens: list[str], most: int = 1000, most_breadcrumb: int = 250) -> Column:
    """What the scorer reads of a chunk: its shortened breadcrumb and the text around the best line."""
    tokens = list(tokens)

    @F.pandas_udf(T.StringType())
    def around(texts: pd.Series, room: pd.Series) -> pd.Series:
        return pd.Series([hit_window(t or "", tokens, max(0, int(r))) for t, r in zip(texts, room, strict=True)])

    head = truncate_middle(breadcrumb, most_breadcrumb)
    return F.concat(head, F.lit("\n"), around(code, F.lit(most) - F.length(head) - 1))


def service(call: Callable[[list[str], list[str]], list[float]], tries: int = 3, wait: float = 0.0) -> Callable[[Column, list[str]], Column]:
    """A scorer from a function (texts, tokens) -> scores that may fail: so many tries, then null scores."""

    def scorer(text: Column, tokens: list[str]) -> Column:
        tokens = list(tokens)

        @F.pandas_udf(T.DoubleType())
        def ask(texts: pd.Series) -> pd.Series:
            for turn in range(tries):
                try:
                    scores = call([t or "" for t in texts], tokens)
                    if len(scores) == len(texts):
                        return pd.Series([float(s) for s in scores], dtype=float)
                except Exception:  # noqa: BLE001 - any failure of a service counts as one try
                    time.sleep(wait * 2**turn)
            return pd.Series([None] * len(texts), dtype=float)

        return ask(text)

    return scorer


def rerank(candidates: DataFrame, text: str, tokens: list[str], keys: list[str], top: int = 10, scorer: Callable[[Column, list[str]], Column] | None = None) -> DataFrame:
    """The ``top`` candidates by a 0..1 score; by default the share of query tokens that the text holds.

    Where the scorer fails for any candidate, all keep their scores (QK12).
    """
    if not tokens:
        return candidates.orderBy(F.desc("score"), *keys).limit(top)
    new = scorer(F.col(text), tokens) if scorer else overlap_score(F.col(text), tokens) / len(tokens)
    everything = Window.partitionBy()  # candidates are a top-k of a few dozen rows
    scored = candidates.withColumn("_new", new).withColumn("_failed", F.count_if(F.col("_new").isNull()).over(everything))
    scored = scored.withColumn("score", F.when(F.col("_failed") == 0, F.col("_new")).otherwise(F.col("score"))).drop("_new", "_failed")
    return scored.orderBy(F.desc("score"), *keys).limit(top)


def _tried(model: Callable[[pd.Series], list[list[float]]], texts: pd.Series, tries: int, wait: float) -> list[list[float]]:
    for turn in range(tries):
        try:
            return list(model(texts))
        except Exception:  # noqa: BLE001 - the last failure is raised below
            if turn == tries - 1:
                raise
            time.sleep(min(60.0, wait * 2**turn))
    return []


def embed(rows: DataFrame, text: str, name: str = "vector", dimensions: int = 64, embedder: Callable[[pd.Series], list[list[float]]] | None = None, at_once: int = 20, tries: int = 5, wait: float = 5.0) -> DataFrame:
    """``rows`` with a vector per text; by default signed hashed words, normalised.

    An embedder gets ``at_once`` texts a call; a call that fails is repeated after a growing wait (S10).
    """

    def hashed(texts: pd.Series) -> list[list[float]]:
        out = np.zeros((len(texts), dimensions), dtype=np.float32)
        places: dict[str, tuple[int, int]] = {}
        for i, t in enumerate(texts):
            for w, n in Counter((t or "").lower().split()).items():
                if w not in places:
                    h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                    places[w] = h % dimensions, 1 if h >> 63 else -1
                at, sign = places[w]
                out[i, at] += sign * n
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(size > 0, size, 1)).tolist()

    model = embedder or hashed

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors: list[list[float]] = []
            for at in range(0, len(frame), at_once if embedder else max(1, len(frame))):
                vectors += _tried(model, frame[text].iloc[at : at + (at_once if embedder else len(frame))], tries, wait)
            yield frame.assign(**{name: vectors})

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField(name, T.ArrayType(T.FloatType()))]))
