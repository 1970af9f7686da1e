"""The retrieval plan from query text to packed context (QK5-QK18, API1), for one query or several variants."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SearchConfig, load_config
from ..functions.query_text import ResultCache, query_variants, tokens_of
from ..functions.text import clamp_slice, glob_to_regex
from ..operators import expansion, ranking, rerank
from ..sources.scratch import stored

KEYS = ["path", "chunk_index"]


@dataclass
class Index:
    """Tables of an indexed corpus.

    ``files`` (path, hash, content, ...), ``chunks`` (path, hash, chunk_index, spans,
    breadcrumb), ``vectors`` per chunk (path, chunk_index, vector; optional), ``links``
    (src, dst; optional) and ``ready`` (path, hash; optional): where it is given, only
    chunks of these versions are found (F13).
    """

    files: DataFrame
    chunks: DataFrame
    vectors: DataFrame | None = None
    links: DataFrame | None = None
    ready: DataFrame | None = None
    version: int = 0

    def only_ready(self) -> Index:
        """The index of its ready chunks."""
        if self.ready is None:
            return self
        ready = self.ready.select("path", "hash").distinct()
        chunks = self.chunks.join(ready, ["path", "hash"], "left_semi")
        vectors = self.vectors
        if vectors is not None:
            vectors = vectors.join(ready, ["path", "hash"] if "hash" in vectors.columns else ["path"], "left_semi")
        return Index(self.files, chunks, vectors, self.links, None, self.version)


def with_code(index: Index, rows: DataFrame) -> DataFrame:
    """Rows keyed by (path, chunk_index) with spans, breadcrumb and code."""
    spans = rows.join(index.chunks.select(*KEYS, "start", "end", "raw_start", "raw_end", "breadcrumb"), KEYS)
    return spans.join(index.files.select("path", "content"), "path").withColumn("code", clamp_slice(F.col("content"), F.col("start"), F.col("end"))).drop("content")


def lexical_hits(code: DataFrame, query: str, limit: int) -> DataFrame:
    """Best chunks of ``code`` (with breadcrumb and code) for a query text (QK3, QK6)."""
    return ranking.bm25_filled(code.select(*KEYS, "breadcrumb", "code"), KEYS, ["breadcrumb", "code"], tokens_of(query), limit)


def retrieve(index: Index, query: str, vector: list[float] | None = None, config: SearchConfig | None = None, terms: list[str] | None = None, deep: bool = False, scorer: Callable[[Column, list[str]], Column] | None = None, code: DataFrame | None = None) -> DataFrame:
    """Fused, merged and re-ranked chunks of a query: path, chunk_index, score (0..1)."""
    config = config or SearchConfig()
    code = with_code(index, index.chunks.select(*KEYS)) if code is None else code
    every = None
    for i, variant in enumerate(query_variants(query, terms, deep)):
        found = lexical = lexical_hits(code, variant, config.lexical_total)
        if index.vectors is not None and vector is not None:
            distance = F.sqrt(ranking.squared_distance(F.col("vector"), vector))
            near = index.vectors.select(*KEYS, distance.alias("d")).orderBy("d", *KEYS).limit(config.vector_top_k)
            near = near.select(*KEYS, (1 / (1 + F.col("d"))).alias("score")).orderBy(F.desc("score"), *KEYS).limit(config.vector_top_m)
            found = ranking.hybrid(near, lexical, KEYS, w_vec=config.w_vec, w_lex=config.w_lex, k0=config.rrf_k0).drop("source")
        found = ranking.pinned(found.withColumn("variant", F.lit(i)).limit(config.lexical_total + config.vector_top_m))
        every = found if every is None else every.unionByName(found)
    merged = ranking.pinned(ranking.merge_variants(every, KEYS, "variant").orderBy(F.desc("score"), *KEYS).limit(config.fused_top_m))
    tokens = tokens_of(query)
    read = with_code(index, merged)
    read = read.withColumn("text", rerank.rerank_text(F.col("breadcrumb"), F.col("code"), tokens, config.max_rerank_chars))
    return rerank.rerank(read, "text", tokens, KEYS, config.rerank_top_n, scorer).select(*KEYS, "score")


def expand(index: Index, seeds: DataFrame, query: str, config: SearchConfig, code: DataFrame) -> DataFrame:
    """Seeds and what the stages E1-E5 add to them; the first stage that finds a chunk scores it (U4)."""
    keys = ["query_id", *KEYS]
    stages = [seeds, expansion.neighbours(seeds, index.chunks, config.neighbor_hops), expansion.breadcrumb_siblings(seeds, index.chunks, config.breadcrumb_limit)]
    if index.links is not None and config.import_files:
        for reverse, per_seed, decay in ((False, config.import_files, 0.6), (True, 2, 0.5)):
            files = expansion.linked_files(seeds, index.links, reverse, per_seed, decay)
            read = with_code(index, index.chunks.join(files.select("path").distinct(), "path", "left_semi").select(*KEYS))
            stages.append(expansion.chunks_of_files(files, read.withColumn("text", F.concat_ws(" ", "breadcrumb", "code")), tokens_of(query)))
    names = expansion.called_names(seeds.join(index.chunks.select(*KEYS, "breadcrumb"), KEYS)) if config.callsite_chunks else []
    if names:
        hits = [ranking.pinned(lexical_hits(code, f"{name}(", config.callsite_chunks)) for name in names]
        stages.append(expansion.call_sites(seeds, hits, config.callsite_chunks))
    return ranking.pinned(expansion.first_stage_wins(stages, keys))


def scoped(index: Index, packed: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, language: str | None = None, max_files: int | None = None) -> DataFrame:
    """Packed segments within a scope (F16): globs and language of the files, then the first ``max_files`` files."""
    for globs, wanted in ((include, True), (exclude, False)):
        if globs:
            hit = F.col("path").rlike("|".join(glob_to_regex(g) for g in globs))
            packed = packed.where(hit if wanted else ~hit)
    if language:
        packed = packed.join(index.files.where(F.col("language") == language).select("path"), "path", "left_semi")
    if max_files:
        first = packed.groupBy("path").agg(F.min("position").alias("first")).orderBy("first").limit(max_files)
        packed = packed.join(first.select("path"), "path", "left_semi")
    return packed


def context(index: Index, query: str, vector: list[float] | None = None, config: SearchConfig | None = None, terms: list[str] | None = None, deep: bool = False, scorer: Callable[[Column, list[str]], Column] | None = None, **scope) -> DataFrame:
    """Packed segments of a query: position, path, raw_start, raw_end, text."""
    config = config or SearchConfig()
    index = index.only_ready()
    code = stored(with_code(index, index.chunks.select(*KEYS)), "chunk-texts")
    hits = retrieve(index, query, vector, config, terms, deep, scorer, code).withColumn("query_id", F.lit(0))
    seeds = ranking.smart_cutoff(hits, ["query_id"], KEYS, config.ratio, config.delta, config.floor, config.min_k, config.max_k)
    seeds = ranking.pinned(seeds.select("query_id", *KEYS, "score"))
    picked = expand(index, seeds, query, config, code)
    spans = picked.join(index.chunks.select(*KEYS, "raw_start", "raw_end"), KEYS)
    segments = expansion.best_segments(expansion.merge_intervals(spans, ["query_id", "path"]), ["query_id", "path"], config.max_segments)
    packed = scoped(index, expansion.pack(segments, config.max_chars), **scope)
    text = clamp_slice(F.col("content"), F.col("raw_start"), F.col("raw_end"))
    return packed.join(index.files.where(F.length("content") > 0).select("path", "content"), "path").select("position", "path", "raw_start", "raw_end", text.alias("text"))


class Searcher:
    """Answers queries over an index by mode (QK18), with a cache of results per project (QK17)."""

    def __init__(self, index: Index, project: str = "", embedder: Callable[[str], list[float]] | None = None):
        self.index, self.project, self.embedder, self.cache = index, project, embedder, ResultCache()

    def search(self, query: str, terms: list[str] | None = None, mode: str = "balanced", overrides: dict | None = None, **scope) -> list[dict]:
        config = load_config(overrides, mode)
        key = ResultCache.key(query, self.project, self.index.version, asdict(config) | {"mode": mode, "terms": terms, "scope": scope})
        if (held := self.cache.get(key)) is not None:
            return held
        vector = self.embedder(query) if self.embedder else None
        rows = context(self.index, query, vector, config, terms, mode == "deep", **scope).orderBy("position").collect()
        found = [r.asDict() for r in rows]
        self.cache.put(key, found)
        return found
