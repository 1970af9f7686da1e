"""Retrieval kernel: exact BM25, vector search, fusion, merging, cut-off (QK3-QK13, A5-A7, A11, W1, W2, W6, T1-T4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import overlap_score, quote
from ..sources.scratch import stored

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def _overlaps_itself(phrase: str) -> bool:
    return any(phrase.startswith(phrase[i:]) for i in range(1, len(phrase)))


def term_frequency(columns: list[Column], phrase: str) -> Column:
    """Overlapping, case-insensitive occurrences of a phrase in all indexed columns.

    A phrase that cannot overlap itself is counted by what its removal takes away, which
    needs no regular expression.
    """
    low = phrase.lower()
    if _overlaps_itself(low):
        return sum((F.regexp_count(F.lower(c), F.lit(f"(?={quote(low)})")) for c in columns), F.lit(0))
    return sum((((F.length(F.lower(c)) - F.length(F.replace(F.lower(c), F.lit(low)))) / len(low)).cast("int") for c in columns), F.lit(0))


def trigram_length(columns: list[Column]) -> Column:
    return sum((F.greatest(F.length(c) - 2, F.lit(0)) for c in columns), F.lit(0))


def bm25(rows: DataFrame, keys: list[str], columns: list[str], phrases: list[str], mode: str = "or") -> DataFrame:
    """Exact BM25 scores of ``rows`` that hold all (``and``) or any (``or``) of ``phrases``.

    One pass over the texts stores length and counts of every row (a narrow table); the
    corpus statistics, one row, and the scores are read from it. Phrases under three
    characters match nothing (with ``and`` the result is empty).
    """
    usable = [p for p in phrases if len(p) >= 3]
    if not usable or (mode == "and" and len(usable) < len(phrases)):
        return rows.select(*keys, F.lit(0.0).alias("score")).where(F.lit(False))
    indexed = [F.coalesce(F.col(c), F.lit("")) for c in columns]
    counted = rows.select(*keys, trigram_length(indexed).alias("_len"), *[term_frequency(indexed, p).alias(f"_f{i}") for i, p in enumerate(usable)])
    return scored(stored(counted, "term-counts"), keys, len(usable), mode)


def scored(counted: DataFrame, keys: list[str], phrases: int, mode: str) -> DataFrame:
    """Scores from counts (``_f0`` ..., ``_len``)."""
    usable = range(phrases)
    stats = counted.agg(F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avg"), *[F.count_if(F.col(f"_f{i}") > 0).alias(f"_n{i}") for i in range(len(usable))])
    hits = [F.col(f"_f{i}") > 0 for i in range(len(usable))]
    wanted = hits[0]
    for h in hits[1:]:
        wanted = (wanted & h) if mode == "and" else (wanted | h)
    parts = []
    for i in range(len(usable)):
        idf = F.greatest(F.ln((F.col("_n") - F.col(f"_n{i}") + 0.5) / (F.col(f"_n{i}") + 0.5)), F.lit(LEAST_IDF))
        f = F.col(f"_f{i}")
        parts.append(idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_len") / F.col("_avg"))))
    #: ``stats`` is a single row by construction.
    return counted.where(wanted).join(F.broadcast(stats)).select(*keys, sum(parts[1:], parts[0]).alias("score"))


def bm25_filled(rows: DataFrame, keys: list[str], columns: list[str], phrases: list[str], limit: int) -> DataFrame:
    """Strict matches first; where they do not fill ``limit``, the best lenient ones join; sorted by score."""
    usable = [p for p in phrases if len(p) >= 3]
    if len(phrases) < 2 or not usable:
        return bm25(rows, keys, columns, phrases, "and").orderBy(F.desc("score"), *keys).limit(limit)
    indexed = [F.coalesce(F.col(c), F.lit("")) for c in columns]
    counts = [term_frequency(indexed, p).alias(f"_f{i}") for i, p in enumerate(usable)]
    counted = stored(rows.select(*keys, trigram_length(indexed).alias("_len"), *counts), "term-counts")
    all_there = F.lit(len(usable) == len(phrases))
    for i in range(len(usable)):
        all_there = all_there & (F.col(f"_f{i}") > 0)
    lenient = scored(counted.withColumn("strict", all_there.cast("int")), [*keys, "strict"], len(usable), "or")
    first = lenient.orderBy(F.desc("strict"), F.desc("score"), *keys).limit(limit)
    return first.drop("strict").orderBy(F.desc("score"), *keys)


def squared_distance(vector: Column, query: list[float]) -> Column:
    target = F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(vector, target, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, x: acc + x)


def nearest(vectors: DataFrame, key: str, vector: str, query: list[float], limit: int) -> DataFrame:
    """Exact k nearest neighbours by Euclidean distance with score ``1 / (1 + d)``: one scan and a top-k."""
    found = vectors.select(key, F.sqrt(squared_distance(F.col(vector), query)).alias("distance")).orderBy("distance", key).limit(limit)
    return found.withColumn("score", 1 / (1 + F.col("distance")))


def ranked(found: DataFrame, keys: list[str]) -> DataFrame:
    """Zero-based ``rank`` by descending score (over a top-k result, not a corpus)."""
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), *keys)) - 1)


def fuse(vector_hits: DataFrame, lexical_hits: DataFrame, keys: list[str], w_vec: float = 0.6, w_lex: float = 0.4, k0: int = 20) -> DataFrame:
    """Weighted reciprocal-rank fusion; hits of both kinds count as vector hits (QK10)."""
    part = lambda df, w, name: ranked(df, keys).select(*keys, (w / (k0 + F.col("rank"))).alias("part"), F.lit(name).alias("source"))
    both = part(vector_hits, w_vec, "vector").unionByName(part(lexical_hits, w_lex, "lexical"))
    return both.groupBy(*keys).agg(F.sum("part").alias("score"), F.max("source").alias("source"))


def pinned(df: DataFrame) -> DataFrame:
    """A result of at most a few dozen rows (a top-k by construction) as literal rows, so that later stages do not compute it again."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def hybrid(vector_hits: DataFrame, lexical_hits: DataFrame, keys: list[str], **weights) -> DataFrame:
    """Fusion of two top-k results, or the raw vector scores where nothing matches lexically (QK9)."""
    lexical = pinned(lexical_hits)
    if lexical.isEmpty():
        return vector_hits.select(*keys, "score", F.lit("vector").alias("source"))
    return fuse(vector_hits, lexical, keys, **weights)


def merge_variants(hits: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Best score per key over query variants; the earlier variant wins ties (A5)."""
    best = F.max(F.struct(F.col("score"), (-F.col(order)).alias("late")))
    return hits.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.score").alias("score"), (-F.col("b.late")).alias(order))


def smart_cutoff(hits: DataFrame, group: list[str], keys: list[str], ratio: float = 0.5, delta: float = 0.25, floor: float = 0.25, min_k: int = 2, max_k: int = 8, behaviour: str = "return_top1") -> DataFrame:
    """Seeds per group by scores relative to the top one (QK13, W6), with ``low_confidence``.

    The first ``min_k`` need only the floor, the others the dynamic threshold; the first
    failure ends the list. A key counts once; where repeats leave fewer than ``min_k``
    seeds, the next ones above the floor fill up (U6). A top score below the floor keeps
    one seed, or none with ``return_empty``.
    """
    order = Window.partitionBy(*group).orderBy(F.desc("score"), *keys)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(*group)
    w = hits.withColumn("rank", F.row_number().over(order) - 1).withColumn("top", F.first("score").over(order))
    dynamic = F.greatest(F.lit(floor), F.least(F.col("top") * ratio, F.col("top") - delta))
    passes = F.when(F.col("rank") < min_k, F.col("score") >= floor).otherwise(F.col("score") >= dynamic) & (F.col("rank") < max_k)
    w = w.withColumn("low_confidence", F.col("top") < floor).withColumn("_prefix", F.min(passes.cast("int")).over(upto) == 1)
    w = w.withColumn("_first", F.row_number().over(Window.partitionBy(*group, *keys).orderBy("rank")) == 1)
    kept = ~F.col("low_confidence") & F.col("_prefix") & F.col("_first")
    spare = ~F.col("low_confidence") & ~kept & F.col("_first") & (F.col("score") >= floor)
    missing = min(min_k, max_k) - F.sum(kept.cast("int")).over(everything)
    w = w.withColumn("_missing", missing).withColumn("_spare", F.when(spare, F.sum(spare.cast("int")).over(upto)))
    low = F.col("low_confidence") & (F.col("rank") == 0) & F.lit(behaviour != "return_empty")
    return w.where(low | kept | (F.col("_spare") <= F.col("_missing"))).drop("top", "_prefix", "_first", "_missing", "_spare")


def drill_down(file_hits: DataFrame, chunks: DataFrame, tokens: list[str], per_file: int = 2, total: int = 40) -> DataFrame:
    """Chunks of matching files by file score and token overlap, ``per_file`` each and ``total`` in file order (QK7, W2)."""
    scored = chunks.join(file_hits.select("path", F.col("score").alias("file_score")), "path").withColumn("overlap", overlap_score(F.concat_ws(" ", "breadcrumb", "code"), tokens)).where("overlap > 0")
    scored = scored.withColumn("score", F.col("file_score") * (1 + 0.5 * F.col("overlap")))
    own = Window.partitionBy("path").orderBy(F.desc("overlap"), "chunk_index")
    kept = scored.withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= per_file)
    return kept.orderBy(F.desc("file_score"), "path", "nth").limit(total).select("path", "chunk_index", "score")
