"""Context expansion and packing.

All work on batches: ``query_id`` groups seeds, so one plan serves many queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import overlap_score, parent_breadcrumb

#: Files that only pass on what others export.
BARREL = r"(?i)/(?:__init__\.py|mod\.rs|index\.(?:ts|tsx|js|jsx|mts|mjs|cts|cjs))$"


def neighbours(seeds: DataFrame, chunks: DataFrame, hops: int = 2, decay: float = 0.8) -> DataFrame:
    """Chunks within ``hops`` of a seed in its file; the nearest seed (then the better one) lends its score."""
    around = seeds.select("query_id", "path", F.col("chunk_index").alias("seed"), "score", F.explode(F.sequence(F.lit(-hops), F.lit(hops))).alias("step")).where("step <> 0")
    around = around.select("query_id", "path", (F.col("seed") + F.col("step")).alias("chunk_index"), F.abs("step").alias("distance"), "score")
    best = around.groupBy("query_id", "path", "chunk_index").agg(F.max(F.struct((-F.col("distance")).alias("near"), "score")).alias("b"))
    found = best.join(chunks.select("path", "chunk_index"), ["path", "chunk_index"]).join(seeds.select("query_id", "path", "chunk_index"), ["query_id", "path", "chunk_index"], "left_anti")
    return found.select("query_id", "path", "chunk_index", (F.col("b.score") * F.pow(F.lit(decay), -F.col("b.near"))).alias("score"))


def breadcrumb_siblings(seeds: DataFrame, chunks: DataFrame, limit: int = 3, decay: float = 0.7) -> DataFrame:
    """Chunks under a seed's parent breadcrumb, by chunk index, ``limit`` for each."""
    named = seeds.join(chunks.select("path", "chunk_index", "breadcrumb"), ["path", "chunk_index"])
    groups = named.groupBy("query_id", "path", parent_breadcrumb(F.col("breadcrumb")).alias("prefix")).agg(F.max("score").alias("score"))
    mates = chunks.select("path", "chunk_index", parent_breadcrumb(F.col("breadcrumb")).alias("prefix"))
    found = groups.join(mates, ["path", "prefix"]).join(seeds.select("query_id", "path", "chunk_index"), ["query_id", "path", "chunk_index"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("query_id", "path", "prefix").orderBy("chunk_index"))
    return found.withColumn("nth", nth).where(F.col("nth") <= limit).select("query_id", "path", "chunk_index", (F.col("score") * decay).alias("score"))


def linked_files(seeds: DataFrame, links: DataFrame, reverse: bool = False, per_seed: int = 3, decay: float = 0.6) -> DataFrame:
    """Files that seed files import (or that import them, ``reverse``), with the best decayed seed score.

    An imported barrel file passes on up to two of its own imports, at 0.7 of the score.
    """
    near, far = ("dst", "src") if reverse else ("src", "dst")
    best = seeds.groupBy("query_id", "path").agg(F.max("score").alias("score"))
    edges = links.select(F.col(near).alias("path"), F.col(far).alias("other")).distinct().where("path <> other")
    unseen = lambda df: df.join(edges, "path").join(best.select("query_id", F.col("path").alias("other")), ["query_id", "other"], "left_anti")
    met = unseen(best)
    if not reverse:
        nth = F.row_number().over(Window.partitionBy("query_id", "path").orderBy("other"))
        met = met.withColumn("nth", nth).where(F.col("nth") <= per_seed)
        barrels = met.where(F.col("other").rlike(BARREL)).groupBy("query_id", F.col("other").alias("path")).agg((F.max("score") * 0.7).alias("score"))
        met = met.unionByName(unseen(barrels).withColumn("nth", nth).where(F.col("nth") <= min(per_seed, 2)))
        return met.groupBy("query_id", F.col("other").alias("path")).agg((F.max("score") * decay).alias("score"))
    scored = met.groupBy("query_id", F.col("other").alias("path")).agg((F.max("score") * decay).alias("score"))
    seeds_per_query = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "path"))
    return scored.join(seeds_per_query, "query_id").withColumn("nth", nth).where(F.col("nth") <= F.col("n") * per_seed).select("query_id", "path", "score")


def chunks_of_files(files: DataFrame, read: DataFrame, tokens: list[str], most: int = 3) -> DataFrame:
    """The chunks of linked files that share most with the query (``read`` has their text), or the first ones where none does."""
    scored = files.join(read.select("path", "chunk_index", overlap_score(F.col("text"), tokens).alias("overlap")), "path")
    own = Window.partitionBy("query_id", "path")
    nth = F.row_number().over(own.orderBy(F.desc("overlap"), "chunk_index"))
    kept = scored.withColumn("best", F.max("overlap").over(own)).withColumn("nth", nth).where((F.col("nth") <= most) & ((F.col("overlap") > 0) | (F.col("best") == 0)))
    return kept.select("query_id", "path", "chunk_index", "score")


#: Words that stand before a name in the last part of a breadcrumb.
_LABELS, _EVERY_LABEL = r"^(?:async\s+)?(?:class|function|method|const|let|var)\s+", r"^.*\s"


def called_names(seeds: DataFrame, every_label: bool = False) -> list[str]:
    """Names that seeds (with ``breadcrumb``) declare, for a search of their calls; ``every_label`` knows ``fn``, ``def`` and others too."""
    tail = F.element_at(F.split("breadcrumb", " > "), -1)
    name = F.trim(F.regexp_replace(tail, _EVERY_LABEL if every_label else _LABELS, ""))
    rows = seeds.select(name.alias("name")).where(F.col("name").rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*$")).distinct().orderBy("name")
    return [r["name"] for r in rows.collect()]


def call_sites(seeds: DataFrame, hits: list[DataFrame], per_seed: int = 2, decay: float = 0.5) -> DataFrame:
    """Chunks that call what seeds declare (J12, E5): lexical ``hits`` of each name, de-duplicated and capped in total."""
    about = seeds.groupBy("query_id").agg(F.max("score").alias("best"), F.count(F.lit(1)).alias("n"))
    every = None
    for i, found in enumerate(hits):
        part = found.select("path", "chunk_index", F.struct(F.lit(i).alias("name"), (-F.col("score")).alias("low")).alias("place"))
        every = part if every is None else every.unionByName(part)
    single = every.groupBy("path", "chunk_index").agg(F.min("place").alias("place"))
    met = single.join(F.broadcast(about)).join(seeds.select("query_id", "path", "chunk_index"), ["query_id", "path", "chunk_index"], "left_anti")  # one row a query
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("place", "path", "chunk_index"))
    kept = met.withColumn("nth", nth).where(F.col("nth") <= per_seed * F.col("n"))
    return kept.select("query_id", "path", "chunk_index", (F.col("best") * decay).alias("score"))


def first_stage_wins(stages: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union in stage order; the first stage that has a key keeps it (U4)."""
    every = None
    for i, df in enumerate(stages):
        part = df.select(*keys, "score").withColumn("stage", F.lit(i))
        every = part if every is None else every.unionByName(part)
    best = every.groupBy(*keys).agg(F.min(F.struct("stage", (-F.col("score")).alias("low"))).alias("b"))
    return best.select(*keys, F.col("b.stage").alias("stage"), (-F.col("b.low")).alias("score"))


def merge_intervals(spans: DataFrame, group: list[str], start: str = "raw_start", end: str = "raw_end") -> DataFrame:
    """Overlapping or touching spans of a group become one, with the best score and the number of parts."""
    order = Window.partitionBy(*group).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("island", F.sum(F.when(F.col(start) <= reach, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*group, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.max("score").alias("score"), F.count(F.lit(1)).alias("parts")).drop("island")


def best_segments(segments: DataFrame, group: list[str], most: int = 3) -> DataFrame:
    """The ``most`` best segments of each group."""
    nth = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), "raw_start"))
    return segments.withColumn("_nth", nth).where(F.col("_nth") <= most).drop("_nth")


def pack(segments: DataFrame, budget: int = 48000) -> DataFrame:
    """Greedy character budget per query (W5): files by best score, segments by position.

    A segment over the budget ends its file, later files go on; a full budget ends all.
    The fold runs over one ordered array per query (at most max_k seeds and what they
    expand to), not over the corpus.
    """
    files = segments.groupBy("query_id", "path").agg(F.max("score").alias("file_score"))
    rows = segments.join(files, ["query_id", "path"])
    entry = F.struct((-F.col("file_score")).alias("order"), F.col("path"), F.col("raw_start"), F.col("raw_end"))
    per_query = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(entry)).alias("items"))
    kept_type = "array<struct<path:string,raw_start:int,raw_end:int>>"

    def step(acc: Column, x: Column) -> Column:
        size = x["raw_end"] - x["raw_start"]
        blocked = (acc["stopped"] == x["path"]) | (acc["total"] >= budget)
        fits = ~blocked & (acc["total"] + size <= budget)
        return F.struct(
            F.when(fits, acc["total"] + size).otherwise(acc["total"]).alias("total"),
            F.when(blocked | fits, acc["stopped"]).otherwise(x["path"]).alias("stopped"),
            F.when(fits, F.concat(acc["kept"], F.array(F.struct(x["path"].alias("path"), x["raw_start"].cast("int").alias("raw_start"), x["raw_end"].cast("int").alias("raw_end"))))).otherwise(acc["kept"]).alias("kept"),
        )

    begin = F.struct(F.lit(0).cast("long").alias("total"), F.lit("").alias("stopped"), F.array().cast(kept_type).alias("kept"))
    rows = per_query.select("query_id", F.aggregate(F.transform("items", lambda x: F.struct(x["path"].alias("path"), x["raw_start"].cast("long").alias("raw_start"), x["raw_end"].cast("long").alias("raw_end"))), begin, step, lambda acc: acc["kept"]).alias("kept"))
    return rows.select("query_id", F.posexplode("kept").alias("position", "k")).select("query_id", "position", "k.path", "k.raw_start", "k.raw_end")
