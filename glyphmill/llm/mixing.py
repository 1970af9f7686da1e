"""Mixing sources to target weights [native].

Sources are ranked by code point (null last) and weigh 1, 2, 3, repeating. Targets
share the total size by weight; no target exceeds ``cap`` times its source's size,
and what is above is shared again by weight (water filling, solved in closed form
over one row per source).

Documents of a source stand in the order of a hash of their id. The hash range of a
source is cut into about sqrt(rows) ranges; a prefix sum over range totals finds the
range in which the source's budget ends, and only that range is sorted to find the
exact cut. No source, however large, is ever sorted or gathered in one task, and texts
are never shuffled: the last pass compares each row's hash with its source's cut.

Defined results: null text has size 0; a source without words has target 0 and takes
nothing; rows that share an id share a hash and, at the cut, share the rest in
proportion (rounded down); null ids and null sources are ordinary values; an empty
table gives an empty result; texts of any length are counted whole. Added columns that
clash get a leading underscore; helper columns never clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .support import WORD, fresh, materialise, small

WEIGHTS = (1, 2, 3)
CAP = 3


def hash_key(column: F.Column) -> F.Column:
    """Reproducible random key of an id: the MD5 of its text (null: of the empty text)."""
    return F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def word_count(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Adds ``rank`` and ``target`` to one row per source (``source``, ``source_size``).

    The windows here are over sources, not documents.
    """
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    turn = ((F.col("rank") - 1) % len(weights) + 1).cast("int")
    ranked = totals.withColumn("rank", F.row_number().over(by_source)).withColumn("weight", F.element_at(cycle, turn).cast("long"))
    ranked = ranked.withColumn("most", F.col("source_size") * cap)
    fill = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("rank").asc())
    everything = Window.partitionBy()
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    left = lambda whole, gone: F.sum(whole).over(everything) - F.coalesce(F.sum(gone).over(before), F.lit(0))
    share = left("source_size", "most") / left("weight", "weight")
    level = ranked.withColumn("share", share).withColumn("step", F.row_number().over(fill))
    is_open = F.col("most") > F.col("weight") * F.col("share")
    level = level.withColumn("level", F.min_by(F.when(is_open, F.col("share")), F.when(is_open, F.col("step"))).over(everything))
    target = F.when(F.col("level").isNull(), F.col("most").cast("double")).otherwise(F.least(F.col("most").cast("double"), F.col("weight") * F.col("level")))
    return level.select("source", "source_size", "rows", "rank", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Returns every row of ``docs`` with ``size``, ``source_size``, ``target`` and ``taken``."""
    sized = docs.select(F.col(source_col).alias("source"), hash_key(F.col(id_col)).alias("key"), word_count(F.col(text_col)).alias("size"))
    sized = materialise(sized, "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    targets = materialise(source_targets(totals, weights, cap), "mix-targets")
    n_sources = targets.count()
    budget = F.round("target").cast("long")
    has = F.col("source_size") > 0
    targets = targets.withColumn("epochs", F.when(has, F.floor(budget / F.when(has, F.col("source_size")))).otherwise(0).cast("long"))
    targets = targets.withColumn("rest", budget - F.col("epochs") * F.col("source_size")).withColumn("ranges", F.greatest(F.lit(1), F.ceil(F.sqrt("rows"))).cast("long"))
    ranged = sized.join(small(targets.select(F.col("source").alias("of"), "rank", "ranges", "rest"), n_sources), F.col("source").eqNullSafe(F.col("of")))
    position = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / float(1 << 32)
    ranged = ranged.select("rank", "rest", "key", "size", F.floor(position * F.col("ranges")).cast("long").alias("range"))
    of_ranges = ranged.groupBy("rank", "rest", "range").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("rank").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = of_ranges.withColumn("before", before).where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
    in_range = ranged.join(small(ends.select("rank", "range", "before"), n_sources), ["rank", "range"]).groupBy("rank", "rest", "before", "key").agg(F.sum("size").alias("words"))
    first = F.col("before") + F.coalesce(F.sum("words").over(Window.partitionBy("rank").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = in_range.withColumn("first", first).where((F.col("first") <= F.col("rest")) & (F.col("first") + F.col("words") > F.col("rest")))
    cuts = cuts.select("rank", F.col("key").alias("cut_key"), (F.col("rest") - F.col("first")).alias("cut_rest"), F.col("words").alias("cut_words"))
    plan = materialise(targets.join(cuts, "rank", "left"), "mix-plan")

    size, source_size, target, taken, of, epochs, cut, cut_rest, cut_words = fresh(docs, "size", "source_size", "target", "taken", "mix_of", "mix_epochs", "mix_cut", "mix_rest", "mix_words")
    named = {"source": of, "source_size": source_size, "target": target, "epochs": epochs, "cut_key": cut, "cut_rest": cut_rest, "cut_words": cut_words}
    mine = small(plan.select(*[F.col(a).alias(b) for a, b in named.items()]), n_sources)
    out = docs.withColumn(size, word_count(F.col(text_col))).join(mine, F.col(source_col).eqNullSafe(F.col(of)), "left")
    key = hash_key(F.col(id_col))
    at_cut = F.floor(F.col(size) * F.col(cut_rest) / F.col(cut_words))
    share = F.when(F.col(cut).isNull() | (key > F.col(cut)), 0).when(key < F.col(cut), F.col(size)).otherwise(at_cut)
    out = out.withColumn(taken, (F.col(epochs) * F.col(size) + share).cast("long"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], size, source_size, target, taken)


def op5_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, (rank - 1) % 3 + 1 AS weight, source_size * 3 AS most FROM s),
f AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(most) OVER b, 0) AS DOUBLE) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS share,
        row_number() OVER (ORDER BY CAST(most AS DOUBLE) / weight, rank) AS step
      FROM w WINDOW b AS (ORDER BY CAST(most AS DOUBLE) / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(share, step) AS level FROM f WHERE most > weight * share),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN CAST(most AS DOUBLE) ELSE least(CAST(most AS DOUBLE), weight * level) END AS target FROM f CROSS JOIN l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
p AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.epochs, CAST(round(b.target) AS BIGINT) - b.epochs * b.source_size AS rest,
        CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id) AS BIGINT) - d.size AS first
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - first)) AS BIGINT) AS taken FROM p
"""
