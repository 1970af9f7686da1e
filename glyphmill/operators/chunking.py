"""Line chunking as one Catalyst fold per file (C9, C10, W8, W9, SC15): no Python, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import visible_length

MAX_VISIBLE = 500


def line_chunks(text: Column, most: int = MAX_VISIBLE) -> Column:
    """Array of chunks (start, end, raw_start, raw_end, nws) of a text; null text has none.

    A text of at most ``most`` visible characters is one chunk. Otherwise lines are
    gathered greedily; a longer line is a chunk of its own. ``start`` / ``end`` leave out
    the newline between chunks, the raw spans tile the text.
    """
    whole = visible_length(text)
    length = F.length(text)
    lines = F.transform(F.split(text, "\n", -1), lambda line: F.struct(F.length(line).alias("len"), visible_length(line).alias("nws")))
    chunk_type = "array<struct<start:int,end:int,nws:int>>"
    empty = F.array().cast(chunk_type)
    begin = F.struct(empty.alias("done"), F.lit(0).alias("at"), F.lit(0).alias("start"), F.lit(0).alias("nws"), F.lit(0).alias("lines"))

    def step(acc: Column, line: Column) -> Column:
        full = (acc["nws"] + line["nws"] > most) & (acc["lines"] > 0)
        closed = F.concat(acc["done"], F.array(F.struct(acc["start"].alias("start"), (acc["at"] - 1).alias("end"), acc["nws"].alias("nws"))))
        return F.struct(
            F.when(full, closed).otherwise(acc["done"]).alias("done"),
            (acc["at"] + line["len"] + 1).alias("at"),
            F.when(full, acc["at"]).otherwise(acc["start"]).alias("start"),
            F.when(full, line["nws"]).otherwise(acc["nws"] + line["nws"]).alias("nws"),
            F.when(full, 1).otherwise(acc["lines"] + 1).alias("lines"),
        )

    def finish(acc: Column) -> Column:
        return F.concat(acc["done"], F.array(F.struct(acc["start"].alias("start"), (acc["at"] - 1).alias("end"), acc["nws"].alias("nws"))))

    many = F.aggregate(lines, begin, step, finish)
    one = F.array(F.struct(F.lit(0).alias("start"), length.alias("end"), whole.alias("nws")))
    spans = F.when(whole <= most, one).otherwise(many)
    tile = lambda all_, s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["start"].alias("raw_start"), F.when(i == F.size(all_) - 1, length).otherwise(s["end"] + 1).alias("raw_end"), s["nws"].alias("nws"))
    #: The one-element array names the spans, so that the inner lambda does not compute them again.
    return F.transform(F.array(spans), lambda all_: F.transform(all_, lambda s, i: tile(all_, s, i))).getItem(0)


def chunk_table(files: DataFrame, most: int = MAX_VISIBLE) -> DataFrame:
    """One row per chunk: path, hash, chunk_index, spans, nws, breadcrumb and chunk_id (``path#hash#index``)."""
    made = files.select("path", "hash", F.posexplode(line_chunks(F.col("content"), most)).alias("chunk_index", "c"))
    return made.select("path", "hash", "chunk_index", "c.start", "c.end", "c.raw_start", "c.raw_end", "c.nws", F.col("path").alias("breadcrumb"), F.concat_ws("#", "path", "hash", "chunk_index").alias("chunk_id"))


def vector_text(breadcrumb: Column, code: Column) -> Column:
    """What an embedder reads of a chunk."""
    return F.concat(F.lit("// Context: "), breadcrumb, F.lit("\n"), code)
