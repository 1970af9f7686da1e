"""Rendered output of packed context and of file lists (K14, SC6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import human_size, line_of


def with_lines(packed: DataFrame, files: DataFrame) -> DataFrame:
    """Packed segments with their first and last line numbers in the file."""
    met = packed.join(files.select("path", "content", "language"), "path")
    last = F.greatest(F.col("raw_end") - 1, F.col("raw_start"))
    return met.withColumn("first_line", line_of(F.col("content"), F.col("raw_start"))).withColumn("last_line", line_of(F.col("content"), last)).drop("content")


def markdown(segments: DataFrame) -> DataFrame:
    """One row: the segments (``position, path, language, first_line, last_line, text``) as Markdown in packing order.

    The text of one pack is bounded by the packing budget.
    """
    block = F.format_string("## %s (L%d-L%d)\n\n```%s\n%s\n```", "path", "first_line", "last_line", "language", "text")
    ordered = F.array_sort(F.collect_list(F.struct("position", block.alias("block"))))
    return segments.agg(F.array_join(F.transform(ordered, lambda s: s["block"]), "\n\n").alias("markdown"))


def as_json(segments: DataFrame) -> DataFrame:
    """One row: the segments as a JSON array in packing order."""
    fields = F.struct("position", "path", "first_line", "last_line", "text")
    return segments.agg(F.to_json(F.array_sort(F.collect_list(fields))).alias("json"))


def file_lines(files: DataFrame) -> DataFrame:
    """``path (language, size)`` of each file."""
    return files.select("path", F.format_string("%s (%s, %s)", "path", "language", human_size(F.col("size"))).alias("line"))
