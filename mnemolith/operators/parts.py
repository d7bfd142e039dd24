"""Texts larger than a cell, as numbered parts.

A text is a table of its lines with an order. The lines are sorted into ranges, byte offsets are sums within
a range on top of the ranges before, and each line belongs to the part that its offset falls into. So a part is
bounded by its size and one line, whatever the text's, and no task sees a whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import materialize

PART_BYTES = 8 << 20


def text_parts(lines: DataFrame, *order: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """``path, part_no, begin, content`` of lines (path, text and the columns of ``order``); ``begin`` is the byte offset
    of a part in its text. Texts count with their line ends; joined in the order of ``begin``, the parts of a path
    are its text. Empty or null lines add nothing; part numbers may have gaps after a line longer than a part."""
    if part_bytes <= 0:
        raise ValueError("parts must have a size")
    rows = lines.where("octet_length(text) > 0").orderBy("path", *order)
    rows = materialize(rows.select("path", "text", F.monotonically_increasing_id().alias("at")))
    rows = rows.withColumn("range", F.shiftright("at", 33)).withColumn("size", F.octet_length("text").cast("long"))
    sums = rows.groupBy("path", "range").agg(F.sum("size").alias("all"))  # a row for each range of a path
    sums = sums.withColumn("before", F.sum("all").over(Window.partitionBy("path").orderBy("range")) - F.col("all"))
    inside = F.sum("size").over(Window.partitionBy("path", "range").orderBy("at")) - F.col("size")
    placed = rows.withColumn("inside", inside).join(sums.drop("all"), ["path", "range"]).withColumn("begin", F.col("before") + F.col("inside"))
    placed = placed.withColumn("part_no", F.floor(F.col("begin") / part_bytes))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "")
    return placed.groupBy("path", "part_no").agg(F.min("begin").alias("begin"), whole.alias("content"))
