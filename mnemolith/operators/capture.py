"""Conversation capture: what of a conversation goes into the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip_blocks

MAX_MESSAGES, MAX_BYTES = 20, 200_000
ROLES = ("user", "assistant")


def select_tail(messages: DataFrame, max_messages: int = MAX_MESSAGES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The newest messages of each conversation within both bounds; the newest always stays. Exact as
    a running sum, because that never falls."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = messages.withColumn("rn", F.row_number().over(w)).withColumn("total", F.sum(F.octet_length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where((F.col("rn") <= max_messages) & ((F.col("rn") == 1) | (F.col("total") <= max_bytes))).drop("rn", "total")


def captured(messages: DataFrame, tag: str = "recall", max_messages: int = MAX_MESSAGES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """User and assistant messages without injected blocks, empty ones gone, cut to the tail."""
    rows = messages.where(F.col("role").isin(*ROLES)).withColumn("text", strip_blocks(F.col("text"), tag)).where("text <> ''")
    return select_tail(rows, max_messages, max_bytes)


def reset_summary(messages: DataFrame, tag: str = "recall", last: int = 3, least: int = 10, cut: int = 300) -> DataFrame:
    """``conv_id, summary``: the last user texts longer than ``least`` before stripping, each cut."""
    rows = messages.where((F.col("role") == "user") & (F.length("text") > least))
    rn = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    rows = rows.withColumn("rn", rn).where(F.col("rn") <= last).withColumn("s", F.substring(strip_blocks(F.col("text"), tag), 1, cut))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "s"))), lambda x: x["s"])
    return rows.groupBy("conv_id").agg(F.concat(F.lit("[session-summary before reset] "), F.array_join(parts, " | ")).alias("summary"))
