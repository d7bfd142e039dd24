"""Run-length guards over traces, and small decision tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _runs(df: DataFrame, by: list[str], order: str, starts: Column) -> DataFrame:
    """Adds ``run``: a number that goes up where ``starts`` holds."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("run", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def repeated_reads(trace: DataFrame, limit: int = 8, by: str = "trace_id") -> DataFrame:
    """Traces stopped for repeating one read-only call: ``by, call_no`` of the first call past
    ``limit`` equal ones. A successful write resets the count, a failed one doesn't."""
    wrote = ~F.col("read_only") & F.col("error").isNull()
    w = Window.partitionBy(by).orderBy("call_no")
    epochs = trace.withColumn("epoch", F.coalesce(F.sum(wrote.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    reads = epochs.where("read_only")
    wr = Window.partitionBy(by, "epoch").orderBy("call_no")
    same = (F.lag("name").over(wr) == F.col("name")) & (F.lag("input").over(wr) == F.col("input"))
    reads = reads.withColumn("fresh", ~F.coalesce(same, F.lit(False)))
    reads = _runs(reads, [by, "epoch"], "call_no", F.col("fresh"))
    n = F.row_number().over(Window.partitionBy(by, "epoch", "run").orderBy("call_no"))
    return reads.withColumn("n", n).where(F.col("n") > limit).groupBy(by).agg(F.min("call_no").alias("call_no"))


def consecutive(trace: DataFrame, bad: Column, limit: int, by: str = "trace_id", order: str = "call_no") -> DataFrame:
    """``by, order`` of the first row at which more than ``limit`` bad rows stand in a row."""
    rows = _runs(trace.withColumn("bad", bad), [by], order, ~F.col("bad")).where("bad")
    n = F.row_number().over(Window.partitionBy(by, "run").orderBy(order))
    return rows.withColumn("n", n).where(F.col("n") > limit).groupBy(by).agg(F.min(order).alias(order))


def deferred_items(attempts: DataFrame, limit: int = 3) -> DataFrame:
    """Items with ``limit`` or more failures since their last success: (item, at_no, ok) rows."""
    w = Window.partitionBy("item")
    last = F.coalesce(F.max(F.when(F.col("ok"), F.col("at_no"))).over(w), F.lit(-1))
    since = attempts.withColumn("last", last).groupBy("item").agg(F.count_if(~F.col("ok") & (F.col("at_no") > F.col("last"))).alias("failures"))
    return since.where(F.col("failures") >= limit)


def compile_cursor(calls: DataFrame, start: int, events: int) -> DataFrame:
    """One row: the cursor after a compile run. The first successful read whose input was the start
    cursor decides; the value stays between the start and the event count."""
    hit = calls.where((F.col("cursor") == start) & F.col("error").isNull())
    new = hit.agg(F.min_by("new_cursor", "call_no").alias("c"))
    return new.select(F.greatest(F.lit(start), F.least(F.coalesce("c", F.lit(start)), F.lit(events))).alias("cursor"))


#: Fragments of error texts that are worth another attempt.
RETRYABLE = ("context deadline exceeded", "timeout", "temporary", "eof", "connection reset", "connection refused", "broken pipe", "api error 429", "api error 500", "api error 502", "api error 503", "api error 504")


def retryable(message: Column) -> Column:
    return F.lower(message).rlike("(" + "|".join(RETRYABLE) + ")")


def retry_delay(attempt: Column, base_seconds: int = 2) -> Column:
    """base * 2 ** (attempt - 1)."""
    return F.lit(base_seconds).cast("long") * F.pow(F.lit(2), attempt - 1).cast("long")


def batch_timeout(events: Column, turn_seconds: int = 600, per_event: int = 90, most: int = 600) -> Column:
    """The turn's time or that of its events, whichever is longer, up to ``most``; which also stands in
    for no time at all."""
    seconds = F.least(F.greatest(F.lit(turn_seconds), events * per_event), F.lit(most))
    return F.when(seconds > 0, seconds).otherwise(most)


def health(state: str = "") -> Column:
    """First match of the coordinator's states. Columns: suspended, in_progress, pending (-1: unknown,
    counts as one), deferred, last_succeeded (null: no flush yet), failures, index_stale, write_errors."""
    c = lambda x: F.col(state + x)
    todo = F.greatest(F.when(c("pending") == -1, 1).otherwise(c("pending")) - c("deferred"), F.lit(0))
    idle = c("in_progress") == 0
    return (
        F.when(c("suspended") & idle, "suspended")
        .when((todo > 0) & idle & (c("last_succeeded") == 0), "stuck")
        .when(~idle | (todo > 0), "in_progress")
        .when((c("failures") > 0) | c("index_stale") | (c("write_errors") > 0) | (c("deferred") > 0), "degraded")
        .otherwise("healthy")
    )


def failure_reason(deadline: Column, violations: Column, error: Column) -> Column:
    """Why a batch that can't be split further failed."""
    return (
        F.when(deadline, "batch_timeout_at_max_depth")
        .when(violations > 0, "collateral: bisect terminal with poison event")
        .when(error.isNotNull(), F.concat(F.lit("batch_crash_at_max_depth: "), error))
        .otherwise("batch_failed_at_max_depth")
    )


def exit_code(errors: Column, warnings: Column, strict: Column) -> Column:
    return F.when((errors > 0) | (strict & (warnings > 0)), 1).otherwise(0)


def next_run(pending: Column, suspended: Column, deferred: Column) -> Column:
    """Whether to come back after a flush: not when suspended or when only deferred items remain."""
    return F.when(suspended, "stay suspended").when(pending > deferred, "resume later").otherwise("idle")
