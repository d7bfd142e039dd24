"""The append-only event log and its status log.

``seq`` is the ordinal over valid lines. In a table it is a stored column and a cursor is a pushed-down filter; in a
log of appended folders (sources/appendlog) the manifest says which folders reach past a cursor. The status log is a changelog: its state is the last valid record of each event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cut_bytes, parse_time
from ..sources.tables import broadcast_if_small, materialize

#: What an integration can end in.
TERMINAL = ("integrated", "skipped", "failed", "unknown")
EARLIEST = "0001-01-01 00:00:00"


def events_since(events: DataFrame, cursor: int) -> DataFrame:
    """Events at or past a 0-based cursor."""
    return events.where(F.col("seq") >= cursor)


def next_cursor(events: DataFrame) -> DataFrame:
    """One row: the cursor after a read, which is the log's length even if the old one overshot."""
    return events.agg(F.count("*").alias("new_cursor"))


def recent_events(events: DataFrame, n: int) -> DataFrame:
    """The last n in log order (not in time order)."""
    return events.orderBy(F.desc("seq")).limit(max(n, 0))


def event_by_id(events: DataFrame, ident: str) -> DataFrame:
    """First match in log order."""
    return events.where(F.col("id") == ident).orderBy("seq").limit(1)


def bounded_content(events: DataFrame, limit: int = 2_000, mark: str = "... [truncated]") -> DataFrame:
    """Content of more than ``limit`` bytes cut there, for bounded reads."""
    return events.withColumn("content", cut_bytes(F.col("content"), limit, mark))


def valid_status(r: str = "") -> Column:
    """Whether a status record is one of its three forms."""
    c = lambda x: F.coalesce(F.col(r + x), F.lit(""))
    return (
        F.when(c("type") == "bootstrap", c("epoch") != "")
        .when(c("type") == "reset", c("event_id") != "")
        .when(c("type") != "", False)
        .otherwise((c("event_id") != "") & c("status").isin(*TERMINAL))
    )


def latest_status(log: DataFrame) -> DataFrame:
    """``event_id, status, reason`` after the whole log: the last record counts, a reset removes.

    ``max_by`` combines on the map side, so an event with very many records costs one row a task.
    """
    records = log.where(valid_status() & (F.coalesce("type", F.lit("")) != "bootstrap"))
    last = records.groupBy("event_id").agg(F.max_by(F.struct("type", "status", "reason"), "line_no").alias("r"))
    return last.where(F.coalesce("r.type", F.lit("")) != "reset").select("event_id", "r.status", "r.reason")


def log_health(log: DataFrame) -> DataFrame:
    """One row: lines, valid and skipped ones, and whether the log is refused. The last line doesn't
    count as valid without a line end (``terminated``)."""
    ok = F.coalesce(valid_status() & F.coalesce(F.col("terminated"), F.lit(True)), F.lit(False))
    return log.agg(F.count("*").alias("total"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("skipped")).withColumn(
        "verdict",
        F.when((F.col("total") > 0) & (F.col("valid") == 0), "unparseable")
        .when((F.col("skipped") > 10) & (F.col("skipped") * 10 > F.col("total")), "corrupt")
        .otherwise("accepted"),
    )


def with_created_at(events: DataFrame) -> DataFrame:
    """Adds ``created_at``; an unreadable time is the earliest."""
    return events.withColumn("created_at", F.coalesce(parse_time(F.col("timestamp")), F.lit(EARLIEST).cast("timestamp")))


def pending_events(events: DataFrame, status: DataFrame) -> DataFrame:
    """Events without a terminal status, with ``created_at``."""
    return with_created_at(events.join(status.select(F.col("event_id").alias("id")), "id", "left_anti"))


def once_each(events: DataFrame) -> DataFrame:
    """One event of each id. Ids alone are shuffled to see which come again; the contents of those only are compared."""
    more = events.groupBy(F.col("id").alias("_id")).count().where("count > 1").select("_id")
    if more.isEmpty():
        return events
    more, same = broadcast_if_small(materialize(more)), F.col("id").eqNullSafe(F.col("_id"))
    return events.join(more, same, "left_anti").unionByName(events.join(more, same, "left_semi").dropDuplicates(["id"]))


def status_counts(events: DataFrame, status: DataFrame) -> DataFrame:
    """One row of counts; statuses count for known events only."""
    known = events.select("id").distinct().join(status.select(F.col("event_id").alias("id"), "status"), "id", "left")
    return known.agg(*(F.count_if(F.col("status") == s).alias(s) for s in TERMINAL), F.count_if(F.col("status").isNull()).alias("pending"), F.count("*").alias("total"))


def bootstrap_records(events: DataFrame, epoch: str) -> DataFrame:
    """A header and an integrated record for every event created strictly before the epoch."""
    at = F.coalesce(parse_time(F.col("timestamp")), F.lit(EARLIEST).cast("timestamp"))
    rows = events.where(at < F.lit(epoch).cast("timestamp")).select(
        F.lit("").alias("type"), F.col("id").alias("event_id"), F.lit("integrated").alias("status"), F.lit("pre_epoch_bootstrap").alias("reason"), F.lit("").alias("epoch")
    )
    head = events.sparkSession.range(1).select(F.lit("bootstrap").alias("type"), F.lit("").alias("event_id"), F.lit("").alias("status"), F.lit("").alias("reason"), F.lit(epoch).alias("epoch"))
    return head.unionByName(rows)


def recovered_events(pages: DataFrame, pending: DataFrame) -> DataFrame:
    """Pending events that a page header already names: they become unknown, never redone."""
    found = F.regexp_extract_all("content", F.lit(r"compiled_from:[\t\n\f\r ]*([^\n]*?)[\t\n\f\r ]*-->"), F.lit(1))
    ids = pages.select(F.explode(found).alias("ids")).select(F.explode(F.split("ids", ",")).alias("id")).select(F.trim("id").alias("id"))
    return pending.select("id").join(ids.distinct(), "id", "left_semi").select(F.col("id").alias("event_id"), F.lit("unknown").alias("status"), F.lit("recovered_from_frontmatter").alias("reason"))


def transition(action: Column, old: Column) -> Column:
    """New status of an admin action, or the reason of refusal."""
    return (
        F.when((action == "reset") & old.isin("unknown", "failed"), "pending")
        .when((action == "confirm") & (old == "unknown"), "integrated")
        .otherwise(F.concat(F.lit("refused: "), action, F.lit(" from "), old))
    )


def remember(requests: DataFrame) -> DataFrame:
    """Event columns of remember requests (content, context map): five context keys become columns,
    the map is kept as JSON unless empty, closed fields get their defaults."""
    ctx = F.coalesce(F.col("context"), F.create_map().cast("map<string,string>"))
    value = lambda k: F.coalesce(F.try_element_at(ctx, F.lit(k)), F.lit(""))
    return requests.select(
        "content",
        *(value(k).alias(k) for k in ("actor", "source", "session_id", "active_project", "active_task")),
        F.when(F.size(ctx) > 0, F.to_json(ctx)).otherwise("").alias("context_json"),
        F.coalesce(F.nullif("source_type", F.lit("")), F.lit("user")).alias("source_type"),
        F.coalesce(F.nullif("evidence_kind", F.lit("")), F.lit("user_statement")).alias("evidence_kind"),
        F.coalesce(F.nullif("trust_tier", F.lit(0)), F.lit(1)).alias("trust_tier"),
    )


def remember_from_tool(requests: DataFrame) -> DataFrame:
    """The same for the tool surface, whose defaults differ."""
    return requests.select(
        "content",
        F.coalesce(F.nullif("source_type", F.lit("")), F.lit("assistant")).alias("source_type"),
        F.coalesce(F.nullif("evidence_kind", F.lit("")), F.lit("direct_observation")).alias("evidence_kind"),
        F.coalesce(F.nullif("trust_tier", F.lit(0)), F.lit(2)).alias("trust_tier"),
    )
