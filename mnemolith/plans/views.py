"""The engine's relations derived from the driver's tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log: ordinal, id, RFC 3339 time, actor, content and context."""
    e = table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    return e.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("evt_"), F.col("event_id").cast("string")).alias("id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.concat(F.lit("u"), user).alias("actor"),
        F.concat("event_type", F.lit(" by "), user, F.lit(" "), F.repeat("props", (F.col("event_id") % 7).cast("int"))).alias("content"),
        F.lit("driver").alias("source"),
        F.concat(F.lit("s"), (F.col("user_id") % 50).cast("string")).alias("session_id"),
        F.lit("").alias("active_project"),
        F.lit("").alias("active_task"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"z": "'), "event_type", F.lit('", "a": "x'), user, F.lit('"}'))).when(F.col("event_id") % 11 == 0, "{}").otherwise(F.col("props")).alias("context_json"),
        F.col("event_type").alias("source_type"),
        "user_id",
        "ts",
    )


RAW = """raw AS (SELECT event_id AS seq, 'evt_' || event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS "timestamp", 'u' || user_id AS actor,
  event_type || ' by ' || user_id || ' ' || repeat(props, (event_id % 7)::INT) AS content, 'driver' AS source, 's' || (user_id % 50) AS session_id,
  CASE WHEN event_id % 3 = 0 THEN '{"z": "' || event_type || '", "a": "x' || user_id || '"}' WHEN event_id % 11 = 0 THEN '{}' ELSE props END AS context_json,
  event_type AS source_type, user_id, ts, date_trunc('second', ts) AS created_at FROM events)"""

#: The context as the batching rules see it, and the bytes an event takes.
CTX = """ctx AS (SELECT *, CASE WHEN seq % 3 = 0 THEN 'a=x' || user_id || '; z=' || source_type WHEN seq % 11 = 0 THEN 'none'
  ELSE 'actor=' || actor || '; session_id=' || session_id || '; source=driver; source_type=' || source_type END AS context FROM raw),
sized AS (SELECT *, (strlen(content) + strlen(context))::BIGINT AS bytes FROM ctx)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages: path by memory type and source, every seventh one archived."""
    d = table(spark, sf_dir, "documents")
    kind = F.element_at(F.array(*(F.lit(x) for x in ("semantic", "episodic", "procedural", "prospective"))), (F.col("doc_id") % 4 + 1).cast("int"))
    path = F.concat(F.when(F.col("doc_id") % 7 == 0, "archive/").otherwise(""), kind, F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return d.select("doc_id", path.alias("path"), F.col("text").alias("content"))


PAGES = """pg AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'archive/' ELSE '' END || ['semantic', 'episodic', 'procedural', 'prospective'][(doc_id % 4 + 1)::INT]
  || '/' || source || '/' || doc_id || '.md' AS path, text AS content FROM documents)"""


def status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A changelog over the events: five lines for each two, with resets, a bootstrap and bad rows."""
    e = table(spark, sf_dir, "events").select("event_id")
    line = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")
    rows = e.select("event_id", line).withColumn("h", (F.col("event_id") * 7 + F.col("k") * 3) % 10)
    kind = F.when((F.col("h") == 0) & (F.col("k") == 0), "bootstrap").when(F.col("h") == 1, "reset").otherwise("")
    status = F.when(F.col("h") == 2, "pending").when(F.col("h") < 5, "failed").when(F.col("h") < 6, "unknown").when(F.col("h") < 7, "skipped").otherwise("integrated")
    rows = rows.where((F.col("event_id") + F.col("k")) % 2 == 0)
    return rows.select(
        (F.col("event_id") * 3 + F.col("k")).alias("line_no"),
        kind.alias("type"),
        F.when(kind == "bootstrap", "").otherwise(F.concat(F.lit("evt_"), (F.col("event_id") - F.col("k") % 2).cast("string"))).alias("event_id"),
        status.alias("status"),
        F.concat(F.lit("r"), F.col("h").cast("string")).alias("reason"),
        F.when(kind == "bootstrap", "2024-01-01T00:00:00Z").otherwise("").alias("epoch"),
        F.lit(True).alias("terminated"),
    )


STATUS = """lg AS (SELECT event_id * 3 + k AS line_no, t AS type, CASE WHEN t = 'bootstrap' THEN '' ELSE 'evt_' || (event_id - k % 2) END AS event_id,
  CASE WHEN h = 2 THEN 'pending' WHEN h < 5 THEN 'failed' WHEN h < 6 THEN 'unknown' WHEN h < 7 THEN 'skipped' ELSE 'integrated' END AS status, 'r' || h AS reason
  FROM (SELECT *, CASE WHEN h = 0 AND k = 0 THEN 'bootstrap' WHEN h = 1 THEN 'reset' ELSE '' END AS t FROM
    (SELECT event_id, k, (event_id * 7 + k * 3) % 10 AS h FROM events, (SELECT unnest([0, 1, 2]) AS k) WHERE (event_id + k) % 2 = 0))),
ok AS (SELECT *, type = 'bootstrap' OR (type = 'reset' AND event_id <> '') OR (type = '' AND event_id <> '' AND status <> 'pending') AS valid FROM lg),
latest AS (SELECT event_id, status, reason FROM (SELECT event_id, arg_max(type, line_no) AS t, arg_max(status, line_no) AS status, arg_max(reason, line_no) AS reason
  FROM ok WHERE valid AND type <> 'bootstrap' GROUP BY event_id) WHERE t <> 'reset')"""


def values_sql(name: str, columns: str, rows: list[tuple]) -> str:
    """The same rows as a CTE."""

    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, str):
            return "'" + v.replace("'", "''").replace("\n", "'||chr(10)||'").replace("\t", "'||chr(9)||'").replace("\r", "'||chr(13)||'") + "'"
        return str(v)

    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"
