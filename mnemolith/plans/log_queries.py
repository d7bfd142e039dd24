"""Queries over the event log, its status log, and batches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import parse_time, redact
from ..operators import batching, guards, log
from ..sources.files import EVENT_SCHEMA, append_events, read_events
from ..sources.tables import shared_dir
from ..streaming.flush import FlushLoop
from .views import CTX, PAGES, RAW, STATUS, pages, raw_events, status_log, table

EPOCH = "2024-01-10 00:00:00"


def _pending(spark, sf_dir):
    return log.pending_events(raw_events(spark, sf_dir), log.latest_status(status_log(spark, sf_dir)))


def _sized(spark, sf_dir):
    e = raw_events(spark, sf_dir)
    return e.withColumn("bytes", batching.event_bytes(F.col("content"), batching.context_map())).withColumn("created_at", parse_time(F.col("timestamp")))


#: Rows of every form, made of the events and documents; the same text is Spark's and DuckDB's.
ODD_TIMES = """seq AS i; CASE seq % 9 WHEN 0 THEN '' WHEN 1 THEN replace(t0, 'Z', '+02:00') WHEN 2 THEN substr(t0, 1, 10) WHEN 3 THEN replace(t0, 'T', ' ')
  WHEN 4 THEN replace(t0, 'Z', '') WHEN 5 THEN replace(t0, 'Z', '.123456Z') WHEN 6 THEN 'x' || t0 WHEN 7 THEN replace(t0, 'Z', '-05:30') ELSE t0 END AS t"""
ODD_SECRETS = """doc_id AS i; CASE doc_id % 7 WHEN 0 THEN 'key sk-abcdefghij ' || text WHEN 1 THEN text || ' sk_live-' || doc_id || '0123456789' WHEN 2 THEN 'ask-abcdefghij ' || text
  WHEN 3 THEN text || 'é' || 'sk-abcdefghij' WHEN 4 THEN text || ' sk-short' WHEN 5 THEN 'a sk-aaaaaaaaaa_b, sk_bbbbbbbbbbbb.' || text ELSE text END AS t"""
ODD_LINES = """seq AS line_no; CASE seq % 10 WHEN 0 THEN 'EVENT ' || id || ' INTEGRATED pages: semantic/' || seq || '.md, b.md' WHEN 1 THEN 'EVENT ' || id || ' SKIPPED reason: ' || content
  WHEN 2 THEN '  EVENT  ' || id || '  FAILED reason: no idea  ' WHEN 3 THEN 'EVENT evt_' || (seq - 2) || ' INTEGRATED pages: later/line.md' WHEN 4 THEN 'EVENT ' || id || ' INTEGRATED pages: ,'
  WHEN 5 THEN 'EVENT ' || id || ' SKIPPED because' WHEN 6 THEN 'EVENT x' || id || ' INTEGRATED pages: x.md' WHEN 7 THEN content WHEN 8 THEN 'EVENT ' || id || ' SKIPPED reason:'
  ELSE 'EVENT ' || id || ' FAILED reason:' || content END AS line"""
ODD_STATES = """event_id; event_id % 13 = 0 AS suspended; CAST(CASE WHEN event_id % 5 = 0 THEN user_id % 3 ELSE 0 END AS INT) AS in_progress; CAST(event_id % 6 - 1 AS INT) AS pending; CAST(user_id % 4 AS INT) AS deferred;
  CAST(CASE WHEN event_id % 7 > 0 THEN event_id % 2 END AS INT) AS last_succeeded; CAST(user_id % 2 AS INT) AS failures; event_id % 11 = 0 AS index_stale; CAST(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS INT) AS write_errors"""
ODD_ERRORS = """event_id; CAST(event_id % 20 AS INT) AS i; CASE event_id % 9 WHEN 0 THEN 'Context deadline exceeded' WHEN 1 THEN 'API error 429: ' || props WHEN 2 THEN 'api error 400: bad' WHEN 3 THEN 'unexpected EOF'
  WHEN 4 THEN 'broken pipe' WHEN 5 THEN 'no such host' WHEN 6 THEN 'Timeout awaiting ' || event_type WHEN 7 THEN '' ELSE event_type END AS t"""


def _odd(df, columns: str):
    return df.selectExpr(*columns.split(";"))


def _sql(columns: str) -> str:
    return columns.replace(";", ",")


def _trace(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    name = F.col("event_type")
    return e.select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("call_no"), F.when(name == "click", "view").otherwise(name).alias("name"), F.lit("x").alias("input"), (name != "purchase").alias("read_only"), F.when(F.col("event_id") % 2 == 0, "failed").alias("error"))


_TRACE = "tr AS (SELECT user_id AS trace_id, event_id AS call_no, CASE WHEN event_type = 'click' THEN 'view' ELSE event_type END AS name, event_type <> 'purchase' AS read_only, CASE WHEN event_id % 2 = 0 THEN 'failed' END AS error FROM events)"

def _flush_statuses(spark, sf_dir):
    """The statuses that one run of the integration loop over the whole log leaves: some events fail, some are
    skipped, some aren't reported."""
    said = F.expr("CASE WHEN text LIKE 'error %' THEN 'failed_by_agent' WHEN text LIKE 'view %' THEN 'skipped' ELSE 'integrated' END")
    decide = lambda batches: batches.where("text NOT LIKE 'signup %'").select(F.col("id").alias("event_id"), said.alias("status"), F.substring("text", 1, 9).alias("reason"))
    loop = FlushLoop(spark, f"{shared_dir(spark)}/flush-{uuid.uuid4().hex}", decide, max_events=20, max_bytes=2_000, max_tokens=450)
    events = raw_events(spark, sf_dir)
    loop.on_batch(events.select(*(F.col(f.name).cast(f.dataType) if f.name in events.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA.fields)), 0)
    return spark.read.schema("event_id string, status string, reason string, batch_id string").parquet(f"{loop.root}/status")


def _logged_since(spark, sf_dir):
    """The events appended as a log in three parts, and read back past the first."""
    path, events = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}", raw_events(spark, sf_dir)
    part = F.floor(F.col("seq") % 3_000 / 1_000)
    for k in range(3):
        append_events(events.where(part == k).orderBy("seq").select("id", "timestamp", "content"), path)
    first = events.where(part == 0).count()
    return read_events(spark, path, first).select("seq", "id", "content")


QUERIES = {
    "events_since_cursor": (lambda s, d: log.events_since(raw_events(s, d), 900).select("seq", "id", "content"), f"WITH {RAW} SELECT seq, id, content FROM raw WHERE seq >= 900"),
    "cursor_after_read": (lambda s, d: log.next_cursor(raw_events(s, d)), "SELECT count(*) AS new_cursor FROM events"),
    "recent_events": (lambda s, d: log.recent_events(raw_events(s, d), 10).orderBy("seq").select("seq", "id"), f"WITH {RAW} SELECT seq, id FROM raw ORDER BY seq DESC LIMIT 10"),
    "event_by_id": (lambda s, d: log.event_by_id(raw_events(s, d), "evt_77").select("seq", "id", "content"), f"WITH {RAW} SELECT seq, id, content FROM raw WHERE id = 'evt_77' ORDER BY seq LIMIT 1"),
    "event_truncated": (lambda s, d: log.bounded_content(raw_events(s, d), 40).select("id", "content"), f"WITH {RAW} SELECT id, CASE WHEN strlen(content) > 40 THEN substr(content, 1, 40) || '... [truncated]' ELSE content END AS content FROM raw"),
    "parse_times": (
        lambda s, d: _odd(raw_events(s, d).withColumnRenamed("timestamp", "t0"), ODD_TIMES).select("i", parse_time(F.col("t")).alias("at")),
        f"WITH {RAW}, v AS (SELECT {_sql(ODD_TIMES)} FROM (SELECT *, \"timestamp\" AS t0 FROM raw)) SELECT i, CASE WHEN regexp_matches(t, '^\\d{{4}}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\d(\\.\\d+)?(Z|[+-]\\d\\d:\\d\\d)\\z') THEN TRY_CAST(t AS TIMESTAMPTZ) AT TIME ZONE 'UTC' END AS at FROM v",
    ),
    "normalize_context": (lambda s, d: raw_events(s, d).select("id", batching.serialized(batching.context_map()).alias("context")), f"WITH {RAW}, {CTX} SELECT id, context FROM ctx"),
    "event_byte_size": (lambda s, d: _sized(s, d).select("id", "bytes"), f"WITH {RAW}, {CTX} SELECT id, bytes FROM sized"),
    "batch_id_hash": (
        lambda s, d: raw_events(s, d).groupBy("session_id").agg(batching.batch_id(F.collect_list("id")).alias("batch_id")),
        f"WITH {RAW} SELECT session_id, substr(sha256(string_agg(id, ',' ORDER BY id)), 1, 16) AS batch_id FROM raw GROUP BY session_id",
    ),
    "greedy_batches": (
        lambda s, d: batching.greedy_batches(_sized(s, d), 20, 2_000, 450).select("id", "batch_no", "batch_id", "pos"),
        f"""WITH RECURSIVE {RAW}, {CTX}, o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY created_at, id) AS n, id, bytes FROM sized),
g(n, id, bytes, no, c, b, t) AS (SELECT n, id, bytes, 0::BIGINT, 1, bytes, bytes // 4 FROM o WHERE n = 1 UNION ALL
SELECT o.n, o.id, o.bytes, CASE WHEN x THEN g.no + 1 ELSE g.no END, CASE WHEN x THEN 1 ELSE c + 1 END, CASE WHEN x THEN o.bytes ELSE b + o.bytes END, CASE WHEN x THEN o.bytes // 4 ELSE t + o.bytes // 4 END
FROM g JOIN o ON o.n = g.n + 1, LATERAL (SELECT c + 1 > 20 OR b + o.bytes > 2000 OR t + o.bytes // 4 > 450 AS x)),
i AS (SELECT no, substr(sha256(string_agg(id, ',' ORDER BY id)), 1, 16) AS batch_id FROM g GROUP BY no)
SELECT id, g.no AS batch_no, batch_id, (row_number() OVER (PARTITION BY g.no ORDER BY n) - 1)::INT AS pos FROM g JOIN i ON g.no = i.no""",
    ),
    "batch_totals": (
        lambda s, d: batching.batch_totals(_sized(s, d).withColumn("batch_no", F.floor(F.col("seq") / 20)).withColumn("batch_id", F.col("batch_no").cast("string"))),
        f"WITH {RAW}, {CTX} SELECT seq // 20 AS batch_no, (seq // 20)::VARCHAR AS batch_id, count(*) AS events, sum(bytes)::BIGINT AS bytes, sum(bytes // 4)::BIGINT AS tokens FROM sized GROUP BY ALL",
    ),
    "log_cursor_read": (
        _logged_since,
        f"WITH {RAW}, p AS (SELECT row_number() OVER (ORDER BY seq % 3000 // 1000, seq) - 1 AS n, seq % 3000 // 1000 AS k, id, content FROM raw) SELECT n AS seq, id, content FROM p WHERE k > 0",
    ),
    "status_latest": (lambda s, d: log.latest_status(status_log(s, d)), f"WITH {STATUS} SELECT * FROM latest"),
    "status_log_health": (
        lambda s, d: log.log_health(status_log(s, d)),
        f"WITH {STATUS} SELECT count(*) AS total, count_if(valid)::BIGINT AS valid, count_if(NOT valid)::BIGINT AS skipped, CASE WHEN count_if(valid) = 0 THEN 'unparseable' WHEN count_if(NOT valid) > 10 AND count_if(NOT valid) * 10 > count(*) THEN 'corrupt' ELSE 'accepted' END AS verdict FROM ok",
    ),
    "pending_events": (
        lambda s, d: _pending(s, d).select("id", "created_at"),
        f"WITH {RAW}, {STATUS} SELECT id, created_at FROM raw WHERE id NOT IN (SELECT event_id FROM latest)",
    ),
    "status_counts": (
        lambda s, d: log.status_counts(raw_events(s, d), log.latest_status(status_log(s, d))),
        f"WITH {RAW}, {STATUS} SELECT count_if(status = 'integrated')::BIGINT AS integrated, count_if(status = 'skipped')::BIGINT AS skipped, count_if(status = 'failed')::BIGINT AS failed, count_if(status = 'unknown')::BIGINT AS unknown, count_if(status IS NULL)::BIGINT AS pending, count(*) AS total FROM raw LEFT JOIN latest ON id = event_id",
    ),
    "bootstrap_epoch": (
        lambda s, d: log.bootstrap_records(raw_events(s, d), EPOCH),
        f"WITH {RAW} SELECT 'bootstrap' AS type, '' AS event_id, '' AS status, '' AS reason, '{EPOCH}' AS epoch UNION ALL SELECT '', id, 'integrated', 'pre_epoch_bootstrap', '' FROM raw WHERE created_at < TIMESTAMP '{EPOCH}'",
    ),
    "crash_recovery": (
        lambda s, d: log.recovered_events(pages(s, d).select("path", F.format_string("<!-- compiled_from: evt_%d, evt_%d,evt_%d -->\n%s", "doc_id", F.col("doc_id") * 3, F.col("doc_id") + 5000000, "content").alias("content")), _pending(s, d)),
        f"WITH {RAW}, {STATUS}, {PAGES}, r AS (SELECT DISTINCT 'evt_' || unnest([doc_id, doc_id * 3, doc_id + 5000000]) AS id FROM pg) SELECT id AS event_id, 'unknown' AS status, 'recovered_from_frontmatter' AS reason FROM raw WHERE id NOT IN (SELECT event_id FROM latest) AND id IN (SELECT id FROM r)",
    ),
    "remember_projection": (
        lambda s, d: log.remember(raw_events(s, d).select("content", F.create_map(F.lit("actor"), "actor", F.lit("extra"), "session_id").alias("context"), F.when(F.col("seq") % 2 == 0, "").otherwise("tool").alias("source_type"), F.lit(None).cast("string").alias("evidence_kind"), (F.col("seq") % 4).cast("int").alias("trust_tier"))),
        f"""WITH {RAW} SELECT content, actor, '' AS source, '' AS session_id, '' AS active_project, '' AS active_task, '{{"actor":"' || actor || '","extra":"' || session_id || '"}}' AS context_json, CASE WHEN seq % 2 = 0 THEN 'user' ELSE 'tool' END AS source_type, 'user_statement' AS evidence_kind, CASE WHEN seq % 4 = 0 THEN 1 ELSE (seq % 4)::INT END AS trust_tier FROM raw""",
    ),
    "remember_tool_projection": (
        lambda s, d: log.remember_from_tool(raw_events(s, d).select("content", F.when(F.col("seq") % 2 == 0, "").otherwise("tool").alias("source_type"), F.lit("").alias("evidence_kind"), (F.col("seq") % 4).cast("int").alias("trust_tier"))),
        f"WITH {RAW} SELECT content, CASE WHEN seq % 2 = 0 THEN 'assistant' ELSE 'tool' END AS source_type, 'direct_observation' AS evidence_kind, CASE WHEN seq % 4 = 0 THEN 2 ELSE (seq % 4)::INT END AS trust_tier FROM raw",
    ),
    "admin_transitions": (
        lambda s, d: log.latest_status(status_log(s, d)).select("event_id", F.explode(F.array(F.lit("reset"), F.lit("confirm"))).alias("action"), "status").select("event_id", "action", log.transition(F.col("action"), F.col("status")).alias("result")),
        f"WITH {STATUS}, a AS (SELECT event_id, status, unnest(['reset', 'confirm']) AS action FROM latest) SELECT event_id, action, CASE WHEN action = 'reset' AND status IN ('unknown', 'failed') THEN 'pending' WHEN action = 'confirm' AND status = 'unknown' THEN 'integrated' ELSE 'refused: ' || action || ' from ' || status END AS result FROM a",
    ),
    "redact": (
        lambda s, d: _odd(table(s, d, "documents"), ODD_SECRETS).select("i", redact(F.col("t")).alias("t")),
        f"WITH v AS (SELECT {_sql(ODD_SECRETS)} FROM documents) SELECT i, regexp_replace(regexp_replace(t, '\\bsk-[A-Za-z0-9][A-Za-z0-9_-]{{8,}}\\b', 'sk_<redacted>', 'g'), '\\bsk_[A-Za-z0-9][A-Za-z0-9_-]{{8,}}\\b', 'sk_<redacted>', 'g') AS t FROM v",
    ),
    "parse_results": (
        lambda s, d: batching.results_of_batch(raw_events(s, d).select("id"), _odd(raw_events(s, d), ODD_LINES)).withColumn("pages", F.array_join("pages", "|")),
        f"""WITH {RAW}, v AS (SELECT {_sql(ODD_LINES)} FROM raw), b AS (SELECT id AS event_id FROM raw),
x AS (SELECT line_no AS n, regexp_extract(trim(line), '^EVENT\\s+(\\S+)\\s+(INTEGRATED|SKIPPED|FAILED)\\s+(.+)\\z', ['e', 'w', 'r']) AS m FROM v),
y AS (SELECT n, m.e AS e, m.w AS w, list_filter(list_transform(string_split(substr(m.r, 7), ','), lambda p: trim(p)), lambda p: p <> '') AS pages, m.r AS r FROM x WHERE m.w <> ''),
z AS (SELECT n, e, CASE w WHEN 'INTEGRATED' THEN 'integrated' WHEN 'SKIPPED' THEN 'skipped' ELSE 'failed_by_agent' END AS status, CASE WHEN w = 'INTEGRATED' THEN array_to_string(pages, '|') ELSE '' END AS pages, CASE WHEN w = 'INTEGRATED' THEN '' ELSE trim(substr(r, 8)) END AS reason
  FROM y WHERE (w = 'INTEGRATED' AND r LIKE 'pages:%' AND len(pages) > 0) OR (w <> 'INTEGRATED' AND r LIKE 'reason:%' AND trim(substr(r, 8)) <> ''))
SELECT b.event_id, coalesce(arg_max(status, n), 'unknown') AS status, coalesce(arg_max(pages, n), '') AS pages, coalesce(arg_max(reason, n), 'not reported by agent') AS reason FROM b LEFT JOIN z ON b.event_id = e GROUP BY b.event_id""",
    ),
    "split_suspects": (
        lambda s, d: batching.split_batch(_sized(s, d).select(F.floor(F.col("seq") / 8).alias("batch_no"), (F.col("seq") % 8).alias("pos"), "id", (F.floor(F.col("seq") / 8) % 3).alias("depth")), raw_events(s, d).where("seq % 24 = 3").select("id")),
        f"""WITH {RAW}, b AS (SELECT seq // 8 AS batch_no, seq % 8 AS pos, id, (seq // 8) % 3 AS depth, seq % 24 = 3 AS suspect FROM raw),
w AS (SELECT *, count(*) OVER (PARTITION BY batch_no) AS n, count_if(suspect) OVER (PARTITION BY batch_no) AS k FROM b)
SELECT batch_no, id, depth + 1 AS depth, CASE WHEN k > 0 AND k < n THEN suspect::INT ELSE (pos >= n // 2)::INT END AS part FROM w WHERE n > 5 AND depth < 2""",
    ),
    "batch_prompts": (
        lambda s, d: batching.batch_prompt(_sized(s, d).select(F.floor(F.col("seq") / 20).alias("batch_no"), (F.col("seq") % 20).alias("pos"), "id", "created_at", batching.context_map().alias("context"), F.col("content").alias("text")), "Report one line per event."),
        f"WITH {RAW}, {CTX} SELECT seq // 20 AS batch_no, string_agg('### Event ' || (seq % 20 + 1) || ': ' || id || chr(10) || 'Timestamp: ' || \"timestamp\" || chr(10) || 'Context: ' || context || chr(10) || content || chr(10), chr(10) ORDER BY seq) || 'Report one line per event.' AS prompt FROM ctx GROUP BY ALL",
    ),
    "health_case": (
        lambda s, d: _odd(table(s, d, "events"), ODD_STATES).withColumn("health", guards.health()),
        f"""WITH v AS (SELECT {_sql(ODD_STATES)} FROM events), t AS (SELECT *, greatest(CASE WHEN pending = -1 THEN 1 ELSE pending END - deferred, 0) AS todo FROM v)
SELECT * EXCLUDE (todo), CASE WHEN suspended AND in_progress = 0 THEN 'suspended' WHEN todo > 0 AND in_progress = 0 AND last_succeeded = 0 THEN 'stuck' WHEN in_progress > 0 OR todo > 0 THEN 'in_progress'
WHEN failures > 0 OR index_stale OR write_errors > 0 OR deferred > 0 THEN 'degraded' ELSE 'healthy' END AS health FROM t""",
    ),
    "retry_policy": (
        lambda s, d: _odd(table(s, d, "events"), ODD_ERRORS).select("event_id", guards.retryable(F.col("t")).alias("retry"), guards.retry_delay(F.col("i") + 1).alias("delay"), guards.batch_timeout(F.col("i")).alias("timeout")),
        f"WITH v AS (SELECT {_sql(ODD_ERRORS)} FROM events) SELECT event_id, regexp_matches(lower(t), 'context deadline exceeded|timeout|temporary|eof|connection reset|connection refused|broken pipe|api error (429|500|502|503|504)') AS retry, (2 * pow(2, i))::BIGINT AS delay, least(greatest(600, i * 90), 600)::INT AS timeout FROM v",
    ),
    "repeat_guard": (
        lambda s, d: guards.repeated_reads(_trace(s, d), 2),
        f"""WITH {_TRACE}, e AS (SELECT *, coalesce(sum((NOT read_only AND error IS NULL)::INT) OVER (PARTITION BY trace_id ORDER BY call_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ep FROM tr),
r AS (SELECT *, coalesce(lag(name) OVER (PARTITION BY trace_id, ep ORDER BY call_no) <> name, true) AS fresh FROM e WHERE read_only),
g AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY trace_id, ep ORDER BY call_no) AS run FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY trace_id, ep, run ORDER BY call_no) AS n FROM g) SELECT trace_id, min(call_no) AS call_no FROM n WHERE n > 2 GROUP BY trace_id""",
    ),
    "invalid_guard": (
        lambda s, d: guards.consecutive(_trace(s, d), F.col("name") == "view", 3),
        f"""WITH {_TRACE}, g AS (SELECT *, sum((name <> 'view')::INT) OVER (PARTITION BY trace_id ORDER BY call_no) AS run FROM tr),
n AS (SELECT *, row_number() OVER (PARTITION BY trace_id, run ORDER BY call_no) AS n FROM g WHERE name = 'view') SELECT trace_id, min(call_no) AS call_no FROM n WHERE n > 3 GROUP BY trace_id""",
    ),
    "deferred_items": (
        lambda s, d: guards.deferred_items(_trace(s, d).select(F.col("trace_id").alias("item"), F.col("call_no").alias("at_no"), F.col("name").isin("view", "signup", "error").alias("ok")).withColumn("ok", F.col("ok") & (F.col("at_no") % 5 != 0)), 2),
        f"WITH {_TRACE}, a AS (SELECT trace_id AS item, call_no AS at_no, name IN ('view', 'signup', 'error') AND call_no % 5 <> 0 AS ok FROM tr), l AS (SELECT *, coalesce(max(CASE WHEN ok THEN at_no END) OVER (PARTITION BY item), -1) AS last FROM a) SELECT item, count_if(NOT ok AND at_no > last)::BIGINT AS failures FROM l GROUP BY item HAVING count_if(NOT ok AND at_no > last) >= 2",
    ),
    "compile_cursor": (
        lambda s, d: guards.compile_cursor(_trace(s, d).select("call_no", (F.col("call_no") % 4).alias("cursor"), (F.col("call_no") + 40).alias("new_cursor"), "error"), 3, 42),
        f"WITH {_TRACE} SELECT greatest(3, least(coalesce(arg_min(call_no + 40, call_no), 3), 42)) AS cursor FROM tr WHERE call_no % 4 = 3 AND error IS NULL",
    ),
}

QUERIES["flush_statuses"] = (
    _flush_statuses,
    f"""SELECT id AS event_id, batch_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped' WHEN 'signup' THEN 'unknown' ELSE 'integrated' END AS status,
CASE WHEN event_type = 'signup' THEN 'not reported' ELSE substr(event_type || ' by ' || user_id, 1, 9) END AS reason FROM ({QUERIES["greedy_batches"][1]}) JOIN events ON id = 'evt_' || event_id""",
)
