"""Queries over the surfaces: checks, text forms, flush bookkeeping, manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import codefacts, guards, log, surface
from ..operators import pages as pg
from .views import PAGES, RAW, STATUS, pages, raw_events, status_log, table

#: Rows of every form, made of the tables' own; the same text is Spark's and DuckDB's.
ODD_REQUESTS = """event_id AS i; CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN event_type WHEN 3 THEN 'compiler' WHEN 4 THEN 'tool' ELSE 'user' END AS s;
  CASE user_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'guess' WHEN 3 THEN 'inferred' ELSE 'user_statement' END AS k; CAST(CASE WHEN event_id % 7 > 0 THEN event_id % 5 END AS INT) AS t"""
ODD_SCOPES = """doc_id AS i; CASE doc_id % 9 WHEN 0 THEN '' WHEN 1 THEN '.' WHEN 2 THEN './' || path WHEN 3 THEN replace(path, '/', '//') || '/' WHEN 4 THEN '../' || path
  WHEN 5 THEN path || '/../../../../..' WHEN 6 THEN '/' || path WHEN 7 THEN ' ' || path || ' ' ELSE path || '/..' END AS x"""
ODD_REMOTES = """page_id AS i; CASE page_id % 6 WHEN 0 THEN 'git@host:team/r' || page_id || '.git' WHEN 1 THEN url || '/' WHEN 2 THEN 'host:r' || page_id WHEN 3 THEN NULL WHEN 4 THEN '' ELSE 'plain' END AS r; '/x/y' || page_id || '/' AS f"""
ODD_RECEIVERS = """event_id AS i; CASE event_id % 5 WHEN 0 THEN '*' || event_type WHEN 1 THEN event_type WHEN 2 THEN ' *pkg.' || event_type WHEN 3 THEN 'a.b.' || event_type ELSE '*' END AS r"""


def _odd(df, columns: str):
    return df.selectExpr(*columns.split(";"))


def _sql(columns: str) -> str:
    return columns.replace(";", ",")


def _results(s, d):
    """Events as flush results: every seventh batch failed."""
    e = table(s, d, "events")
    batch = F.floor(F.col("event_id") / 20)
    status = F.get(F.array(*(F.lit(x) for x in ("integrated", "skipped", "failed_by_agent", "unknown"))), (F.col("event_id") % 4).cast("int"))
    page = F.concat(F.lit("./semantic//p"), (F.col("event_id") % 300).cast("string"), F.lit(".md"))
    return e.select(batch.cast("string").alias("batch_id"), F.when(batch % 7 == 0, "failed").otherwise("success").alias("batch_status"), F.concat(F.lit("evt_"), F.col("event_id").cast("string")).alias("event_id"), status.alias("status"), F.array(page).alias("pages"))


_RES = """rs AS (SELECT (event_id // 20)::VARCHAR AS batch_id, CASE WHEN (event_id // 20) % 7 = 0 THEN 'failed' ELSE 'success' END AS batch_status, 'evt_' || event_id AS event_id,
  ['integrated', 'skipped', 'failed_by_agent', 'unknown'][(event_id % 4 + 1)::INT] AS status, 'semantic/p' || (event_id % 300) || '.md' AS page FROM events)"""

QUERIES = {
    "request_checks": (
        lambda s, d: _odd(table(s, d, "events"), ODD_REQUESTS).select("i", surface.request_error(F.col("s"), F.col("k"), F.col("t")).alias("error")),
        f"""WITH v AS (SELECT {_sql(ODD_REQUESTS)} FROM events) SELECT i, CASE WHEN s <> '' AND s NOT IN ('user', 'assistant', 'tool', 'system', 'compiler') THEN 'invalid source_type'
WHEN k <> '' AND k NOT IN ('direct_observation', 'user_statement', 'inferred', 'compiler_synthesis') THEN 'invalid evidence_kind' WHEN t < 1 OR t > 3 THEN 'invalid trust_tier: must be 1, 2, or 3' ELSE '' END AS error FROM v""",
    ),
    "concept_text": (
        lambda s, d: surface.concept_text(pages(s, d).select("path", "content", F.when(F.col("doc_id") % 3 > 0, F.struct(F.when(F.col("doc_id") % 2 == 0, "semantic").otherwise("").alias("memory_type"), (F.col("doc_id") % 4).cast("int").alias("trust_tier_max"), F.array(F.lit("e1"), F.lit("e2")).alias("source_events"), F.lit("").alias("last_accessed"))).alias("telemetry"))),
        f"""WITH {PAGES} SELECT path, '# ' || path || chr(10) || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE CASE WHEN doc_id % 2 = 0 THEN 'Memory type: semantic' || chr(10) ELSE '' END ||
CASE WHEN doc_id % 4 > 0 THEN 'Trust tier: T' || (doc_id % 4) || chr(10) ELSE '' END || 'Sources: e1, e2' || chr(10) || chr(10) || '---' || chr(10) || chr(10) END || content AS text FROM pg""",
    ),
    "status_text": (
        lambda s, d: surface.status_text(pg.memory_stats(pages(s, d), table(s, d, "events"), 7)),
        f"""WITH {PAGES} SELECT '{{' || chr(10) || '  "events": ' || (SELECT count(*) FROM events) || ',' || chr(10) || '  "uncompiled": ' || (SELECT count(*) - 7 FROM events) || ',' || chr(10) || '  "pages": ' || count_if(path NOT LIKE 'archive/%') || ',' || chr(10) || '  "archived": ' || count_if(path LIKE 'archive/%') || chr(10) || '}}' AS text FROM pg""",
    ),
    "recall_prompt": (
        lambda s, d: surface.recall_prompt("What now?", log.recent_events(raw_events(s, d).withColumn("active_task", F.when(F.col("seq") % 2 == 0, "t").otherwise("")), 10)),
        f"""WITH {RAW}, r AS (SELECT * FROM raw ORDER BY seq DESC LIMIT 10) SELECT 'Recall/answer this question:' || chr(10) || chr(10) || 'What now?' || chr(10) || chr(10) || '---' || chr(10) || 'Recent events (may not be in wiki yet):' || chr(10) ||
string_agg('[' || id || '] ' || content || CASE WHEN seq % 2 = 0 THEN '  task=t' ELSE '' END || chr(10), '' ORDER BY seq) AS prompt FROM r""",
    ),
    "suspect_events": (
        lambda s, d: surface.suspect_events(_results(s, d), table(s, d, "events").where("event_id % 30 = 8").selectExpr("'./semantic/p' || (event_id % 300) || '.md' AS path")),
        f"WITH {_RES} SELECT event_id FROM rs WHERE status = 'integrated' AND page IN (SELECT 'semantic/p' || (event_id % 300) || '.md' FROM events WHERE event_id % 30 = 8)",
    ),
    "deferred_sets": (
        lambda s, d: (lambda p, f: surface.prune_deferred(f, p).withColumn("set", F.lit("deferred")).unionByName(surface.actionable(p, f).select("id").withColumn("set", F.lit("actionable"))))(log.pending_events(raw_events(s, d), log.latest_status(status_log(s, d))), raw_events(s, d).where("seq % 9 = 0").select("id")),
        f"WITH {RAW}, {STATUS}, p AS (SELECT id, seq FROM raw WHERE id NOT IN (SELECT event_id FROM latest)) SELECT id, CASE WHEN seq % 9 = 0 THEN 'deferred' ELSE 'actionable' END AS set FROM p",
    ),
    "reconcile_pending": (
        lambda s, d: surface.reconcile(raw_events(s, d).where("seq % 3 <> 0"), raw_events(s, d).where("seq % 3 <> 1"), log.latest_status(status_log(s, d))),
        f"WITH {RAW}, {STATUS} SELECT id FROM raw WHERE id NOT IN (SELECT event_id FROM latest)",
    ),
    "flush_counters": (
        lambda s, d: surface.flush_counters(_results(s, d)),
        f"WITH {_RES} SELECT count(DISTINCT CASE WHEN batch_status = 'success' THEN batch_id END) AS batches_succeeded, count(DISTINCT CASE WHEN batch_status = 'failed' THEN batch_id END) AS batches_failed, count_if(batch_status = 'success' AND status = 'integrated')::BIGINT AS integrated, count_if(batch_status = 'success' AND status = 'skipped')::BIGINT AS skipped, count_if(batch_status = 'failed' OR status = 'failed_by_agent')::BIGINT AS failed, count_if(batch_status = 'success' AND status = 'unknown')::BIGINT AS unknown FROM rs",
    ),
    "progress_lines": (
        lambda s, d: surface.progress_lines(_results(s, d)),
        f"""WITH {_RES} SELECT '{{"batch_id":"' || batch_id || '","status":"' || batch_status || '","events":' || count(*) || '}}' AS line FROM rs GROUP BY batch_id, batch_status""",
    ),
    "failure_classes": (
        lambda s, d: table(s, d, "events").selectExpr("event_id AS i", "CAST(event_id % 3 AS INT) AS v", "event_id % 5 = 0 AS d", "CASE WHEN event_id % 2 = 0 THEN event_type END AS e").select("i", surface.error_class(F.col("v"), F.col("d")).alias("class"), guards.failure_reason(F.col("d"), F.col("v"), F.col("e")).alias("reason")),
        "WITH v AS (SELECT event_id AS i, event_id % 3 AS v, event_id % 5 = 0 AS d, CASE WHEN event_id % 2 = 0 THEN event_type END AS e FROM events) SELECT i, CASE WHEN v > 0 THEN 'validation' WHEN d THEN 'timeout' ELSE 'crash' END AS class, CASE WHEN d THEN 'batch_timeout_at_max_depth' WHEN v > 0 THEN 'collateral: bisect terminal with poison event' WHEN e IS NOT NULL THEN 'batch_crash_at_max_depth: ' || e ELSE 'batch_failed_at_max_depth' END AS reason FROM v",
    ),
    "consecutive_errors": (
        lambda s, d: guards.consecutive(_results(s, d).select(F.lit(0).alias("trace_id"), F.col("batch_id").cast("int").alias("call_no"), "batch_status").distinct().withColumn("bad", F.col("call_no") % 10 > 5), F.col("bad"), 2),
        "SELECT 0 AS trace_id, min(n)::INT AS call_no FROM (SELECT DISTINCT event_id // 20 AS n FROM events) WHERE n % 10 = 8",
    ),
    "next_runs": (
        lambda s, d: table(s, d, "events").select("event_id", guards.next_run(F.col("event_id") % 5, F.col("event_id") % 7 == 0, F.col("user_id") % 5).alias("next_run")),
        "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'stay suspended' WHEN event_id % 5 > user_id % 5 THEN 'resume later' ELSE 'idle' END AS next_run FROM events",
    ),
    "scan_manifest": (
        lambda s, d: surface.scan_manifest(pages(s, d).select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("id")), pages(s, d).select("path", F.when(F.col("doc_id") % 5 > 0, F.sha2("content", 256)).alias("hash")), codefacts.file_sets(pages(s, d).select(F.when(F.col("doc_id") % 2 == 0, "D").otherwise("M").alias("status"), F.col("path").alias("old_path"), F.lit("").alias("new_path")))).select(F.md5(F.array_join("fact_ids", ",")).alias("facts"), F.md5(F.array_join(F.transform(F.map_entries("file_hashes"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")).alias("hashes"), F.md5(F.array_join("changed", ",")).alias("changed"), F.md5(F.array_join("deleted", ",")).alias("deleted")),
        f"WITH {PAGES} SELECT md5(string_agg('f' || doc_id, ',' ORDER BY 'f' || doc_id)) AS facts, md5(string_agg(CASE WHEN doc_id % 5 > 0 THEN path || '=' || sha256(content) END, ',' ORDER BY path)) AS hashes, md5(string_agg(CASE WHEN doc_id % 2 > 0 THEN path END, ',' ORDER BY path)) AS changed, md5(string_agg(CASE WHEN doc_id % 2 = 0 THEN path END, ',' ORDER BY path)) AS deleted FROM pg",
    ),
    "scan_manifest_parts": (
        lambda s, d: surface.scan_manifest_parts(
            pages(s, d).select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("id")),
            pages(s, d).select("path", F.when(F.col("doc_id") % 5 > 0, F.sha2("content", 256)).alias("hash")),
            codefacts.file_sets(pages(s, d).select(F.when(F.col("doc_id") % 2 == 0, "D").otherwise("M").alias("status"), F.col("path").alias("old_path"), F.lit("").alias("new_path"))),
            part_bytes=4096,
        ).drop("path"),
        f"""WITH {PAGES}, l AS (SELECT 0 AS s, '' AS k, '{{"incremental":true}}' AS x
UNION ALL SELECT 1, 'f' || doc_id, '{{"fact_id":"f' || doc_id || '"}}' FROM pg UNION ALL SELECT 2, path, '{{"path":"' || path || '","hash":"' || sha256(content) || '"}}' FROM pg WHERE doc_id % 5 > 0
UNION ALL SELECT 3 + (doc_id % 2 = 0)::INT, path, '{{"' || CASE doc_id % 2 WHEN 0 THEN 'deleted' ELSE 'changed' END || '":"' || path || '"}}' FROM pg),
o AS (SELECT s, k, x || chr(10) AS line, sum(strlen(x) + 1) OVER (ORDER BY s, k) - strlen(x) - 1 AS b FROM l)
SELECT floor(b / 4096)::BIGINT AS part_no, min(b)::BIGINT AS begin, string_agg(line, '' ORDER BY s, k) AS content FROM o GROUP BY ALL""",
    ),
    "clean_scopes": (
        lambda s, d: _odd(pages(s, d), ODD_SCOPES).select("i", surface.clean_scope(F.col("x")).alias("scope")),
        f"WITH {PAGES} SELECT doc_id AS i, CASE WHEN doc_id % 9 < 2 THEN '.' WHEN doc_id % 9 IN (2, 3, 7) THEN path WHEN doc_id % 9 = 8 THEN array_to_string(string_split(path, '/')[:-2], '/') END AS scope FROM pg",
    ),
    "repo_names": (
        lambda s, d: _odd(table(s, d, "pages"), ODD_REMOTES).select("i", surface.repo_name(F.col("r"), F.col("f")).alias("name")),
        "SELECT page_id AS i, CASE WHEN page_id % 6 IN (0, 2) THEN 'r' || page_id WHEN page_id % 6 = 1 THEN string_split(rtrim(url, '/'), '/')[-1] ELSE 'y' || page_id END AS name FROM pages",
    ),
    "receiver_names": (
        lambda s, d: _odd(table(s, d, "events"), ODD_RECEIVERS).select("i", surface.receiver_name(F.col("r")).alias("name")),
        "SELECT event_id AS i, CASE WHEN event_id % 5 = 4 THEN '' ELSE event_type END AS name FROM events",
    ),
    "capture_triggers": (
        lambda s, d: table(s, d, "events").selectExpr("event_id AS i", "CASE event_id % 4 WHEN 0 THEN 'cron' WHEN 1 THEN 'heartbeat' WHEN 2 THEN event_type END AS t", "event_id % 3 <> 0 AS s").select("i", surface.capture_trigger(F.col("t"), F.col("s")).alias("captured")),
        "WITH v AS (SELECT event_id AS i, CASE event_id % 4 WHEN 0 THEN 'cron' WHEN 1 THEN 'heartbeat' WHEN 2 THEN event_type END AS t, event_id % 3 <> 0 AS s FROM events) SELECT i, s AND coalesce(t, '') NOT IN ('cron', 'heartbeat') AS captured FROM v",
    ),
}
