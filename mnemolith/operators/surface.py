"""What the store's surfaces add around the core relations: vocabulary checks, text forms, flush
bookkeeping, manifests and scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_all
from .parts import PART_BYTES, text_parts

#: The closed vocabularies of an event.
VOCABULARY = {
    "durability": ("ephemeral", "session", "long-term", "permanent"),
    "actionability": ("none", "informational", "actionable", "urgent"),
    "source_type": ("user", "assistant", "tool", "system", "compiler"),
    "evidence_kind": ("direct_observation", "user_statement", "inferred", "compiler_synthesis"),
}


def request_error(source_type: Column, evidence_kind: Column, trust_tier: Column) -> Column:
    """First refusal of a request's optional fields; null ones take defaults. Empty if none."""
    unset = lambda c: F.coalesce(c, F.lit("")) == ""
    return (
        F.when(~unset(source_type) & ~source_type.isin(*VOCABULARY["source_type"]), "invalid source_type")
        .when(~unset(evidence_kind) & ~evidence_kind.isin(*VOCABULARY["evidence_kind"]), "invalid evidence_kind")
        .when(F.coalesce((trust_tier < 1) | (trust_tier > 3), F.lit(False)), "invalid trust_tier: must be 1, 2, or 3")
        .otherwise("")
    )


def concept_text(pages: DataFrame) -> DataFrame:
    """``path, text``: a page with its telemetry in front; ``telemetry`` null leaves that out."""
    t = lambda x: F.col(f"telemetry.{x}")
    part = lambda ok, *x: F.when(F.coalesce(ok, F.lit(False)), F.concat(*x, F.lit("\n"))).otherwise("")
    head = F.concat(
        part(t("memory_type") != "", F.lit("Memory type: "), t("memory_type")),
        part(t("trust_tier_max") > 0, F.lit("Trust tier: T"), t("trust_tier_max").cast("string")),
        part(F.size(t("source_events")) > 0, F.lit("Sources: "), F.array_join(t("source_events"), ", ")),
        part(t("last_accessed") != "", F.lit("Last accessed: "), t("last_accessed")),
        F.lit("\n---\n\n"),
    )
    return pages.select("path", F.concat(F.lit("# "), "path", F.lit("\n\n"), F.when(F.col("telemetry").isNotNull(), head).otherwise(""), "content").alias("text"))


def neighbors_text(index: str) -> str:
    return index or "Wiki is empty. No knowledge pages yet."


def status_text(stats: DataFrame) -> DataFrame:
    """One row: the statistics as indented JSON."""
    fields = ("events", "uncompiled", "pages", "archived")
    body = F.concat_ws(",\n", *(F.concat(F.lit(f'  "{f}": '), F.col(f).cast("string")) for f in fields))
    return stats.select(F.concat(F.lit("{\n"), body, F.lit("\n}")).alias("text"))


def recall_prompt(question: str, recent: DataFrame) -> DataFrame:
    """One row: the question with recent events (seq, id, content, active_project, active_task); the
    number of those is bounded by the caller's limit."""
    extra = lambda c, k: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"  {k}="), F.col(c))).otherwise("")
    line = F.concat(F.lit("["), "id", F.lit("] "), "content", extra("active_project", "project"), extra("active_task", "task"), F.lit("\n"))
    lines = recent.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("s")))), lambda x: x["s"]), "").alias("e"))
    head = f"Recall/answer this question:\n\n{question}"
    more = "\n\n---\nRecent events (may not be in wiki yet):\n"
    return lines.select(F.concat(F.lit(head), F.when(F.col("e") != "", F.concat(F.lit(more), "e")).otherwise("")).alias("prompt"))


def suspect_events(results: DataFrame, violations: DataFrame) -> DataFrame:
    """Events whose integrated pages include a path with a violation, if that leaves others clean."""
    tidy = lambda c: F.regexp_replace(F.regexp_replace(c, "/+", "/"), "^\\./", "")
    pages = results.where("status = 'integrated'").select("event_id", F.explode("pages").alias("p")).select("event_id", tidy("p").alias("path"))
    bad = violations.where("path <> ''").select(tidy("path").alias("path")).distinct()
    hit = pages.join(bad, "path", "left_semi").select("event_id").distinct()
    clean = results.join(hit, "event_id", "left_anti").limit(1).select(F.lit(1).alias("k"))
    return hit.withColumn("k", F.lit(1)).join(clean, "k", "left_semi").drop("k")


def prune_deferred(deferred: DataFrame, pending: DataFrame) -> DataFrame:
    """Deferred ids that are still pending."""
    return deferred.join(pending.select("id"), "id", "left_semi")


def actionable(pending: DataFrame, deferred: DataFrame) -> DataFrame:
    """Pending events that aren't deferred."""
    return pending.join(deferred.select("id"), "id", "left_anti")


def reconcile(snapshot: DataFrame, notified: DataFrame, status: DataFrame) -> DataFrame:
    """Pending ids of a log snapshot united with those announced meanwhile, without terminal ones."""
    ids = snapshot.select("id").unionByName(notified.select("id")).distinct()
    return ids.join(status.select(F.col("event_id").alias("id")), "id", "left_anti")


def flush_counters(results: DataFrame) -> DataFrame:
    """One row of (batch_id, batch_status, event_id, status) results: batches and events by outcome.
    All events of a failed batch count as failed."""
    ok = F.col("batch_status") == "success"
    b = lambda s: F.count_distinct(F.when(F.col("batch_status") == s, F.col("batch_id")))
    e = lambda s: F.count_if(ok & (F.col("status") == s))
    return results.agg(
        b("success").alias("batches_succeeded"),
        b("failed").alias("batches_failed"),
        e("integrated").alias("integrated"),
        e("skipped").alias("skipped"),
        F.count_if(~ok | (F.col("status") == "failed_by_agent")).alias("failed"),
        e("unknown").alias("unknown"),
    )


def error_class(violations: Column, deadline: Column) -> Column:
    return F.when(violations > 0, "validation").when(deadline, "timeout").otherwise("crash")


def progress_lines(results: DataFrame) -> DataFrame:
    """One JSON line a batch for the progress log."""
    n = results.groupBy("batch_id", "batch_status").agg(F.count("*").alias("events"))
    return n.select(F.to_json(F.struct("batch_id", F.col("batch_status").alias("status"), "events")).alias("line"))


def scan_manifest(facts: DataFrame, files: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """One row: ids of all facts in order, hashes of present files, and the changed and deleted sets
    (null on a full scan). Ids are gathered per file first."""
    ids = facts.agg(F.array_sort(F.collect_list("id")).alias("fact_ids"))
    hashes = files.agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.coalesce("hash", F.lit("")) != "", F.struct("path", "hash"))))).alias("file_hashes"))
    one = lambda df: df.withColumn("k", F.lit(1))
    out = one(ids).join(one(hashes), "k")
    if changed is None:
        none = F.lit(None).cast("array<string>")
        return out.select("fact_ids", "file_hashes", none.alias("changed"), none.alias("deleted"))
    sets = changed.agg(*(F.array_sort(F.collect_set(F.when(F.col("change") == c, F.col("path")))).alias(c) for c in ("changed", "deleted")))
    return out.join(one(sets), "k").select("fact_ids", "file_hashes", "changed", "deleted")


def scan_manifest_parts(facts: DataFrame, files: DataFrame, changed: DataFrame | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """The same manifest as JSON lines in numbered parts (path, part_no, begin, content), with nothing gathered in a
    cell: first whether the scan was incremental, then ids, hashes, changed and deleted paths, each kind in order.

    Nulls and empty hashes are left out, repeated ids stay, changed and deleted paths are sets.
    """
    line = lambda section, key, *fields: F.struct(F.lit(section).alias("section"), key.alias("key"), F.to_json(F.struct(*fields)).alias("text")).alias("r")
    id_, path, hash_ = (F.col(c).cast("string") for c in ("id", "path", "hash"))
    rows = facts.sparkSession.range(1, numPartitions=1).select(line(0, F.lit(""), F.lit(changed is not None).alias("incremental")))
    rows = rows.unionByName(facts.where(id_.isNotNull()).select(line(1, id_, id_.alias("fact_id"))))
    rows = rows.unionByName(files.where(path.isNotNull() & (F.coalesce(hash_, F.lit("")) != "")).select(line(2, path, path.alias("path"), hash_.alias("hash"))))
    if changed is not None:
        sets = changed.where(path.isNotNull()).select(path.alias("path"), "change").distinct()
        for section, kind in ((3, "changed"), (4, "deleted")):
            rows = rows.unionByName(sets.where(F.col("change") == kind).select(line(section, path, path.alias(kind))))
    lines = rows.select(F.lit("manifest.jsonl").alias("path"), "r.section", "r.key", F.concat("r.text", F.lit("\n")).alias("text"))
    return text_parts(lines, "section", "key", part_bytes=part_bytes)


def clean_scope(scope: Column) -> Column:
    """A repository-relative scope without ``.`` parts; null if it leaves the repository."""
    from ..functions.paths import clean_path

    s = trim_all(scope)
    inside = clean_path(F.when(s == "", ".").otherwise(s))
    return F.when(F.startswith(s, F.lit("/")), None).when(inside == "", ".").otherwise(inside)


def repo_name(remote: Column, folder: Column) -> Column:
    """Last component of a remote's address, else of the folder."""
    r = F.rtrim(F.regexp_replace(trim_all(F.coalesce(remote, F.lit(""))), "\\.git\\z", ""), F.lit("/"))
    last = F.regexp_extract(r, "[/:]([^/:]+)\\z", 1)
    return F.when(last != "", last).otherwise(F.regexp_extract(folder, "([^/]*)/*\\z", 1))


def receiver_name(receiver: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(trim_all(receiver), "^\\*", ""), "([^.]*)\\z", 1)


def capture_trigger(trigger: Column, success: Column) -> Column:
    """Whether a finished run is captured: it succeeded and no timer started it."""
    return success & ~F.coalesce(trigger, F.lit("")).isin("cron", "heartbeat")


def shortened(c: Column, n: int) -> Column:
    from ..functions.text import cut_bytes

    return cut_bytes(c, n, "...")
