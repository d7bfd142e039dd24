"""Pending events into size-bounded batches, and what comes back from them.

Greedy packing is sequential: where a batch ends depends on where it began. But the end of the batch
that would begin at an event depends on the next few events only (``next start``). Blocks of the sorted
log therefore become maps from entry place to exit place, with as many entries as a batch can have
events. Composing maps is associative, so neighbours are composed up a tree, level by level; entry places
are handed down the same tree, and each block then marks the batches that begin in it. No task sees more than a block,
and the driver sees a count.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import broadcast_if_small, materialize

MAX_EVENTS, MAX_BYTES, MAX_TOKENS = 20, 48_000, 12_000
CONTEXT_COLUMNS = ("actor", "source", "session_id", "active_project", "active_task")


def context_map(raw: str = "context_json") -> Column:
    """The context of an event: its JSON object if all values are strings (null: empty), else the map
    of its non-empty columns, else null. An empty object stays an empty map."""
    text = F.coalesce(F.col(raw), F.lit(""))
    parsed = F.from_json(text, "map<string,variant>")
    kinds = F.transform(F.map_values(parsed), lambda v: F.schema_of_variant(v))
    strings = (text != "") & (text != "null") & text.rlike(r"^[\t\n\r ]*\{") & F.forall(kinds, lambda k: k.isin("STRING", "VOID"))  # null where it isn't read
    own = F.transform_values(F.from_json(text, "map<string,string>"), lambda _, v: F.coalesce(v, F.lit("")))
    pairs = lambda names: F.filter(F.array(*(F.struct(F.lit(c).alias("key"), F.coalesce(F.col(c), F.lit("")).alias("value")) for c in names)), lambda x: x["value"] != "")
    some = F.size(pairs(CONTEXT_COLUMNS)) > 0
    return F.when(strings, own).when(some, F.map_from_entries(pairs((*CONTEXT_COLUMNS, "source_type"))))


def serialized(context: Column) -> Column:
    """Sorted ``key=value`` joined by ``; ``; ``none`` without any."""
    parts = F.transform(F.array_sort(F.map_entries(context)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.when(F.coalesce(F.size(context), F.lit(0)) < 1, "none").otherwise(F.array_join(parts, "; "))


def event_bytes(text: Column, context: Column) -> Column:
    return (F.octet_length(text) + F.octet_length(serialized(context))).cast("long")


def batch_id(ids: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the sorted ids joined by commas."""
    return F.substring(F.sha2(F.array_join(F.array_sort(ids), ","), 256), 1, 16)


def next_starts(size: np.ndarray, own: int, events: int, size_cap: int, token_cap: int) -> np.ndarray:
    """For each of the first ``own`` places, where the batch that begins there ends (exclusive)."""
    n = len(size)
    at = np.arange(own)
    end, total, tokens = at + 1, size[:own].copy(), size[:own] // 4
    open_ = np.ones(own, bool)
    for k in range(1, events):
        j = at + k
        open_ &= j < n
        s = np.where(open_, size[np.minimum(j, n - 1)], 0)
        open_ &= (total + s <= size_cap) & (tokens + s // 4 <= token_cap)
        total, tokens = total + np.where(open_, s, 0), tokens + np.where(open_, s // 4, 0)
        end += open_
    return end


def _marked(ids: list, size: np.ndarray, own: int, entry: int, before: int, caps: tuple[int, int, int]) -> dict[str, list | np.ndarray]:
    """The batches that begin among the first ``own`` places, coming in at ``entry``: for each of their events its place
    ``at``, and its batch's number and id and its place there. Where the last one ends can be past ``own``."""
    nxt = next_starts(size, own, *caps)
    starts, i = [], entry
    while i < own:
        starts.append(i)
        i = int(nxt[i])
    if not starts:
        return {"at": np.empty(0, np.int64), "batch_no": [], "batch_id": [], "pos": []}
    ends = [*starts[1:], i]
    sizes = np.subtract(ends, starts)
    at = np.arange(starts[0], i)
    names = [hashlib.sha256(",".join(sorted(x for x in ids[a:b] if x is not None)).encode()).hexdigest()[:16] for a, b in zip(starts, ends, strict=True)]
    return {"at": at, "batch_no": before + np.repeat(np.arange(len(starts)), sizes), "batch_id": np.repeat(np.array(names, object), sizes), "pos": at - np.repeat(starts, sizes)}


#: Block maps that are composed in one step. A node of the tree holds so many and no more.
FAN = 16


def _block_map(f: pd.DataFrame, own: int, caps: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Where a walk from each entry place leaves the block, as a place in the next one, and the batches it begins."""
    reach = caps[0] + 1
    size = f.sort_values("row")["bytes"].to_numpy()
    leave = np.concatenate((next_starts(size, own, *caps), np.arange(own, own + reach)))
    begun = (np.arange(own + reach) < own).astype(np.int64)
    while (leave[:own] < own).any():  # the next starts, followed twice as far each time
        begun, leave = begun + np.where(leave < own, begun[np.minimum(leave, own)], 0), np.where(leave < own, leave[np.minimum(leave, own)], leave)
    return leave[:reach] - own, begun[:reach]


def _composed(kids: Column, reach: int) -> Column:
    """The map of neighbouring blocks (block, exits, begun), in order, as one."""
    same = F.struct(F.sequence(F.lit(0), F.lit(reach - 1)).alias("exits"), F.array_repeat(F.lit(0).cast("long"), reach).alias("begun"))

    def then(a, k):
        begun = F.transform(a["exits"], lambda x, i: F.get(a["begun"], i) + F.get(k["begun"], x))
        return F.struct(F.transform(a["exits"], lambda x: F.get(k["exits"], x)).alias("exits"), begun.alias("begun"))

    return F.aggregate(kids, same, then)


def _handed_down(kids: Column, entry: Column, before: Column) -> Column:
    """(block, entry, before) of each of the blocks, from the entry place into the first and the batches before it."""
    none = F.array().cast("array<struct<block: bigint, entry: int, before: bigint>>")

    def then(a, k):
        here = F.struct(k["block"].alias("block"), a["entry"].alias("entry"), a["before"].alias("before"))
        return F.struct(F.get(k["exits"], a["entry"]).alias("entry"), (a["before"] + F.get(k["begun"], a["entry"])).alias("before"), F.concat(a["out"], F.array(here)).alias("out"))

    return F.aggregate(kids, F.struct(entry.alias("entry"), before.alias("before"), none.alias("out")), then, lambda a: a["out"])


def _block_entries(maps: DataFrame, blocks: int, reach: int, fan: int) -> DataFrame:
    """``block, entry, before`` of every block: maps are composed up a tree of ``fan``, entries handed down it."""
    levels = []
    while blocks > 1:
        kids = maps.groupBy(F.floor(F.col("block") / fan).alias("parent")).agg(F.array_sort(F.collect_list(F.struct("block", "exits", "begun"))).alias("kids"))
        levels.append(materialize(kids))
        maps = levels[-1].select(F.col("parent").alias("block"), _composed(F.col("kids"), reach).alias("m")).select("block", "m.*")
        blocks = -(-blocks // fan)
    entries = maps.sparkSession.createDataFrame([(0, 0, 0)], "block long, entry int, before long")
    for kids in reversed(levels):
        met = kids.join(entries, kids["parent"] == entries["block"])
        entries = met.select(F.explode(_handed_down(F.col("kids"), F.col("entry"), F.col("before"))).alias("e")).select("e.*")
    return materialize(entries) if levels else entries


def greedy_batches(pending: DataFrame, max_events: int = MAX_EVENTS, max_bytes: int = MAX_BYTES, max_tokens: int = MAX_TOKENS, block_rows: int = 100_000, fan: int = FAN) -> DataFrame:
    """``id, bytes, batch_no, batch_id, pos`` in the order (created_at, id).

    ``pending`` has ``id, created_at, bytes``. A batch closes before the event that would break a cap; an
    event over a cap is a batch of its own.
    """
    if min(max_events, max_bytes, max_tokens) <= 0:
        raise ValueError("caps must be positive")
    caps = (max_events, max_bytes, max_tokens)
    block_rows = max(block_rows, max_events)  # so that a batch that begins in a block ends in the next one at the latest
    rows = pending.select("id", "created_at", F.col("bytes").cast("long").alias("bytes"))
    ordered = materialize(rows.orderBy("created_at", "id").withColumn("at", F.monotonically_increasing_id()))
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("c"))
    sums = F.sum("c").over(Window.orderBy("part"))  # a row a sorted range
    before = materialize(sizes.select("part", (sums - F.col("c")).alias("ahead")))
    placed = ordered.withColumn("part", part).join(broadcast_if_small(before), "part").withColumn("g", F.col("ahead") + place)
    block, row = F.floor(F.col("g") / block_rows), F.col("g") % block_rows
    # The first rows of a block are the last one's, too, which so sees past its end.
    spots = F.array(F.struct(block.alias("block"), row.alias("row")), F.struct((block - 1).alias("block"), (row + block_rows).alias("row")))
    spots = F.when((row < max_events) & (block > 0), spots).otherwise(F.slice(spots, 1, 1))
    spread = placed.select("id", "created_at", "bytes", F.explode(spots).alias("s")).select("id", "created_at", "bytes", "s.block", "s.row")

    def exits(key, f):
        leave, begun = _block_map(f, int((f["row"] < block_rows).sum()), caps)
        return pd.DataFrame({"block": key[0], "exits": [leave], "begun": [begun]})

    blocks = -(-ordered.count() // block_rows)
    maps = spread.select("block", "row", "bytes").groupBy("block").applyInPandas(exits, "block long, exits array<int>, begun array<long>")
    entries = _block_entries(maps, blocks, max_events + 1, fan)

    def mark(f):
        f = f.sort_values("row")
        own = int((f["row"] < block_rows).sum())
        # The block sees past its end, so batches are whole here and get their ids from the block that they begin in.
        found = _marked(f["id"].tolist(), f["bytes"].to_numpy(), own, int(f["entry"].iloc[0]), int(f["before"].iloc[0]), caps)
        return f[["id", "bytes"]].iloc[found.pop("at")].assign(**found)

    marked = spread.select("id", "bytes", "block", "row").join(entries, "block").groupBy("block")
    return marked.applyInPandas(mark, "id string, bytes long, batch_no long, batch_id string, pos int")


def batch_totals(batches: DataFrame) -> DataFrame:
    """Events, bytes and the token estimate (a sum of floors) of each batch."""
    return batches.groupBy("batch_no", "batch_id").agg(F.count("*").alias("events"), F.sum("bytes").alias("bytes"), F.sum(F.floor(F.col("bytes") / 4)).alias("tokens"))


def parse_results(lines: DataFrame) -> DataFrame:
    """Valid result lines: ``line_no, event_id, status, pages, reason`` of (line_no, line)."""
    from ..functions.text import trim_all

    shape = r"^EVENT[\t\n\f\r ]+([^\t\n\f\r ]+)[\t\n\f\r ]+(INTEGRATED|SKIPPED|FAILED)[\t\n\f\r ]+([^\n]+)\z"
    rows = lines.withColumn("line", trim_all(F.col("line"))).where(F.col("line").rlike(shape))
    part = lambda i: F.regexp_extract("line", shape, i)
    rows = rows.select("line_no", part(1).alias("event_id"), part(2).alias("word"), trim_all(part(3)).alias("rest"))
    pages = F.filter(F.transform(F.split(F.regexp_replace("rest", "^pages:", ""), ","), trim_all), lambda x: x != "")
    reason = trim_all(F.regexp_replace("rest", "^reason:", ""))
    done = F.col("word") == "INTEGRATED"
    ok = F.when(done, F.startswith("rest", F.lit("pages:")) & (F.size(pages) > 0)).otherwise(F.startswith("rest", F.lit("reason:")) & (reason != ""))
    return rows.where(ok).select(
        "line_no",
        "event_id",
        F.when(done, "integrated").when(F.col("word") == "SKIPPED", "skipped").otherwise("failed_by_agent").alias("status"),
        F.when(done, pages).otherwise(F.array().cast("array<string>")).alias("pages"),
        F.when(done, "").otherwise(reason).alias("reason"),
    )


def results_of_batch(batch: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per event of the batch: its last valid line, or unknown with a default reason."""
    valid = parse_results(lines)
    mine = valid.join(batch.select(F.col("id").alias("event_id")), "event_id", "left_semi")
    last = mine.groupBy("event_id").agg(F.max_by(F.struct("status", "pages", "reason"), "line_no").alias("r"))
    said = lines.agg(F.coalesce(F.max(F.regexp_replace("line", r"[\x{9}-\x{D} ]+", "") != ""), F.lit(False))).first()[0]
    seen, matched = valid.limit(1).count(), last.limit(1).count()
    why = "empty agent output" if not said else "no matching event IDs in output" if seen and not matched else "not reported by agent"
    out = batch.select(F.col("id").alias("event_id")).join(last, "event_id", "left")
    return out.select("event_id", F.coalesce("r.status", F.lit("unknown")).alias("status"), F.coalesce("r.pages", F.array().cast("array<string>")).alias("pages"), F.coalesce("r.reason", F.lit(why)).alias("reason"))


def split_batch(batch: DataFrame, suspects: DataFrame, max_depth: int = 2, least: int = 5) -> DataFrame:
    """Retry parts of failed batches: ``batch_no, id, depth, part`` of (batch_no, pos, id, depth) rows.

    With suspect and other events in a batch, those are its two parts; else its two halves. A batch of
    ``least`` events or fewer, or at ``max_depth``, isn't split (no rows).
    """
    w = Window.partitionBy("batch_no")
    rows = batch.join(suspects.select("id", F.lit(True).alias("suspect")).distinct(), "id", "left").withColumn("suspect", F.coalesce("suspect", F.lit(False)))
    rows = rows.withColumn("n", F.count("*").over(w)).withColumn("k", F.count_if("suspect").over(w))
    rows = rows.where((F.col("n") > least) & (F.col("depth") < max_depth))
    part = F.when((F.col("k") > 0) & (F.col("k") < F.col("n")), F.col("suspect").cast("int")).otherwise((F.col("pos") >= F.floor(F.col("n") / 2)).cast("int"))
    return rows.select("batch_no", "id", (F.col("depth") + 1).alias("depth"), part.alias("part"))


def batch_prompt(batch: DataFrame, instructions: str = "") -> DataFrame:
    """One text per batch of (batch_no, pos, id, created_at, context, text): its events in order."""
    when = F.concat(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    block = F.format_string("### Event %d: %s\nTimestamp: %s\nContext: %s\n%s\n", (F.col("pos") + 1).cast("long"), "id", when, serialized(F.col("context")), "text")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", block.alias("b")))), lambda x: x["b"])
    return batch.groupBy("batch_no").agg(F.concat(F.array_join(parts, "\n"), F.lit(instructions)).alias("prompt"))
