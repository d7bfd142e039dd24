"""The integration loop as Structured Streaming.

Events land as files. Each micro-batch appends to the event table and, when enough are pending, flushes; a
heartbeat stream flushes what is pending when the log has been quiet long enough, or when a flush left some and it
is time to resume. A flush packs the pending events, decides on the batches, and appends the statuses. A batch
that fails or takes too long is split, by suspects or in halves, and its parts are decided on again, down to parts that
can't be split, whose events fail. An event whose status could not be written three times is deferred: it stays
pending and is left out of packing. The status log is what counts; replaying it is the recovery.
"""

from __future__ import annotations

import functools
import threading
import time
import uuid
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators import batching, guards, log, surface
from ..sources.appendlog import qualified
from ..sources.files import EVENT_SCHEMA, append_progress
from ..sources.tables import Scratch, broadcast_if_small, materialize, remove
from .turns import said_columns, take_turns

STATUS_DDL = "line_no long, type string, event_id string, status string, batch_id string, reason string, epoch string, terminated boolean"


ATTEMPTS_DDL = "item string, at_no long, ok boolean"
#: Errors in a row that suspend the loop.
MAX_ERRORS = 3
#: How often a failed batch is split.
MAX_DEPTH = 2
#: What a decision says of an event whose batch as a whole failed.
BATCH_FAILED = "batch_failed"


class Decision(Protocol):
    """What an integration does with batches: (event_id, status, reason) of (batch_id, id, text) rows. A
    batch with an event whose status is ``batch_failed`` has failed; a boolean column ``suspect`` may mark
    the events to part from the others."""

    def __call__(self, batches: DataFrame) -> DataFrame: ...


def integrate_all(batches: DataFrame) -> DataFrame:
    """The deterministic default: every event is integrated."""
    return batches.select(F.col("id").alias("event_id"), F.lit("integrated").alias("status"), F.lit("").alias("reason"))


class FlushLoop:
    """Events that are pending are state: parts of a table below ``pending``, one added by a micro-batch with its
    new events and all replaced by what a flush leaves. It is made from the event and status tables once, when
    the loop starts, so a tick costs what is new and a flush what is pending, however long the history is.

    ``workers`` None decides on all batches of a flush in one go; a number decides batch by batch, as many at a time, each
    within the time of its events. ``clock`` tells seconds.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        decide: Decision = integrate_all,
        threshold: int = 20,
        quiet_seconds: float = 30.0,
        clock: Callable[[], float] = time.time,
        workers: int | None = None,
        turn_seconds: int = 600,
        per_event_seconds: int = 90,
        resume_seconds: float = 60.0,
        envelope_seconds: float = 2_400.0,
        **caps: int,
    ):
        self.spark, self.root, self.decide, self.caps = spark, root.rstrip("/"), decide, caps
        self.threshold, self.quiet_seconds, self.clock = threshold, quiet_seconds, clock
        self.workers, self.turn_seconds, self.per_event_seconds = workers, turn_seconds, per_event_seconds
        self.resume_seconds, self.envelope_seconds = resume_seconds, envelope_seconds
        self.last_signal = clock()
        self.resume_at: float | None = None
        self.suspended = False
        self.errors = 0
        self.lock = threading.RLock()
        self.last_flush: dict[str, int] = {}
        self.stopped = ""
        self.next_run = "idle"
        self.query = self.heartbeat = None
        self._parts: list[str] | None = None
        self._waiting = self._set_aside = 0
        self._stamp = 0

    def _table(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}") if self._there(name) else self.spark.createDataFrame([], schema)

    def _there(self, name: str) -> bool:
        files, path = qualified(self.spark, f"{self.root}/{name}")
        return files.exists(path)

    def events(self) -> DataFrame:
        return self._table("events", T.StructType([*EVENT_SCHEMA.fields, T.StructField("batch", T.LongType())]))

    def status(self) -> DataFrame:
        return log.latest_status(self._table("status", STATUS_DDL))

    def pending(self) -> DataFrame:
        """Each pending event once."""
        with self.lock:
            if self._parts is None:
                self._rebuild()
            return log.once_each(self._read_parts())

    def _read_parts(self) -> DataFrame:
        schema = T.StructType([*EVENT_SCHEMA.fields, T.StructField("created_at", T.TimestampType())])
        return self.spark.read.schema(schema).parquet(*self._parts) if self._parts else self.spark.createDataFrame([], schema)

    def _new_part(self, rows: DataFrame) -> tuple[str, int]:
        """A part of the pending table, and its rows."""
        path = f"{self.root}/pending/{uuid.uuid4().hex}"
        rows.select(*EVENT_SCHEMA.names, "created_at").write.parquet(path)
        return path, self.spark.read.parquet(path).count()

    def _replace(self, rows: DataFrame | None) -> None:
        old, n = self._parts or [], 0
        self._parts = []
        if rows is not None:
            path, n = self._new_part(rows)
            self._parts = [path]
        self._waiting = n
        for path in old:
            remove(self.spark, path)

    def _rebuild(self) -> None:
        """Pending events from the whole history: what is terminal goes first, so only what is pending is compared."""
        self._parts, self._waiting = [], 0
        if self._there("events"):
            self._replace(log.once_each(log.pending_events(self.events(), self.status())))

    def waiting(self) -> int:
        """How many events are pending and not deferred, without a job."""
        with self.lock:
            if self._parts is None:
                self._rebuild()
            return self._waiting - self._set_aside

    def due(self, pending: int) -> bool:
        """Enough pending; or some, and no signal for a while or the time to resume has come."""
        if self.suspended or pending <= 0:
            return False
        resume = self.resume_at is not None and self.clock() >= self.resume_at
        return pending >= self.threshold or resume or self.clock() - self.last_signal >= self.quiet_seconds

    def next_stamp(self) -> int:
        """A number that grows with every flush and reset of this log, whoever asks: later records count."""
        self._stamp = max(self._stamp + 1, time.time_ns())
        return self._stamp

    def _turn_limit(self, events: int) -> float:
        """guards.batch_timeout for a number."""
        seconds = min(max(self.turn_seconds, events * self.per_event_seconds), 600)
        return seconds if seconds > 0 else 600

    def _decided(self, packed: DataFrame, until: float) -> DataFrame:
        """The decision computed, so that its errors come up here: a row for each event of ``packed`` whose batch
        was decided on."""
        late: list[str] = []
        if self.workers is None:
            said = said_columns(self.decide(packed))
            rows = packed.select(F.col("id").alias("event_id"), "batch_id").join(said, "event_id", "left")
        else:
            turns = take_turns(packed, self.decide, self.workers, self._turn_limit, until, self.errors, MAX_ERRORS)
            undone = [*turns.raised, *turns.left]
            late = turns.late
            rows = packed.where(~F.col("batch_id").isin(undone)) if undone else packed
            rows = rows.select(F.col("id").alias("event_id"), "batch_id").join(turns.said.drop("batch_id"), "event_id", "left")
            self.errors = self.errors + len(turns.raised) if turns.raised and not turns.said.take(1) else len(turns.raised)
            if turns.left:
                self.stopped = "internal_error_limit" if self.errors >= MAX_ERRORS else "envelope_timeout"
        deadline = F.col("batch_id").isin(late) if late else F.lit(False)
        bad = F.max(F.coalesce(F.col("status") == BATCH_FAILED, F.lit(False)) | deadline).over(Window.partitionBy("batch_id"))
        return materialize(rows.withColumns({"bad": bad, "deadline": deadline, "suspect": F.coalesce("suspect", F.lit(False))}))

    def _append(self, rows: DataFrame, stamp: int, kind: str = "") -> None:
        full = rows.select(F.lit(stamp).cast("long").alias("line_no"), F.lit(kind).alias("type"), "event_id", "status", "batch_id", "reason", F.lit("").alias("epoch"), F.lit(True).alias("terminated"))
        full.write.mode("append").parquet(f"{self.root}/status")

    def attempts(self) -> DataFrame:
        """Failed status writes of events, and the good ones that came after: ``item, at_no, ok``."""
        return self._table("attempts", ATTEMPTS_DDL)

    def deferred(self) -> DataFrame:
        """Pending events (``id``) whose status could not be written three times since the last time it could."""
        if not self._there("attempts"):
            return self.spark.createDataFrame([], "id string")
        items = guards.deferred_items(self.attempts()).select(F.col("item").alias("id"))
        return surface.prune_deferred(items, self.pending())

    def flush(self, stamp: int | None = None) -> int:
        """Pack what is pending and not deferred, decide, split what failed, append statuses; returns how many
        events were pending.

        Three decisions in a row that raise suspend the loop; the third error comes up. A flush begins no round, nor a
        turn, past its envelope. ``next_run`` says whether to come back, which the heartbeat does.
        """
        with self.lock, Scratch(self.spark):
            self.suspended, self.stopped, self.last_flush = False, "", {}
            stamp = self.next_stamp() if stamp is None else stamp
            until = time.monotonic() + self.envelope_seconds
            aside = materialize(self.deferred())
            self._set_aside = aside.count()
            pending = self.pending()
            n = self._waiting
            todo = surface.actionable(pending, aside) if self._set_aside else pending
            todo = todo.withColumn("context", batching.context_map())
            todo = todo.withColumn("bytes", batching.event_bytes(F.col("content"), F.col("context")))
            todo = materialize(todo.select("id", "content", "context", "created_at", "bytes"))
            if n > self._set_aside:
                texts = todo.select("id", F.col("content").alias("text"), "context", "created_at")
                packed = materialize(batching.greedy_batches(todo, **self.caps).join(texts, "id").withColumn("depth", F.lit(0)))
                try:
                    done = self._decide_all(packed, stamp, until)
                    if self.workers is None:
                        self.errors = 0
                    if done:
                        ids = functools.reduce(DataFrame.unionByName, done)
                        # Ids are compared first, so contents are read for what is left only.
                        left = materialize(pending.select("id").join(ids, "id", "left_anti").select(F.col("id").alias("_id")))
                        rest = pending.join(broadcast_if_small(left), F.col("id").eqNullSafe(F.col("_id")), "left_semi")
                        self._replace(None if left.isEmpty() else rest)
                    self.suspended = self.errors >= MAX_ERRORS
                except Exception:
                    self._parts = None  # some rounds may have been written
                    self.errors += 1
                    self.suspended = self.errors >= MAX_ERRORS
                    if self.suspended:
                        raise
            self._set_aside = self.deferred().count() if self._there("attempts") else 0
            waiting = self.waiting()
            self.next_run = self.spark.range(1).select(guards.next_run(F.lit(waiting + self._set_aside), F.lit(self.suspended), F.lit(self._set_aside))).first()[0]
            self.resume_at = self.clock() + self.resume_seconds if self.next_run == "resume later" else None
            return n

    def _decide_all(self, packed: DataFrame, stamp: int, until: float) -> list[DataFrame]:
        """One round a depth, at most ``MAX_DEPTH`` + 1; counters go to ``last_flush``, a line a batch to the progress
        log. Returns the events that are terminal now."""
        terminal: list[DataFrame] = []
        for depth in range(MAX_DEPTH + 1):
            said = self._decided(packed, until)
            batches = packed.join(said.where("bad").select("batch_id").distinct(), "batch_id", "left_semi")
            suspects = said.where("suspect").select(F.col("event_id").alias("id"))
            parts = materialize(batching.split_batch(batches.select("batch_no", "pos", "id", "depth"), suspects, MAX_DEPTH))
            again = said.join(parts.select(F.col("id").alias("event_id")), "event_id", "left_semi")
            done = said.join(again.select("event_id"), "event_id", "left_anti")
            why = guards.failure_reason(F.col("deadline"), F.col("suspect").cast("int"), F.col("reason"))
            rows = done.withColumn("reason", F.when(F.col("bad"), why).otherwise(F.coalesce("reason", F.lit("not reported"))))
            status = F.when(F.col("status") == "failed_by_agent", "failed").otherwise(F.coalesce("status", F.lit("unknown")))
            rows = rows.withColumn("status", F.when(F.col("bad"), "failed").otherwise(status))
            rows = materialize(rows.withColumn("batch_status", F.when(F.col("bad"), "failed").otherwise("success")))
            good = F.col("status").isin(*log.TERMINAL)
            now = surface.flush_counters(rows.where(good)).first().asDict() | {"write_errors": rows.where(~good).count()}
            self._append(rows.where(good), stamp)
            self._note_attempts(rows.withColumn("ok", good), stamp, now["write_errors"])
            terminal.append(rows.where(good).select(F.col("event_id").alias("id")))
            append_progress(rows, f"{self.root}/progress")
            self.last_flush = {k: self.last_flush.get(k, 0) + v for k, v in now.items()}
            if parts.isEmpty():
                break
            if self.stopped or time.monotonic() > until:
                self.stopped = self.stopped or "envelope_timeout"
                break
            ids = Window.partitionBy("batch_no", "part").orderBy("created_at", "id")
            packed = packed.drop("batch_id", "pos", "depth").join(parts, ["batch_no", "id"]).withColumn("pos", F.row_number().over(ids) - 1)
            names = packed.groupBy("batch_no", "part").agg(batching.batch_id(F.collect_list("id")).alias("batch_id"))  # 20 ids at most
            packed = packed.join(names, ["batch_no", "part"]).withColumn("batch_no", F.col("batch_no") * 2 + F.col("part"))
            packed = materialize(packed.drop("part"))
        return terminal

    def _note_attempts(self, rows: DataFrame, stamp: int, failed: int) -> None:
        """Failed writes, and good ones of events that had failed before."""
        if not failed and not self._there("attempts"):
            return
        notes = rows.select(F.col("event_id").alias("item"), F.lit(stamp).cast("long").alias("at_no"), "ok")
        before = self.attempts().select("item").distinct()
        notes = notes.where("NOT ok").unionByName(notes.where("ok").join(before, "item", "left_semi"))
        materialize(notes).write.mode("append").parquet(f"{self.root}/attempts")

    def reset(self, ids: DataFrame) -> int:
        """Failed and unknown events of ``ids`` (id) become pending again, by a record that counts later than theirs;
        returns how many."""
        with self.lock, Scratch(self.spark):
            old = self.status().join(ids.select(F.col("id").alias("event_id")).distinct(), "event_id", "left_semi")
            rows = materialize(old.where(log.transition(F.lit("reset"), F.col("status")) == "pending").select("event_id", "status", F.lit("").alias("batch_id"), F.lit("reset").alias("reason")))
            n = rows.count()
            if n:
                self.waiting()
                self._append(rows.withColumn("status", F.lit("")), self.next_stamp(), "reset")
                back = self.events().join(rows.select(F.col("event_id").alias("id")), "id", "left_semi").dropDuplicates(["id"])
                path, more = self._new_part(log.pending_events(back, self.status()))
                self._parts.append(path)
                self._waiting += more
            return n

    def on_batch(self, events: DataFrame, number: int) -> None:
        """A micro-batch: its events join the log and the pending ones. One that comes again replaces itself, and the
        pending table is made anew, as some of its events may be terminal."""
        with self.lock:
            if not events.isEmpty():
                self.last_signal = self.clock()
                self.waiting()
                name = f"events/batch={number}"
                again = self._there(name)
                # Dealt by id, as a few small files that compress well can hold very many events.
                events.select(*EVENT_SCHEMA.names).repartition("id").write.mode("overwrite").parquet(f"{self.root}/{name}")
                if again:
                    self._rebuild()
                else:
                    path, n = self._new_part(log.with_created_at(self.spark.read.schema(EVENT_SCHEMA).parquet(f"{self.root}/{name}")))
                    self._parts.append(path)
                    self._waiting += n
            self.tick()

    def tick(self) -> None:
        """Flush if it is time; nothing is read to find out."""
        if self.due(self.waiting()):
            self.flush()

    def start(self, landing: str, checkpoint: str, available_now: bool = False, seconds: float = 5.0):
        """Tail a folder of JSON-lines files. An id that comes again later is dropped by the stream's own state, which is
        keyed by id (for very many ids, a session with the RocksDB state store). A running loop has a heartbeat beside it, as a
        stream without new files calls nothing; it ends with the loop. ``stop`` ends both."""
        stream = self.spark.readStream.schema(EVENT_SCHEMA).json(landing).where("id IS NOT NULL").dropDuplicates(["id"])
        writer = stream.writeStream.foreachBatch(self.on_batch).option("checkpointLocation", f"{checkpoint}")
        if available_now:
            return writer.trigger(availableNow=True).start()
        self.query = writer.trigger(processingTime=f"{seconds} seconds").start()
        beat = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load().writeStream.option("checkpointLocation", f"{checkpoint}-heartbeat")

        def on_beat(_: DataFrame, number: int) -> None:
            if self.query.isActive:
                self.tick()

        self.heartbeat = beat.foreachBatch(on_beat).trigger(processingTime=f"{seconds} seconds").start()
        return self.query

    def stop(self) -> None:
        for q in (self.heartbeat, self.query):
            if q is not None:
                q.stop()


def recover(loop: FlushLoop, pages: DataFrame, stamp: int | None = None) -> int:
    """Before a start: pending events that pages already name become unknown."""
    with loop.lock, Scratch(loop.spark):
        rows = materialize(log.recovered_events(pages, loop.pending()).withColumn("batch_id", F.lit("")))
        n = rows.count()
        if n:
            loop._append(rows, loop.next_stamp() if stamp is None else stamp)
            loop._replace(materialize(loop.pending().join(rows.select(F.col("event_id").alias("id")), "id", "left_anti")))
        return n
