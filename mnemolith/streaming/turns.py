"""Decisions taken batch by batch, a bounded number at a time and each within its time.

Every batch is a turn: its own Spark jobs under a tag, in the scheduler pool of its slot. A turn that is over its
time has its jobs cancelled by the tag, and its batch failed. Code of a decision that runs in the driver can't be
cancelled; such a turn is left behind, what it still returns is dropped, and its slot stays taken until it ends, so
that never more than ``workers`` run.
"""

from __future__ import annotations

import contextvars
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import shared_dir

SAID = "event_id string, status string, reason string, suspect boolean, batch_id string"


@dataclass
class Turns:
    """What came of the turns: the rows said, and batches by what else happened."""

    said: DataFrame
    late: list[str] = field(default_factory=list)  #: over their time
    raised: dict[str, str] = field(default_factory=dict)  #: an error, by batch
    left: list[str] = field(default_factory=list)  #: not begun
    most: int = 0  #: how many ran at once at most


def said_columns(said: DataFrame) -> DataFrame:
    """What a decision says in the loop's columns, an event once."""
    if "suspect" not in said.columns:
        said = said.withColumn("suspect", F.lit(False))
    return said.select("event_id", "status", "reason", "suspect").dropDuplicates(["event_id"])


def take_turns(packed: DataFrame, decide: Callable[[DataFrame], DataFrame], workers: int, seconds: Callable[[int], float], until: float = float("inf"), errors: int = 0, most_errors: int = 3) -> Turns:
    """``decide`` on each batch of ``packed`` (batch_id, id, ...) on its own, ``seconds(events)`` long at most. None
    begins after ``until`` (of time.monotonic) or once ``most_errors`` turns in a row raised, ``errors`` of them before."""
    spark = packed.sparkSession
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    out, lock, free = Turns(said=packed), threading.Lock(), list(range(workers))
    slots, wrote = threading.Semaphore(workers), []
    state = {"errors": errors, "running": 0}

    def turn(batch: str, slot: int, done: threading.Event, number: int, limit: float) -> None:
        tag = f"turn-{uuid.uuid4().hex}"
        over = threading.Event()

        def cancel() -> None:
            over.set()
            spark.interruptTag(tag)
            done.set()

        clock = threading.Timer(limit, cancel)
        clock.daemon = True
        clock.start()
        path, error = f"{folder}/{number}", None
        try:
            spark.addTag(tag)
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"turns-{slot}")
            mine = packed.where(F.col("batch_id") == batch)
            said_columns(decide(mine)).join(mine.select(F.col("id").alias("event_id")), "event_id", "left_semi").withColumn("batch_id", F.lit(batch)).write.parquet(path)
        except Exception as e:
            error = str(e)
        finally:
            clock.cancel()
            spark.removeTag(tag)
            with lock:
                if over.is_set():
                    pass  # counted as late already
                elif error is None:
                    wrote.append(path)
                    state["errors"] = 0
                else:
                    out.raised[batch] = error
                    state["errors"] += 1
                state["running"] -= 1
                free.append(slot)
            done.set()
            slots.release()

    waiting = []
    for number, row in enumerate(packed.groupBy("batch_no", "batch_id").count().orderBy("batch_no").toLocalIterator()):
        batch, limit = row["batch_id"], seconds(row["count"])
        began = slots.acquire(timeout=max(0.0, min(until - time.monotonic(), threading.TIMEOUT_MAX)))
        with lock:
            stop = state["errors"] >= most_errors
        if not began or stop or time.monotonic() > until:
            if began:
                slots.release()
            out.left.append(batch)
            continue
        done = threading.Event()
        with lock:
            slot = free.pop()
            state["running"] += 1
            out.most = max(out.most, state["running"])
        thread = threading.Thread(target=contextvars.copy_context().run, args=(turn, batch, slot, done, number, limit), daemon=True)
        thread.start()
        waiting.append((batch, done, f"{folder}/{number}"))
    for batch, done, path in waiting:
        done.wait()
        with lock:
            if path not in wrote and batch not in out.raised:
                out.late.append(batch)
    out.said = spark.read.schema(SAID).parquet(*wrote) if wrote else spark.createDataFrame([], SAID)
    return out
