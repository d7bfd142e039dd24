import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemolith.streaming.flush import FlushLoop, recover


def land(folder, name, ids):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps({"id": i, "timestamp": f"2024-01-01T00:{int(i[1:]) // 60:02d}:{int(i[1:]) % 60:02d}Z", "content": "payload"}) + "\n" for i in ids))


def test_drain_and_second_run(spark, tmp_path):
    land(tmp_path / "in", "a.json", [f"e{i:03d}" for i in range(186)])
    loop = FlushLoop(spark, str(tmp_path / "state"))
    run = lambda: loop.start(str(tmp_path / "in"), str(tmp_path / "cp"), available_now=True).awaitTermination()
    run()
    assert loop.pending().count() == 0 and loop.events().count() == 186
    rows = spark.read.parquet(str(tmp_path / "state/status"))
    assert rows.count() == 186 and rows.select("batch_id").distinct().count() == 10
    run()
    assert spark.read.parquet(str(tmp_path / "state/status")).count() == 186


def test_quiet_time_and_decision(spark, tmp_path):
    now = [0.0]
    odd = lambda b: b.select(F.col("id").alias("event_id"), F.when(F.substring("id", -1, 1) == "1", "failed").otherwise("integrated").alias("status"), F.lit("r").alias("reason")).where("event_id <> 'e002'")
    loop = FlushLoop(spark, str(tmp_path / "state"), decide=odd, clock=lambda: now[0])
    land(tmp_path / "in", "a.json", ["e001", "e002", "e003"])
    loop.start(str(tmp_path / "in"), str(tmp_path / "cp"), available_now=True).awaitTermination()
    assert loop.pending().count() == 3 and not loop.due(3)
    now[0] = 31.0
    assert loop.due(3) and loop.flush(9) == 3
    assert {r["event_id"]: r["status"] for r in loop.status().collect()} == {"e001": "failed", "e002": "unknown", "e003": "integrated"}


def test_recovery_marks_named_events(spark, tmp_path):
    loop = FlushLoop(spark, str(tmp_path / "state"))
    land(tmp_path / "in", "a.json", ["e001", "e002"])
    loop.start(str(tmp_path / "in"), str(tmp_path / "cp"), available_now=True).awaitTermination()
    pages = spark.createDataFrame([("a.md", "<!-- compiled_from: e001, zzz -->")], "path string, content string")
    assert recover(loop, pages, 5) == 1
    assert [r["id"] for r in loop.pending().collect()] == ["e002"]


def test_three_errors_suspend(spark, tmp_path):
    def fail(_):
        raise RuntimeError("no")

    loop = FlushLoop(spark, str(tmp_path / "state"), decide=fail)
    loop._table("events", "id string")
    events = spark.createDataFrame([("e1", "2024-01-01T00:00:00Z", "x")], "id string, timestamp string, content string")
    for c in ("actor", "source", "session_id", "active_project", "active_task", "context_json", "durability", "actionability", "source_type", "evidence_kind"):
        events = events.withColumn(c, F.lit(""))
    events.withColumn("trust_tier", F.lit(1)).withColumn("batch", F.lit(0).cast("long")).write.parquet(str(tmp_path / "state/events"))
    for _ in range(2):
        assert loop.flush(0) == 1
    try:
        loop.flush(0)
    except RuntimeError:
        pass
    assert loop.suspended and not loop.due(99)


def seconds_until(done, most=60):
    import time

    end = time.time() + most
    while time.time() < end and not done():
        time.sleep(1)
    return done()


def test_poison_events_fail_in_small_parts(spark, tmp_path):
    land(tmp_path / "in", "a.json", [f"e{i:03d}" for i in range(186)])
    poison = ["e005", "e047", "e083", "e121", "e160"]

    def decide(b):
        bad = F.max(F.col("id").isin(poison).cast("int")).over(Window.partitionBy("batch_id")) > 0
        return b.select(F.col("id").alias("event_id"), F.when(bad, "batch_failed").otherwise("integrated").alias("status"), F.lit("r").alias("reason"))

    loop = FlushLoop(spark, str(tmp_path / "state"), decide=decide)
    loop.start(str(tmp_path / "in"), str(tmp_path / "cp"), available_now=True).awaitTermination()
    got = {r["event_id"]: r["status"] for r in loop.status().collect()}
    assert len(got) == 186 and all(got[p] == "failed" for p in poison)
    assert sum(s == "failed" for s in got.values()) <= 25 and sum(s == "integrated" for s in got.values()) >= 161
    assert loop.last_flush["integrated"] + loop.last_flush["failed"] == 186 and loop.next_run == "idle"


def test_suspects_are_parted_first(spark, tmp_path):
    land(tmp_path / "in", "a.json", [f"e{i:03d}" for i in range(20)])
    rounds = []

    def decide(b):
        rounds.append(sorted(tuple(sorted(r["x"])) for r in b.groupBy("batch_id").agg(F.collect_list("id").alias("x")).collect()))
        bad = F.max(F.col("id").isin("e003").cast("int")).over(Window.partitionBy("batch_id")) > 0
        return b.select(F.col("id").alias("event_id"), F.when(bad, "batch_failed").otherwise("integrated").alias("status"), F.lit("r").alias("reason"), F.col("id").isin("e003", "e004").alias("suspect"))

    loop = FlushLoop(spark, str(tmp_path / "state"), decide=decide)
    loop.start(str(tmp_path / "in"), str(tmp_path / "cp"), available_now=True).awaitTermination()
    assert ("e003", "e004") in rounds[1] and len(rounds) == 2
    assert sorted(r["event_id"] for r in loop.status().where("status = 'failed'").collect()) == ["e003", "e004"]


def test_errors_of_a_lazy_decision_count(spark, tmp_path):
    fail = lambda b: b.select(F.col("id").alias("event_id"), F.raise_error(F.lit("no")).cast("string").alias("status"), F.lit("").alias("reason"))
    loop = FlushLoop(spark, str(tmp_path / "state"), decide=fail, threshold=99)
    land(tmp_path / "in", "a.json", ["e001"])
    loop.start(str(tmp_path / "in"), str(tmp_path / "cp"), available_now=True).awaitTermination()
    for i in range(2):
        assert loop.flush(0) == 1 and loop.errors == i + 1 and loop.next_run == "resume later"
    with pytest.raises(Exception, match="no"):
        loop.flush(0)
    assert loop.suspended and loop.pending().count() == 1


def test_a_quiet_log_is_flushed(spark, tmp_path):
    land(tmp_path / "in", "a.json", ["e001", "e002", "e003"])
    loop = FlushLoop(spark, str(tmp_path / "state"), quiet_seconds=2.0)
    loop.start(str(tmp_path / "in"), str(tmp_path / "cp"), seconds=1.0)
    try:
        assert seconds_until(lambda: loop.status().count() == 3)
    finally:
        loop.stop()


def test_compile_cycle(spark, tmp_path):
    from mnemolith.store import MemoryStore

    store = MemoryStore(spark, str(tmp_path / "m"))
    add = lambda *ids: store.append_event(spark.createDataFrame([(i, "x") for i in ids], "id string, content string").coalesce(1))
    add("a", "b")
    seen = []

    def half(events, cursor):
        seen.append((cursor, [r["id"] for r in events.orderBy("seq").collect()]))
        return cursor + 1

    assert store.run_compile(half) and store.cursor() == 1
    assert not store.run_compile(lambda e, c: None) and not store.run_compile(lambda e, c: 0) and store.cursor() == 1
    with pytest.raises(ZeroDivisionError):
        store.run_compile(lambda e, c: 1 // 0)
    assert store.run_compile(lambda e, c: 99) and store.cursor() == 2  # never past the log
    assert not store.run_compile(half)  # nothing to do
    add("c")
    timer = store.start_auto_compile(half, str(tmp_path / "cp"), seconds=1.0)
    try:
        assert seconds_until(lambda: store.cursor() == 3)
    finally:
        timer.stop()
    assert seen == [(0, ["a", "b"]), (2, ["c"])]


def test_one_compile_at_a_time(spark, tmp_path):
    import threading

    from mnemolith.sources.lease import Lease
    from mnemolith.store import MemoryStore

    store = MemoryStore(spark, str(tmp_path / "m"))
    store.append_event(spark.createDataFrame([("a", "x"), ("b", "x")], "id string, content string").coalesce(1))
    inside, go, second = threading.Event(), threading.Event(), []

    def slow(events, cursor):
        inside.set()
        assert go.wait(60)
        return 1

    first: list[bool] = []
    runner = threading.Thread(target=lambda: first.append(store.run_compile(slow)))
    runner.start()
    assert inside.wait(60)
    assert not MemoryStore(spark, store.root).run_compile(lambda e, c: second.append(c) or 2)
    go.set()
    runner.join()
    assert first == [True] and second == [] and store.cursor() == 1
    # A cycle that outlasts its lease: another takes over, and the first one's result doesn't count.
    assert not store.run_compile(lambda e, c: 2 if Lease(spark, f"{store.root}/compiling", 60).take() else 0, lease_seconds=0.0)
    assert store.cursor() == 1 and not store.run_compile(lambda e, c: 2)
    # Of many at once one gets it, and a released lease can be taken.
    many = [Lease(spark, str(tmp_path / "lease"), 60) for _ in range(8)]
    got = [False] * 8
    threads = [threading.Thread(target=lambda i=i: got.__setitem__(i, many[i].take())) for i in range(8)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert sum(got) == 1 and many[got.index(True)].held()
    many[got.index(True)].release()
    assert many[0].take()


def rows_of(spark, ids):
    from mnemolith.sources.files import EVENT_FIELDS

    df = spark.createDataFrame([(i, "2024-01-01T00:00:00Z", "payload") for i in ids], "id string, timestamp string, content string").coalesce(1)
    return df.select(*(F.col(c) if c in df.columns else F.lit("").alias(c) for c in EVENT_FIELDS), F.lit(1).alias("trust_tier"))


def test_a_turn_over_its_time_fails_and_others_finish(spark, tmp_path):
    import time

    from pyspark.sql.types import StringType

    slow = F.udf(lambda x: time.sleep(60 if x == "e03" else 0) or "integrated", StringType())
    loop = FlushLoop(spark, str(tmp_path / "state"), decide=lambda b: b.select(F.col("id").alias("event_id"), slow("id").alias("status"), F.lit("").alias("reason")), workers=2, turn_seconds=6, per_event_seconds=0)
    began = time.time()
    loop.on_batch(rows_of(spark, [f"e{i:02d}" for i in range(40)]), 0)
    rows = loop.status().collect()
    assert time.time() - began < 90
    late = {r["event_id"] for r in rows if r["status"] == "failed"}
    assert late == {f"e{i:02d}" for i in range(5)} and {r["reason"] for r in rows if r["status"] == "failed"} == {"batch_timeout_at_max_depth"}
    assert sum(r["status"] == "integrated" for r in rows) == 35 and loop.waiting() == 0


def test_turns_are_bounded_and_stop_after_errors(spark):
    import threading
    import time

    from mnemolith.streaming.turns import take_turns

    packed = spark.createDataFrame([(i, f"b{i}", f"e{i}") for i in range(9)], "batch_no long, batch_id string, id string")
    now, most, lock = [0], [0], threading.Lock()

    def decide(b):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.5)
        with lock:
            now[0] -= 1
        return b.select(F.col("id").alias("event_id"), F.lit("integrated").alias("status"), F.lit("").alias("reason"))

    turns = take_turns(packed, decide, 4, lambda n: 60)
    assert most[0] == turns.most == 4 and turns.said.count() == 9 and not turns.late and not turns.raised and not turns.left
    turns = take_turns(packed, lambda b: 1 // 0, 1, lambda n: 60)
    assert len(turns.raised) == 3 and len(turns.left) == 6 and turns.said.count() == 0
    assert take_turns(packed, decide, 2, lambda n: 60, until=time.monotonic() - 1).left == [f"b{i}" for i in range(9)]


def test_an_event_without_a_writable_status_is_deferred(spark, tmp_path):
    now = [0.0]
    odd = lambda b: b.select(F.col("id").alias("event_id"), F.when(F.col("id") == "e2", "odd").otherwise("integrated").alias("status"), F.lit("").alias("reason"))
    loop = FlushLoop(spark, str(tmp_path / "state"), decide=odd, threshold=99, clock=lambda: now[0])
    loop.on_batch(rows_of(spark, ["e1", "e2"]), 0)
    assert loop.flush() == 2 and loop.last_flush["write_errors"] == 1
    assert loop.next_run == "resume later" and loop.waiting() == 1 and not loop.due(1)
    for _ in range(2):
        now[0] += 20.0
        loop.on_batch(rows_of(spark, [f"x{now[0]}"]), int(now[0]))  # signals, so that quiet isn't what is due
        now[0] += 41.0
        assert loop.due(loop.waiting()) or loop.flush() >= 0
        loop.tick()
    if loop.waiting():
        loop.flush()
    assert [r["id"] for r in loop.deferred().collect()] == ["e2"] and loop.waiting() == 0 and loop.next_run == "idle"
    loop.on_batch(rows_of(spark, ["e3"]), 1000)
    assert loop.flush() == 2 and loop.last_flush["integrated"] == 1 and loop.last_flush["write_errors"] == 0
    again = FlushLoop(spark, str(tmp_path / "state"), threshold=99)  # a new process reads the attempts
    assert again.flush() == 1 and [r["id"] for r in again.pending().collect()] == ["e2"]


def test_a_tick_costs_what_is_new(spark, tmp_path):
    from mnemolith.sources.appendlog import qualified
    from mnemolith.sources.tables import shared_dir

    files, folder = qualified(spark, shared_dir(spark))
    tables = lambda: len(list(files.listStatus(folder)))
    loop = FlushLoop(spark, str(tmp_path / "state"), threshold=2)
    left = []
    for i in range(4):
        loop.on_batch(rows_of(spark, [f"e{i}a", f"e{i}b", f"e{i}c"]), i)
        left.append(tables())
        assert loop.pending().inputFiles() == [] and loop.waiting() == 0  # nothing of the history is read for the next tick
    assert left[0] == left[3]
    loop.on_batch(rows_of(spark, ["e0a", "e3b"]), 3)  # a micro-batch that comes again
    assert {r["id"] for r in loop.pending().collect()} <= {"e0a", "e3b"}
    progress = spark.read.text(str(tmp_path / "state/progress/rows-*"))
    assert progress.count() >= 4


def test_a_reset_event_is_terminal_after_a_heartbeat(spark, tmp_path):
    loop = FlushLoop(spark, str(tmp_path / "state"), decide=lambda b: b.select(F.col("id").alias("event_id"), F.lit("failed").alias("status"), F.lit("").alias("reason")), threshold=1)
    loop.on_batch(rows_of(spark, ["e1", "e2"]), 0)
    ids = spark.createDataFrame([("e1",), ("zz",)], "id string")
    assert loop.reset(ids) == 1 and [r["id"] for r in loop.pending().collect()] == ["e1"]
    from mnemolith.streaming.flush import integrate_all

    loop.decide = integrate_all
    loop.tick()
    assert {r["event_id"]: r["status"] for r in loop.status().collect()} == {"e1": "integrated", "e2": "failed"} and loop.pending().count() == 0
    assert loop.reset(ids) == 0
