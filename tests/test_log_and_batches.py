import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from mnemolith.operators import batching, guards, log
from mnemolith.sources import files

T0 = dt.datetime(2024, 1, 1)


def pending(spark, rows):
    return spark.createDataFrame(rows, "id string, created_at timestamp, bytes long")


def packed(df):
    out = {}
    for r in df.orderBy("batch_no", "pos").collect():
        out.setdefault(r["batch_no"], (r["batch_id"], []))[1].append(r["id"])
    return [out[k] for k in sorted(out)]


def test_pack_order_and_count_cap(spark):
    rows = [("c", T0 + dt.timedelta(seconds=1), 8), ("b", T0, 8), ("a", T0, 8)]
    got = packed(batching.greedy_batches(pending(spark, rows), 2, 100, 100))
    assert [g[1] for g in got] == [["a", "b"], ["c"]]
    assert got[0][0] == "1eb7c54d52831bbf"


@pytest.mark.parametrize("caps, batches", [((20, 20, 100), 2), ((20, 100, 3), 2), ((20, 100, 100), 1)])
def test_pack_byte_and_token_caps(spark, caps, batches):
    assert len(packed(batching.greedy_batches(pending(spark, [("a", T0, 12), ("b", T0, 12)]), *caps))) == batches


def test_oversize_event_is_alone(spark):
    out = batching.greedy_batches(pending(spark, [("a", T0, 104)]), 1, 1, 1)
    assert batching.batch_totals(out).first().asDict() | {"batch_id": 0} == {"batch_no": 0, "batch_id": 0, "events": 1, "bytes": 104, "tokens": 26}


def test_drain_of_186_events(spark):
    rows = [(f"event-{i:03d}", T0 + dt.timedelta(seconds=i), 11) for i in range(186)]
    assert len(packed(batching.greedy_batches(pending(spark, rows)))) == 10


def test_blocks_pack_as_one_loop(spark):
    rnd = random.Random(3)
    rows = [(f"e{i:05d}", T0 + dt.timedelta(seconds=i), rnd.choice([1, 5, 40, 90, 400])) for i in range(3000)]
    want, count, size, tokens = [], 0, 0, 0
    for i, _, b in rows:
        if count and (count + 1 > 7 or size + b > 300 or tokens + b // 4 > 70):
            count = size = tokens = 0
        if not count:
            want.append([])
        want[-1].append(i)
        count, size, tokens = count + 1, size + b, tokens + b // 4
    got = packed(batching.greedy_batches(pending(spark, rows), 7, 300, 70, block_rows=41))
    assert [g[1] for g in got] == want
    for block_rows, fan in ((13, 3), (1, 16), (2999, 2), (3000, 2)):  # 231 blocks in five levels; 429; two; one
        got = packed(batching.greedy_batches(pending(spark, rows), 7, 300, 70, block_rows=block_rows, fan=fan))
        assert [g[1] for g in got] == want, (block_rows, fan)


def test_no_events_and_bad_caps(spark):
    assert batching.greedy_batches(pending(spark, [])).count() == 0
    with pytest.raises(ValueError):
        batching.greedy_batches(pending(spark, []), 0)


@pytest.mark.parametrize(
    "raw, want",
    [
        ('{"b": "2", "a": "1"}', "a=1; b=2"),
        ('{"k": 69}', "actor=me; source_type=user"),
        ('{"k": null}', "k="),
        ("{}", "none"),
        ("null", "actor=me; source_type=user"),
        ("[1]", "actor=me; source_type=user"),
        ("{bad", "actor=me; source_type=user"),
        (None, "actor=me; source_type=user"),
    ],
)
def test_context_falls_back_unless_all_strings(spark, raw, want):
    df = spark.createDataFrame([(raw, "me", "", "", "", "", "user")], "context_json string, actor string, source string, session_id string, active_project string, active_task string, source_type string")
    assert df.select(batching.serialized(batching.context_map())).first()[0] == want


STATUS = "line_no long, type string, event_id string, status string, reason string, epoch string, terminated boolean"


def test_status_fold_reset_and_invalid(spark):
    rows = [(0, "", "a", "integrated", "", "", True), (1, "reset", "a", "", "", "", True), (2, "", "b", "unknown", "", "", True), (3, "", "a", "pending", "", "", True)]
    events = spark.createDataFrame([("a",), ("b",)], "id string")
    got = log.status_counts(events, log.latest_status(spark.createDataFrame(rows, STATUS))).first()
    assert (got["total"], got["pending"], got["unknown"]) == (2, 1, 1)


@pytest.mark.parametrize("bad, total, verdict", [(11, 101, "corrupt"), (5, 100, "accepted"), (3, 3, "unparseable"), (10, 20, "accepted")])
def test_corruption_threshold(spark, bad, total, verdict):
    rows = [(i, "", f"e{i}", "odd" if i < bad else "failed", "", "", True) for i in range(total)]
    assert log.log_health(spark.createDataFrame(rows, STATUS)).first()["verdict"] == verdict


def test_epoch_boundary(spark):
    rows = [("before", "2023-12-31T23:59:59Z"), ("equal", "2024-01-01T00:00:00Z"), ("after", "2024-01-01T00:00:01Z"), ("bad", "not a time")]
    got = log.bootstrap_records(spark.createDataFrame(rows, "id string, timestamp string"), "2024-01-01 00:00:00")
    assert {r["event_id"] for r in got.collect()} == {"", "before", "bad"}


def test_split_shapes(spark):
    batch = spark.createDataFrame([(0, i, f"e{i}", 0) for i in range(8)], "batch_no int, pos int, id string, depth int")
    one, none = spark.createDataFrame([("e3",)], "id string"), spark.createDataFrame([], "id string")
    sizes = lambda s: sorted(r["count"] for r in batching.split_batch(batch, s).groupBy("part").count().collect())
    assert sizes(one) == [1, 7] and sizes(none) == [4, 4]
    assert batching.split_batch(batch.where("pos < 5"), none).count() == 0
    assert batching.split_batch(batch.withColumn("depth", F.lit(2)), none).count() == 0


def test_read_guard(spark):
    ddl = "trace_id int, call_no int, name string, input string, read_only boolean, error string"
    reads = [(1, i, "read", "x", True, None) for i in range(9)]
    assert guards.repeated_reads(spark.createDataFrame(reads, ddl)).first()["call_no"] == 8
    wrote = [*reads[:5], (1, 5, "write", "y", False, None), *[(1, i, "read", "x", True, None) for i in range(6, 12)]]
    assert guards.repeated_reads(spark.createDataFrame(wrote, ddl)).count() == 0
    failed = [*reads[:5], (1, 5, "write", "y", False, "no"), *[(1, i, "read", "x", True, None) for i in range(6, 12)]]
    assert guards.repeated_reads(spark.createDataFrame(failed, ddl)).first()["call_no"] == 9


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "x"}\n{bad\n\n{"id": "y", "trust_tier": 2}\n[1]\n')
    (tmp_path / "b.jsonl").write_text('{"id": "z"}\n')
    rows = files.read_events(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r["seq"], r["id"], r["trust_tier"]) for r in rows] == [(0, "x", None), (1, "y", 2), (2, "z", None)]


def test_status_file_without_final_newline(spark, tmp_path):
    p = tmp_path / "s.jsonl"
    p.write_text('{"event_id": "a", "status": "failed"}\n{"event_id": "b", "status": "failed"}')
    rows = files.read_status_log(spark, str(p)).orderBy("line_no").collect()
    assert [(r["event_id"], r["terminated"]) for r in rows] == [("a", True), ("b", False)]
    health = log.log_health(files.read_status_log(spark, str(p))).first()
    assert (health["valid"], health["skipped"]) == (1, 1)


def test_status_writes(spark, tmp_path):
    ddl = "type string, event_id string, status string, reason string, epoch string"
    good = spark.createDataFrame([("", "a", "failed", "r", "")], ddl)
    files.append_statuses(good, str(tmp_path / "s"))
    with pytest.raises(ValueError):
        files.append_statuses(good.unionByName(spark.createDataFrame([("", "b", "pending", "", "")], ddl)), str(tmp_path / "s"))
    assert files.read_status_log(spark, str(tmp_path / "s")).count() == 1
    events = spark.createDataFrame([("e1", "2023-01-01T00:00:00Z"), ("e2", "2025-01-01T00:00:00Z")], "id string, timestamp string")
    files.write_bootstrap(events, "2024-01-01 00:00:00", str(tmp_path / "boot"))
    assert spark.read.json(str(tmp_path / "boot")).count() == 2
    with pytest.raises(Exception):
        files.write_bootstrap(events, "2024-01-01 00:00:00", str(tmp_path / "boot"))


def test_appended_events_get_ids(spark, tmp_path):
    said = files.append_events(spark.createDataFrame([("x", ""), ("y", "mine")], "content string, id string"), str(tmp_path / "raw"))
    assert {r["id"] for r in said.collect()} == {r["id"] for r in files.read_events(spark, str(tmp_path / "raw")).collect()}
    rows = {r["content"]: r for r in files.read_events(spark, str(tmp_path / "raw")).collect()}
    import re

    assert re.fullmatch(r"evt_\d{8}_\d{6}_[0-9a-f]{4}", rows["x"]["id"]) and rows["y"]["id"] == "mine"


def test_reconcile_query_covers_the_whole_log(spark, tmp_path):
    from mnemolith.plans import registry

    spark.range(3000).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "id % 9 AS user_id", "'a' AS event_type", "'{}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    got = {int(r["id"][4:]) for r in registry.QUERIES["reconcile_pending"](spark, str(tmp_path)).collect()}
    assert {i // 300 for i in got} == set(range(10)) and {i % 3 for i in got} == {0, 1, 2}


def test_appends_never_renumber_the_log(spark, tmp_path):
    path, cursor, seen = str(tmp_path / "raw"), 0, []
    for i in range(20):
        files.append_events(spark.createDataFrame([(f"e{i:02d}-{j}", f"c{i}") for j in range(i % 3 + 1)], "id string, content string").coalesce(1), path)
        now = files.read_events(spark, path)
        if i % 4 == 3:
            seen += [r["id"] for r in log.events_since(now, cursor).orderBy("seq").collect()]
            cursor = log.next_cursor(now).first()[0]
    assert seen == [f"e{i:02d}-{j}" for i in range(20) for j in range(i % 3 + 1)]
    assert [r["seq"] for r in now.orderBy("seq").collect()] == list(range(len(seen)))


def test_lines_are_numbered_across_splits(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "old.jsonl").write_text("".join(f'{{"id": "e{i}", "content": "{"x" * 50}"}}\n' + "broken\n" * (i % 5 == 0) for i in range(400)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        rows = files.read_events(spark, str(tmp_path / "log"))
        assert rows.select(F.spark_partition_id()).distinct().count() > 1
        assert [r["id"] for r in rows.orderBy("seq").collect()] == [f"e{i}" for i in range(400)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_status_appends_keep_their_order(spark, tmp_path):
    path = str(tmp_path / "status")
    for s in ("failed", "integrated", "unknown", "skipped"):
        files.append_statuses(spark.createDataFrame([("", "e1", s, "", "")], "type string, event_id string, status string, reason string, epoch string"), path)
    assert log.latest_status(files.read_status_log(spark, path)).first()["status"] == "skipped"


def test_markdown_paths_where_a_folder_repeats_the_root(spark, tmp_path):
    at = tmp_path / "wiki" / "semantic" / "wiki"
    at.mkdir(parents=True)
    (at / "a.md").write_text("x")
    (tmp_path / "wiki" / "b c.md").write_text("y")
    for rules in (True, False):
        for root in (str(tmp_path / "wiki"), f"file://{tmp_path}/wiki/"):
            assert {r["path"] for r in files.read_markdown(spark, root, rules).collect()} == {"semantic/wiki/a.md", "b c.md"}


def test_fact_bundle_and_progress(spark, tmp_path):
    src = "package a\n\nfunc B() {}\n\nfunc A() {}\n"
    snippet = spark.createDataFrame([("a.go", 3, "function", "B")], "path string, start_line int, kind string, symbol string")
    facts = spark.createDataFrame([("b.go", 1, "function", "Z", "c"), ("a.go", 5, "function", "A", "c"), ("a.go", 3, "function", "B", src)], "path string, line int, kind string, symbol string, content string")
    files.write_facts(facts, snippet, str(tmp_path / "bundle"))
    back = spark.read.json(str(tmp_path / "bundle/facts"))
    assert "content" not in back.columns and [r["symbol"] for r in back.orderBy("path", "line").collect()] == ["B", "A", "Z"]
    results = spark.createDataFrame([("b1", "success", "e1", "integrated"), ("b1", "success", "e2", "skipped")], "batch_id string, batch_status string, event_id string, status string")
    for _ in range(2):
        files.append_progress(results, str(tmp_path / "progress"))
    assert [r[2] for r in files.numbered_lines(spark, str(tmp_path / "progress")).orderBy("line_no").collect()] == ['{"batch_id":"b1","status":"success","events":2}'] * 2


def appender(spark, path):
    return lambda *ids: files.append_events(spark.createDataFrame([(i, f"c {i}") for i in ids], "id string, content string").coalesce(1), path)


def test_writers_at_once_lose_nothing(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "raw")
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "old.jsonl").write_text('{"id": "old0"}\nbroken\n{"id": "old1"}\n')
    add = appender(spark, path)
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda k: [add(*(f"e{k}-{i}-{j}" for j in range(25))) for i in range(4)], range(8)))
    rows = files.read_events(spark, path).orderBy("seq").collect()
    assert [r["seq"] for r in rows] == list(range(802)) and [r["id"] for r in rows[:2]] == ["old0", "old1"]
    assert {r["id"] for r in rows[2:]} == {f"e{k}-{i}-{j}" for k in range(8) for i in range(4) for j in range(25)}
    at = {r["id"]: r["seq"] for r in rows}
    assert all(at[f"e{k}-{i}-{j + 1}"] == at[f"e{k}-{i}-{j}"] + 1 for k in range(8) for i in range(4) for j in range(24))


def test_a_cursor_read_opens_what_is_past_it(spark, tmp_path):
    path = str(tmp_path / "raw")
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "old.jsonl").write_text('{"id": "old0"}\n')
    add = appender(spark, path)
    for i in range(6):
        add(f"a{i}", f"b{i}")
    spark.createDataFrame([(f"w{i}", "x") for i in range(40)], "id string, content string").repartition(5).transform(lambda df: files.append_events(df, path))
    got = files.read_events(spark, path, since=10)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan and "rangepartitioning" not in plan
    folders = {f.rsplit("/", 2)[1] for f in got.inputFiles()}
    assert len(folders) == 3 and not any("old.jsonl" in f for f in got.inputFiles())
    assert [r["id"] for r in got.orderBy("seq").collect()][:3] == ["b4", "a5", "b5"] and got.count() == 43
    whole = files.read_events(spark, path).orderBy("seq").collect()
    assert [r["seq"] for r in whole] == list(range(53)) and [r["seq"] for r in got.orderBy("seq").collect()] == list(range(10, 53))
    assert files.read_events(spark, path, since=99).count() == 0
    log_ = files.json_log(spark, path, files.EVENT_SCHEMA)
    assert log_.length() == 53 and [e["first"] for e in log_.entries(12)] == [11, 13]


def test_many_entries_are_read_by_spark(spark, tmp_path, monkeypatch):
    from mnemolith.sources import appendlog

    monkeypatch.setattr(appendlog, "ONE_BY_ONE", 2)
    path = str(tmp_path / "raw")
    add = appender(spark, path)
    for i in range(6):
        add(f"e{i}")
    assert [r["id"] for r in files.read_events(spark, path, since=1).orderBy("seq").collect()] == [f"e{i}" for i in range(1, 6)]


def test_an_append_that_dies_leaves_nothing(spark, tmp_path, monkeypatch):
    from mnemolith.sources import appendlog

    path = str(tmp_path / "raw")
    add = appender(spark, path)
    add("a")
    with monkeypatch.context() as m:
        m.setattr(appendlog, "create_if_absent", lambda *_: 1 // 0)
        with pytest.raises(ZeroDivisionError):
            add("b")
    add("c")
    assert [r["id"] for r in files.read_events(spark, path).orderBy("seq").collect()] == ["a", "c"]
    target = str(tmp_path / "claim" / "1")
    (tmp_path / "claim").mkdir()
    assert appendlog.create_if_absent(spark, target, "x") and not appendlog.create_if_absent(spark, target, "y")
    assert appendlog.read_text(spark, target) == "x" and [p.name for p in (tmp_path / "claim").iterdir() if not p.name.endswith(".crc")] == ["1"]


def test_unclosed_files_of_one_name(spark, tmp_path):
    for folder, text in (("a", '{"event_id": "x", "status": "failed"}\n'), ("b", '{"event_id": "y", "status": "failed"}')):
        (tmp_path / "s" / folder).mkdir(parents=True)
        (tmp_path / "s" / folder / "log.jsonl").write_text(text)
    assert {r["event_id"]: r["terminated"] for r in files.read_status_log(spark, str(tmp_path / "s")).collect()} == {"x": True, "y": False}
