"""A flush sorts and shuffles contents no more often than it must."""

from mnemolith.operators import batching, log
from mnemolith.sources.files import EVENT_SCHEMA
from mnemolith.streaming.flush import FlushLoop


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def events(spark, ids):
    return spark.createDataFrame([(i, "2024-01-01T00:00:00Z", f"text of {i}") for i in ids], "id string, timestamp string, content string").selectExpr(
        *(f.name if f.name in ("id", "timestamp", "content") else f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}" for f in EVENT_SCHEMA.fields)
    )


def test_contents_of_unique_ids_are_not_compared(spark, tmp_path):
    loop = FlushLoop(spark, str(tmp_path), threshold=1_000)
    loop.on_batch(events(spark, [f"e{i:02}" for i in range(40)]), 0)
    assert loop.pending().count() == 40
    assert "Aggregate" not in plan(loop.pending())


def test_ids_that_come_again_are_there_once(spark):
    rows = log.once_each(events(spark, ["a", "b", "a", None, None, "c", "a"]))
    assert sorted(r["id"] or "" for r in rows.collect()) == ["", "a", "b", "c"]
    assert {(r["id"], r["content"]) for r in rows.where("id IS NOT NULL").collect()} == {(x, f"text of {x}") for x in "abc"}


def test_batches_get_their_ids_where_they_begin(spark):
    rows = spark.createDataFrame([(f"e{i:03}", "2024-01-01 00:00:00", 30 + i % 17) for i in range(97)], "id string, created_at string, bytes long").selectExpr("id", "CAST(created_at AS timestamp) AS created_at", "bytes")
    out = batching.greedy_batches(rows, 7, 200, 60, block_rows=10, fan=2)
    assert "Window" not in plan(out)
    got = out.toPandas().sort_values(["batch_no", "pos"])
    assert got["id"].tolist() == [f"e{i:03}" for i in range(97)]
    for _, batch in got.groupby("batch_no"):
        want = spark.createDataFrame([(batch["id"].tolist(),)], "ids array<string>").select(batching.batch_id("ids")).first()[0]
        assert set(batch["batch_id"]) == {want} and batch["pos"].tolist() == list(range(len(batch)))
