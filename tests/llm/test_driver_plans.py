"""Plans of loops stay small, whose planning the driver pays for in memory."""

from mnemolith.llm import common, mixing


def aggregates(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [")


def watched(monkeypatch, module) -> list[int]:
    seen = []
    write = module.materialize
    monkeypatch.setattr(module, "materialize", lambda df: (seen.append(aggregates(df)), write(df))[1])
    return seen


def test_a_round_of_raking_sums_each_axis_once(spark, monkeypatch):
    cells = spark.createDataFrame([("a", "x", "p", 10), ("a", "y", "q", 20), ("b", "x", "q", 30), ("b", "y", "p", 40)], "source string, lang string, topic string, tokens long")
    seen = watched(monkeypatch, mixing)
    rows = {(r["source"], r["lang"]): r["w"] for r in mixing.rake(cells, rounds=2).collect()}
    assert max(seen) <= 1
    assert abs(sum(rows.values()) - 1) < 1e-9


def test_a_round_of_components_plans_its_edges_once(spark, monkeypatch):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 6)], "src long, dst long")
    seen = watched(monkeypatch, common)
    got = {r["node"]: r["component"] for r in common.connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 6: 6, 7: 6}
    assert max(seen) <= 3
