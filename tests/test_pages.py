import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from mnemolith.operators import codefacts, lint, migrate, pages, surface
from mnemolith.plans import registry
from mnemolith.plans.page_queries import GOOD, LEGACY
from mnemolith.store import MemoryStore

PAGE = "path string, content string"


def issues(spark, rows, strict=False):
    return [(r["severity"], r["message"]) for r in lint.validate_bundle(spark.createDataFrame(rows, PAGE), strict).collect()]


def test_valid_bundle(spark):
    assert issues(spark, [("semantic/a.md", GOOD + "[b](b.md 'title') [c](<b.md>) ![x](none.png)"), ("semantic/b.md", GOOD)]) == []


def test_five_hard_errors(spark):
    bad = "---\ntype: ''\ntitle: t\ndescription: d\ntimestamp: soon\nmemory_type: x\nsource_events: [e]\ntrust_tier: T7\nconfidence: odd\n---\n"
    assert sum(s == "error" for s, _ in issues(spark, [("a.md", bad)])) == 5


def test_missing_frontmatter(spark):
    got = issues(spark, [("a.md", "text")])
    assert (sum(s == "error" for s, _ in got), sum(s == "warning" for s, _ in got)) == (1, 4)
    assert issues(spark, [("deep/index.md", "text")]) == []


def test_crlf_and_block_scalar(spark):
    text = GOOD.replace('description: "d"', "description: |\n  two\n  lines").replace("\n", "\r\n")
    assert issues(spark, [("semantic/a.md", text)]) == []


@pytest.mark.parametrize("link, broken", [("none.md", True), ("`x` [y](none.md)", None), ("../..//etc/x.md", False), ("repo:" + "a" * 40 + ":f.go:deleted", False), ("a.md#x", False), (".", False), ("%61.md", True)])
def test_links(spark, link, broken):
    body = f"[x]({link})" if broken is not None else link
    assert bool(issues(spark, [("semantic/a.md", GOOD + body)])) == (broken is not False)


def test_upsert_trust_and_sources(spark):
    old = spark.createDataFrame([("semantic/a.md", "v0", ["e1"], 2, "t0", "semantic")], "path string, content string, source_events array<string>, trust_tier_max int, created_at string, memory_type string")
    writes = spark.createDataFrame([("semantic/a.md", "v1", ["e2", "e1"], 1, "t1", 0), ("semantic/a.md", "v2", ["e2"], 3, "t2", 1), ("x.md", "n", ["e"], 0, "t3", 2)], "path string, content string, sources array<string>, trust_tier int, at string, write_no int")
    got = {r["path"]: r for r in pages.upsert_pages(old, writes).collect()}
    assert got["semantic/a.md"][1:] == ("v2", ["e1", "e2"], 1, "t0", "semantic")
    assert (got["x.md"]["trust_tier_max"], got["x.md"]["memory_type"]) == (0, "")


def test_index_placeholder_and_links(spark):
    got = {r["path"]: r["content"] for r in pages.category_index(spark.createDataFrame([("semantic/d/x.md", "# T\n<!-- c -->\nline"), ("semantic/a-b.md", "---\nq")], PAGE)).collect()}
    assert got["semantic/index.md"] == "# Semantic\n\n- [a-b.md](a-b.md) — ---\n- [x.md](d/x.md) — line\n"
    assert got["episodic/index.md"] == "# Episodic\n\n_No pages yet._\n"
    assert got["index.md"].startswith("# Wiki Index\n\n## semantic\n\n- [a-b.md](semantic/a-b.md)")


def test_migration_twice_changes_nothing(spark):
    ddl = "path string, content string, mtime timestamp"
    rows = [(p, c, dt.datetime(2024, 5, 6)) for p, c in LEGACY] + [("semantic/index.md", "<!-- type: x -->\n[[new]]", None), ("bad.md", "---\nopen", None), ("prospective/p.md", "<!-- trust_tier: 2 -->\nbody", dt.datetime(2024, 5, 6))]
    once = migrate.migrate_bundle(spark.createDataFrame(rows, ddl)).collect()
    got = {r["path"]: r for r in once}
    assert got["bad.md"]["error"] == "unterminated YAML frontmatter" and not got["bad.md"]["changed"]
    assert got["semantic/index.md"]["content"] == "[New](new.md)"
    assert 'timestamp: "2024-05-06T00:00:00Z"' in got["prospective/p.md"]["content"] and 'trust_tier: "T2"' in got["prospective/p.md"]["content"]
    again = migrate.migrate_bundle(spark.createDataFrame([(r["path"], r["content"], None) for r in once], ddl))
    assert again.where("changed").count() == 0


def test_code_facts(spark):
    src = 'package m\n\nvar (\n\ta, b = "(", 2 // {\n)\n\nfunc F[T any](x T) {}\n'
    facts = codefacts.scan_facts(spark.createDataFrame([("m.go", src)], PAGE), "r", "c" * 40, spark.createDataFrame([("gone.go",), ("x.txt",)], "path string"))
    rows = [(r["kind"], r["symbol"], r["line"]) for r in facts.collect()]
    assert rows == [("file", "gone.go", None), ("package", "m", 1), ("var", "a", 4), ("var", "b", 4), ("func", "F", 7)]
    snip = codefacts.snippets(facts).collect()
    assert {r["fact_id"] for r in snip} <= {r["id"] for r in facts.collect()}
    with pytest.raises(ValueError):
        codefacts.scan_source("x.go", "func f() {}")


def test_store(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path))
    store.append_event(spark.createDataFrame([("hello", "a")], "content string, actor string"))
    assert store.read_events_since(5)[1] == 1 and store.read_recent_events(3).count() == 1
    ddl = "path string, content string, sources array<string>, trust_tier int, at string, write_no int"
    store.write_pages(spark.createDataFrame([("semantic/a.md", "Alice", ["e"], 1, "t", 0)], ddl))
    with pytest.raises(ValueError):
        store.write_pages(spark.createDataFrame([("../a.md", "x", ["e"], 1, "t", 0)], ddl))
    store.rebuild_index()
    assert "semantic/a.md" in store.index()
    assert {r["path"] for r in store.search("alice").collect()} == {"semantic/a.md", "semantic/index.md", "index.md"}
    store.archive(spark.createDataFrame([("semantic/a.md", "old", "t")], "path string, reason string, at string"))
    assert store.read_page("archive/semantic/a.md").count() == 1
    assert store.advance_cursor(1) and not store.advance_cursor(1)
    assert store.stats().first().asDict() == {"events": 1, "uncompiled": 0, "pages": 4, "archived": 1}
    with pytest.raises(PermissionError):
        MemoryStore(spark, str(tmp_path), read_only=True).rebuild_index()


HEAD = "<!-- compiled_from: e -->\n<!-- last_compiled: t -->\n"


def test_open_page_records_the_access(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path))
    store.write_pages(spark.createDataFrame([("semantic/a.md", "A", ["e"], 2, "t", 0)], "path string, content string, sources array<string>, trust_tier int, at string, write_no int"))
    assert store.open_page("semantic/b.md").count() == 0 and store.telemetry().count() == 0
    row = store.open_page("semantic/a.md").first()
    assert (row["content"], row["source_events"], row["trust_tier_max"]) == ("A", ["e"], 2) and row["last_accessed"]
    assert 1 <= len(store.open_page("semantic/a.md").first()["access_dates"]) <= 2  # twice a day counts once
    bundle = MemoryStore(spark, str(tmp_path), read_only=True)
    before = spark.read.parquet(f"{tmp_path}/reads").count()
    row = bundle.open_page("semantic/a.md").first().asDict()
    assert {k: v for k, v in row.items() if v is not None} == {"path": "semantic/a.md", "content": "A", "memory_type": "semantic"}
    assert bundle.open_page("semantic/a.md").count() == 1 and spark.read.parquet(f"{tmp_path}/reads").count() == before == 2


def test_staged_turn_swaps_all_or_nothing(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path))
    store.write_pages(spark.createDataFrame([("semantic/a.md", HEAD + "A", ["e"], 2, "t", 0)], "path string, content string, sources array<string>, trust_tier int, at string, write_no int"))
    more = lambda path, text: lambda p: p.select("path", "content").union(spark.createDataFrame([(path, text)], "path string, content string"))
    version = store.tree.current()
    assert store.staged_turn(more("semantic/b.md", "no header")).count() == 1
    assert store.staged_turn(more("notes.txt", "x")).count() == 1
    assert store.staged_turn(lambda p: p.where("false")).count() == 1  # a page gone
    assert store.staged_turn(more("semantic/b.md", HEAD + "B" * 99), budget=50).first()["path"] == ""
    with pytest.raises(ZeroDivisionError):
        store.staged_turn(lambda p: 1 // 0)
    assert store.tree.current() == version
    assert store.staged_turn(more("semantic/b.md", HEAD + "B")).count() == 0
    assert {r["path"]: r["source_events"] for r in store.pages().collect()} == {"semantic/a.md": ["e"], "semantic/b.md": None}
    with pytest.raises(PermissionError):
        MemoryStore(spark, str(tmp_path), read_only=True).staged_turn(lambda p: p)


def test_walk_order_ranks_every_page(spark, tmp_path):
    n = 450
    spark.range(n).selectExpr("id AS doc_id", "'t' AS text", "'s' || id % 5 AS source").write.parquet(f"{tmp_path}/documents.parquet")
    rows = registry.QUERIES["walk_order"](spark, str(tmp_path)).collect()
    got = [r["path"] for r in sorted(rows, key=lambda r: r["rank"])]
    assert sorted(r["rank"] for r in rows) == list(range(1, n + 1)) and got == sorted(got, key=lambda p: p.split("/"))


def test_index_parts_join_to_the_index(spark):
    many = [(f"{c}/{'d/' * (i % 3)}p{i:03d}.md", f"# T\n{'é' * (i % 70)} line {i}") for i in range(60) for c in ("episodic", "prospective")]
    for rows in ([], [("semantic/a.md", None), ("semantic/index.md", "x"), ("other/b.md", "x"), ("procedural/b.md", "")], many):
        df = spark.createDataFrame(rows, PAGE)
        want = {r["path"]: r["content"] for r in pages.category_index(df).collect()}
        for size in (1, 200, 1 << 20):
            parts = pages.category_index_parts(df, size).orderBy("path", "begin").collect()
            got: dict[str, str] = {}
            for r in parts:
                assert r["begin"] == len(got.get(r["path"], "").encode()) and r["begin"] // size == r["part_no"]
                got[r["path"]] = got.get(r["path"], "") + r["content"]
            assert got == want
    assert all(len(r["content"].encode()) < 200 + 300 for r in pages.category_index_parts(df, 200).collect())
    with pytest.raises(ValueError):
        pages.category_index_parts(df, 0)


def test_manifest_parts_hold_the_manifest(spark):
    ids = [("f%03d" % (i % 90),) for i in range(120)] + [(None,), ('q"\n\\é',)]
    hashes = [(f"d/{i}.go", None if i % 4 == 0 else "" if i % 4 == 1 else f"h{i}") for i in range(50)]
    sets = [(f"d/{i % 9}.go", "deleted" if i % 2 else "changed") for i in range(20)]
    for a, b, c in ((ids, hashes, sets), (ids, hashes, None), ([], [], []), ([], [], None)):
        facts, files = spark.createDataFrame(a, "id string"), spark.createDataFrame(b, "path string, hash string")
        changed = None if c is None else spark.createDataFrame(c, "path string, change string")
        want = surface.scan_manifest(facts, files, changed).first()
        for size in (1, 300, 1 << 20):
            parts = surface.scan_manifest_parts(facts, files, changed, size).orderBy("begin").collect()
            assert all(r["begin"] // size == r["part_no"] and len(r["content"].encode()) < size + 100 for r in parts)
            lines = [json.loads(x) for x in "".join(r["content"] for r in parts).split("\n")[:-1]]
            assert lines[0] == {"incremental": c is not None}
            assert [x["fact_id"] for x in lines if "fact_id" in x] == want["fact_ids"]
            assert {x["path"]: x["hash"] for x in lines if "path" in x} == want["file_hashes"]
            for kind in ("changed", "deleted"):
                assert [x[kind] for x in lines if kind in x] == (want[kind] or [])


def test_category_index_of_every_page(spark, tmp_path):
    rows = [(3, "# t\n" + "x" * 99 + "éé", "s"), (1, "é" * 51, "s"), (2, "short", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["path"]: r["content"] for r in registry.QUERIES["category_index"](spark, str(tmp_path)).collect()}
    assert got["prospective/index.md"] == "# Prospective\n\n- [3.md](s/3.md) — " + "x" * 99 + "\ufffd...\n"
    assert got["episodic/index.md"].endswith(" — " + "é" * 50 + "...\n") and got["procedural/index.md"].endswith(" — short\n")
    assert got["semantic/index.md"] == "# Semantic\n\n_No pages yet._\n"


WRITE = "path string, content string, sources array<string>, trust_tier int, at string, write_no int"


def test_two_page_writers_both_land(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    store = MemoryStore(spark, str(tmp_path))
    write = lambda i: store.write_pages(spark.createDataFrame([(f"semantic/{i}.md", f"c{i}", [f"e{i}"], 1, "t", 0), ("semantic/same.md", f"s{i}", [f"e{i}"], 1, "t", 0)], WRITE))
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(write, range(3)))
    rows = {r["path"]: r for r in store.pages().collect()}
    assert set(rows) == {f"semantic/{x}.md" for x in (0, 1, 2, "same")} and set(rows["semantic/same.md"]["source_events"]) == {"e0", "e1", "e2"}
    before = store.tree._version(store.tree.current())["buckets"]
    store.write_pages(spark.createDataFrame([("semantic/0.md", "new", ["e9"], 1, "t", 0)], WRITE))
    after = store.tree._version(store.tree.current())["buckets"]
    assert len(before) == len(after) and sum(before[b] != after[b] for b in before) == 1  # one bucket was written


def test_a_turn_from_an_old_version_is_refused(spark, tmp_path):
    from mnemolith.sources.files import StaleBase

    store = MemoryStore(spark, str(tmp_path))
    store.write_pages(spark.createDataFrame([("semantic/a.md", HEAD + "A", ["e"], 2, "t", 0)], WRITE))

    def edit(p):
        store.write_pages(spark.createDataFrame([("semantic/b.md", HEAD + "B", ["e"], 2, "t", 0)], WRITE))
        return p.select("path", F.concat("content", F.lit("!")).alias("content"))

    with pytest.raises(StaleBase):
        store.staged_turn(edit)
    assert {r["path"]: r["content"] for r in store.pages().collect()} == {"semantic/a.md": HEAD + "A", "semantic/b.md": HEAD + "B"}


def test_archive_keeps_reason_time_and_accesses(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path))
    page = lambda text: store.write_pages(spark.createDataFrame([("semantic/a.md", text, ["e"], 2, "t", 0)], WRITE))
    page("A")
    store.open_page("semantic/a.md")
    store.archive(spark.createDataFrame([("semantic/a.md", "stale", "2024")], "path string, reason string, at string"))
    row = store.read_page("archive/semantic/a.md").first()
    assert (row["archived_at"], row["archive_reason"], row["source_events"]) == ("2024", "stale", ["e"])
    assert {r["path"] for r in store.telemetry().collect()} == {"archive/semantic/a.md"}
    page("again")
    assert store.read_page("semantic/a.md").first()["archived_at"] is None and store.read_page("archive/semantic/a.md").first()["archive_reason"] == "stale"
    with pytest.raises(FileNotFoundError):
        store.archive(spark.createDataFrame([("semantic/none.md", "x", "t")], "path string, reason string, at string"))


def test_scratch_of_one_thread_leaves_others_alone(spark):
    import threading

    from mnemolith.sources.tables import Scratch, materialize

    kept = []
    with Scratch(spark):
        mine = materialize(spark.range(3))
        t = threading.Thread(target=lambda: kept.append(materialize(spark.range(5))))
        t.start()
        t.join()
        assert mine.count() == 3
    assert kept[0].count() == 5
    with pytest.raises(Exception):
        mine.count()
