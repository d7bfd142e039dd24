"""Regex pitfalls, the command line, and Markdown trees."""

import pytest
from pyspark.sql import functions as F

from mnemolith.__main__ import main
from mnemolith.functions import text
from mnemolith.plans.page_queries import GO, GOOD
from mnemolith.sources.files import PageVersions, checkout, read_markdown, write_markdown


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "fn, value, want",
    [
        (text.trim_all, " \t a b  \n", "a b"),
        (text.lower_runes, "İΣ", "iσ"),
        (text.redact, "ésk-abcdefghij", "ésk_<redacted>"),
        (text.redact, "task-abcdefghij", "task-abcdefghij"),
        (lambda c: text.cut_bytes(c, 3, "..."), "abé", "ab�..."),
        (lambda c: text.cut_bytes(c, 4, "..."), "abé", "abé"),
        (lambda c: text.parse_time(c).isNull(), "2024-01-02", True),
        (lambda c: text.parse_time(c).isNull(), "2024-01-02T00:00:00Z\n", True),
        (lambda c: text.strip_blocks(c, "r"), "a<r>x</r>b<r>rest", "ab"),
    ],
)
def test_text(spark, fn, value, want):
    assert one(spark, fn, value) == want


def tree(tmp_path):
    for path, body in {"semantic/a.md": GOOD + "[b](b.md)", "semantic/b.md": GOOD, ".git/x.md": "no", "n.txt": "x", "pkg/a.go": GO[0].replace("#", "1")}.items():
        p = tmp_path / "wiki" / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    return str(tmp_path / "wiki")


def test_markdown_tree(spark, tmp_path):
    got = read_markdown(spark, tree(tmp_path))
    assert {r["path"] for r in got.collect()} == {"semantic/a.md", "semantic/b.md"}


def test_command_line(spark, tmp_path, capsys):
    root = tree(tmp_path)
    assert main(["validate", root]) == 0
    (tmp_path / "wiki/semantic/c.md").write_text(GOOD + "[x](none.md)")
    assert main(["validate", root]) == 0 and main(["validate", root, "--strict"]) == 1
    assert "broken internal link: none.md" in capsys.readouterr().out
    (tmp_path / "wiki/semantic/d.md").write_text("no header")
    assert main(["validate", root]) == 1 and main(["odd"]) == 2
    assert main(["migrate", root, "--write", str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).where("path = 'semantic/c.md'").first()["content"].endswith("x")
    assert main(["scan", root, "--write", str(tmp_path / "facts")]) == 0
    assert spark.read.json(str(tmp_path / "facts/facts")).count() == 10


def test_scan_names_the_commit_and_relative_paths(spark, tmp_path, capsys):
    root, git, sha = tree(tmp_path), tmp_path / "wiki/.git", "a" * 40
    (git / "y.go").write_text("package no")
    assert checkout(spark, root) == ("", "")
    scan = lambda *args: (main(["scan", root, "--write", str(tmp_path / "facts"), *args]), {(r["repo"], r["commit_sha"], r["path"]) for r in spark.read.json(str(tmp_path / "facts/facts")).collect()})
    assert scan() == (0, {("wiki", "HEAD", "pkg/a.go")})
    (git / "HEAD").write_text("ref: refs/heads/main\n")
    (git / "packed-refs").write_text(f"# pack-refs with: peeled\n{'b' * 40} refs/heads/other\n{sha} refs/heads/main\n^{'c' * 40}\n")
    (git / "config").write_text('[core]\n\turl = no\n[remote "other"]\n\turl = no\n[remote "origin"]\n\tfetch = x\n\turl = git@host:team/name.git\n')
    assert checkout(spark, root) == (sha, "git@host:team/name.git") and scan() == (0, {("name", sha, "pkg/a.go")})
    (git / "refs/heads").mkdir(parents=True)
    (git / "refs/heads/main").write_text("d" * 40 + "\n")  # a loose ref comes before a packed one
    assert checkout(spark, root)[0] == "d" * 40
    (git / "HEAD").write_text(sha)
    assert checkout(spark, root)[0] == sha and scan("--commit", "e" * 40) == (0, {("name", "e" * 40, "pkg/a.go")})


def test_migrate_writes_markdown(spark, tmp_path):
    root = tree(tmp_path)
    old = "<!-- last_compiled: 2024-01-01T00:00:00Z -->\n# Old\n\n[[semantic/a]] tells.\n"
    page = tmp_path / "wiki/semantic/old.md"
    page.write_text(old)
    assert main(["migrate", root, "--tree", str(tmp_path / "out")]) == 0
    assert page.read_text() == old and main(["validate", str(tmp_path / "out"), "--strict"]) == 0
    assert (tmp_path / "out/semantic/a.md").read_text() == (tmp_path / "wiki/semantic/a.md").read_text()
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "wiki").rglob("*.md") if p != page}
    assert main(["migrate", root, "--in-place", "--backup"]) == 0
    assert page.read_text() == (tmp_path / "out/semantic/old.md").read_text() != old
    assert page.with_suffix(".md.bak").read_text() == old
    assert before == {p: p.stat().st_mtime_ns for p in before}  # unchanged pages aren't written
    page.write_text(old)
    with pytest.raises(FileExistsError):
        main(["migrate", root, "--in-place", "--backup"])
    assert page.read_text() == old and not [p for p in (tmp_path / "wiki").rglob("*.tmp")]


def test_markdown_sink(spark, tmp_path):
    ddl = "path string, content string"
    write = lambda *rows, **k: write_markdown(spark.createDataFrame(rows, ddl), str(tmp_path / "w"), **k)
    got = write(("a/é b.md", "ü\n"), ("c.md", None), ("d.md", "x" * 3_000_000))
    assert {r["path"]: r["bytes"] for r in got.collect()} == {"a/é b.md": 3, "c.md": 0, "d.md": 3_000_000}
    assert (tmp_path / "w/a/é b.md").read_text() == "ü\n" and (tmp_path / "w/c.md").read_bytes() == b""
    for rows in ([("../e.md", "")], [("/e.md", "")], [("a/./e.md", "")], [("a//e.md", "")], [(None, "x")], [("e.md", "1"), ("e.md", "1")]):
        with pytest.raises(ValueError):
            write(*rows)
    write(("a/é b.md", "2"), backup=True)
    assert (tmp_path / "w/a/é b.md.bak").read_text() == "ü\n"
    with pytest.raises(FileExistsError):
        write(("new.md", "3"), ("a/é b.md", "3"), backup=True)
    assert not (tmp_path / "w/new.md").exists() and write_markdown(spark.createDataFrame([], ddl), str(tmp_path / "n")).count() == 0


def test_versions_swap(spark, tmp_path):
    v = PageVersions(spark, str(tmp_path / "v"))
    assert v.read() is None
    v.swap(spark.createDataFrame([("a", "1")], "path string, content string"))
    v.swap(v.read().withColumn("content", F.lit("2")))
    assert [tuple(r) for r in v.read().collect()] == [("a", "2")]
    (tmp_path / "v/versions/999999999999-torn").mkdir()  # a write that never finished
    assert v.read().count() == 1
