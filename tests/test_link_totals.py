"""Totals of links by page: links are found once and stay in their row."""

import posixpath
import random
import time

from pyspark.sql import functions as F

from mnemolith.functions import markdown, paths
from mnemolith.operators import lint
from mnemolith.plans import page_queries

BODIES = ["", "none", "[x](b.md) [y](b.md) `[z](c.md)`", "[x](../b.md#a) [y](<c d.md> 't') [z](b%20c.md?q)", "[x](../../../out.md)", "[x](#a) [y](/a) [z](HTTPS://a) [w](mailto:a)", "[a](é.md) [b]()", None]


def by_links(pages):
    target = F.col("target")
    out = lint.page_links(pages).groupBy("path").agg(F.count("*"), F.count(target), F.count_distinct(target), F.min(target), F.max(target), F.sum(F.length(target)))
    return {tuple(r) for r in out.collect()}


def test_totals_equal_those_of_the_links(spark):
    rng = random.Random(3)
    once = [(f"semantic/{i}.md", " ".join(b or "" for b in rng.sample(BODIES, 3))) for i in range(60)] + [("a/x.md", None)]
    pages = spark.createDataFrame(once, "path string, body string")
    totals = lint.link_totals(pages)
    assert {tuple(r) for r in totals.collect()} == by_links(pages) and totals.columns[0] == "path"
    plan = totals._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and plan.count("Aggregate [") == 1  # before: links were exploded, sorted and shuffled
    # Pages of one path, of none, and without a link inside.
    again = [("semantic/1.md", "[x](b.md) [y](new.md)"), ("semantic/1.md", "[x](new.md)"), ("semantic/2.md", "none"), (None, "[x](a.md)"), (None, "[x](a.md) [y](b.md)"), ("o.md", "[x](../o)"), ("o.md", "[x](../../o)")]
    both = pages.union(spark.createDataFrame(again, pages.schema))
    got = {tuple(r) for r in lint.link_totals(both).collect()}
    assert got == by_links(both) and ("o.md", 2, 0, 0, None, None, None) in got and any(r[0] is None and r[1] == 3 for r in got)


def test_links_of_a_page_are_found_once(spark):
    pages = spark.createDataFrame([("a.md", "[x](b.md)")], "path string, body string").selectExpr("path", "upper(body) AS body")
    plan = lint.page_links(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(markdown.next_link(lint.ASIDE)) == 1 and "size(" not in plan.split("Generate")[1]  # before: once more to see whether there are any


def test_links_that_lead_to_files(spark):
    bodies = ["[a](b.md#x) [a](c.md?y#z) [a](d?#) [a](%2F) [a](%20e) [a](#) [a](?) [a](tel:1) [a](Tel:1) [a](x:y) [a](/z) [a]( /z) [a]( #z) [a](<https://a>) [a](`c`https://a) [a](htt`c`ps://a)",
              "[a](r:" + "a1" * 20 + ":f.go:3:F) [a](r:" + "a1" * 20 + ":f.go:no) [a](''b) [a](<>) ![a](i.png) [a] (b) [a]`c`(b'~~~\n~~~\nx\n~~~\n')"]
    got = [r["l"] for r in spark.createDataFrame(list(enumerate(bodies)), "i int, body string").orderBy("i").select(lint.file_links(F.col("body")).alias("l")).collect()]
    assert got == [["b.md", "c.md", "d", "%2F", " e", "x:y"], ["r:" + "a1" * 20 + ":f.go:no", "''b", "b'~~~\n\n\n\n'"]]


def test_brackets_without_partners_are_passed_over_once(spark):
    n = 100_000  # before: each bracket looked through the rest
    texts = ["[" * n + "](b", "[a](" * n, "![a](" * n, "[a] " * n + "[x](y)", "[" * n + "x](y)", "![" * n]
    start = time.time()
    got = {r["i"]: r["t"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, body string").select("i", markdown.link_targets(F.col("body")).alias("t")).collect()}
    assert got == {0: [], 1: [], 2: [], 3: ["y"], 4: ["y"], 5: []} and time.time() - start < 30


def test_paths_are_cleaned_as_by_posixpath(spark):
    rng = random.Random(5)
    some = ["/".join(rng.choice(["a", "b.c", "..", ".", "", "...", ".d", "e.."]) for _ in range(rng.randint(1, 7))) for _ in range(3000)]
    for r in spark.createDataFrame([(x,) for x in some], "p string").select("p", paths.clean_path(F.col("p")).alias("c")).collect():
        want = posixpath.normpath(r["p"].lstrip("/") or ".")
        assert r["c"] == (None if want == ".." or want.startswith("../") else "" if want == "." else want), repr(r["p"])


def test_marked_words_equal_those_one_by_one(spark):
    texts = ["", "a", "12 3", *(" é1".join("abcdefghijklmnopqrstuvwxyz"[:k]) + end for k in (10, 11, 12, 22, 26) for end in ("", " ", "-é"))]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, x string")
    one = F.expr(f"array_join(transform(regexp_extract_all(x, '[A-Za-z]+', 0), (w, i) -> {page_queries.MARKED}), ' ')")
    assert {tuple(r) for r in page_queries._marked(docs).collect()} == {tuple(r) for r in docs.select("path", one).collect()}
