"""Code and links of Markdown: the columns against plain loops over fuzzed texts."""

import random
import re

from pyspark.sql import functions as F

from mnemolith.functions import markdown
from mnemolith.operators import lint, migrate


def plain_lines(body):
    """(line, is it code) with fences followed line by line."""
    fenced = False
    for line in body.split("\n"):
        mark = line.strip().startswith(("```", "~~~"))
        yield line, fenced or mark
        fenced ^= mark


def plain_prose(body):
    out = []
    for line, code in plain_lines(body):
        kept, rest = "", "" if code else line
        while m := re.search("`+", rest):
            kept, rest = kept + rest[: m.start()], rest[m.end() :]
            end = rest.find(m[0])
            rest = rest[end + len(m[0]) :] if end >= 0 else rest
        out.append(kept + rest)
    return "\n".join(out)


def plain_destination(raw):
    raw = raw.strip()
    if raw.startswith("<") and ">" in raw:
        return raw[1 : raw.index(">")].strip()
    quote = ""
    for i, c in enumerate(raw):
        if c in "'\"" and quote in ("", c):
            quote = "" if quote else c
        elif c in " \t\n" and not quote:
            return raw[:i].strip()
    return raw


def plain_targets(body):
    return [plain_destination(m[2]) for m in re.finditer(r"(!?)\[[^\]]*\]\(([^)]*)\)", plain_prose(body)) if not m[1]]


def plain_outside(body, change):
    out = []
    for line, code in plain_lines(body):
        done, rest = "", "" if code else line
        while rest:
            m = re.search("`+", rest)
            done += change(rest[: m.start()] if m else rest)
            end = rest.find(m[0], m.end()) if m else -1
            stop = len(rest) if end < 0 else end + len(m[0])
            done, rest = done + (rest[m.start() : stop] if m else ""), rest[stop:]
        out.append(line if code else done)
    return "\n".join(out)


def fuzz(n, seed=7):
    rng = random.Random(seed)
    bits = ["`", "``", "```", "~~~", "~", "\n", "\n", "\n```", "\n~~~ go", " ", "\t", " ", " ", "\r", "\v", "[", "]", "(", ")", "](", "!", "[a](b.md)", "![i](p.png)", "<", ">", "'", '"', "a", "é", "😀", "x.md", "#", "\\"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_columns_equal_plain_loops(spark):
    texts = [*fuzz(4000), "", "```", "~~~\n", "```\n[a](b)", "a\n```\n[a](b)\n~~~\n[c](d)", "[a\n```\nx\n```\nb](c 'q\n```\ny\n```\n r')", "[x](a  b)", "[x]('a b' c)", "[x]('a b)", "[x](< a b > t)", "[x](<a b)"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, body string").repartition(4)
    got = df.select("i", markdown.prose(F.col("body")).alias("p"), markdown.link_targets(F.col("body")).alias("t")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r["p"], r["t"]) == (plain_prose(texts[r["i"]]), plain_targets(texts[r["i"]])), repr(texts[r["i"]])
    assert sum(len(r["t"]) for r in got) > 500


def test_migration_uses_the_same_grammar():
    for t in fuzz(4000, seed=8):
        assert migrate.outside_code(t, lambda x: f"<{x}>" if x else "") == plain_outside(t, lambda x: f"<{x}>" if x else ""), repr(t)
        assert migrate.destination(t) == plain_destination(t), repr(t)


def test_null_and_long_texts(spark):
    """Half a million lines in a fence, of backticks, or in a link neither recurse nor go back."""
    n = 500_000
    long = ["```\n" + "[a](b)\n" * n + "```\n[c](d)", "` `` " * 1000 + "[c](d)", "[" + "x\n" * n + "](d)", "[c](" + "'q' " * 3 + "y\n" * n + ")", "[c]('" + "y " * n + ")", "a" * n + "[c](d)", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(long)], "i int, body string")
    got = {r["i"]: r["t"] for r in rows.select("i", markdown.link_targets(F.col("body")).alias("t")).collect()}
    assert got[0] == got[2] == got[5] == ["d"] and got[1] == plain_targets(long[1])
    assert got[3] == ["'q'"] and got[4] == ["'" + ("y " * n).strip()] and got[6] is None


def test_page_links_need_no_python_worker(spark):
    pages = spark.createDataFrame([("semantic/a.md", "[x](b.md) `[y](c.md)`", 1), ("semantic/b.md", None, 2)], "path string, body string, link int")
    links = lint.page_links(pages)
    assert [tuple(r) for r in links.collect()] == [("semantic/a.md", "b.md", "semantic/b.md")]
    assert "Python" not in links._jdf.queryExecution().executedPlan().toString()
    assert lint.page_links(pages.where("false")).count() == 0
