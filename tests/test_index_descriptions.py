from mnemolith.functions.text import HEAD_LINES
from mnemolith.operators import pages


def test_index_parts_describe_a_page_once(spark, monkeypatch):
    asked, real = [], pages.first_prose_line
    monkeypatch.setattr(pages, "first_prose_line", lambda *a: asked.append(1) or real(*a))
    late = "# t\n" * HEAD_LINES + "  \nfound late\nnot this"
    df = spark.createDataFrame([("semantic/a.md", late), ("semantic/b.md", "# only\n" * 20), ("semantic/c.md", "\n" * (HEAD_LINES - 2) + " eighth "), ("semantic/d.md", None)], "path string, content string")
    rows = pages.category_index_parts(df).where("path = 'semantic/index.md'").collect()
    assert asked == [1]  # before: once for each of the two indexes
    text = "".join(r["content"] for r in sorted(rows, key=lambda r: r["begin"]))
    assert text.splitlines()[2:] == ["- [a.md](a.md) — found late", "- [b.md](b.md) — ", "- [c.md](c.md) — eighth", "- [d.md](d.md) — "]
