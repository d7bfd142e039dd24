import re

from mnemolith.functions.text import WHITE
from mnemolith.operators import lint


def test_bundle_validation_parses_pages_once(spark, monkeypatch):
    asked = []
    real = lint.parse_fields
    monkeypatch.setattr(lint, "parse_fields", lambda c: asked.append(1) or real(c))
    pages = spark.createDataFrame([("a.md", "---\ntype: concept\n---\n[x](gone.md) [y]`code`(none.md)"), ("b.md", "---\na: [1\n---\n"), ("c.md", None)], "path string, content string")
    out = lint.validate_bundle(pages)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert asked == [1] and "parse_fields" not in plan  # before: a copy for each of the three rule sets
    got = {(r["path"], r["message"]) for r in out.collect()}
    assert ("a.md", "broken internal link: gone.md") in got and ("a.md", "broken internal link: none.md") in got
    assert any(p == "b.md" and m.startswith("invalid YAML") for p, m in got)


def test_frontmatter_cut_equals_that_by_lines(spark):
    texts = ["---", "---\n", "---\n---", "---\n---\nx", "---\na\n \u2003---\t\nb\n---\n", "---\r\na: 1\r---\rb", "--- \na\n---\n", " ---\n---", "---\na\n----\n", "---\n\n---\n\n", "\ufeff---\na\n\u0085---\x0b\nb", "", None, "x\r\ny", "---\na\n---x\n--- ---\n"]
    space = "".join(chr(i) for i in range(0x3001) if re.match(re.sub(r"\\x\{(\w+)\}", lambda m: "\\u" + m[1].zfill(4), f"[{WHITE}]"), chr(i)))
    got = {r["i"]: r for r in lint.split_frontmatter(spark.createDataFrame(list(enumerate(texts)), "i int, content string")).collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert (got[i]["header"], got[i]["body"], got[i]["unterminated"]) == (None, None, None)
            continue
        lines = t.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n").split("\n")
        close = next((k for k, x in enumerate(lines) if k and x.strip(space) == "---"), None)
        if lines[0] != "---":
            want = (None, "\n".join(lines), False)
        elif close is None:
            want = (None, "", True)
        else:
            want = ("\n".join(lines[1:close]), "\n".join(lines[close + 1 :]), False)
        assert (got[i]["header"], got[i]["body"], got[i]["unterminated"]) == want, repr(t)
