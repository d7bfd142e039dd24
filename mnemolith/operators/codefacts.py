"""Code facts of Go sources: identifiers, manifests, incremental file sets, and a scanner.

The scanner splits a file into top-level declarations with a tokenizer for strings, comments and
brackets. It isn't a full parser: it finds what stands at the top level and reads names, receivers and
signatures from there. A file without a package clause is an error.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _hashed(prefix: str, parts: list[Column]) -> Column:
    key = F.concat_ws("\0", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(prefix), F.substring(F.sha2(key, 256), 1, 16))


def fact_id() -> Column:
    c = F.col
    return _hashed("fact_", [c("repo"), c("commit_sha"), c("path"), c("kind"), c("symbol"), F.coalesce(c("line"), F.lit(0)), c("status")])


def snippet_id() -> Column:
    c = F.col
    return _hashed("snippet_", [c("repo"), c("commit_sha"), c("path"), c("kind"), c("symbol"), c("start_line"), c("end_line"), c("file_hash")])


def source_anchor() -> Column:
    """Where a fact stands: repo, commit, path, then line and symbol, or that the file is gone."""
    head = F.concat_ws(":", "repo", "commit_sha", "path")
    return F.when(F.col("status") == "deleted", F.concat(head, F.lit(":deleted"))).otherwise(F.concat_ws(":", head, F.col("line").cast("string"), F.col("symbol")))


def file_sets(diff: DataFrame) -> DataFrame:
    """``path, change`` (changed or deleted) of name-status rows (status, old_path, new_path). Both a
    rename and a copy delete the old path and change the new one; a path may be in both sets."""
    kind = F.substring("status", 1, 1)
    two = kind.isin("R", "C")
    item = lambda p, x: F.struct(F.col(p).alias("path"), F.lit(x).alias("change"))
    sets = F.when(kind == "D", F.array(item("old_path", "deleted"))).when(two, F.array(item("old_path", "deleted"), item("new_path", "changed"))).otherwise(F.array(item("old_path", "changed")))
    return diff.where("status <> ''").select(F.explode(sets).alias("x")).select("x.path", "x.change").distinct()


def file_manifest(facts: DataFrame) -> DataFrame:
    """Sorted ids, symbols and anchors per file; duplicates stay."""
    some = lambda c: F.array_sort(F.collect_list(F.nullif(c, F.lit(""))))
    return facts.groupBy("path").agg(some("id").alias("fact_ids"), some("symbol").alias("symbols"), some("anchor").alias("anchors"))


def test_target(name: Column) -> Column:
    """What a test, benchmark or fuzz function is named after, else empty."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"^(?:Test|Benchmark|Fuzz)(.*)\z", 1), F.lit("")), F.lit(""))


_TOP = re.compile(r"(?P<skip>//[^\n]*|/\*.*?\*/|`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|(?P<open>[({\[])|(?P<close>[)}\]])|(?P<word>\b(?:package|import|type|const|var|func)\b)|(?P<end>\n|;)", re.S)


def declarations(source: str) -> list[tuple[str, int, int]]:
    """(keyword, start, end) of what stands at the top level."""
    out, depth, word, start = [], 0, "", 0
    for m in _TOP.finditer(source):
        kind = m.lastgroup
        if kind == "open":
            depth += 1
        elif kind == "close":
            depth -= 1
        elif depth == 0 and kind == "word" and not word:
            word, start = m[0], m.start()
        elif depth == 0 and kind == "end" and word:
            out.append((word, start, m.start()))
            word = ""
    return out + ([(word, start, len(source))] if word else [])


def _specs(body: str, at: int) -> list[tuple[str, int]]:
    """The entries of a declaration, with or without parentheses: text and place."""
    if not body.lstrip().startswith("("):
        return [(body.strip(), at + len(body) - len(body.lstrip()))]
    inner, base = body[body.index("(") + 1 : body.rindex(")")], at + body.index("(") + 1
    out, depth, begin = [], 0, 0
    for m in [*_TOP.finditer(inner), None]:
        if m and m.lastgroup == "open":
            depth += 1
        elif m and m.lastgroup == "close":
            depth -= 1
        elif m is None or (m.lastgroup == "end" and depth == 0):
            stop = m.start() if m else len(inner)
            text = re.sub(r"^(\s|//[^\n]*|/\*.*?\*/)+", "", inner[begin:stop], flags=re.S)
            if text.strip():
                out.append((text.rstrip(), base + stop - len(text)))
            begin = m.end() if m else stop
    return out


def _doc(source: str, start: int) -> str:
    lines = []
    for line in reversed(source[:start].split("\n")[:-1]):
        if not line.startswith("//"):
            break
        lines.append(line[2:].removeprefix(" "))
    return "\n".join(reversed(lines)).strip()


def scan_source(path: str, source: str) -> list[dict]:
    """Facts of one file, without repository columns."""
    line = lambda i: source.count("\n", 0, i) + 1
    facts: list[dict] = []
    package = ""

    def add(kind, symbol, start, end, **more):
        facts.append({"path": path, "kind": kind, "symbol": symbol, "line": line(start), "end_line": line(end), "start": start, "end": end, "name": symbol, "receiver": "", "signature": "", "target": "", "test_target": "", "doc": "", "imports": [], "package": package, **more, "exported": bool(more.get("name", symbol)[:1].isupper()) and kind not in ("package", "import")})

    for word, start, end in declarations(source):
        body = source[start + len(word) : end]
        if word == "package":
            package = body.split("//")[0].strip()
            add("package", package, start, end)
        elif word == "import":
            for text, at in _specs(body, start + len(word)):
                if m := re.search(r'["`]([^"`]+)["`]', text):
                    add("import", m[1], at, at, target=m[1], imports=[m[1]])
        elif word == "type":
            for text, at in _specs(body, start + len(word)):
                name = re.match(r"\w+", text)
                if name:
                    rest = text[name.end() :].strip().removeprefix("=").strip()
                    add("interface" if rest.startswith("interface") else "type", name[0], at, at + len(text), signature=rest, doc=_doc(source, start), whole=(start, end))
        elif word in ("const", "var"):
            for text, at in _specs(body, start + len(word)):
                names = re.match(r"\w+(\s*,\s*\w+)*", text)
                for m in re.finditer(r"\w+", names[0] if names else ""):
                    add(word, m[0], at + m.start(), at + len(text), signature=text, doc=_doc(source, start), whole=(start, end))
        elif m := re.match(r"\s*(?:\(\s*(?:\w+\s+)?(?P<recv>[^)]+?)\s*\))?\s*(?P<name>\w+)", body):
            brace = re.search(r"\{\s*(?:\n|\S.*\}$|$)", body)
            signature = ("func" + (body[: brace.start()] if brace else body)).strip()
            recv = m["recv"] or ""
            test = re.match(r"(Test|Benchmark|Fuzz)(.*)", m["name"])
            kind = "method" if recv else "test" if test and path.endswith("_test.go") else "func"
            add(kind, f"{recv}.{m['name']}" if recv else m["name"], start, end, name=m["name"], receiver=recv.lstrip("*").split("[")[0], signature=signature, doc=_doc(source, start), test_target=test[2] if test else "", whole=(start, end))
    if not package:
        raise ValueError(f"parse {path}: no package clause")
    imports = sorted(f["target"] for f in facts if f["kind"] == "import")
    for f in facts:
        if f["kind"] == "package":
            f["imports"] = imports
        f["content"] = source[slice(*f.pop("whole"))] if "whole" in f else None
    return facts


FACT_COLUMNS = "path string, kind string, symbol string, name string, line int, end_line int, package string, receiver string, signature string, doc string, target string, imports array<string>, exported boolean, test_target string, content string, file_hash string"


def scan_facts(files: DataFrame, repo: str, commit: str, deleted: DataFrame | None = None) -> DataFrame:
    """Facts of (path, content) Go files, with tombstones for deleted ones; ``content`` is the source
    of the declaration (null for package and import facts). One bad file fails the scan."""

    def scan(frames):
        for f in frames:
            rows = [x | {"file_hash": h} for p, c, h in zip(f["path"], f["content"], f["file_hash"], strict=True) for x in scan_source(p, c)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FACT_COLUMNS.split(", ")])

    go = files.where(F.endswith("path", F.lit(".go"))).select("path", "content", F.sha2("content", 256).alias("file_hash"))
    facts = go.mapInPandas(scan, FACT_COLUMNS).withColumn("status", F.lit("present"))
    if deleted is not None:
        gone = deleted.where(F.endswith("path", F.lit(".go"))).select("path", F.lit("file").alias("kind"), F.lit("deleted").alias("status"), F.col("path").alias("symbol"), F.lit(False).alias("exported"))
        facts = facts.unionByName(gone, allowMissingColumns=True)
    facts = facts.withColumn("repo", F.lit(repo)).withColumn("commit_sha", F.lit(commit))
    return facts.withColumn("anchor", source_anchor()).withColumn("id", fact_id()).orderBy("path", "line", "kind", "symbol")


def snippets(facts: DataFrame) -> DataFrame:
    """Source ranges of the facts that have one, with their fact's id."""
    own = facts.where("content IS NOT NULL").withColumn("end_line", F.col("line") + F.size(F.split("content", "\n")) - 1).withColumn("start_line", F.col("line"))
    return own.select(snippet_id().alias("id"), F.col("id").alias("fact_id"), "kind", "repo", "commit_sha", "path", "start_line", "end_line", "symbol", "anchor", F.lit("go").alias("language"), "file_hash", "content")
