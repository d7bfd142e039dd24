"""Migration of legacy pages: header comments become frontmatter, wikilinks become Markdown links,
broken links become plain text. Column logic where it is flat; one Arrow UDF per page where nesting
of code spans decides.
"""

from __future__ import annotations

import json
import os.path
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.markdown import ANGLE, FENCED, TARGET
from ..functions.paths import MEMORY_TYPES, PERCENT

#: Header keys that a legacy page may carry.
LEGACY_KEYS = ("compiled_from", "source_events", "last_compiled", "timestamp", "memory_type", "trust_tier", "confidence", "type", "title", "description")
_COMMENT = re.compile(r"^<!--\s*([A-Za-z_][\w-]*)\s*:\s*(.*?)\s*-->$", re.A)
_WIKI = re.compile(r"\[\[([^\[\]\n]+)\]\]")
_MARKDOWN = re.compile(r"(!?)\[([^\]]*)\]\(([^)]*)\)")
_ANGLE, _TARGET = re.compile(ANGLE), re.compile(TARGET)
_PIECE = re.compile(rf"{FENCED}|(?P<run>`++)(?:[^\n]*?(?P=run)|[^\n]*+)|(?P<text>[^`\n]++)|\n")
_EXTERNAL = re.compile(r"(?i)https?://|mailto:|tel:|#")
_ANCHOR = re.compile(r"^[^\s:]+:[0-9a-fA-F]{40}:.+:(deleted|[0-9]+:.+)$")


def _words(base: str) -> str:
    """Words of a file name, each begun in upper case and otherwise left alone."""
    text = re.sub(r"[-_]", " ", base)
    return re.sub(r"(^|\s)(\S)", lambda m: m[1] + m[2].upper(), text)


def _cut(text: str, n: int) -> str:
    raw = text.encode()
    return raw[:n].decode(errors="replace") + "..." if len(raw) > n else text


def destination(raw: str) -> str:
    """As the column of the same name, for one text."""
    raw = raw.strip()
    return (m[1] if (m := _ANGLE.match(raw)) else _TARGET.match(raw)[0]).strip()


def outside_code(body: str, change) -> str:
    """``change`` applied to the text outside fences and inline code, piece by piece; an open span ends
    the line."""
    return _PIECE.sub(lambda m: change(m[0]) if m["text"] else m[0], body)


def _escape(href: str) -> str:
    return "".join(next((code for code, c in PERCENT if c == x), x) for x in href)


def _wikilink(rel: str, inner: str) -> str | None:
    target, _, label = (x.strip() for x in inner.strip().partition("|"))
    if not target:
        return None
    cut = min((target.index(s) for s in "#?" if s in target), default=len(target)) if "#" not in target else target.index("#")
    path, suffix = target[:cut].strip(), target[cut:]
    label = label or _words(os.path.splitext(os.path.basename(path))[0]) or target
    label = label.replace("[", "\\[").replace("]", "\\]")
    if not path or _EXTERNAL.match(path):
        return f"[{label}]({target})"
    path = (path if path.endswith(".md") else path + ".md").removeprefix("/")
    rooted = path.split("/")[0] in (*MEMORY_TYPES, "archive")
    href = os.path.relpath("/" + path, "/" + os.path.dirname(rel)) if rooted else os.path.normpath(path)
    return f"[{label}]({_escape(href + suffix)})"


def convert_wikilinks(rel: str, body: str) -> str:
    return outside_code(body, lambda t: _WIKI.sub(lambda m: _wikilink(rel, m[1]) or m[0], t))


def unlink_broken(rel: str, body: str, known: set[str]) -> str:
    """Links into the bundle that lead nowhere are replaced by their label."""

    def one(m):
        link = destination(m[3])
        if m[1] or not link or _EXTERNAL.match(link) or _ANCHOR.match(link):
            return m[0]
        link = link.split("#")[0].split("?")[0]
        for code, c in PERCENT:
            link = link.replace(code, c)
        if not link or link.startswith("/"):
            return m[0]
        target = os.path.normpath(os.path.join(os.path.dirname(rel), link))
        return m[0] if target.startswith("..") or target in known or target == "." else m[2].strip() or m[0]

    return outside_code(body, lambda t: _MARKDOWN.sub(one, t))


def link_paths(rel: str, content: str) -> list[str]:
    """Paths inside the bundle that a page's links resolve to, after wikilinks are converted."""
    out: list[str] = []

    def note(m):
        link = destination(m[3]).split("#")[0].split("?")[0]
        for code, c in PERCENT:
            link = link.replace(code, c)
        if link and not link.startswith("/"):
            out.append(os.path.normpath(os.path.join(os.path.dirname(rel), link)))
        return m[0]

    outside_code(convert_wikilinks(rel, content.replace("\r\n", "\n").replace("\r", "\n")), lambda t: _MARKDOWN.sub(note, t))
    return sorted(set(out))


def split_header(content: str) -> tuple[str | None, str]:
    """(frontmatter with its marks, body); None without frontmatter. Unterminated is an error."""
    text = content.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    lines = text.split("\n")
    if lines[0] != "---":
        return None, text
    for i in range(1, len(lines)):
        if lines[i].strip() == "---":
            return "\n".join(lines[: i + 1]) + "\n", "\n".join(lines[i + 1 :])
    raise ValueError("unterminated YAML frontmatter")


def legacy_header(content: str) -> tuple[dict[str, list[str]], str]:
    """Values of the leading comment block, and what follows it."""
    fields: dict[str, list[str]] = {}
    lines = content.split("\n")
    i = 0
    while i < len(lines):
        line = lines[i].strip()
        m = _COMMENT.match(line)
        key = m[1].replace("-", "_").lower() if m else ""
        if line and key not in LEGACY_KEYS:
            break
        if key:
            fields.setdefault(key, []).extend(v.strip() for v in m[2].split(",") if v.strip())
        i += 1
    return fields, "\n".join(lines[i:])


def new_header(rel: str, old: dict[str, list[str]], body: str, modified: str) -> str:
    """Frontmatter of a legacy page: its own values first, else what path and body tell."""
    first = lambda *keys: next((old[k][0] for k in keys if old.get(k)), "")
    lines = [x.strip() for x in body.split("\n")]
    base = os.path.splitext(os.path.basename(rel))[0]
    title = first("title") or next((x.lstrip("#").strip() for x in lines if x.startswith("#")), None) or _words(base)
    parts = rel.split("/")
    kind = parts[1] if parts[0] == "archive" and len(parts) > 1 else parts[0]
    kind = kind if kind in MEMORY_TYPES else "semantic"
    guess = {"procedural": "procedure", "episodic": "event", "prospective": "event"}.get(kind) or ("person" if re.search("/(people|person)/", rel) else "concept")
    prose = next((x for x in lines if x and not x.startswith(("#", "<!--"))), None)
    sources = list(dict.fromkeys(v for k in ("compiled_from", "source_events") for v in old.get(k, [])))
    tier = first("trust_tier").upper()
    fields = {
        "type": [first("type") or guess],
        "title": [title],
        "description": [first("description") or (_cut(prose, 160) if prose else title)],
        "timestamp": [first("last_compiled", "timestamp") or modified],
        "memory_type": [first("memory_type") or kind],
        "source_events": sources or ["legacy:" + rel],
        "trust_tier": ["T3" if not tier else tier if tier.startswith("T") else "T" + tier],
    }
    if first("confidence"):
        fields["confidence"] = [first("confidence")]
    quote = lambda v: json.dumps(v, ensure_ascii=False)
    rows = [f"{k}: {quote(v[0])}" if len(v) == 1 else f"{k}:\n" + "\n".join(f"  - {quote(x)}" for x in v) for k, v in fields.items()]
    return "\n".join(["---", *rows, "---", ""])


def migrate_page(rel: str, content: str, modified: str, known: set[str]) -> str:
    header, body = split_header(content)
    if header is not None:
        return header + unlink_broken(rel, convert_wikilinks(rel, body), known)
    old, rest = legacy_header(body)
    linked = convert_wikilinks(rel, rest)
    if not old and linked == rest:
        linked, header = body, ""
    elif os.path.basename(rel) == "index.md":
        header = ""
    else:
        header, linked = new_header(rel, old, linked, modified) + "\n", linked.lstrip("\n")
    return header + unlink_broken(rel, linked, known)


def migrate_bundle(pages: DataFrame) -> DataFrame:
    """``path, content, changed, error`` for (path, content, mtime) pages, in path order.

    Which link targets exist comes from a join of the pages' targets with the bundle's paths; no list
    of all paths is broadcast. Running it again changes nothing.
    """

    @F.pandas_udf("array<string>")
    def targets(path: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([link_paths(p, c) for p, c in zip(path, content, strict=True)])

    @F.pandas_udf("struct<content: string, error: string>")
    def migrate(path: pd.Series, content: pd.Series, modified: pd.Series, known: pd.Series) -> pd.DataFrame:
        done = []
        for p, c, m, k in zip(path, content, modified, known, strict=True):
            try:
                done.append((migrate_page(p, c, m, set(k) if k is not None else set()), None))
            except ValueError as e:
                done.append((c, str(e)))
        return pd.DataFrame(done, columns=["content", "error"])

    parts = F.split("path", "/")
    there = pages.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("target")).distinct()
    md = pages.where(F.endswith("path", F.lit(".md")) & ~F.col("path").rlike("(^|/)\\.[^/]*/"))
    known = md.select("path", F.explode(targets("path", "content")).alias("target")).join(there, "target").groupBy("path").agg(F.collect_list("target").alias("known"))
    when = F.date_format("mtime", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    out = md.join(known, "path", "left").withColumn("r", migrate("path", "content", when, "known"))
    return out.select("path", F.col("r.content").alias("content"), (F.col("r.content") != F.col("content")).alias("changed"), F.col("r.error").alias("error")).orderBy("path")
