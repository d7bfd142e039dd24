"""License scans by template-markup matching.

A template is wording with marked regions: ``<<opt>> ... <<end>>`` may be left out, ``<<one:a|b>>`` is one
of some words, ``<<any:m-n>>`` stands for m to n words of any kind. It compiles into an automaton over
words; a text is accepted at a place where every mandatory word is met exactly, in order. All
templates run as one automaton whose state sets are determinised as they are met.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Template wording by label (words as the scanner sees them: lower case, no punctuation).
TEMPLATES = {
    "agpl": "gnu affero general public license",
    "apache-2.0": "licensed under the apache license <<opt>>version<<end>> 2 0 <<opt>>the license<<end>>",
    "apache-2.0-notice": (
        "you may not use this file except in compliance with the license you may obtain a copy of the license at"
        " <<any:1-12>> unless required by applicable law or agreed to in writing software distributed under the license is"
        " distributed on an as is basis without warranties or conditions of any kind either express or implied"
    ),
    "artistic-2.0": "artistic license <<opt>>version<<end>> 2 0",
    "boost-1.0": "boost software license <<opt>>version<<end>> 1 0",
    "bsd-conditions": (
        "redistribution and use in source and binary forms with or without modification are permitted"
        " <<one:provided|providing>> that the following conditions are met"
    ),
    "bsd-endorsement": (
        "neither the <<one:name|names>> of <<any:1-12>> nor the names of <<one:its|their>> contributors may be used to endorse"
        " or promote products derived from this software without specific prior written permission"
    ),
    "cc-attribution": "creative commons attribution <<one:1|2|3|4>> <<one:0|5>> <<opt>><<one:international|unported|generic>><<end>> license",
    "cc-by-nc": "<<one:licensed|released|available>> under <<opt>>a<<end>> <<opt>>creative commons<<end>> cc by nc",
    "cc-by-nd": "<<one:licensed|released|available>> under <<opt>>a<<end>> <<opt>>creative commons<<end>> cc by nd",
    "cc-by-sa": "<<one:licensed|released|available>> under <<opt>>a<<end>> <<opt>>creative commons<<end>> cc by sa",
    "cc0-1.0": "cc0 1 0 universal",
    "epl": "eclipse public license <<opt>><<one:v|version>><<end>> <<one:1|2|v1|v2>> 0",
    "gpl-2.0": "licensed under the <<opt>>terms of the<<end>> gnu general public license <<opt>>version<<end>> <<one:2|v2>>",
    "gpl-3.0": "licensed under the <<opt>>terms of the<<end>> gnu general public license <<opt>>version<<end>> <<one:3|v3>>",
    "gpl-notice": (
        "program is free software you can redistribute it and or modify it under the terms of the gnu general public license"
        " as published by the free software foundation either version <<any:1-1>> of the license or <<opt>>at your option<<end>>"
        " any later version"
    ),
    "isc-text": (
        "permission to use copy modify and <<opt>>or<<end>> distribute this software for any purpose with or without fee is"
        " hereby granted provided that the above copyright notice and this permission notice appear in all copies"
    ),
    "lgpl": "gnu <<one:lesser|library>> general public license",
    "mit": "<<one:licensed|released|distributed>> under the <<opt>>terms of the<<end>> mit license",
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files the software to deal in the software without restriction including without limitation"
        " the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to"
        " permit persons to whom the software is furnished to do so subject to the following conditions"
    ),
    "mit-warranty": (
        "software is provided as is without warranty of any kind express or implied including but not limited to the"
        " warranties of merchantability fitness for a particular purpose and <<one:noninfringement|nonfringement>>"
    ),
    "mpl-2.0": "subject to the terms of the mozilla public license <<one:v|version>> 2 0",
    "reserved-holder": "copyright <<opt>>c<<end>> <<any:1-8>> all rights reserved",
    "unlicense": "free and unencumbered software released into the public domain",
    "zlib": (
        "software is provided as is without any express or implied warranty in no event <<one:will|shall>> the"
        " <<one:author|authors>> be held liable for any damages arising from the use of this software"
    ),
}

#: ASCII upper case becomes lower case; all ASCII but letters and digits becomes a space.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


class TemplateAutomaton:
    """Words in, labels out. States are numbered per template; a state set is a frozenset."""

    def __init__(self, templates: dict[str, str]):
        self.edges: list[list[tuple[frozenset | None, int]]] = []
        self.skips: list[list[int]] = []
        self.final: dict[int, str] = {}
        starts = []
        for label, markup in templates.items():
            start = at = self._state()
            starts.append(start)
            opened = []
            for part in re.findall(r"<<[^>]*>>|[^\s<]+", markup):
                if part == "<<opt>>":
                    opened.append(at)
                elif part == "<<end>>":
                    self.skips[opened.pop()].append(at)
                elif part.startswith("<<one:"):
                    at = self._step(at, frozenset(w.encode() for w in part[6:-2].split("|")))
                elif part.startswith("<<any:"):
                    low, high = map(int, part[6:-2].split("-"))
                    ends = []
                    for i in range(1, high + 1):
                        at = self._step(at, None)
                        ends += [at] if i >= low else []
                    for e in ends[:-1]:
                        self.skips[e].append(at)
                else:
                    at = self._step(at, frozenset([part.encode()]))
            self.final[at] = label
        self.start = self._close(starts)
        self.first = frozenset(w for s in self.start for ws, _ in self.edges[s] for w in ws or ())
        self.known = frozenset(w for es in self.edges for ws, _ in es for w in ws or ())
        self.table: dict[tuple, tuple] = {}

    def _state(self) -> int:
        self.edges.append([])
        self.skips.append([])
        return len(self.edges) - 1

    def _step(self, at: int, words: frozenset | None) -> int:
        new = self._state()
        self.edges[at].append((words, new))
        return new

    def _close(self, states) -> frozenset:
        todo = list(states)
        seen = set(todo)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def _next(self, states: frozenset, word: bytes | None) -> tuple[frozenset, frozenset]:
        key = (states, word)
        if key not in self.table:
            to = self._close(t for s in states for ws, t in self.edges[s] if ws is None or word in ws)
            self.table[key] = (to, frozenset(self.final[s] for s in to if s in self.final))
        return self.table[key]

    def match(self, words: list[bytes], starts: list[int]) -> list[tuple[int, int, str]]:
        """(start, end, label): the longest match of each label from each start."""
        out = []
        for i in starts:
            states, best = self.start, {}
            for j in range(i, len(words)):
                w = words[j]
                states, labels = self._next(states, w if w in self.known else None)
                for x in labels:
                    best[x] = j + 1
                if not states:
                    break
            out += [(i, e, x) for x, e in best.items()]
        return out


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches`` for every row.

    Words are runs of ASCII letters, digits and non-ASCII characters, with A-Z in lower case. ``n_base``
    counts all places of the base phrases. ``matches`` holds (start, end, label) of accepted templates.
    ``score`` is 1 where a template is accepted, 0.5 where only base phrases stand, else 0. Null and
    empty texts have no words; repeated rows and null ids each give their row.
    """
    phrases = [(p.encode().split(), label) for p, label in base.items()]

    def scan(batches):
        automaton = TemplateAutomaton(templates)
        heads = {p[0] for p, _ in phrases} | automaton.first
        for b in slices(batches):
            out = {k: [] for k in schema.names}
            for i, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = words_of(text)
                at = [j for j, w in enumerate(words) if w in heads]
                places = [(j, label) for j in at for p, label in phrases if words[j] == p[0] and words[j : j + len(p)] == p]
                found = automaton.match(words, [j for j in at if words[j] in automaton.first])
                mine = {x for _, x in places}
                row = (i, len(words), len(places), min((j for j, _ in places), default=None), max((j for j, _ in places), default=None), ",".join(sorted(mine)), ",".join(sorted(mine | {x for _, _, x in found})), 1.0 if found else 0.5 if places else 0.0, [{"start": s, "end": e, "label": x} for s, e, x in found])
                for k, v in zip(schema.names, row, strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    hit = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("matches", pa.list_(hit))])
    ddl = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, matches array<struct<start: bigint, end: bigint, label: string>>"
    return docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"CAST(`{text_col}` AS STRING) AS text").mapInArrow(scan, ddl)


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("matches")


#: The templates again, as patterns over the words joined by single spaces.
_PATTERNS = {
    "agpl": " gnu affero general public license ",
    "apache-2.0": " licensed under the apache license (version )?2 0 ",
    "apache-2.0-notice": (
        " you may not use this file except in compliance with the license you may obtain a copy of the license at"
        " ([^ ]+ ){1,12}unless required by applicable law or agreed to in writing software distributed under the license is"
        " distributed on an as is basis without warranties or conditions of any kind either express or implied "
    ),
    "artistic-2.0": " artistic license (version )?2 0 ",
    "boost-1.0": " boost software license (version )?1 0 ",
    "bsd-conditions": (
        " redistribution and use in source and binary forms with or without modification are permitted"
        " provid(ed|ing) that the following conditions are met "
    ),
    "bsd-endorsement": (
        " neither the names? of ([^ ]+ ){1,12}nor the names of (its|their) contributors may be used to endorse"
        " or promote products derived from this software without specific prior written permission "
    ),
    "cc-attribution": " creative commons attribution [1-4] [05] ((international|unported|generic) )?license ",
    "cc-by-nc": " (licensed|released|available) under (a )?(creative commons )?cc by nc ",
    "cc-by-nd": " (licensed|released|available) under (a )?(creative commons )?cc by nd ",
    "cc-by-sa": " (licensed|released|available) under (a )?(creative commons )?cc by sa ",
    "cc0-1.0": " cc0 1 0 universal ",
    "epl": " eclipse public license ((v|version) )?v?[12] 0 ",
    "gpl-2.0": " licensed under the (terms of the )?gnu general public license (version )?v?2 ",
    "gpl-3.0": " licensed under the (terms of the )?gnu general public license (version )?v?3 ",
    "gpl-notice": (
        " program is free software you can redistribute it and or modify it under the terms of the gnu general public license"
        " as published by the free software foundation either version [^ ]+ of the license or (at your option )?any later version "
    ),
    "isc-text": (
        " permission to use copy modify and (or )?distribute this software for any purpose with or without fee is"
        " hereby granted provided that the above copyright notice and this permission notice appear in all copies "
    ),
    "lgpl": " gnu (lesser|library) general public license ",
    "mit": " (licensed|released|distributed) under the (terms of the )?mit license ",
    "mit-text": f" {TEMPLATES['mit-text']} ",
    "mit-warranty": (
        " software is provided as is without warranty of any kind express or implied including but not limited to the"
        " warranties of merchantability fitness for a particular purpose and non(in)?fringement "
    ),
    "mpl-2.0": " subject to the terms of the mozilla public license (v|version) 2 0 ",
    "reserved-holder": " copyright (c )?([^ ]+ ){1,8}all rights reserved ",
    "unlicense": " free and unencumbered software released into the public domain ",
    "zlib": (
        " software is provided as is without any express or implied warranty in no event (will|shall) the"
        " authors? be held liable for any damages arising from the use of this software "
    ),
}
SQL = (
    r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, ' ' || array_to_string(ws, ' ') || ' ' AS j,
  list_filter(range(len(ws)), lambda i: ws[i + 1] = 'cc' AND ws[i + 2] = 'by') AS a,
  list_filter(range(len(ws)), lambda i: ws[i + 1] = 'general' AND ws[i + 2] = 'public' AND ws[i + 3] = 'license') AS b,
  list_filter(range(len(ws)), lambda i: ws[i + 1] = 'all' AND ws[i + 2] = 'rights' AND ws[i + 3] = 'reserved') AS c FROM w),
q AS (SELECT *, list_concat(a, list_concat(b, c)) AS pl,
  list_filter([CASE WHEN len(a) > 0 THEN 'cc-by' END, CASE WHEN len(b) > 0 THEN 'gpl' END, CASE WHEN len(c) > 0 THEN 'reserved' END], lambda x: x IS NOT NULL) AS bl,
  list_filter(["""
    + ", ".join(f"CASE WHEN regexp_matches(j, '{p}') THEN '{x}' END" for x, p in _PATTERNS.items())
    + r"""], lambda x: x IS NOT NULL) AS tl FROM p)
SELECT doc_id, len(ws)::BIGINT AS n_words, len(pl)::BIGINT AS n_base, list_min(pl)::BIGINT AS first_word, list_max(pl)::BIGINT AS last_word,
  array_to_string(list_sort(bl), ',') AS base_labels, array_to_string(list_sort(list_concat(bl, tl)), ',') AS labels,
  CASE WHEN len(tl) > 0 THEN 1.0 WHEN len(bl) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM q
"""
)
