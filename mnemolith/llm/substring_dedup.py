"""Substring deduplication with a compressed FM-index per shard.

Windows of ``window`` words are placed by content: the smallest hash of an 8-word run inside a window
is its anchor, so equal windows share one. Windows of a document that follow each other and share an
anchor form a unit. Anchors met in one document only end there. Of the others, each distinct unit
goes once to the shard of its anchor, with its words and the smallest document it stands in. Anchors only
place units: units count as equal by a 128-bit cryptographic digest of their words, and shards compare the
words themselves.

A shard numbers its words, joins its units to one text over them, sorts its suffixes, and keeps the
Burrows-Wheeler transform as a wavelet matrix with rank counts. Every unit is then streamed through backward search,
which yields matching statistics cut off at the window: at each place the suffix interval of the
window, and from it the smallest document where the window starts. Documents read their units'
statistics back and drop the words of windows that start in a smaller document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, mix, powers, slices, word_hashes

BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
RUN = 8


class RunHashes:
    """Hash of any run of words in constant time: prefix sums of a polynomial modulo 2**64."""

    _up = _down = np.ones(1, np.uint64)

    def __init__(self, h: np.ndarray):
        n = len(h)
        if len(RunHashes._up) <= n:
            size = 2 * n + 1024
            RunHashes._up = powers(BASE, size)
            RunHashes._down = powers(BASE_INVERSE, size)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * RunHashes._up[:n], dtype=np.uint64)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * RunHashes._down[start]
        return mix(mix(raw) + (end - start).astype(np.uint64))


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w values in a row, by doubling."""
    out, done = v, 1
    while done < w:
        step = min(done, w - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


class Words:
    """A text's words with one space between them, and where each starts and ends."""

    def __init__(self, text: bytes | None):
        self.text = b" ".join((text or b"").split())
        gaps = np.flatnonzero(np.frombuffer(self.text, np.uint8) == 32)
        self.start, self.end = np.append(0, gaps + 1), np.append(gaps, len(self.text))
        if not self.text:
            self.start, self.end = self.start[:0], self.end[:0]

    def spans(self, first: np.ndarray, last: np.ndarray) -> list[bytes]:
        """The words first .. last - 1 of each pair."""
        t = self.text
        return [t[a:b] for a, b in zip(self.start[first].tolist(), self.end[last - 1].tolist(), strict=True)]

    def digests(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """128 bits of each span, as two columns."""
        return digests_of(self.spans(first, last))


def digests_of(spans: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(s, digest_size=16).digest() for s in spans), np.int64).reshape(-1, 2)


def units_of(h: np.ndarray, window: int, chunk: int = 1 << 20):
    """(anchor, first, last) arrays of a text's units; first and last are window starts."""
    n = len(h) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    runs = RunHashes(h)
    at = np.arange(len(h) - RUN + 1)
    v = runs.of(at, at + RUN)
    places = []
    for c in range(0, n, chunk):  # value above, place below: of equal values the first counts
        part = v[c : c + chunk + window - RUN]
        key = (part >> np.uint64(24) << np.uint64(24)) | np.arange(len(part), dtype=np.uint64)
        places.append((sliding_min(key, window - RUN + 1) & np.uint64(0xFFFFFF)).astype(np.int64) + c)
    anchor = np.concatenate(places)[:n]
    first = np.concatenate(([0], np.flatnonzero(np.diff(anchor)) + 1))
    last = np.append(first[1:], n) - 1
    return v[anchor[first]], first, last


class WaveletMatrix:
    """Symbols 0..sigma-1 as one packed bit vector a level, with the ones before each 64-bit word."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.before, self.zeros = [], [], []
        s, n = symbols, len(symbols)
        for lv in range(self.levels - 1, -1, -1):
            bit = ((s >> lv) & 1).astype(np.uint8)
            packed = np.packbits(np.pad(bit, (0, -n % 64 + 64)), bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.before.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))[:-1])
            self.zeros.append(n - int(bit.sum()))
            s = np.concatenate((s[bit == 0], s[bit == 1]))
        #: where each symbol's block starts in the last level's order
        order, self.start = np.unique(s, return_index=True)
        full = np.zeros(sigma, np.int64)
        full[order] = self.start
        self.start = full

    def _ones(self, lv: int, i: np.ndarray) -> np.ndarray:
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[lv][i >> 6] + np.bitwise_count(self.bits[lv][i >> 6] & mask)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol c[j] before place i[j]."""
        i = i.copy()
        for k in range(self.levels):
            one = (c >> (self.levels - 1 - k)) & 1
            ones = self._ones(k, i)
            i = np.where(one == 1, self.zeros[k] + ones, i - ones)
        return i - self.start[c]


class FMIndex:
    """Index of a word text; suffixes are sorted by their first 64 words or more, which backward
    search for patterns up to that length can't tell from a full sort."""

    def __init__(self, text: np.ndarray, window: int):
        n = len(text)
        rank, k, ranks = text.astype(np.int64), 1, {}
        while k < max(64, window):
            ranks[k] = rank
            tail = np.zeros(n, np.int64)
            tail[: max(n - k, 0)] = rank[k:] + 1
            key = rank * (int(tail.max(initial=0)) + 1) + tail
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            new[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
            rank, k = new, 2 * k
        self.sa = order
        sigma = int(text.max(initial=0)) + 1
        self.bwt = WaveletMatrix(text[self.sa - 1], sigma)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        self.n, self._ranks = n, ranks

    def blocks(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Block number of each row, rows of a block agreeing in their first ``length`` words, and
        the starts of the blocks (with n at the end)."""
        k = max(x for x in self._ranks if x <= length)
        r, at = self._ranks[k], self.sa
        rest = np.minimum(at + length - k, self.n - 1)
        same = (r[at][1:] == r[at][:-1]) & (r[rest][1:] == r[rest][:-1])
        block = np.concatenate(([0], np.cumsum(~same)))
        return block, np.append(np.flatnonzero(np.concatenate(([True], ~same))), self.n)

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of the patterns with word c put in front."""
        return self.first[c] + self.bwt.rank(c, lo), self.first[c] + self.bwt.rank(c, hi)


def window_owners(units: list[np.ndarray], docs: np.ndarray, window: int) -> list[np.ndarray]:
    """For each window of each unit, the smallest document of a unit in which it starts."""
    sizes = np.array([len(u) for u in units], np.int64)
    flat = np.concatenate([np.append(u, np.uint64(0)) for u in units])
    start = np.cumsum(sizes + 1) - (sizes + 1)
    body = np.ones(len(flat), bool)
    body[start + sizes] = False
    ids = np.zeros(len(flat), np.int64)
    ids[body] = np.unique(flat[body], return_inverse=True)[1] + 1  # 0 ends a unit
    index = FMIndex(ids, window)
    whole, whole_at = index.blocks(window)
    part, part_at = index.blocks(window - 1)
    owner = np.repeat(docs, sizes + 1)[index.sa]
    least = np.minimum.reduceat(owner, whole_at[:-1])
    out = np.zeros(int((sizes - window + 1).sum()), np.int64)
    end = np.cumsum(sizes - window + 1)
    lo, hi = np.zeros(len(units), np.int64), np.full(len(units), index.n, np.int64)
    order = np.argsort(-sizes, kind="stable")
    for step in range(1, int(sizes.max()) + 1):
        q = order[: np.searchsorted(-sizes[order], -step, side="right")]  # units with so many words
        c = ids[start[q] + sizes[q] - step]
        a, b = index.extend(c, lo[q], hi[q])
        if step >= window:
            row = whole[a]
            out[end[q] - 1 - (step - window)] = least[row]
        if step >= window - 1:  # the first window - 1 words are what the next window ends with
            row = part[a]
            a, b = part_at[row], part_at[row + 1]
        lo[q], hi[q] = a, b
    return np.split(out, end[:-1])


def numbered(units: list[bytes]) -> list[np.ndarray]:
    """Units of words as arrays of word numbers: equal numbers are equal words."""
    ids: dict[bytes, int] = {}
    return [np.array([ids.setdefault(w, len(ids) + 1) for w in u.split(b" ")], np.uint64) for u in units]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, shard_words: int = 1_000_000, hot_units: int = 14_000, texts: bool = True) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept_text`` for every row; no ``kept_text`` if not ``texts``.

    Words stand between ASCII white space. Each word covered by a window that also starts in a document
    with a smaller id is removed; windows are judged on the input. Null and empty texts, and texts of
    fewer words than a window, lose nothing. Rows that share an id are one document, so they take
    nothing from each other; a null id counts as the smallest and is returned as null.

    An anchor with more than ``hot_units`` distinct units, about what fills a shard, is split: its windows are
    placed by what they hold.
    """
    spark = docs.sparkSession
    low = -(1 << 63)
    text = F.col(text_col).cast("string")
    own = F.conv(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 15), 16, 10).cast("long")  # tells rows of one id apart
    src = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(low)).alias("doc_id"), own.alias("th"), text.alias("text"))
    names = ["doc_id", "th", "anchor", "c1", "c2", "first", "last"]
    unit_ddl = ", ".join(f"{n} bigint" for n in names)

    def batch_of(cols):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names)

    def add_units(cols, i, th, anchor, words, first, last):
        c = words.digests(first, last + window)
        for col, v in zip(cols, (np.full(len(first), i), np.full(len(first), th), c[:, 0] if anchor is None else anchor.view(np.int64), c[:, 0], c[:, 1], first, last), strict=True):
            col.append(v)

    def find_units(batches):
        for b in slices(batches):
            cols = [[np.empty(0, np.int64)] for _ in names]
            for i, th, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                anchor, first, last = units_of(word_hashes(t), window)
                if len(first):
                    add_units(cols, i, th, anchor, Words(t), first, last)
            yield batch_of(cols)

    def find_anchors(batches):
        for b in slices(batches):
            ids, anchors = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                anchors.append(np.unique(units_of(word_hashes(t), window)[0]))
                ids.append(np.full(len(anchors[-1]), i))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(anchors).view(np.int64))], ["doc_id", "anchor"])

    # A pass for the anchors alone, so that units of anchors met in one document only are never written.
    met = src.select("doc_id", "text").mapInArrow(find_anchors, "doc_id bigint, anchor bigint").groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    met = broadcast_if_small(materialize(met.where("a < b").select("anchor")))
    units = materialize(src.mapInArrow(find_units, unit_ddl).join(met, "anchor", "left_semi").select(*names))

    def shared(u: DataFrame) -> DataFrame:
        """Distinct units (anchor, content) whose anchor stands in two documents or more, each with its
        first place; ``n`` counts those of the anchor. Copies are combined before anything is joined."""
        first = F.min(F.struct("doc_id", "th", "first", "last")).alias("at")
        each = materialize(u.groupBy("anchor", "c1", "c2").agg(first, F.max("doc_id").alias("most")))
        by = each.groupBy("anchor").agg(F.min("at.doc_id").alias("a"), F.max("most").alias("b"), F.count("*").alias("n")).where("a < b")
        return materialize(each.drop("most").join(by.select("anchor", "n"), "anchor"))

    def with_text(per_unit: DataFrame, what) -> DataFrame:
        """Documents joined with an array of theirs."""
        per = per_unit.groupBy("doc_id", "th").agg(F.collect_list(what).alias("at"))
        return src.join(per, ["doc_id", "th"]).select("doc_id", "th", "at", "text")

    def one_window_units(batches):
        """Units of a crowded anchor, a unit for each window and placed by the window's content."""
        for b in slices(batches):
            cols = [[np.empty(0, np.int64)] for _ in names]
            for i, th, at, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).cast(pa.binary()).to_pylist(), strict=True):
                s = np.concatenate([np.arange(r["first"], r["last"] + 1) for r in at])
                add_units(cols, i, th, None, Words(t), s, s)
            yield batch_of(cols)

    distinct = shared(units)
    crowded = materialize(distinct.where(F.col("n") > hot_units).select("anchor").distinct())
    if crowded.take(1):
        crowded = broadcast_if_small(crowded)
        single = materialize(with_text(units.join(crowded, "anchor", "left_semi"), F.struct("first", "last")).mapInArrow(one_window_units, unit_ddl))
        units = units.join(crowded, "anchor", "left_anti").unionByName(single)
        distinct = distinct.where(F.col("n") <= hot_units).unionByName(shared(single))

    def words_of_units(batches):
        schema = pa.schema([("anchor", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("doc_id", pa.int64()), ("words", pa.binary())])
        for b in slices(batches, 64):
            out, size = {name: [] for name in schema.names}, 0
            for i, at, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).cast(pa.binary()).to_pylist(), strict=True):
                first, last = (np.array([r[k] for r in at], np.int64) for k in ("first", "last"))
                spans = Words(t).spans(first, last + window)
                for name, v in zip(schema.names, ([r["anchor"] for r in at], [r["c1"] for r in at], [r["c2"] for r in at], [i] * len(at), spans), strict=True):
                    out[name] += v
                size += sum(map(len, spans))
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pydict(out, schema=schema)
                    out, size = {name: [] for name in schema.names}, 0
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    rep = distinct.select("anchor", "c1", "c2", "at.*")
    sent = with_text(rep, F.struct("anchor", "c1", "c2", "first", "last")).mapInArrow(words_of_units, "anchor bigint, c1 bigint, c2 bigint, doc_id bigint, words binary")

    def search(batches):
        """Shards of whole anchor groups, each near ``shard_words`` words."""
        schema = pa.schema([("c1", pa.int64()), ("c2", pa.int64()), ("until", pa.list_(pa.int32())), ("owner", pa.list_(pa.int64()))])

        def run(rows):
            until, owner = [], []
            for m in window_owners(numbered([r[4] for r in rows]), np.array([r[3] for r in rows], np.int64), window):
                end = np.append(np.flatnonzero(np.diff(m)), len(m) - 1)
                until.append((end + 1).astype(np.int32))
                owner.append(m[end])
            return pa.RecordBatch.from_pydict({"c1": [r[1] for r in rows], "c2": [r[2] for r in rows], "until": until, "owner": owner}, schema=schema)

        held, size = [], 0
        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if size > shard_words and r[0] != held[-1][0]:
                    yield run(held)
                    held, size = [], 0
                held.append(r)
                size += r[4].count(b" ") + 1
        if held:
            yield run(held)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = sent.repartition(parts, "anchor").sortWithinPartitions("anchor", "c1", "c2").mapInArrow(search, "c1 bigint, c2 bigint, until array<int>, owner array<bigint>")
    found = materialize(found)

    def covered(batches):
        """Word intervals of the windows that start in a smaller document."""
        for b in batches:
            ids, ths, lo, hi = [], [], [], []
            for i, th, first, until, owner in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                start = 0
                for u, o in zip(until, owner, strict=True):
                    if o < i:
                        ids.append(i)
                        ths.append(th)
                        lo.append(first + start)
                        hi.append(first + u - 1 + window)
                    start = u
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "th": ths, "lo": lo, "hi": hi}, schema=pa.schema([(n, pa.int64()) for n in ("doc_id", "th", "lo", "hi")]))

    cut = units.join(found, ["c1", "c2"]).select("doc_id", "th", "first", "until", "owner").mapInArrow(covered, "doc_id bigint, th bigint, lo bigint, hi bigint")
    cut = cut.groupBy("doc_id", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("at"))

    def keep(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept_text", pa.string())] * texts)
        for b in slices(batches):
            out = {name: [] for name in schema.names}
            for i, at, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                words = (t or b"").split()
                n = len(words)
                if at:
                    gone = np.zeros(n + 1, np.int64)
                    np.add.at(gone, [r["lo"] for r in at], 1)
                    np.add.at(gone, [r["hi"] for r in at], -1)
                    words = [words[j] for j in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
                kept = b" ".join(words)
                row = (None if i == low else i, n, n - len(words), hashlib.sha256(kept).hexdigest(), *[kept.decode()] * texts)
                for name, v in zip(schema.names, row, strict=True):
                    out[name].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return src.join(cut, ["doc_id", "th"], "left").select("doc_id", "at", "text").mapInArrow(keep, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * texts)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i + 1:i + 50], ' ') AS t FROM (SELECT doc_id, ws, unnest(range(len(ws) - 49)) AS i FROM w WHERE len(ws) >= 50)),
m AS (SELECT t, min(doc_id) AS d FROM win GROUP BY t),
gone AS (SELECT win.doc_id, i FROM win JOIN m ON win.t = m.t WHERE d < win.doc_id),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w WHERE len(ws) > 0),
y AS (SELECT x.doc_id, x.i, word, max(gone.i) OVER (PARTITION BY x.doc_id ORDER BY x.i) AS s FROM x LEFT JOIN gone ON x.doc_id = gone.doc_id AND x.i = gone.i),
z AS (SELECT doc_id, count(*) AS c, coalesce(string_agg(word, ' ' ORDER BY i), '') AS kept FROM y WHERE s IS NULL OR s < i - 49 GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(c, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN z ON w.doc_id = z.doc_id
"""
