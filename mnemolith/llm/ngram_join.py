"""N-gram Jaccard join by a token-group matrix.

Documents are sets of word shingles. A shingle's token is a 64-bit hash of its words; tokens choose what
is compared, and the words themselves decide what is linked. Equal texts become one representative.

* Round 1 connects what is easily connected. Sets with the same smallest token, under either of two
  orders, form a group: similar sets agree in it with a probability near their similarity. Each block of a
  group is compared with itself and with the group's first block.
* Round 2 is exact for all that round 1 left in different components. Documents of a component, in blocks
  of bounded size, are its groups. In one global order of tokens, rare ones first, two sets over the
  threshold share several tokens of their prefixes. Tokens whose documents are all of one component are
  dropped; what the prefix of a document shares with the union of a group's prefixes is summed over
  tokens, within size and position bounds, and only cells are visited whose sum reaches what the suffixes can't
  make up for, which is most of the prefix where sizes are alike. Documents of the
  smaller component visit the groups of the larger. Documents outside any component that are of like size and
  have the same one of their commonest tokens are a group, too, in blocks of the same bounds, so that many that are alike but
  not linked meet a few blocks and not each other one by one; they visit their own group's blocks as well.
* A visited group holds the union of its members' tokens, which bounds a query's overlap with every one;
  only a group whose bound reaches the threshold is opened, and its members are then compared.

Components need no pair to leave a task: members already known to be connected aren't compared again,
and one linked pair, checked word by word, goes on for each that joins. Two sets' tokens never show less
overlap than their shingles do while no document's own shingles share a token; where one does, which is
checked, all is done again under another hash. A token's frequency only affects speed, never a result.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, broadcast_if_small, connected_components, materialize, mix, slices

#: Shingles that a step holds as separate strings.
STEP = 1 << 18


def token_hash(seed: int):
    """Hash of a shingle's bytes: fast for seed 0, keyed and cryptographic for the others."""
    if seed == 0:
        return xxhash.xxh3_64_intdigest
    key = seed.to_bytes(8, "little")
    return lambda s: int.from_bytes(hashlib.blake2b(s, digest_size=8, key=key).digest(), "little")


class Shingles:
    """The k-word shingles of a text by place, as slices of its normal form (A-Z lower-cased, one space
    between words); fewer words are one shingle, no words none."""

    def __init__(self, text: bytes | None, k: int):
        self.text = b" ".join((text or b"").lower().split())
        gaps = np.flatnonzero(np.frombuffer(self.text, np.uint8) == 32)
        start, end = np.append(0, gaps + 1), np.append(gaps, len(self.text))
        if not self.text:
            start, end = start[:0], end[:0]
        elif len(start) < k:
            start, end = start[:1], end[-1:]
        else:
            start, end = start[: len(start) - k + 1], end[k - 1 :]
        self.start, self.end = start, end

    def __len__(self) -> int:
        return len(self.start)

    def at(self, places: np.ndarray | slice) -> list[bytes]:
        t = self.text
        return [t[a:b] for a, b in zip(self.start[places].tolist(), self.end[places].tolist(), strict=True)]

    def steps(self, places: np.ndarray):
        for i in range(0, len(places), STEP):
            yield self.at(places[i : i + STEP])

    def tokens(self, seed: int = 0) -> np.ndarray:
        """Token of the shingle at each place."""
        h = token_hash(seed)
        out = np.empty(len(self), np.uint64)
        for i in range(0, len(self), STEP):
            part = self.at(slice(i, i + STEP))
            out[i : i + len(part)] = np.fromiter(map(h, part), np.uint64, len(part))
        return out

    def print(self) -> tuple[int, int]:
        """128 bits that identify the normal form."""
        return tuple(np.frombuffer(hashlib.blake2b(self.text, digest_size=16).digest(), np.int64).tolist())


def distinct_tokens(sh: Shingles, tokens: np.ndarray) -> tuple[np.ndarray, int]:
    """The distinct tokens, ascending, and the exact number of distinct shingles: places whose token comes
    once hold different shingles, the others are compared."""
    u, c = np.unique(tokens, return_counts=True)
    if len(u) == len(tokens):
        return u, len(u)
    again = np.flatnonzero((c > 1)[np.searchsorted(u, tokens)])
    kinds: set[bytes] = set()
    for part in sh.steps(again):
        kinds.update(part)
    return u, int((c == 1).sum()) + len(kinds)


def linked(a: Shingles, b: Shingles, tokens: tuple[np.ndarray, np.ndarray], t: int) -> bool:
    """Whether two texts link, by their shingles' bytes. Equal shingles have equal tokens, so a pass
    takes those of one residue and holds a bounded number of strings."""
    passes = 1 + max(len(a), len(b)) // (4 * STEP)
    both = whole = 0
    for p in range(passes):
        x, y = (set(s.at(slice(None) if passes == 1 else np.flatnonzero(k % np.uint64(passes) == p))) for s, k in zip((a, b), tokens, strict=True))
        inter = len(x & y)
        both, whole = both + inter, whole + len(x) + len(y) - inter
    return 100 * both >= t * whole


def prefix_overlap(n, low, high, t: int, shared: int):
    """Prefix tokens that a set of n tokens shares at least with a linked set of ``low`` to ``high`` tokens (columns).

    Of two sets that overlap in o tokens, take the one whose prefix ends first: the other's tokens up to there are
    prefix tokens too, so the prefixes share what its suffix can't hold of o. That falls to either side of n, so the ends of
    the range of sizes that may link decide; a token less makes up for sizes that aren't whole.
    """
    suffix = lambda x: F.lit((t * 1.0) / 100) * x + 1 - F.least(F.lit(shared), F.ceil(t * x / F.lit(100)))
    low, high = F.greatest(low, F.floor(t * n / F.lit(100))), F.least(high, F.ceil(100 * n / F.lit(t)))
    at = lambda m: F.lit(t / (100 + t)) * (n + m) - F.greatest(suffix(n), suffix(m))
    return F.greatest(F.lit(1), F.ceil(F.least(at(low), at(high)) - 1))


def most_overlap(n, t: int, shared: int):
    """No less than prefix_overlap of n with any sizes: sets as large as it ask for most."""
    return F.ceil(F.lit(2 * t / (100 + t)) * n) - F.ceil(t * n / F.lit(100)) + shared + 2


def least_shared(n, t: int):
    """Tokens that a set of n shares at least with any set at t percent or more."""
    return (t * n + 99) // 100


class GroupUnion:
    """Token union of a group, with the members that hold each token."""

    def __init__(self, sets: list[np.ndarray]):
        flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        self.size, self.owner = len(sets), owner[order]
        self.union, self.start = np.unique(flat[order], return_index=True)
        self.end = np.append(self.start[1:], len(flat))

    def hits(self, query: np.ndarray) -> np.ndarray:
        """Places in the union of the query's tokens: their number bounds every overlap."""
        at = np.searchsorted(self.union, query)
        inside = at < len(self.union)
        at, query = at[inside], query[inside]
        return at[self.union[at] == query]

    def overlaps(self, hits: np.ndarray) -> np.ndarray:
        """Tokens shared with each member."""
        lo = self.start[hits]
        width = self.end[hits] - lo
        places = np.repeat(lo - np.cumsum(width) + width, width) + np.arange(width.sum())
        return np.bincount(self.owner[places], minlength=self.size)


def link_group(label, sets, host, check, t: int) -> list[tuple[int, int]]:
    """Linked pairs of rows that connect what one task can connect. ``label`` is each row's component as
    known before; ``host`` marks the group's members. Without other rows members are the queries too.
    ``check`` decides on a pair of rows for which the tokens allow a link."""
    label = np.array(label, np.int64)
    sizes = np.array([len(s) for s in sets], np.int64)
    members = np.flatnonzero(host)
    queries = np.arange(len(label)) if len(members) == len(label) else np.flatnonzero(~np.asarray(host))
    group = GroupUnion([sets[i] for i in members])
    m, out = sizes[members], []
    for q in queries:
        may = (label[members] != label[q]) & (100 * np.minimum(m, sizes[q]) >= t * np.maximum(m, sizes[q]))
        if not may.any():
            continue
        hits = group.hits(sets[q])
        if 100 * len(hits) < t * sizes[q]:  # the group isn't opened
            continue
        inter = group.overlaps(hits)
        near = members[may & (100 * inter >= t * (m + sizes[q] - inter))]
        while len(near):
            x, near = near[0], near[1:]
            if check(q, x):
                out.append((int(q), int(x)))
                label[label == label[x]] = label[q]
                near = near[label[near] != label[q]]
    return out


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, block: int = 256, block_tokens: int = 500_000, shared: int = 8, hot_rows: int = 1_024, hot_limit: int = 500_000, kin: int = 64) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row.

    Two documents link when the Jaccard similarity of their sets of ``words``-word shingles (lower-cased
    A-Z, words between ASCII white space) is at least ``percent`` per cent, compared in integers. Null
    and empty texts have no shingles and link with nothing. Equal texts always link. Rows that repeat an
    id with another text are sets of their own and connected by the id. ``component_id`` is the smallest id
    reachable. A null id takes part as the smallest value internally and is returned as null.

    ``shared`` is the number of tokens that prefixes have beyond the first that must be shared, ``block`` and ``block_tokens`` bound a
    group's members, ``hot_limit`` the frequent tokens that the order knows, and unconnected documents are grouped
    by tokens of ``kin`` documents or more: all of them only affect speed. The tables in between are deleted when the result is written.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with Scratch(docs.sparkSession) as tables:
        for seed in itertools.count():
            out = join_under(rows, words, percent, block, block_tokens, shared, hot_rows, hot_limit, kin, seed)
            if out is not None:
                return tables.keep(out)


def join_under(docs: DataFrame, words: int, t: int, block: int, block_tokens: int, shared: int, hot_rows: int, hot_limit: int, kin: int, seed: int) -> DataFrame | None:
    """ngram_join under one hash; None if a document's own shingles share a token."""
    low = -(1 << 63)
    src = docs.select(F.coalesce("doc_id", F.lit(low)).alias("doc_id"), "text")

    def shingles_of(column):
        return [Shingles(x, words) for x in column.cast(pa.binary()).to_pylist()]

    def frequent(batches):
        """Tokens of two documents or more of a block, with their counts there."""

        def flush(held):
            v, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(v[c > 1].view(np.int64)), pa.array(c[c > 1].astype(np.int64))], ["tok", "c"])

        held, size = [], 0
        for b in slices(batches, 64):
            held += [np.unique(s.tokens(seed)) for s in shingles_of(b.column(0))]
            size += sum(map(len, held[-b.num_rows :]))
            if size > 2_000_000:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    # Only the order depends on this list, so its bound can't lose a link.
    top = src.select("text").mapInArrow(frequent, "tok bigint, c bigint").groupBy("tok").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "tok").limit(hot_limit).toArrow()
    hot, level = top["tok"].to_numpy().view(np.uint64), np.log2(np.maximum(top["c"].to_numpy(), 1)).astype(np.uint8)
    hot, level = hot[np.argsort(hot)], level[np.argsort(hot)]
    del top

    def sign(batches):
        schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n", "kinds", "f1", "f2", "g1", "g2", "cold", "kin")] + [("prefix", pa.list_(pa.int64()))])
        for b in slices(batches, 64):
            cols = {c: [] for c in schema.names[1:]}
            for sh in shingles_of(b.column(1)):
                u, n = distinct_tokens(sh, sh.tokens(seed))
                kinds = len(u)
                f1, f2 = sh.print()
                own = np.zeros(len(u), np.uint8)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, u), len(hot) - 1)
                    own = np.where(hot[at] == u, level[at], own)
                order = np.lexsort((u, own))
                least = least_shared(len(u), t)
                order = order[: len(u) - least + min(shared, least)]
                g = (int(u[0]), int(mix(mix(u ^ np.uint64(0xA5A5A5A5A5A5A5A5)).min(keepdims=True))[0])) if n else (0, 0)
                u, own = u[order].view(np.int64), own[order]
                near = int(u[np.searchsorted(own, own[-1])]) if len(u) and own[-1] >= np.log2(kin) else None  # the first of the commonest
                row = (n, kinds, f1, f2, *np.array(g, np.uint64).view(np.int64).tolist(), int((own < np.log2(hot_rows)).sum()), near, u)
                for c, v in zip(schema.names[1:], row, strict=True):
                    cols[c].append(v)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), **cols}, schema=schema)

    signed = materialize(src.mapInArrow(sign, "doc_id bigint, n bigint, kinds bigint, f1 bigint, f2 bigint, g1 bigint, g2 bigint, cold bigint, kin bigint, prefix array<bigint>"))
    if signed.where("n <> kinds").take(1):
        return None
    light = signed.select("doc_id", "n", "f1", "f2")
    reps = materialize(light.where("n > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.count("*").alias("c")))
    copies = broadcast_if_small(materialize(reps.where("c > 1").select("f1", "f2", "rep")))
    mine = signed.where("n > 0").join(copies, ["f1", "f2"], "left").where("rep IS NULL OR doc_id = rep")
    members = materialize(mine.select("doc_id", "f1", "n", "g1", "g2").distinct())

    def compare(key, table):
        ids, label, host = (table[c].to_numpy() for c in ("doc_id", "label", "host"))
        texts = shingles_of(table["text"].combine_chunks())
        same = [s.print()[0] == f for s, f in zip(texts, table["f1"].to_pylist(), strict=True)]  # else another text of the id
        rows = np.flatnonzero(same)
        texts, ids, label, host = [texts[i] for i in rows], ids[rows], label[rows], host[rows]
        tokens = [s.tokens(seed) for s in texts]
        found = link_group(label, [np.unique(x) for x in tokens], host, lambda q, x: linked(texts[q], texts[x], (tokens[q], tokens[x]), t), t)
        return pa.table({"src": pa.array([ids[q] for q, _ in found], pa.int64()), "dst": pa.array([ids[x] for _, x in found], pa.int64())})

    def links(tasks: DataFrame, *key: str) -> DataFrame:
        """Linked pairs found by tasks of (doc_id, f1, label, host), one for each value of ``key``."""
        tasks = broadcast_if_small(materialize(tasks))
        return materialize(src.join(tasks, "doc_id").groupBy(*key).applyInArrow(compare, "src bigint, dst bigint"))

    def blocks_of(rows, tokens):
        return F.greatest(F.ceil(rows / F.lit(block)), F.ceil(tokens / F.lit(block_tokens))).cast("int")

    dealt = lambda k: F.pmod(F.xxhash64("doc_id"), F.col(k)).cast("int")

    # Round 1. A group of k blocks has k tasks: the first block with each of the others.
    entries = members.select("doc_id", "f1", "n", F.explode(F.array_distinct(F.array("g1", "g2"))).alias("g"))
    sizes = entries.groupBy("g").agg(F.count("*").alias("c"), blocks_of(F.count("*"), F.sum("n")).alias("k")).where("c > 1").select("g", "k")
    entries = entries.join(broadcast_if_small(materialize(sizes)), "g").withColumn("b", dealt("k"))
    at = F.when(F.col("b") == 0, F.sequence(F.lit(0), F.col("k") - 1)).otherwise(F.array("b"))
    first = links(entries.select("doc_id", "f1", "g", F.explode(at).alias("q"), F.col("doc_id").alias("label"), F.lit(True).alias("host")), "g", "q")

    # Round 2. Documents outside any component are one of their own.
    found = connected_components(first).withColumnRenamed("node", "doc_id")
    found = materialize(found)
    parts = found.groupBy("component").agg(F.count("*").alias("members")).join(found, "component").join(members.select("doc_id", "n"), "doc_id")
    width = materialize(parts.groupBy("component").agg(F.first("members").alias("members"), blocks_of(F.count("*"), F.sum("n")).alias("k")))
    known = broadcast_if_small(materialize(found.join(width, "component").select("doc_id", "component", "members", dealt("k").alias("blk"))))

    def placed(df: DataFrame, known: DataFrame) -> DataFrame:
        """With the component and the group that a document is compared in; ``loose`` is one of documents in no component."""
        df = df.join(known, "doc_id", "left")
        alone = {"component": F.col("doc_id"), "home": F.coalesce("component", "doc_id"), "members": F.lit(1).cast("long"), "blk": F.lit(0), "loose": F.lit(False)}
        return df.withColumns({c: F.coalesce(c, v) for c, v in alone.items()})

    # Of what is in no component, those of like size with the same commonest token are compared in blocks.
    known = known.withColumns({"home": F.col("component"), "loose": F.lit(False)})
    single = placed(mine.where("kin IS NOT NULL").select("doc_id", "n", "kin"), known).where("members = 1")
    single = materialize(single.groupBy("doc_id").agg(F.min("kin").alias("kin"), F.max("n").alias("n")).withColumn("class", F.floor(F.log("n") / math.log(100 / t))))
    crowds = single.groupBy("kin", "class").agg(F.min("doc_id").alias("home"), F.count("*").alias("members"), blocks_of(F.count("*"), F.sum("n")).alias("k")).where("members > 1")
    alike = single.join(crowds, ["kin", "class"]).select("doc_id", F.col("doc_id").alias("component"), "members", dealt("k").alias("blk"), "home", F.lit(True).alias("loose"))
    known = broadcast_if_small(materialize(known.unionByName(alike)))

    posts = placed(mine.select("doc_id", "f1", "n", "cold", "prefix"), known)
    posts = posts.select("doc_id", "f1", "n", "cold", "component", "home", "loose", "members", "blk", F.posexplode("prefix").alias("pos", "tok"))
    by = Window.partitionBy("tok")
    rare = posts.where("pos < cold").withColumn("open", F.min("component").over(by) < F.max("component").over(by)).where("open").drop("open")
    often = posts.where("pos >= cold")  # of a bounded list; a token may have very many rows
    mixed = often.groupBy("tok").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("tok")
    often = often.join(broadcast_if_small(materialize(mixed)), "tok", "left_semi").select(rare.columns)
    met = materialize(rare.unionByName(often).withColumn("room", F.col("n") - F.col("pos") + most_overlap(F.col("n"), t, shared) - 1))
    groups = met.groupBy("tok", "home", "blk", "members").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("room").alias("wide"), F.count("*").alias("holders"))
    groups = groups.select("tok", F.col("home").alias("at"), F.col("blk").alias("at_blk"), F.col("members").alias("crowd"), "low", "high", "wide", "holders")
    # In its own block a document shares a token with another only if two hold it; else each would reach any sum by itself.
    own = F.col("loose") & (F.col("home") == F.col("at")) & ((F.col("blk") < F.col("at_blk")) | ((F.col("blk") == F.col("at_blk")) & (F.col("holders") > 1)))
    meets = (
        ((F.col("members") < F.col("crowd")) | ((F.col("members") == F.col("crowd")) & (F.col("home") < F.col("at"))) | own)
        & (100 * F.col("high") >= t * F.col("n"))
        & (100 * F.col("n") >= t * F.col("low"))
        & (F.least("room", "wide") * (100 + t) >= t * (F.col("n") + F.col("low")))
    )
    cells = met.join(groups, "tok").where(meets).groupBy("doc_id", "f1", "n", "component", "at", "at_blk").agg(F.count("*").alias("c"), F.min("low").alias("low"), F.max("high").alias("high"))
    visits = materialize(cells.where(F.col("c") >= prefix_overlap(F.col("n"), F.col("low"), F.col("high"), t, shared)).select("doc_id", "f1", "n", "component", "at", "at_blk"))
    open_ = visits.groupBy("at", "at_blk").agg(blocks_of(F.count("*"), F.sum("n")).alias("k"))
    open_ = broadcast_if_small(materialize(open_))
    guests = visits.join(open_, ["at", "at_blk"]).select("doc_id", "f1", "at", "at_blk", dealt("k").alias("q"), F.col("component").alias("label"), F.lit(False).alias("host"))
    hosts = placed(members.select("doc_id", "f1"), known).withColumnsRenamed({"home": "at", "blk": "at_blk"}).join(open_, ["at", "at_blk"])
    hosts = hosts.select("doc_id", "f1", "at", "at_blk", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("q"), F.col("component").alias("label"), F.lit(True).alias("host"))
    second = links(guests.unionByName(hosts), "at", "at_blk", "q")

    edges = found.select(F.col("doc_id").alias("src"), F.col("component").alias("dst")).unionByName(second)
    comp = connected_components(edges).withColumnRenamed("node", "rep")
    rep = reps.join(comp, "rep", "left").select("f1", "f2", F.coalesce("component", "rep").alias("component_id"))
    out = light.join(rep, ["f1", "f2"], "left")
    back = lambda c: F.when(c != low, c)
    return out.select(back(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), back(F.coalesce("component_id", "doc_id")).alias("component_id"))


def op7_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, percent=85)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
h AS (SELECT g, count(*) AS c FROM s GROUP BY g HAVING c > 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM h JOIN s a ON h.g = a.g JOIN s b ON h.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 85 * (a.n + b.n - i)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce((SELECT min(y) FROM r WHERE x = w.doc_id), w.doc_id)) AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id
"""
