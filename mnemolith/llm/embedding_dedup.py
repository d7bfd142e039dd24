"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Centroids are fitted on a bounded sample; every vector goes to its nearest cell and, as a guest, to
the cells within a margin of it, so that links across a border are met. Within (label, cell) the
vectors are compared in blocks of bounded size: a cell of any size is covered by pairs of blocks, and
no pair leaves a task. What leaves is a count of links and one edge for each linked vector.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, connected_components, materialize


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square overflows or vanishes."""
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matrix_of(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit vectors; an empty cell is restarted at the vector that fits worst."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        sim = x @ c.T
        own = sim.argmax(axis=1)
        new = np.zeros_like(c)
        np.add.at(new, own, x)
        size = np.bincount(own, minlength=len(c))
        worst = np.argsort(sim[np.arange(len(x)), own])
        for j, i in zip(np.flatnonzero(size == 0), worst, strict=False):
            new[j] = x[i]
        norm = np.linalg.norm(new, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, new / np.maximum(norm, 1e-12), c)
    return c


def link_blocks(ids, sizes, vectors, home, guest_of, probes, threshold: float):
    """Linked rows of one block: positions, sizes of what each links with, smallest id of its local
    component. ``home`` marks rows whose own cell this is; ``guest_of`` is each row's home cell and
    ``probes`` the cells it visits. A pair counts in the home cell of its smaller id if the larger
    visits it, else in that of the larger: exactly once."""
    u = unit_rows(vectors)
    adj = u @ u.T >= threshold
    np.fill_diagonal(adj, False)
    adj &= home[:, None] | home[None, :]
    cells, at = np.unique(guest_of, return_inverse=True)
    row, cell = np.repeat(np.arange(len(ids)), [len(p) for p in probes]), np.concatenate([np.asarray(p) for p in probes])
    place = np.minimum(np.searchsorted(cells, cell), len(cells) - 1)
    visits = np.zeros((len(ids), len(cells)), bool)
    visits[row[cells[place] == cell], place[cells[place] == cell]] = True
    # [x, y]: x is a guest, y is at home, and y, the larger id, visits the home cell of x
    elsewhere = visits[:, at].T & ~home[:, None] & home[None, :] & (ids[:, None] < ids[None, :])
    adj &= ~(elsewhere | elsewhere.T)
    return adj


def components_of(adj: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id reachable within the block, by spreading minima until nothing changes."""
    label = ids.copy()
    big = np.iinfo(np.int64).max
    while True:
        new = np.minimum(label, np.where(adj, label[None, :], big).min(axis=1))
        if (new == label).all():
            return label
        label = new


def near_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, cell_rows: int = 2_000, max_cells: int = 4_096, margin_deg: float | None = None, sample_bytes: int = 32 << 20, block: int = 2_048) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Rows link when labels are equal and not null and the cosine, in double precision, reaches
    ``threshold``. A vector that is null, zero, or holds null or non-finite components links with
    nothing, as does a row without id; vectors of different length don't link. Equal vectors of one
    label are one class while comparing and count as separate rows in ``n_links``. ``sample_bytes``
    bounds the sample that centroids are fitted on; all rows are indexed. A vector visits the cells within
    ``margin_deg`` of its nearest centroid, by default the angle of ``threshold``, which loses no link.
    """
    v = F.col("v")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    sane = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))) & F.exists(v, lambda e: e != 0)
    good = rows.where(F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sane, F.lit(False)))
    classes = materialize(good.groupBy("label", "v").agg(F.min("vec_id").alias("cid"), F.count("*").alias("size")))
    n = classes.count()
    first = classes.select(F.size("v").alias("d")).agg(F.max("d")).first()[0] or 1
    sample_rows = max(256, min(20_000, sample_bytes // (8 * first)))
    # The sample is bounded in rows and bytes; vectors of the most common length only.
    by = classes.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim = by[0]["d"] if by else 1
    sample = classes.where(F.size("v") == dim).orderBy(F.xxhash64("cid")).limit(sample_rows).select("v").collect()
    k = max(1, min(max_cells, -(-n // cell_rows)))
    cells = spherical_kmeans(unit_rows([r["v"] for r in sample]), k) if sample else np.ones((1, 1))
    # Of a linked pair, the end farther from its own centroid is within the pair's angle of the other's cell.
    margin = np.arccos(np.clip(threshold, -1, 1)) + 1e-6 if margin_deg is None else np.deg2rad(margin_deg)

    def assign(batches):
        """Each row once for every cell that it visits."""
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                lens = part.column(3).value_lengths().to_numpy(zero_copy_only=False)
                same = np.flatnonzero(lens == dim)
                home = np.zeros(part.num_rows, np.int32)
                row, cell = np.flatnonzero(lens != dim), np.zeros((lens != dim).sum(), np.int32)
                if len(same):
                    angle = np.arccos(np.clip(unit_rows(matrix_of(part.column(3).take(pa.array(same)), dim)) @ cells.T, -1, 1))
                    home[same] = angle.argmin(axis=1)
                    r, c = np.nonzero(angle <= angle.min(axis=1, keepdims=True) + margin)
                    row, cell = np.concatenate((row, same[r])), np.concatenate((cell, c.astype(np.int32)))
                by = np.argsort(row, kind="stable")
                row, cell = row[by], cell[by]
                times = np.bincount(row, minlength=part.num_rows)
                probes = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(times)).astype(np.int32)), pa.array(cell)).take(pa.array(row))
                label, cid, size, v = (part.column(i).take(pa.array(row)) for i in range(4))
                yield pa.RecordBatch.from_arrays([label, pa.array(lens[row].astype(np.int32)), pa.array(cell), cid, size, v, pa.array(home[row]), probes], ["label", "dim", "cell", "cid", "size", "v", "home", "probes"])

    placed = materialize(classes.select("label", "cid", "size", "v").mapInArrow(assign, "label string, dim int, cell int, cid bigint, size bigint, v array<double>, home int, probes array<int>"))
    # A cell of m blocks is covered by the pairs of its blocks; each row goes to m of them.
    counts = materialize(placed.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("m")))
    dealt = placed.join(broadcast_if_small(counts), ["label", "dim", "cell"]).withColumn("b", F.pmod(F.xxhash64("cid"), F.col("m")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    dealt = dealt.withColumn("p", F.least("b", "o")).withColumn("q", F.greatest("b", "o"))

    def compare(key, table):
        p, q = key[3].as_py(), key[4].as_py()
        ids = table["cid"].to_numpy()
        order = np.argsort(ids)
        ids, sizes, b = ids[order], table["size"].to_numpy()[order], table["b"].to_numpy()[order]
        vectors = matrix_of(table["v"].combine_chunks(), key[1].as_py())[order]
        homes, cell = table["home"].to_numpy()[order], key[2].as_py()
        lists = table["probes"].combine_chunks()
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        probes = np.split(lists.flatten().to_numpy(zero_copy_only=False), ends[:-1])
        probes = [probes[i] for i in order]
        adj = link_blocks(ids, sizes, vectors, homes == cell, homes, probes, threshold)
        if p != q:  # rows of one block with each other are the task of (p, p)
            adj &= b[:, None] != b[None, :]
        some = np.flatnonzero(adj.any(axis=1))
        adj, ids, sizes = adj[np.ix_(some, some)], ids[some], sizes[some]
        root = components_of(adj, ids) if len(ids) else ids
        return pa.table({"cid": ids, "root": root, "n": adj @ sizes if len(ids) else sizes})

    found = dealt.groupBy("label", "dim", "cell", "p", "q").applyInArrow(compare, "cid bigint, root bigint, n bigint")
    found = materialize(found)
    links = found.groupBy("cid").agg(F.sum("n").alias("n"))
    comp = connected_components(found, "cid", "root").withColumnRenamed("node", "cid")
    info = classes.select("cid", "size").join(links, "cid", "left").join(comp, "cid", "left")
    info = info.select("cid", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("component_id"))
    again = materialize(classes.where("size > 1").select("label", "v", F.col("cid").alias("_c")))
    mine = rows.join(broadcast_if_small(again), ["label", "v"], "left").select("vec_id", F.coalesce("_c", "vec_id").alias("cid"))
    out = mine.join(info, "cid", "left")
    comp_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), comp_id.eqNullSafe(F.col("vec_id")).alias("kept"))


def op1_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.x = e.vec_id)::BIGINT AS n_links,
  least(e.vec_id, coalesce((SELECT min(y) FROM r WHERE r.x = e.vec_id), e.vec_id)) AS component_id,
  least(e.vec_id, coalesce((SELECT min(y) FROM r WHERE r.x = e.vec_id), e.vec_id)) = e.vec_id AS kept
FROM embeddings e
"""
