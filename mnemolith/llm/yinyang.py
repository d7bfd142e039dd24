"""Centroid clustering by Yinyang grouping, in exact integers.

Centroids are clustered into groups once. Every vector carries its cluster, an upper bound of the distance to
it and one lower bound a group, of the distance to all other centroids of that group. When centroids move, the
bounds move by as much. A vector whose upper bound is below all its lower bounds stays where it is (global
filter); else its own distance is computed, and only groups whose lower bound doesn't exceed it are scanned
(group filter), all their centroids exactly.

A round is one pass over the vectors without a shuffle, from one table in the shared folder to the next. New
centroids come from the old sums and the vectors that changed cluster. Distances are whole numbers; bounds are
doubles, widened by more than their rounding, so no nearer or tied centroid is ever filtered out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, discard, materialize

#: Components beyond this, as integers, could give distances that no long holds.
LIMIT = 1 << 27
#: Sums of products of smaller values are exact in doubles for up to 128 dimensions.
EXACT = 1 << 22
#: More than the relative rounding of a bound's operations.
SLACK = 1e-12
#: Bound of a group without other centroids; finite, so that it can be moved.
FAR = 1e300


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows: one row of ``x`` to all of ``c``."""
    if x.shape[1] <= 128 and max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for j, row in enumerate(c):
        out[:, j] = ((x - row) ** 2).sum(axis=1)
    return out


def own_squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((x - c) ** 2).sum(axis=1)


def group_centroids(c: np.ndarray, n: int, rounds: int = 5) -> list[np.ndarray]:
    """The centroids' numbers in ``n`` groups, each ascending; groups only affect speed."""
    seeds = c[np.linspace(0, len(c) - 1, n).astype(int)].astype(np.float64)
    for _ in range(rounds):
        own = ((c[:, None, :] - seeds[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in range(n):
            if (own == g).any():
                seeds[g] = c[own == g].mean(axis=0)
    return [m for g in range(n) if len(m := np.flatnonzero(own == g))]


class Yinyang:
    """Centroids in their groups, and the step from one set of centroids to the next."""

    def __init__(self, centroids: np.ndarray, groups: list[np.ndarray], before: np.ndarray | None = None):
        self.c, self.groups = centroids, groups
        self.group_of = np.empty(len(centroids), np.int64)
        for g, members in enumerate(groups):
            self.group_of[members] = g
        moved = np.zeros(len(centroids)) if before is None else np.sqrt(own_squared(centroids, before).astype(np.float64))
        self.moved = moved * (1 + SLACK)
        self.group_moved = np.array([self.moved[m].max() for m in groups])
        self.scanned = 0  #: distances computed

    def _scan(self, x, rows, g, best, who, lower):
        """Scan a group for some rows; its lower bounds leave out the cluster that wins, which ``settle`` sees to."""
        members = self.groups[g]
        d = squared(x[rows], self.c[members])
        self.scanned += d.size
        at = d.argmin(axis=1)  # of equal ones the smaller number
        one = d[np.arange(len(rows)), at]
        if len(members) > 1:
            d[np.arange(len(rows)), at] = np.iinfo(np.int64).max
            two = d.min(axis=1).astype(np.float64)
        else:
            two = np.full(len(rows), FAR)
        num = members[at]
        better = (one < best[rows]) | ((one == best[rows]) & (num < who[rows]))
        best[rows] = np.where(better, one, best[rows])
        who[rows] = np.where(better, num, who[rows])
        lower[rows, g] = np.sqrt(one) * (1 - SLACK)
        return num, np.sqrt(two) * (1 - SLACK)

    def _settle(self, scans, who, lower):
        for rows, g, (num, two) in scans:
            won = num == who[rows]
            lower[rows[won], g] = two[won]

    def first(self, x: np.ndarray):
        """Cluster, squared distance and bounds of vectors without any."""
        n, t = len(x), len(self.groups)
        best, who = np.full(n, np.iinfo(np.int64).max), np.full(n, len(self.c), np.int64)
        lower, rows = np.empty((n, t)), np.arange(n)
        scans = [(rows, g, self._scan(x, rows, g, best, who, lower)) for g in range(t)]
        self._settle(scans, who, lower)
        return who, best, np.sqrt(best) * (1 + SLACK), lower

    def step(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        """Cluster and bounds after the centroids moved."""
        cluster, upper = cluster.copy(), (upper + self.moved[cluster]) * (1 + SLACK)
        lower = lower - self.group_moved - SLACK * (lower + self.group_moved)
        rows = np.flatnonzero(lower.min(axis=1) <= upper)  # the others pass the global filter
        if not len(rows):
            return cluster, upper, lower
        sub, old, low = x[rows], cluster[rows], lower[rows]
        own = own_squared(sub, self.c[old])
        self.scanned += len(rows)
        best, who, up = own.copy(), old.copy(), np.sqrt(own) * (1 + SLACK)
        near = low <= up[:, None]
        scans = []
        for g in range(len(self.groups)):
            some = np.flatnonzero(near[:, g] & (low[:, g] <= np.sqrt(best) * (1 + SLACK)))
            if len(some):
                scans.append((some, g, self._scan(sub, some, g, best, who, low)))
        self._settle(scans, who, low)
        # Where the old cluster's group was not scanned, its bound has left that cluster out so far.
        left = np.flatnonzero(who != old)
        g = self.group_of[old[left]]
        low[left, g] = np.minimum(low[left, g], np.sqrt(own[left]) * (1 - SLACK))
        cluster[rows], upper[rows], lower[rows] = who, np.sqrt(best) * (1 + SLACK), low
        return cluster, upper, lower


def integer_vectors(table: DataFrame, id_col: str, vec_col: str, dim: int, scale: int) -> DataFrame:
    """``vec_id, x`` (array of int, floor of scale times each component) of the rows whose vector has ``dim``
    components, none null, non-finite or beyond ``LIMIT``."""
    v = F.col(vec_col).cast("array<double>")
    sane = (F.size(v) == dim) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(LIMIT / scale)))
    return table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.coalesce(sane, F.lit(False))).select("vec_id", F.transform("v", lambda e: F.floor(e * scale).cast("int")).alias("x"))


def rows_of(lists: pa.Array, dim: int, kind=np.int64) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)


def yinyang_clusters(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = 64, k: int = 40, rounds: int = 5, scale: int = 256, group_size: int = 10, salt: str = "2") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector kept.

    Kept are the vectors of ``dim`` components of which none is null or non-finite (nor beyond 2**27 times
    1 / ``scale``, where distances leave the range of a long), as floor(``scale`` * component). The ``k`` with the
    smallest SHA-256 of ``salt:vec_id`` are the first centroids, in that order; of equal ids the smaller vector
    comes first, null ids last; fewer vectors make fewer centroids. A vector belongs to the nearest centroid, of equal ones
    to the smaller number. ``rounds`` times, centroids become the floored means of their vectors, empty ones
    stay; then vectors are assigned once more. Repeated rows count each. ``k`` * ``dim`` numbers are sent to
    every task, and as many come back to the driver in a round.
    """
    spark = table.sparkSession
    empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    vectors = integer_vectors(table, id_col, vec_col, dim, scale)
    name = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    start = vectors.orderBy(name.asc_nulls_last(), "x").limit(k).select("x").collect()
    if not start:
        return spark.createDataFrame([], empty)
    c = np.array([r["x"] for r in start], np.int64)
    groups = group_centroids(c, -(-len(c) // group_size))
    state_ddl = "vec_id long, x array<int>, cluster int, was int, upper double, lower array<double>"

    def state_batch(ids, x, cluster, was, upper, lower):
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, lower.size + 1, lower.shape[1], dtype=np.int32)), pa.array(lower.reshape(-1)))
        return pa.RecordBatch.from_arrays([ids, x, pa.array(cluster.astype(np.int32)), pa.array(was, pa.int32()), pa.array(upper), flat], ["vec_id", "x", "cluster", "was", "upper", "lower"])

    def begin(batches, yy=Yinyang(c, groups)):
        for b in batches:
            if b.num_rows:
                cluster, _, upper, lower = yy.first(rows_of(b.column(1), dim))
                yield state_batch(b.column(0), b.column(1), cluster, np.full(b.num_rows, -1, np.int32), upper, lower)

    def moved(batches, yy):
        for b in batches:
            if b.num_rows:
                was = b.column(2).to_numpy()
                cluster, upper, lower = yy.step(rows_of(b.column(1), dim), was.astype(np.int64), b.column(4).to_numpy(), rows_of(b.column(5), len(groups), np.float64))
                yield state_batch(b.column(0), b.column(1), cluster, was, upper, lower)

    def last(batches, yy):
        for b in batches:
            if b.num_rows:
                x = rows_of(b.column(1), dim)
                cluster, _, _ = yy.step(x, b.column(2).to_numpy().astype(np.int64), b.column(4).to_numpy(), rows_of(b.column(5), len(groups), np.float64))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cluster.astype(np.int32)), pa.array(own_squared(x, yy.c[cluster]))], ["vec_id", "cluster", "distance"])

    signed = F.explode(F.array(F.struct(F.col("cluster").alias("c"), F.lit(1).alias("s")), F.struct(F.col("was").alias("c"), F.lit(-1).alias("s")))).alias("m")
    total = [F.sum(F.col("x")[i].cast("long") * F.col("m.s")).alias(f"s{i}") for i in range(dim)]
    sums, counts = np.zeros((len(c), dim), object), np.zeros(len(c), object)
    with Scratch(spark) as tables:
        state = materialize(vectors.mapInArrow(begin, state_ddl))
        for number in range(rounds):
            # One row a centroid at most: what came and what went.
            changed = state.where("cluster <> was").select("x", signed).where("m.c >= 0")
            for r in changed.groupBy("m.c").agg(F.sum("m.s").alias("n"), *total).collect():
                counts[r["c"]] += r["n"]
                sums[r["c"]] += np.array([r[f"s{i}"] for i in range(dim)], object)
            new = np.array([[int(s) // int(n) for s in row] if n else old for row, n, old in zip(sums, counts, c.tolist(), strict=True)], np.int64)
            yy, c = Yinyang(new, groups, c), new
            if number + 1 < rounds:
                before, state = state, materialize(state.mapInArrow(lambda batches, yy=yy: moved(batches, yy), state_ddl))
                discard(before)
        if not rounds:
            yy = Yinyang(c, groups, c)
        done = tables.keep(state.mapInArrow(lambda batches, yy=yy: last(batches, yy), "vec_id long, cluster int, distance long"))
    # A row a centroid, k at most, here and in the broadcast.
    inertia = dict(done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("string")).collect())
    inertia = {i: int(x) for i, x in inertia.items()}
    whole = sum(inertia.values())
    facts = [(i, inertia[i], whole, hashlib.sha256(",".join(map(str, c[i].tolist())).encode()).hexdigest()) for i in sorted(inertia)]
    facts = F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return done.join(facts, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_yinyang(spark, sf_dir: str) -> DataFrame:
    return yinyang_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    head = r"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (SELECT c, x FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS c, x FROM v) WHERE c < 40)"""
    near = """,
a{r} AS MATERIALIZED (SELECT rid, min(d * 40 + c) AS m FROM (SELECT rid, c, list_sum(list_transform(list_zip(v.x, c{r}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{r}) GROUP BY rid)"""
    mean = """,
m{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS x FROM (SELECT c, i, sum(e) AS s, count(*) AS n FROM
  (SELECT m % 40 AS c, unnest(x) AS e, unnest(range(64)) AS i FROM a{p} JOIN v USING (rid)) GROUP BY c, i) GROUP BY c),
c{r} AS MATERIALIZED (SELECT c, coalesce(m{r}.x, c{p}.x) AS x FROM c{p} LEFT JOIN m{r} USING (c))"""
    rounds = near.format(r=0) + "".join(mean.format(r=r, p=r - 1) + near.format(r=r) for r in range(1, 6))
    return head + rounds + """
SELECT vec_id, (m % 40)::INT AS cluster, m // 40 AS distance, (sum(m // 40) OVER (PARTITION BY m % 40))::BIGINT AS cluster_inertia, (sum(m // 40) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c5.x, ',')) AS centroid_sha256 FROM a5 JOIN v USING (rid) JOIN c5 ON c5.c = m % 40
"""


SQL = _sql()
