"""Embedding whitening by column aggregates of the upper triangle.

A vector is an array of integers. One aggregation takes the sums of its dimensions; a second takes, by generated
SQL expressions, the sum of the centred products of every pair of dimensions on and above the diagonal. For
that, the triangle is folded: its row i and its row d - 1 - i together have d + 1 products, whatever i is. So each
vector becomes d / 2 rows of the same d + 1 expressions, which whole-stage code sums by i before anything is
shuffled. The covariance goes to LAPACK, whose eigenvectors become the expressions of the projection. What
reaches the driver is the triangle itself.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Sums side by side in one aggregation; longer folded rows are taken in blocks.
SUMS = 80
#: Entries beyond this, as integers, aren't exact in a double.
LIMIT = 1 << 52
#: A component whose eigenvalue is a smaller share of the largest has no variance but rounding.
LEAST = 1e-12


def integer_vectors(table: DataFrame, id_col: str, vec_col: str, scale: int, shift: int) -> tuple[DataFrame, int]:
    """``vec_id, x`` (array of long: floor(scale * entry) + shift) of the vectors that count, and their length."""
    v = F.col(vec_col).cast("array<double>")
    sane = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(LIMIT / scale))) & (F.size(v) > 0)
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.coalesce(sane, F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim = sizes[0]["d"] if sizes else 0
    return rows.where(F.size("v") == dim).select("vec_id", F.transform("v", lambda e: F.floor(e * scale) + shift).alias("x")), dim


def weighted(column: str, weights: np.ndarray) -> str:
    """SQL of a weighted sum of an array's entries."""
    return " + ".join(f"{column}[{i}] * {float(w)!r}D" for i, w in enumerate(weights))


def triangle_sums(rows: DataFrame, d: str, dim: int) -> np.ndarray:
    """Sums of the products of all pairs of entries of the array column ``d``, in one aggregation.

    Place s of folded row i is the pair (i, i + s) while that is a pair, then (dim - 1 - i, s - 1).
    """
    width = min(dim + 1, SUMS)
    blocks = -(-(dim + 1) // width)
    halves = (dim + 1) // 2
    each = rows.select(d, F.explode(F.sequence(F.lit(0), F.lit(halves * blocks - 1))).alias("r"))
    each = each.selectExpr(d, "r", f"CAST(r DIV {blocks} AS INT) AS i", f"CAST(r % {blocks} * {width} AS INT) AS s0")
    each = each.selectExpr(d, "r", "i", "s0", f"{d}[i] AS a", f"{d}[{dim - 1} - i] AS b")
    first = lambda t: f"s0 + {t} < {dim} - i"
    product = lambda t: f"if({first(t)}, a, b) * {d}[if({first(t)}, i + s0 + {t}, least(s0 + {t}, {dim}) - 1)]"
    sums = each.groupBy("r").agg(*(F.expr(f"sum({product(t)})").alias(f"p{t}") for t in range(width)))
    out = np.zeros((dim, dim))
    for row in sums.collect():  # the triangle, dim * (dim + 1) / 2 numbers
        i = row["r"] // blocks
        for t in range(width):
            s = row["r"] % blocks * width + t
            if s <= dim:
                j, k = (i, i + s) if s < dim - i else (dim - 1 - i, s - 1)
                out[j, k] = out[k, j] = row[f"p{t}"]
    return out


def whiten(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every vector and component.

    Vectors that are null, empty or hold null or non-finite entries are dropped, as are those with an entry beyond
    2**52 / ``scale``; of different lengths the commonest counts, of equally common ones the smaller. An entry
    becomes x = floor(``scale`` * entry) + ``shift``. All vectors left are fitted on, repeated ones each; n is their
    number and S their sums. Components are the unit eigenvectors of x's covariance (divisor n), by falling
    eigenvalue e from 1, with the entry of largest size positive. ``deviation`` is the sum over dimensions of
    (n*x - S)**2, exact (null beyond a long); ``whitened`` is x - S/n projected and divided by sqrt(e);
    ``explained`` is e's share of the trace; ``identity_error`` the largest absolute entry of whitened's
    covariance minus the identity. Components without variance are left out, so vectors that are all equal give no
    rows. The driver holds d * d numbers for d dimensions.
    """
    spark = table.sparkSession
    rows, dim = integer_vectors(table, id_col, vec_col, scale, shift)
    none = spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    if not dim:
        return none
    rows = materialize(rows)
    entry = F.col("e").cast("decimal(38,0)")
    facts = rows.select(F.posexplode("x").alias("i", "e")).groupBy("i").agg(F.count("*").alias("n"), F.sum(entry).alias("sum"), F.min("e").alias("min"), F.max("e").alias("max")).orderBy("i").collect()
    n, total = facts[0]["n"], [int(f["sum"]) for f in facts]
    mean = [s / n for s in total]  # rounded once
    centred = rows.select("vec_id", "x", F.expr("array(" + ", ".join(f"x[{i}] - {m!r}D" for i, m in enumerate(mean)) + ")").alias("d"))
    cov = triangle_sums(centred, "d", dim) / n
    values, vectors = np.linalg.eigh(cov)
    order = [i for i in np.argsort(-values, kind="stable") if values[i] > LEAST * values.max()][:components]
    if not order:
        return none
    values, vectors = values[order], vectors[:, order]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    # The largest deviation that can occur decides whether longs hold every step.
    most = sum(max(abs(n * f["min"] - s), abs(n * f["max"] - s)) ** 2 for f, s in zip(facts, total, strict=True))
    if most < 1 << 63:
        exact = F.expr(" + ".join(f"({n}L * x[{i}] - {s}L) * ({n}L * x[{i}] - {s}L)" for i, s in enumerate(total)))
    else:
        parts = [f"CAST({n}BD * x[{i}] - {s}BD AS DECIMAL(38, 0))" for i, s in enumerate(total)]
        parts = [f"try_multiply({p}, {p})" for p in parts]
        exact = F.expr("try_cast(" + "try_add(" * (dim - 1) + parts[0] + "".join(f", {p})" for p in parts[1:]) + " AS BIGINT)")
    w = [F.expr(weighted("d", vectors[:, k] / np.sqrt(values[k]))) for k in range(len(order))]
    projected = centred.select("vec_id", "x", F.array(*w).alias("w"))
    means = [r["m"] for r in projected.select(F.posexplode("w").alias("i", "e")).groupBy("i").agg(F.avg("e").alias("m")).orderBy("i").collect()]
    error = np.abs(triangle_sums(projected, "w", len(w)) / n - np.outer(means, means) - np.eye(len(w))).max()
    share = F.array(*(F.lit(float(v)) for v in values / np.trace(cov)))
    out = projected.select("vec_id", exact.alias("deviation"), F.posexplode("w").alias("k", "whitened"))
    return out.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share[F.col("k")].alias("explained"), F.lit(float(error)).alias("identity_error"))


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
