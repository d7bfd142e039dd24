"""Packing by optimal length buckets.

The global histogram of chunk lengths (at most ``max_len`` + 1 rows) goes to the driver, where dynamic
programming finds the ``n_buckets`` boundaries with the least padding. Batches of a token budget are
then formed inside each bucket, with ranks that need no task to hold a whole bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize


def optimal_buckets(lengths: np.ndarray, counts: np.ndarray, k: int) -> list[int]:
    """Boundaries (each an occurring length, the last the longest) minimising the sum over rows of
    boundary - length; of equal plans the one with earlier cuts. ``lengths`` ascend."""
    n = len(lengths)
    if n == 0:
        return []
    k = min(k, n)
    rows = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    best = lengths.astype(np.int64) * rows[1:]  # one bucket: everything padded to lengths[j]
    back = []
    for _ in range(1, k):
        new, cut = best.copy(), np.full(n, -1, np.int64)
        for j in range(1, n):
            cost = best[:j] + lengths[j] * (rows[j + 1] - rows[1 : j + 1])
            i = int(np.argmin(cost))
            if cost[i] < new[j]:
                new[j], cut[j] = cost[i], i
        best = new
        back.append(cut)
    out, j = [int(lengths[-1])], n - 1
    for cut in reversed(back):
        if cut[j] >= 0:
            j = int(cut[j])
            out.append(int(lengths[j]))
    return out[::-1]


def pack_buckets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_len: int = 2048, n_buckets: int = 16, token_budget: int = 65_536, shard_rows: int = 200_000) -> DataFrame:
    """``doc_id, chunk_no, n_tokens, bucket_len, padding, batch_id, slot`` for every chunk.

    Tokens are maximal runs of characters other than ASCII white space. A document is cut into chunks
    of ``max_len`` tokens, the last one shorter; null or empty text is one chunk of no tokens, so that
    no row is lost. A batch holds ``token_budget // bucket_len`` chunks (one at least) of one bucket.
    Within a bucket, chunks are ranked by (shard, doc_id, chunk_no), nulls first, the shard being a hash
    of the chunk, so that no id fills one; repeated rows get
    slots of their own.
    """
    n = F.coalesce(F.regexp_count(F.col(text_col), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
    sizes = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), n.alias("n")))
    last = F.greatest(F.lit(0), F.floor((F.col("n") - 1) / max_len)).cast("int")
    chunks = sizes.select("doc_id", "n", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    chunks = chunks.select("doc_id", "chunk_no", F.least(F.lit(max_len).cast("long"), F.col("n") - F.col("chunk_no") * max_len).alias("n_tokens"))
    # At most max_len + 1 rows, whatever the input.
    hist = sorted((r["n_tokens"], r["count"]) for r in chunks.groupBy("n_tokens").count().collect())
    bounds = optimal_buckets(np.array([x for x, _ in hist], np.int64), np.array([c for _, c in hist], np.int64), n_buckets)
    total = sum(c for _, c in hist)
    bucket = F.lit(bounds[-1] if bounds else 0).cast("long")
    for b in reversed(bounds[:-1]):
        bucket = F.when(F.col("n_tokens") <= b, F.lit(b).cast("long")).otherwise(bucket)
    shards = max(1, -(-total // shard_rows))
    rows = chunks.withColumn("bucket_len", bucket).withColumn("shard", F.pmod(F.xxhash64("doc_id", "chunk_no", "n_tokens"), F.lit(shards)))
    # Rows of the shards before, in a table of n_buckets * shards counts; then ranks within a shard.
    counts = rows.groupBy("bucket_len", "shard").agg(F.count("*").alias("c"))
    before = counts.withColumn("before", F.sum("c").over(Window.partitionBy("bucket_len").orderBy("shard")) - F.col("c")).drop("c")
    rank = F.row_number().over(Window.partitionBy("bucket_len", "shard").orderBy("doc_id", "chunk_no"))
    rows = rows.withColumn("rank", rank).join(before, ["bucket_len", "shard"])
    fits = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(token_budget) / F.greatest(F.col("bucket_len"), F.lit(1))))
    place = F.col("before") + F.col("rank") - 1
    return rows.select(
        "doc_id",
        "chunk_no",
        "n_tokens",
        "bucket_len",
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
        F.concat_ws("-", F.col("bucket_len"), F.floor(place / fits)).alias("batch_id"),
        F.pmod(place, fits).cast("long").alias("slot"),
    )


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack_buckets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
