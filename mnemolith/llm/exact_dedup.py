"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. Every input partition sorts the 64-bit fingerprints of its rows, keeps each value once with its
   count, splits them by owner (the top bits of the fingerprint) and sends each owner one Golomb-Rice
   coded list of gaps. A hot group of copies is one value a block.
2. An owner decodes the lists it got, merges them, and returns to each sender a bitmap with one bit a
   fingerprint: set if the value came more than once anywhere.
3. Rows whose bit is set are suspects. Only their texts are shuffled, pre-aggregated by the whole
   normalised text, which is the byte verification: a fingerprint collision ends in two groups.

Nothing is collected; a hot group of copies is one row a task after the pre-aggregation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize

#: Values of a block for each owner, and rows that a block holds at most (24 bytes a row).
LIST_ROWS, BLOCK_ROWS = 1_000, 1 << 23
#: ASCII white space that counts as one space.
SPACE = "[\\x20\\x09-\\x0D]+"


def normalised(text: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ")


def golomb_encode(values: np.ndarray, bits: int) -> bytes:
    """Sorted uint64 values as Golomb-Rice coded gaps: all quotients in unary first, padded to a byte,
    then all rests of ``bits`` bits. Two streams are decoded without following codes one by one."""
    if not len(values):
        return b""
    gaps = np.diff(values, prepend=np.uint64(0))
    q = (gaps >> np.uint64(bits)).astype(np.int64)
    unary = np.ones(int(q.sum()) + len(q), np.uint8)
    unary[np.cumsum(q + 1) - 1] = 0
    shifts = np.arange(bits - 1, -1, -1, dtype=np.uint64)
    rest = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return np.packbits(unary).tobytes() + np.packbits(rest.reshape(-1)).tobytes()


def golomb_decode(blob: bytes, n: int, bits: int) -> np.ndarray:
    """Inverse of golomb_encode."""
    if not n:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(blob, np.uint8)
    size = -(-n * bits // 8)
    unary, rest = np.unpackbits(raw[: len(raw) - size]), np.unpackbits(raw[len(raw) - size :])[: n * bits]
    ends = np.flatnonzero(unary == 0)[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(bits)
    for j, column in enumerate(rest.reshape(n, bits).T):
        gaps |= column.astype(np.uint64) << np.uint64(bits - 1 - j)
    return np.cumsum(gaps, dtype=np.uint64)


def rice_bits(n: int, span_bits: int) -> int:
    """Rest bits for n values over a span of 2**span_bits: log2 of the mean gap."""
    return max(0, min(62, span_bits - max(n, 1).bit_length()))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_rows: int = 1_000_000, block_rows: int = 200_000) -> DataFrame:
    """Decision per row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after each run of ASCII white space became one space; null counts
    as empty. The smallest id of equal texts stays. Rows with one id are copies of one document and
    get one decision each (``kept`` alike); a null id never wins over another id and is kept only
    where its group has none. Ties, empty tables and other columns don't matter.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(normalised(text_col), 256).alias("text_sha256"))
    base = materialize(base)
    # As many owners (a power of two) as keep what one of them decodes near owner_rows values.
    top = max(4, (base.count() // owner_rows).bit_length())
    owners, span = 1 << top, 64 - top
    # A block has LIST_ROWS rows an owner at least, so that messages grow with the rows and not with blocks times owners.
    block_rows = max(block_rows, min(LIST_ROWS * owners, BLOCK_ROWS))

    def send(batches):
        """Blocks of a bounded number of rows: one row an owner, with the ids in coded order."""
        ids, prints, n = [], [], 0

        def block():
            i, p = np.concatenate(ids), np.concatenate(prints)
            order = np.argsort(p, kind="stable")
            i, p = i[order], p[order]
            own, times = np.unique(p, return_counts=True)  # a block sends each value once
            cut = np.searchsorted(own >> np.uint64(span), np.arange(owners + 1, dtype=np.uint64))
            upto = np.concatenate(([0], np.cumsum(times)))
            out = []
            for o in range(owners):
                part = own[cut[o] : cut[o + 1]]
                if len(part):
                    bits = rice_bits(len(part), span)
                    low = part - (np.uint64(o) << np.uint64(span))
                    row = {"block": f"{i[0]}:{p[0]:x}:{len(p)}:{int(i.sum())}", "owner": o, "n": len(part), "bits": bits, "blob": golomb_encode(low, bits)}
                    out.append(row | {"times": times[cut[o] : cut[o + 1]].tolist(), "ids": i[upto[cut[o]] : upto[cut[o + 1]]].tolist()})
            return pa.RecordBatch.from_pylist(out, schema=sent)

        sent = pa.schema([("block", pa.string()), ("owner", pa.int32()), ("n", pa.int32()), ("bits", pa.int32()), ("blob", pa.binary()), ("times", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64()))])
        for b in batches:
            sha = b.column(1).to_pylist()
            prints.append(np.array([int(x[:16], 16) for x in sha], np.uint64))
            ids.append(b.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False))
            n += b.num_rows
            if n >= block_rows:
                yield block()
                ids, prints, n = [], [], 0
        if n:
            yield block()

    sent = materialize(base.mapInArrow(send, "block string, owner int, n int, bits int, blob binary, times array<int>, ids array<bigint>"))

    def own(key, table):
        """All lists of one owner: a bitmap back for each."""
        rows = table.to_pylist()
        lists = [golomb_decode(r["blob"], r["n"], r["bits"]) for r in rows]
        values, inverse, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        more = counts[inverse] > 1
        out, at = [], 0
        for r in rows:
            out.append({"block": r["block"], "owner": r["owner"], "bitmap": np.packbits(more[at : at + r["n"]]).tobytes()})
            at += r["n"]
        return pa.Table.from_pylist(out, schema=pa.schema([("block", pa.string()), ("owner", pa.int32()), ("bitmap", pa.binary())]))

    bitmaps = sent.select("block", "owner", "n", "bits", "blob").groupBy("owner").applyInArrow(own, "block string, owner int, bitmap binary")
    bitmaps = materialize(bitmaps)

    def suspects(batches):
        for b in batches:
            out = []
            for times, ids, bitmap in zip(*(b.column(i) for i in range(3)), strict=True):
                times = times.values.to_numpy()
                more = np.unpackbits(np.frombuffer(bitmap.as_py(), np.uint8))[: len(times)].astype(bool) | (times > 1)
                out.append(ids.values.to_numpy()[np.repeat(more, times)])
            ids = np.concatenate(out) if out else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(ids))], ["doc_id"])

    found = materialize(sent.select("block", "owner", "times", "ids").join(bitmaps, ["block", "owner"]).select("times", "ids", "bitmap").mapInArrow(suspects, "doc_id bigint").distinct())
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("_key"), F.col(text_col).alias("_text"))
    texts = texts.join(broadcast_if_small(found.withColumnRenamed("doc_id", "_key")), "_key", "left_semi")
    verified = (
        texts.select("doc_id", normalised("_text").alias("t"))
        .groupBy("t")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1")
        .select(F.sha2("t", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    verified = materialize(verified)
    return base.join(broadcast_if_small(verified), "text_sha256", "left").select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce("keep_id", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"),
        "text_sha256",
    )


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS s FROM documents),
g AS (SELECT s, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY s)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.s AS text_sha256 FROM d JOIN g USING (s)
"""
