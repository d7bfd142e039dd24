"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Scratch, broadcast_if_small, materialize, remove, shared_dir

__all__ = ["Scratch", "broadcast_if_small", "connected_components", "discard", "gram_hashes", "materialize", "mix", "powers", "shared_dir", "slices", "sorted_distinct", "word_hashes"]


def discard(table: DataFrame) -> None:
    """Delete a materialized table that nothing reads any more."""
    files = table.inputFiles()
    if files:
        remove(table.sparkSession, files[0].rsplit("/", 1)[0])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node``, ``component`` (smallest node reachable) of every node that has an edge.

    Alternating large-star and small-star rounds: every round is a grouped minimum and a join, so a
    node with very many edges is split by adaptive skew handling. Ends when no edge changes.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u != v").distinct()
    e = materialize(e)
    last = None
    while True:
        sides = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = sides.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u != v").distinct())  # read three times below
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finalizer of splitmix64), wrapping."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hashes of all runs of k values."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[j : j + n]
    return mix(out)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    p = np.full(n + 1, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def sorted_distinct(h: np.ndarray) -> np.ndarray:
    """The distinct values, ascending; faster than np.unique for short arrays."""
    h = np.sort(h)
    keep = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    return h[keep]


BYTE_BASE = 0xD1342543DE82EF95
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_PIECE = 1 << 20
_byte_powers: list[np.ndarray] = []


def word_hashes(text: bytes | None) -> np.ndarray:
    """64-bit hashes of the words between ASCII white space, in order.

    A word's hash is its slice of the prefix sums of a polynomial over its bytes, so no word is cut out;
    long texts are taken in pieces that end between words.
    """
    text = text or b""
    if len(text) <= _PIECE:
        return _piece_hashes(text)
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + _PIECE)
        while end < len(text) and not _WHITE[text[end]]:
            end += 1
        out.append(_piece_hashes(text[at:end]))
        at = end
    return np.concatenate(out)


def _piece_hashes(text: bytes) -> np.ndarray:
    n = len(text)
    if not _byte_powers or len(_byte_powers[0]) <= n:
        size = max(1 << 16, 2 * n)
        _byte_powers[:] = [powers(BYTE_BASE, size), powers(pow(BYTE_BASE, -1, 1 << 64), size)]
    up, down = _byte_powers
    raw = np.frombuffer(text, np.uint8)
    white = np.ones(n + 2, np.int8)
    white[1:-1] = _WHITE[raw]
    edge = np.diff(white)
    start, end = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[:n], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def slices(batches, rows: int = 256):
    """Arrow batches in small slices, which bounds the words held at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
