"""Toxicity by maximum-scoring segment search.

Every token has log-odds between toxic and clean training documents under an informative Dirichlet
prior (the pooled document frequencies), shrunk by how well they are known. A text is then a sequence of
such scores, less a small constant that makes clean text drift down. One linear-time scan finds every
maximal-scoring segment. A segment's score becomes an expectation under the extreme-value law of such
maxima in clean text (E = K n exp(-lambda S)); the significant segments of a document are aggregated by
the law of sums of such scores, and the document's score is calibrated from that.
"""

from __future__ import annotations

import math
from collections.abc import Callable
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, materialize, slices, word_hashes

_TOKEN = re.compile(r"[^\W_]+")
#: A word that isn't significant itself falls back on its longest significant beginning.
PREFIXES = (7, 6, 5, 4)


def tokens_of(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def features_of(words) -> set[str]:
    """Words and, marked by ``*``, their beginnings."""
    out = set(words)
    for w in tuple(out):
        out.update(w[:k] + "*" for k in PREFIXES if len(w) > k)
    return out


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), in linear time."""
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    found: list[list[float]] = []  # [left sum, right sum, start, end], as in Ruzzo and Tompa's list
    places = np.flatnonzero(scores > 0)
    for at, left, right in zip(places.tolist(), sums[places].tolist(), sums[places + 1].tolist(), strict=True):
        start = at
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= left:
                j = found[j][4]
            if j < 0 or found[j][1] >= right:
                found.append([left, right, start, at + 1, j])
                break
            left, start = found[j][0], found[j][2]
            del found[j:]
    return [(int(s), int(e), r - x) for x, r, s, e, _ in found]


def sum_surprise(surprises: list[float]) -> float:
    """-log of how likely clean text has as good a set of segments: the r best together are as likely as
    exp(-T) T^(r-1) / (r! (r-1)!) for the sum T of their surprises, and each r costs a factor of 2 for
    having been tried. Segments that aren't surprising don't count, but the best one always does."""
    best = sorted(surprises, reverse=True)
    out, total = best[0], 0.0
    for r, x in enumerate(best, 1):
        if x <= 0:
            break
        total += x
        out = max(out, total - (r - 1) * math.log(max(total, 1.0)) + math.lgamma(r + 1) + math.lgamma(r) - (r - 1) * math.log(2))
    return out


def feature_hash(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature)


class ToxicityModel:
    """Fitted values; pickled to the executors. ``h`` has the sorted hashes of tokens, ``s`` their scores and
    ``z`` how well they are known."""

    def __init__(self, h: np.ndarray, s: np.ndarray, z: np.ndarray, sure: float, drift: float, lam: float, k: float, a: float, b: float):
        by = np.argsort(h)
        self.h, self.s, self.z = h[by], s[by].astype(np.float32), z[by].astype(np.float32)
        self.sure, self.drift, self.lam, self.k, self.a, self.b = sure, drift, lam, k, a, b

    def find(self, features: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of tokens and how well they are known; 0 for others."""
        x = np.fromiter(map(feature_hash, features), np.uint64, len(features))
        at = np.minimum(np.searchsorted(self.h, x), len(self.h) - 1)
        there = self.h[at] == x
        return np.where(there, self.s[at], 0.0), np.where(there, self.z[at], 0.0)

    def scores_of(self, words: list[str]) -> np.ndarray:
        """A word's own score if it is well known; else that of its longest well-known beginning; else its
        own as far as it is known."""
        s, z = self.find(words)
        todo = np.flatnonzero(np.abs(z) < self.sure)
        for k in PREFIXES:
            able = np.array([i for i in todo.tolist() if len(words[i]) > k], np.int64)
            begin, known = self.find([words[i][:k] + "*" for i in able.tolist()])
            able, begin = able[np.abs(known) >= self.sure], begin[np.abs(known) >= self.sure]
            s[able] = begin
            todo = np.setdiff1d(todo, able)
        return s

    def share(self, spark) -> None:
        """Send the three arrays to the executors once, not with every task's code. They hold the tokens of the bounded
        sample that the model was fitted on."""
        self.table = spark.sparkContext.broadcast((self.h, self.s, self.z))

    def __getstate__(self):
        left = {"cache", "h", "s", "z"} if "table" in self.__dict__ else {"cache"}
        return {k: v for k, v in self.__dict__.items() if k not in left}

    def __getattr__(self, name: str):
        if name in ("h", "s", "z") and "table" in self.__dict__:
            self.h, self.s, self.z = self.table.value
            return self.__dict__[name]
        raise AttributeError(name)

    def scores(self, text: str | None) -> np.ndarray:
        cache = self.__dict__.setdefault("cache", {})
        words = tokens_of(text)
        new = list(set(words).difference(cache))
        if len(cache) + len(new) > 100_000:  # start again with what this text needs
            cache.clear()
            new = list(set(words))
        cache.update(zip(new, self.scores_of(new).tolist(), strict=True))
        return np.fromiter(map(cache.__getitem__, words), np.float64, len(words)) - self.drift

    def surprise(self, n: int, score: float) -> float:
        """-log of the expected number of segments as good in n clean tokens."""
        return self.lam * score - math.log(self.k * max(n, 1))

    def evidence(self, n: int, segments: list[tuple[int, int, float]]) -> float:
        return sum_surprise([self.surprise(n, s) for _, _, s in segments] or [self.surprise(n, 0.0)])

    def evaluate(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Score and the significant segments (expectation under 0.05)."""
        scores = self.scores(text)
        segments = maximal_segments(scores)
        p = 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, self.a * self.evidence(len(scores), segments) + self.b))))
        return p, [t for t in segments if self.surprise(len(scores), t[2]) > -math.log(0.05)]


def log_odds(c, t, n_c: float, n_t: float):
    """Log-odds of tokens in toxic against clean documents, and their z-scores, for counts of documents c
    and t (columns or arrays) of n_c and n_t in all. The prior has the pooled shares and weighs as much as
    the toxic documents."""
    log, sqrt = (F.log, F.sqrt) if isinstance(c, Column) else (np.log, np.sqrt)
    prior = float(n_t)
    a = (c + t) / float(n_c + n_t) * prior
    t_w, c_w = t + a, c + a
    odds = log(t_w / (n_t + prior - t_w)) - log(c_w / (n_c + prior - c_w))
    return odds, odds / sqrt(1 / t_w + 1 / c_w)


def drift_root(scores: np.ndarray, counts: np.ndarray) -> float:
    """lambda: the positive root of sum p exp(lambda s) = 1 for a distribution of scores whose mean is
    negative; 1 if no score is positive."""
    p = counts / counts.sum()
    if not (scores[counts > 0] > 0).any():
        return 1.0
    low, high = 1e-6, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        value = float((p * np.exp(np.minimum(mid * scores, 700))).sum())
        low, high = (mid, high) if value < 1 else (low, mid)
    return low


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, held_fold: int = 1, max_docs: int = 20_000, max_features: int | None = None, sure: float = 4.0) -> ToxicityModel | None:
    """Fit on labelled rows whose crc32(id) mod ``folds`` isn't ``held_fold``; of those, the
    ``max_docs`` with the smallest hash of the id (a documented bound on the sample). Texts of one label
    that share their smallest hash of four words (nearly always copies) count once, or the words of a
    group of copies would look like signs of its label. None if there is no row of either class.

    Log-odds with z-score z are shrunk by z^2 / (z^2 + ``sure``^2): half where z is ``sure``. All tokens of
    the sample are in the model by their 64-bit hashes, so it grows with the sample; ``max_features``, if given, keeps those of highest |z|.
    """
    ident = F.col(id_col).cast("string")
    picked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("y"))
    picked = picked.where(F.crc32(F.col("_id").cast("string")) % folds != held_fold)
    picked = materialize(picked.orderBy(F.md5(F.col("_id").cast("string"))).limit(max_docs))
    # max_docs rows at most, so this broadcast is bounded.
    sample = docs.where(ident.isNotNull()).select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = sample.join(F.broadcast(picked), "_id").select("text", "y")

    def keyed(batches):
        for b in slices(batches):
            keys = []
            for text in b.column(0).to_pylist():
                grams = gram_hashes(word_hashes(" ".join(tokens_of(text)).encode()), 4)
                keys.append(int(grams.min() >> 1) if len(grams) else xxhash.xxh3_64_intdigest(text) >> 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.int64())], ["text", "y", "k"])

    sample = sample.mapInArrow(keyed, "text string, y int, k bigint")
    sample = materialize(sample.groupBy("k", "y").agg(F.min("text").alias("text")))

    def count(batches):
        def flush():
            h, at = np.unique(np.concatenate(held[0] + held[1]), return_inverse=True)
            y = np.repeat([0, 1], [sum(map(len, x)) for x in held])
            c, t = (np.bincount(at[y == v], minlength=len(h)) for v in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64)), pa.array(t.astype(np.int64))], ["f", "c", "t"])

        held, size = ([], []), 0
        for b in slices(batches, 64):
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                features = features_of(tokens_of(text))
                held[y > 0].append(np.fromiter(map(feature_hash, features), np.uint64, len(features)))
                size += len(features)
            if size > 1_000_000:
                yield flush()
                held, size = ([], []), 0
        if size:
            yield flush()

    counts = sample.select("text", "y").mapInArrow(count, "f bigint, c bigint, t bigint").groupBy("f").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))
    counts = materialize(counts)
    sums = counts.agg(F.sum("c"), F.sum("t")).first()
    n_c, n_t = sums[0] or 0, sums[1] or 0
    if not n_c or not n_t:
        return None
    odds, z = log_odds(F.col("c"), F.col("t"), n_c, n_t)
    best = counts.select("f", odds.alias("odds"), z.alias("z"))
    best = (best if max_features is None else best.orderBy(F.desc(F.abs("z")), "f").limit(max_features)).toArrow()
    z = best["z"].to_numpy()
    shrunk = best["odds"].to_numpy() * z**2 / (z**2 + sure**2)
    signs = shrunk[(z >= sure)]
    if not len(signs):
        return None
    model = ToxicityModel(best["f"].to_numpy().view(np.uint64), shrunk, z, sure, 0.05 * float(np.median(signs)), 1.0, 1.0, 1.0, 0.0)
    model.share(docs.sparkSession)

    def spread(batches):
        """Histogram of the clean tokens' scores, in steps of 0.01."""
        total: dict[int, int] = {}
        for b in slices(batches):
            for text in b.column(0).to_pylist():
                bins, n = np.unique(np.round(model.scores(text) * 100).astype(np.int64), return_counts=True)
                for i, m in zip(bins.tolist(), n.tolist(), strict=True):
                    total[i] = total.get(i, 0) + m
        yield pa.RecordBatch.from_pydict({"bin": list(total), "n": list(total.values())}, schema=pa.schema([("bin", pa.int64()), ("n", pa.int64())]))

    hist = sample.where("y = 0").select("text").mapInArrow(spread, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    at, times = np.array([r["bin"] for r in hist], float) / 100, np.array([r["n"] for r in hist], float)
    if len(at):
        # Clean text must drift down, or its maxima have no extreme-value law.
        more = max(0.0, float((at * times).sum() / times.sum()) + 0.01)
        model.drift += more
        model.lam = drift_root(at - more, times)

    def measured(value: Callable) -> list:
        """A number of each document of the sample; ids that come with several texts may make more rows."""

        def measure(batches):
            for b in slices(batches):
                texts = b.column(0).to_pylist()
                out = {"k": b.column(2), "y": [int(y > 0) for y in b.column(1).to_pylist()], "n": [], "v": []}
                for text in texts:
                    scores = model.scores(text)
                    out["n"].append(len(scores))
                    out["v"].append(value(scores))
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("k", pa.int64()), ("y", pa.int64()), ("n", pa.int64()), ("v", pa.float64())]))

        return sample.select("text", "y", "k").mapInArrow(measure, "k bigint, y bigint, n bigint, v double").orderBy("k", "y", "v").limit(max_docs).collect()

    m = measured(lambda scores: max((s for _, _, s in maximal_segments(scores)), default=0.0))
    y, n, top = (np.array([r[k] for r in m], float) for k in ("y", "n", "v"))
    clean = y == 0
    # K: what makes the expected number of clean maxima right at the score that 50 clean documents reach.
    over = [s for s in np.sort(top[clean])[::-1][:50] if s > 0]
    model.k = max(1e-9, len(over) / max(1.0, n[clean].sum()) * math.exp(min(700.0, model.lam * over[-1]))) if over else 1e-3
    # With K known, the evidence of all segments of each document.
    m = measured(lambda scores: model.evidence(len(scores), maximal_segments(scores)))
    model.a, model.b = platt(*(np.array([r[k] for r in m], float) for k in ("v", "y")))
    return model


def platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic calibration with Platt's smoothed targets, by damped Newton steps."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w = np.where(y > 0, 0.5 / max(pos, 1), 0.5 / max(neg, 1)) * len(y)  # either class weighs the same
    mu, sd = x.mean(), x.std() or 1.0
    u = (x - mu) / sd
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * u + b, -50, 50)))
        g = np.array([(w * (p - t) * u).sum() + 1e-3 * a, (w * (p - t)).sum()])
        h = w * p * (1 - p) + 1e-9
        hess = np.array([[(h * u * u).sum() + 1e-3, (h * u).sum()], [(h * u).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if abs(step).max() < 1e-9:
            break
    a = max(a, 1e-6)
    return float(a / sd), float(b - a * mu / sd)


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, folds: int = 3, held_fold: int = 1) -> DataFrame:
    """``doc_id, held_out, score, predicted, passages`` for every row; whole texts, whatever their length.

    Without a model, or without words, the score is that of no toxic token. ``passages`` lists the
    significant segments as (start, end, score) in tokens. Repeated rows score alike; a null id isn't
    held out.
    """

    def score(batches):
        for b in slices(batches):
            ps, passages = [], []
            for text in b.column(2).to_pylist():
                p, found = model.evaluate(text) if model else (0.0, [])
                ps.append(p)
                passages.append([{"start": s, "end": e, "score": v} for s, e, v in found])
            hit = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ps, pa.float64()), pa.array([int(p >= threshold) for p in ps], pa.int32()), pa.array(passages, pa.list_(hit))], ["doc_id", "held_out", "score", "predicted", "passages"])

    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == held_fold, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id bigint, held_out boolean, score double, predicted int, passages array<struct<start: bigint, end: bigint, score: double>>")


def drop_toxic(docs: DataFrame, model: ToxicityModel | None, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Rows under the threshold, with all their columns; every row where there is no model."""
    if model is None:
        return docs
    at = docs.columns.index(text_col)

    def keep(batches):
        for b in slices(batches):
            yield b.filter(pa.array([model.evaluate(t)[0] < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).drop("passages")
