"""Language identification by interpolated Kneser-Ney character models.

Training counts character n-grams of the highest order per language over every training text; lower
orders are Kneser-Ney continuation counts, derived from those. The models of all languages are stored
together as sorted arrays of 64-bit n-gram hashes with one row of log probabilities each. A text gets
the language with the lowest length-normalised cross-entropy. How far that cross-entropy lies above
what the language's own texts have lowers its score, and rejects the text beyond a limit that is calibrated
on training texts, so that a set share of them would be rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix, slices

ORDER = 4
SPACE = 32
_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """Which code points are letters."""
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _letters


#: Characters that are turned into code points at a time.
STEP = 500_000


def code_pieces(text: str | None, order: int = ORDER):
    """A text's code points, in lower case and with every run of other characters than letters as one
    space, a space at the end and ``order`` - 1 in front. Long texts come in pieces, each beginning with the
    last ``order`` - 1 code points of the one before, so that the n-grams of the pieces are those of the
    whole; nothing comes of a text without letters."""
    low, some = (text or "").lower(), False
    tail = np.full(order - 1, SPACE, np.uint32)
    for i in range(0, len(low), STEP):
        c = np.frombuffer(low[i : i + STEP].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = letter_table()[c]
        c = np.where(letter, c, np.uint32(SPACE))
        if i + STEP >= len(low):
            c = np.append(c, np.uint32(SPACE))
        if not some and not letter.any():
            continue
        some = True
        before = np.append(tail[-1:] if len(tail) else np.uint32(SPACE), c[:-1])
        out = np.concatenate((tail, c[(c != SPACE) | (before != SPACE)]))
        yield out
        tail = out[len(out) - order + 1 :]


def ngram_hashes(c: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k code points."""
    n = len(c) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    c = c.astype(np.uint64)
    if k <= 3:  # 21 bits a code point: no collision
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h = (h << np.uint64(21)) | c[j : j + n]
        return mix(h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    h = (c[:n] << np.uint64(42)) | (c[1 : n + 1] << np.uint64(21)) | c[2 : n + 2]
    for j in range(3, k):
        h = mix(h) * np.uint64(0x9E3779B97F4A7C15) + c[j : j + n]
    return mix(h + np.uint64(k))


class SortedRows:
    """Sorted hash array with a row of values for each hash."""

    def __init__(self, h: np.ndarray, rows: np.ndarray):
        self.h, self.rows = h, rows.astype(np.float32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash, and whether it is there."""
        if not len(self.h):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return at, self.h[at] == h


def code_rows(grams: list[str], k: int) -> np.ndarray:
    """Matrix of the code points of strings of k characters."""
    return np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, k)


def ngram_hashes_rows(flat: np.ndarray) -> np.ndarray:
    """Hash of each row of a matrix of code points."""
    n, k = flat.shape
    if n == 0 or k == 0:
        return np.zeros(n, np.uint64)
    return ngram_hashes(flat.reshape(-1), k)[::k] if k > 1 else ngram_hashes(flat.reshape(-1), 1)


class KneserNey:
    """All languages' models: per order from high to low, log probabilities of seen n-grams, and log
    back-off weights of seen contexts."""

    def __init__(self, counts: dict[str, dict[str, int]], order: int = ORDER):
        langs = sorted(counts)
        lang = np.repeat(np.arange(len(langs)), [len(counts[x]) for x in langs])
        n = np.array([c for x in langs for c in counts[x].values()], np.int64)
        self._fit(langs, code_rows([g for x in langs for g in counts[x]], order), lang, n, order)

    @classmethod
    def from_rows(cls, langs: list[str], codes: np.ndarray, lang: np.ndarray, n: np.ndarray, order: int = ORDER) -> KneserNey:
        """Model of distinct (n-gram, language) rows: code points, place in ``langs``, and count."""
        model = cls.__new__(cls)
        model._fit(langs, codes, lang, n, order)
        return model

    def _fit(self, langs: list[str], codes: np.ndarray, lang: np.ndarray, n: np.ndarray, order: int) -> None:
        """Discounts and continuation counts come from all rows given; no row is left out."""
        self.langs, self.order = langs, order
        size = len(langs)
        levels = {}
        for k in range(order, 0, -1):
            h = ngram_hashes_rows(codes)
            if k < order:  # how many different characters precede it
                by = np.lexsort((lang, h))
                h, lang, codes = h[by], lang[by], codes[by]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (lang[1:] != lang[:-1])
                at = np.flatnonzero(first)
                h, lang, codes, n = h[at], lang[at], codes[at], np.diff(np.append(at, len(h)))
            levels[k] = (h, codes, lang, n)
            codes = codes[:, 1:]
        alphabet = len(np.unique(levels[1][0])) + 1
        self.prob, self.gamma = {}, {}
        below = None  # hashes and probabilities of the order below
        for k in range(1, order + 1):
            h, codes, lang, n = levels.pop(k)
            grams, first, row = np.unique(h, return_index=True, return_inverse=True)
            contexts, ctx = np.unique(ngram_hashes_rows(codes[:, :-1]), return_inverse=True)
            cell = ctx * size + lang
            total = np.bincount(cell, n, len(contexts) * size).reshape(-1, size)
            kinds = np.bincount(cell, minlength=len(contexts) * size).reshape(-1, size)
            n1, n2 = np.bincount(lang[n == 1], minlength=size), np.bincount(lang[n == 2], minlength=size)
            d = np.where((n1 > 0) & (n2 > 0), n1 / np.maximum(n1 + 2 * n2, 1), 0.5)
            total1 = np.maximum(total, 1)
            gamma = np.where(total > 0, d * kinds / total1, 1.0)
            p = np.zeros((len(grams), size))
            p[row, lang] = n
            p = np.maximum(p - d, 0) / total1[ctx[first]]
            low = 1 / alphabet if below is None else below[1][np.searchsorted(below[0], ngram_hashes_rows(codes[first, 1:]))]
            p += gamma[ctx[first]] * low
            self.prob[k] = SortedRows(grams, np.log(p))
            if k > 1:
                self.gamma[k] = SortedRows(contexts, np.log(gamma))
            else:  # of a new character
                self.floor = np.log(gamma[0] if len(gamma) else np.ones(size)) - np.log(alphabet)
            below = (grams, p)
        self.mean, self.dev, self.sharp, self.limit = np.zeros(size), np.ones(size), 1.0, np.inf

    def log_probs(self, c: np.ndarray) -> np.ndarray:
        """Log probabilities per language of every character after the first ``order`` - 1."""
        k = self.order
        n = len(c) - k + 1
        out = np.zeros((max(n, 0), len(self.langs)), np.float32)
        todo = np.arange(max(n, 0))
        while k >= 1 and len(todo):
            h = ngram_hashes(c[self.order - k :], k)[todo] if k < self.order else ngram_hashes(c, k)
            at, there = self.prob[k].find(h)
            out[todo[there]] += self.prob[k].rows[at[there]]
            todo = todo[~there]
            if k > 1 and len(todo):  # back off: weight of the context where it was seen
                h = ngram_hashes(c[self.order - k :], k - 1)[todo]
                at, there = self.gamma[k].find(h)
                out[todo[there]] += self.gamma[k].rows[at[there]]
            k -= 1
        out[todo] += self.floor
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Characters scored, and cross-entropy per language, of each text."""
        n = np.zeros(len(texts), np.int64)
        sums = np.zeros((len(texts), len(self.langs)))
        for i, text in enumerate(texts):
            for c in code_pieces(text, self.order):
                p = self.log_probs(c)
                n[i] += len(p)
                sums[i] -= p.sum(axis=0, dtype=np.float64)
        return n, sums / np.maximum(n, 1)[:, None]

    def decide(self, n: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its confidence in 0..1, and how unlike the language's own texts it is (in
        standard deviations)."""
        best = np.argmin(h, axis=1)
        gap = (h - h[np.arange(len(h)), best][:, None]) * (np.minimum(n, 200) * self.sharp)[:, None]
        post = 1 / np.exp(-gap).sum(axis=1)
        spread = self.dev[best] * np.sqrt(np.maximum(1.0, 2000 / np.maximum(n, 1)))  # short texts vary more
        z = (h[np.arange(len(h)), best] - self.mean[best]) / spread
        accept = 1 / (1 + np.exp(np.clip(z - 4, -50, 50)))
        return best, post * accept, z


def count_grams(docs: DataFrame, text_col: str, lang_col: str, order: int = ORDER) -> DataFrame:
    """``lang, gram, n``: n-gram counts over the whole texts; partial sums leave each task in blocks."""

    def count(batches):
        total: dict[tuple[str, str], int] = {}

        def flush():
            keys = list(total)
            b = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(total.values()), pa.int64())], ["lang", "gram", "n"])
            total.clear()
            return b

        for b in slices(batches):
            by: dict[str, list] = {}
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).extend(code_pieces(text, order))
            for lang, parts in by.items():
                if not parts:
                    continue
                c = np.concatenate(parts)
                start = np.ones(len(c), bool)  # no n-gram begins in one piece and ends in the next
                ends = np.cumsum([len(p) for p in parts])
                for j in range(1, order):
                    start[ends - j] = False
                start = np.flatnonzero(start)
                _, at, n = np.unique(ngram_hashes(c, order)[start], return_index=True, return_counts=True)
                at = start[at]
                s = c.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                for i, m in zip(at.tolist(), n.tolist(), strict=True):
                    key = (lang, s[i : i + order])
                    total[key] = total.get(key, 0) + m
            if len(total) > 500_000:
                yield flush()
        yield flush()

    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return rows.mapInArrow(count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def cross_entropies(texts: DataFrame, model: KneserNey, lang_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the language, characters and cross-entropies of each row; only these come to the driver."""
    width = len(model.langs)

    def measure(batches):
        for b in slices(batches):
            n, h = model.entropies(b.column(1).to_pylist())
            y = [model.langs.index(x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int64()), pa.array(n), pa.ListArray.from_arrays(pa.array(np.arange(0, len(n) * width + 1, width, dtype=np.int32)), pa.array(h.reshape(-1)))], ["y", "n", "h"])

    rows = texts.select(F.col(lang_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(measure, "y bigint, n bigint, h array<double>").collect()
    y, n = (np.array([r[k] for r in rows], np.int64) for k in ("y", "n"))
    return y, n, np.array([r["h"] for r in rows], np.float64).reshape(-1, width)


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_fold: int = 2, tune_docs: int = 2_000, reject_share: float = 0.01) -> KneserNey | None:
    """Fit on every text with a language whose crc32(id) mod ``folds`` isn't ``held_fold``.

    The model has every n-gram of every language in them, so it grows with the input; the confidence and
    the limit beyond which texts are rejected are calibrated on whole training texts, those of the
    ``tune_docs`` ids with the smallest hash: ``reject_share`` of them lie beyond the limit. None without
    training text.
    """
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == held_fold, F.lit(False))
    train = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held)
    grams = materialize(count_grams(train, text_col, lang_col))
    langs = sorted(r["lang"] for r in grams.select("lang").distinct().collect())
    if not langs:
        return None
    # The full table of counts as arrays, in Arrow batches and not as rows.
    place = {x: i for i, x in enumerate(langs)}
    batches = grams.toArrow().to_batches()
    codes = np.concatenate([code_rows(b["gram"].to_pylist(), ORDER) for b in batches])
    lang = np.concatenate([np.array([place[x] for x in b["lang"].to_pylist()], np.int64) for b in batches])
    model = KneserNey.from_rows(langs, codes, lang, np.concatenate([b["n"].to_numpy() for b in batches]))
    able = train.where(F.col(lang_col).isin(model.langs) & F.col(id_col).isNotNull())
    ids = able.select(id_col).distinct().orderBy(F.md5(F.concat(F.lit("tune"), F.col(id_col).cast("string")))).limit(tune_docs)
    y, n, h = cross_entropies(able.join(F.broadcast(materialize(ids)), id_col, "left_semi"), model, lang_col, text_col)
    for i in range(len(model.langs)):
        own = h[(y == i) & (n > 50), i]
        if len(own) > 5:
            model.mean[i], model.dev[i] = np.median(own), max(0.02, np.subtract(*np.percentile(own, [84, 16])) / 2)
        else:
            model.mean[i], model.dev[i] = np.median(h[:, i]) if len(h) else 0.0, 1.0
    if (n > 0).any():
        model.limit = float(np.quantile(model.decide(n, h)[2][n > 0], 1 - reject_share))
    return model


def identify_languages(docs: DataFrame, model: KneserNey | None, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held_fold: int = 2, reject: bool = False) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, deviation, rejected`` for every row; the text alone decides.

    ``rejected`` marks texts unlike all that their language's own texts are: ``deviation`` is beyond the
    calibrated limit. With ``reject`` they are ``und`` with score 0, as are texts that are null or have no
    letter, and all where no model could be fitted. Repeated rows score alike; a null id isn't held out.
    """

    def predict(batches):
        for b in slices(batches):
            if model is None:
                lang, score, dev, far = ["und"] * b.num_rows, np.zeros(b.num_rows), np.zeros(b.num_rows), np.ones(b.num_rows, bool)
            else:
                n, h = model.entropies(b.column(2).to_pylist())
                best, score, dev = model.decide(n, h)
                far = (n == 0) | (dev > model.limit)
                ok = (n > 0) & ~(far & reject)
                lang = [model.langs[i] if o else "und" for i, o in zip(best, ok, strict=True)]
                score = np.where(ok, score, 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(dev, pa.float64()), pa.array(far)], ["doc_id", "held_out", "lang_pred", "score", "deviation", "rejected"])

    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == held_fold, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(predict, "doc_id bigint, held_out boolean, lang_pred string, score double, deviation double, rejected boolean")


def op5_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify_languages(docs, fit_languages(docs))
