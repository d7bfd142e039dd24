"""Byte-level BPE against its library, clustering and whitening against plain numpy."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from mnemolith.llm import byte_bpe, whitening, yinyang

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.parse_ranks(byte_bpe.read_rank_file(RANKS))


@pytest.fixture(scope="module")
def library(ranks):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rnd = random.Random(5)
    alphabets = ["ab", "abcdefghij", "a1. 's", " \n\t\r\x0b\x0c\x1c\x1d\x85\xa0 　x", "漢字かな", "éàü ñ", "\U0001f600\U0001f1e9‍️ ", "²½Ⅷ٣ a", "<|endoftext|> "]
    out = ["", " ", "\n\n  x", "don't we'll I'M 's", "  two  spaces ", "a" * 3000, "<|endoftext|>", "x\x00y", "́á"]
    return out + ["".join(rnd.choice(a) for _ in range(n)) for a in alphabets for n in (1, 7, 60, 900)]


def test_encoding_equals_the_library(spark, ranks, library, monkeypatch):
    texts = odd_texts()
    want = [library.encode_ordinary(t) for t in texts]
    bpe = byte_bpe.ByteBPE(ranks, public_tokenizers.PATTERN)
    assert [x.tolist() for x in bpe.encode(texts)] == want
    assert not bpe.queue and not any(bpe.queue.low)  # nothing waits after a merge
    for step, long, words in ((1 << 20, 64, 1 << 17), (50, 1 << 18, 4), (7, 16, 1)):  # other pieces, batches and memory
        monkeypatch.setattr(byte_bpe, "STEP", step)
        monkeypatch.setattr(byte_bpe, "LONG", long)
        monkeypatch.setattr(byte_bpe, "WORDS", words)
        bpe = byte_bpe.ByteBPE(ranks, public_tokenizers.PATTERN)
        assert [x.tolist() for x in bpe.encode(texts)] == want
        assert [x.tolist() for x in bpe.encode(texts[::-1])] == want[::-1]  # from memory, in part
        assert [bpe.decode(x).decode() for x in want] == texts


def test_a_merge_may_make_a_smaller_rank():
    """Ranks out of order: joining x and y makes a pair that comes before the rest of the bucket."""
    singles = {bytes([i]): 100 + i for i in range(256)}
    ranks = singles | {b"xy": 50, b"xyx": 10, b"yx": 60, b"xyxyx": 70}

    def plain(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            some = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
            if not some:
                return tuple(ranks[p] for p in parts)
            _, i = min(some)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rnd = random.Random(3)
    pieces = ["".join(rnd.choice("xyz") for _ in range(rnd.randint(1, 40))).encode() for _ in range(300)]
    bpe = byte_bpe.ByteBPE(ranks, r"\S+|\s+")
    todo = [p for p in pieces if p not in ranks]
    assert bpe.merge(todo) == [plain(p) for p in todo]


def test_long_pre_tokens_take_linear_time(ranks):
    bpe = byte_bpe.ByteBPE(ranks, public_tokenizers.PATTERN)
    text = "ab" * 300_000
    ids = bpe.encode([text])[0]
    assert bpe.decode(ids.tolist()).decode() == text


def test_bpe_odd_rows(odd, none, spark, library):
    tokens = byte_bpe.encode_texts(odd, RANKS, public_tokenizers.PATTERN)
    back = byte_bpe.decode_ids(tokens, RANKS).collect()
    source = sorted(((r["doc_id"] or 0, r["text"] or "") for r in odd.collect()))
    assert sorted(((r["doc_id"] or 0, bytes(r["decoded"]).decode()) for r in back)) == source
    assert all(r["ids"] == library.encode_ordinary(bytes(r["decoded"]).decode()) for r in back)
    assert byte_bpe.encode_texts(none, RANKS, public_tokenizers.PATTERN).count() == 0
    names = spark.createDataFrame([("k", None), (None, "a b")], "key string, body string").withColumn("ids", F.lit(1)).withColumn("doc_id", F.lit("z"))
    got = byte_bpe.encode_texts(names, RANKS, public_tokenizers.PATTERN, "key", "body").collect()
    assert sorted((r["doc_id"] or "", len(r["ids"])) for r in got) == [("", 2), ("k", 0)]


@pytest.mark.parametrize("name", ["op11_byte_bpe"])
def test_bpe_query(spark, library, name):
    got = {r["doc_id"]: r for r in byte_bpe.op11_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        text = r["text"] or ""
        ids, g = library.encode_ordinary(text), got[r["doc_id"]]
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert (g["n_tokens"], g["ids_sha256"], g["decoded_sha256"]) == want


def lloyd(rows, dim, k, rounds, scale=256):
    """(vec_id, cluster, distance) of each row by full scans, and the last centroids."""
    kept = [(i, np.floor(scale * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if v is not None and len(v) == dim and all(e is not None and np.isfinite(e) for e in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1].tolist())
    c = np.array([x for _, x in sorted(kept, key=key)[:k]])
    x = np.array([x for _, x in kept])
    near = lambda: ((x[:, None] - c[None]) ** 2).sum(axis=2)
    for _ in range(rounds):
        own = near().argmin(axis=1)
        c = np.array([x[own == j].sum(axis=0) // (own == j).sum() if (own == j).any() else c[j] for j in range(len(c))])
    d = near()
    own = d.argmin(axis=1)
    return sorted(((i is None, i or 0, int(a), int(d[n, a])) for n, ((i, _), a) in enumerate(zip(kept, own, strict=True)))), c


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS x", "2 AS cluster", "3 AS was", "4 AS label", "5 AS n", "6 AS d0")


@pytest.mark.parametrize("spread, k, size", [(1.0, 12, 4), (0.01, 9, 3), (30_000.0, 7, 2), (0.004, 30, 5)])
def test_clusters_equal_full_scans(spark, spread, k, size):
    """Among them many ties, vectors that are equal, and integers too large for exact doubles."""
    rng = np.random.default_rng(4)
    x = np.concatenate((rng.normal(size=(150, 5)) * spread, np.repeat(rng.normal(size=(3, 5)) * spread, 30, axis=0)))
    rows = [(i, [float(e) for e in v]) for i, v in enumerate(x)]
    rows += [(500, None), (501, []), (502, [1.0] * 4), (503, [NAN] + [0.0] * 4), (504, [INF] + [0.0] * 4), (505, [None] + [0.0] * 4), (None, rows[0][1]), (3, rows[4][1]), (3, rows[3][1])]
    want, c = lloyd(rows, 5, k, 5)
    got = yinyang.yinyang_clusters(vectors(spark, rows), dim=5, k=k, group_size=size).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["cluster"], r["distance"]) for r in got) == want
    total = {}
    for _, _, a, d in want:
        total[a] = total.get(a, 0) + d
    for r in got:
        assert (r["cluster_inertia"], r["inertia"]) == (total[r["cluster"]], sum(total.values()))
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, c[r["cluster"]].tolist())).encode()).hexdigest()


def test_filters_save_distances():
    rng = np.random.default_rng(1)
    x = np.floor(256 * (rng.normal(size=(20, 16))[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 16)) * 0.1)).astype(np.int64)
    c = x[:40]
    groups = yinyang.group_centroids(c, 4)
    yy = yinyang.Yinyang(c, groups)
    own, best, upper, lower = yy.first(x)
    assert yy.scanned == x.shape[0] * 40
    scanned = 0
    for _ in range(4):
        new = np.array([x[own == j].sum(axis=0) // (own == j).sum() if (own == j).any() else c[j] for j in range(40)])
        yy, c = yinyang.Yinyang(new, groups, c), new
        own, upper, lower = yy.step(x, own, upper, lower)
        full = yinyang.squared(x, c)
        assert (own == full.argmin(axis=1)).all()
        assert (np.sqrt(full[np.arange(len(x)), own]) <= upper).all()
        full[np.arange(len(x)), own] = 1 << 60
        assert all((np.sqrt(full[:, m].min(axis=1)) >= lower[:, g]).all() for g, m in enumerate(groups))
        scanned += yy.scanned
    assert scanned < 0.3 * 4 * x.shape[0] * 40


def test_clusters_of_few_or_no_vectors(spark):
    few = vectors(spark, [(1, [0.5] * 5), (2, [0.25] * 5)])
    assert {(r["vec_id"], r["distance"]) for r in yinyang.yinyang_clusters(few, dim=5).collect()} == {(1, 0), (2, 0)}
    assert yinyang.yinyang_clusters(few).count() == 0 and yinyang.yinyang_clusters(few.limit(0)).count() == 0


def plain_whitening(x, most=8):
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    values, u = np.linalg.eigh(centred.T @ centred / n)
    values, u = values[::-1], u[:, ::-1]
    keep = min(most, int((values > 1e-12 * values[0]).sum()))
    return centred @ u[:, :keep] / np.sqrt(values[:keep]), values[:keep] / values.sum(), ((n * x - s) ** 2).sum(axis=1)


def test_whitening_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(whitening, "SUMS", 4)  # folded rows in blocks
    rng = np.random.default_rng(8)
    x = rng.normal(size=(80, 10)) @ rng.normal(size=(10, 10))
    x = np.concatenate((x, x[:7]))
    rows = [(i, [float(e) for e in v]) for i, v in enumerate(x)]
    odd = [(500, None), (501, []), (502, [1.0] * 4), (503, [NAN] + [0.0] * 9), (504, [-INF] + [0.0] * 9), (505, [None] + [0.0] * 9)]
    got = whitening.whiten(vectors(spark, rows + odd)).collect()
    assert len(got) == 87 * 8
    w, share, dev = plain_whitening(np.floor(1024 * x).astype(np.int64) + 100_000)
    for k in range(8):
        mine = {r["vec_id"]: r for r in got if r["component"] == k + 1}
        have = np.array([mine[i]["whitened"] for i in range(87)])
        assert min(np.abs(have - w[:, k]).max(), np.abs(have + w[:, k]).max()) < 1e-9
        assert all(abs(r["explained"] / share[k] - 1) < 1e-9 and r["n"] == 87 and r["identity_error"] < 1e-9 for r in mine.values())
        assert [mine[i]["deviation"] for i in range(87)] == dev.tolist()


def test_whitening_without_variance_and_large_entries(spark):
    flat = vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert whitening.whiten(flat).count() == 0 and whitening.whiten(flat.limit(0)).count() == 0
    line = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i]) for i in range(9)])).collect()
    assert len(line) == 9 and {r["component"] for r in line} == {1} and abs(line[0]["explained"] - 1) < 1e-12
    big = whitening.whiten(vectors(spark, [(1, [1e9, 0.0]), (2, [0.0, 1e6]), (None, [0.0, 0.0])])).collect()
    x = np.array([[1_024_000_100_000, 100_000], [100_000, 1_024_100_000], [100_000, 100_000]], object)
    dev = ((3 * x - x.sum(axis=0)) ** 2).sum(axis=1)
    have = {r["vec_id"]: r["deviation"] for r in big}
    assert [have[i] for i in (1, 2, None)] == [d if d < 1 << 63 else None for d in dev]


@pytest.mark.parametrize("dim, sums", [(1, 80), (2, 80), (5, 80), (8, 3), (9, 4)])
def test_folded_triangle(spark, monkeypatch, dim, sums):
    monkeypatch.setattr(whitening, "SUMS", sums)
    x = np.random.default_rng(dim).normal(size=(40, dim))
    rows = spark.createDataFrame([([float(e) for e in v],) for v in x], "d array<double>")
    assert np.allclose(whitening.triangle_sums(rows, "d", dim), x.T @ x)
