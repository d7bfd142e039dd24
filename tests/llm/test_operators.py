"""Operators on odd rows, empty tables, and against brute force."""

import hashlib
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mnemolith.llm import embedding_dedup, exact_dedup, langid, license_scan, mixing, ngram_join, packing, substring_dedup, toxicity, warc

DATA = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(400)]
RNG = np.random.default_rng(11)


def text(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_exact_dedup_odd_rows(odd, none):
    rows = exact_dedup.exact_dedup(odd, block_rows=3).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == 10
    assert (got[1]["keep_id"], got[1]["group_size"], got[1]["kept"]) == (1, 4, True)
    assert (got[2]["keep_id"], got[2]["kept"], got[None]["keep_id"], got[None]["kept"]) == (1, False, 1, False)
    assert (got[3]["keep_id"], got[3]["group_size"], got[4]["keep_id"]) == (3, 2, 3)
    assert got[5]["keep_id"] == 5 and got[5]["text_sha256"] == hashlib.sha256(b" ").hexdigest()
    assert exact_dedup.exact_dedup(none).count() == 0


def test_substring_dedup_odd_rows(spark, odd, none):
    rows = substring_dedup.substring_dedup(odd).collect()
    assert len(rows) == 10 and sum(r["n_removed"] for r in rows) == 0  # a document takes nothing from itself
    assert substring_dedup.substring_dedup(none).count() == 0


def brute_removed(docs, window):
    starts = {}
    for i, t in docs:
        w = t.split()
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            starts[key] = min(starts.get(key, i), i)
    out = {}
    for i, t in docs:
        w = t.split()
        gone = {j for k in range(len(w) - window + 1) if starts[tuple(w[k : k + window])] < i for j in range(k, k + window)}
        out[i] = [x for j, x in enumerate(w) if j not in gone]
    return out


@pytest.mark.parametrize("hot", [20_000, 2])
def test_substring_dedup_equals_brute_force(spark, hot):
    passages = [text(70, s) for s in range(4)] + ["same " * 80]
    docs = [(i, " ".join([text(int(RNG.integers(0, 90)), 100 + i), passages[i % 5], text(int(RNG.integers(0, 60)), 300 + i), passages[(i * 3) % 5] if i % 2 else ""])) for i in range(40)]
    got = by_id(substring_dedup.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string"), shard_words=500, hot_units=hot))
    for i, kept in brute_removed(docs, 50).items():
        assert got[i]["kept_text"] == " ".join(kept)


def brute_components(docs, k, percent):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("block", [1024, 4])
def test_ngram_join_equals_brute_force(spark, block):
    docs, i = [], 0
    for s in range(12):
        base = text(int(RNG.integers(20, 120)), s).split()
        for _ in range(int(RNG.integers(1, 9))):
            w = list(base)
            for _ in range(int(RNG.integers(0, 4))):
                w[int(RNG.integers(0, len(w)))] = "edit" + str(i)
            docs.append((i, " ".join(w)))
            i += 1
    docs += [(i, "one two"), (i + 1, "ONE two"), (i + 2, ""), (i + 3, ""), (i + 4, "two one")]
    for k, percent in ((4, 85), (5, 80)):
        got = by_id(ngram_join.ngram_join(spark.createDataFrame(docs, "doc_id long, text string"), words=k, percent=percent, block=block))
        want = brute_components(docs, k, percent)
        assert {d: (got[d]["n_shingles"], got[d]["component_id"]) for d in want} == want


def test_substring_dedup_under_a_bad_hash(spark, monkeypatch):
    """Word hashes of one bit only place the units; what is removed stays that of the words."""
    real = substring_dedup.word_hashes
    monkeypatch.setattr(substring_dedup, "word_hashes", lambda t: real(t) & np.uint64(1))
    docs = [(i, " ".join([text(30, 100 + i), text(70, i % 4), text(20, 300 + i)])) for i in range(24)]
    got = by_id(substring_dedup.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string"), shard_words=500))
    for i, kept in brute_removed(docs, 50).items():
        assert got[i]["kept_text"] == " ".join(kept)


def thue_morse(bits):
    """Two words of 2**bits letters that a polynomial modulo 2**64 over them can't tell apart."""
    one = [bin(i).count("1") % 2 for i in range(1 << bits)]
    return "".join("ab"[x] for x in one), "".join("ba"[x] for x in one)


def test_words_that_hash_alike_stay_apart(spark):
    x, y = thue_morse(10)
    rest = text(80, 7).split()
    docs = [(1, " ".join(f"{w} {x}" for w in rest)), (2, " ".join(f"{w} {y}" for w in rest)), (3, " ".join(f"{w} {x}" for w in rest[:-1]) + " end"), (4, f"{x} {y} " * 40), (5, f"{y} {x} " * 40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = by_id(ngram_join.ngram_join(df, words=4, percent=85))
    want = brute_components(docs, 4, 85)
    assert {d: (got[d]["n_shingles"], got[d]["component_id"]) for d in want} == want
    got = by_id(substring_dedup.substring_dedup(df))
    for i, kept in brute_removed(docs, 50).items():
        assert got[i]["kept_text"] == " ".join(kept)


@pytest.mark.parametrize("bits", [8, 20])
def test_ngram_join_under_a_bad_hash(spark, monkeypatch, bits):
    """Tokens of few bits for the first hash: links, sizes and components stay those of the words."""
    real = ngram_join.token_hash
    monkeypatch.setattr(ngram_join, "token_hash", lambda seed: (lambda s, h=real(seed): h(s) & ((1 << bits) - 1)) if seed == 0 else real(seed))
    docs = [(i, " ".join(text(40, i % 9).split()[: 39 - i % 3] + [f"e{i % 4}"])) for i in range(40)]
    got = by_id(ngram_join.ngram_join(spark.createDataFrame(docs, "doc_id long, text string"), words=4, percent=85))
    want = brute_components(docs, 4, 85)
    assert {d: (got[d]["n_shingles"], got[d]["component_id"]) for d in want} == want


def test_ngram_join_odd_rows(odd, none):
    got = by_id(ngram_join.ngram_join(odd))
    assert got[2]["component_id"] is None and got[None]["component_id"] is None  # a null id is the smallest
    assert got[3]["n_shingles"] == 0 and got[3]["component_id"] == 3 and got[4]["component_id"] == 4
    assert got[7]["n_shingles"] == 1
    assert ngram_join.ngram_join(none).count() == 0


def test_license_scan_odd_rows(spark, odd, none):
    assert license_scan.license_scan(odd).count() == 10 and license_scan.license_scan(none).count() == 0
    rows = [(1, "Licensed under CC BY-NC 4.0. All rights reserved; GENERAL PUBLIC LICENSE"), (2, "Copyright (c) 2020 The Authors. All rights reserved."), (3, "released under the terms of the MIT License")]
    got = by_id(license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[1]["base_labels"] == "cc-by,gpl,reserved" and got[1]["labels"] == "cc-by,cc-by-nc,gpl,reserved"
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["n_words"]) == (3, 2, 10, 13)
    assert got[2]["labels"] == "reserved,reserved-holder" and got[3]["labels"] == "mit" and got[3]["n_base"] == 0


def test_language_id_odd_rows(odd, none):
    model = langid.fit_languages(odd)
    got = by_id(langid.identify_languages(odd, model))
    assert got[3]["lang_pred"] == got[6]["lang_pred"] == got[5]["lang_pred"] == "und"
    assert got[8]["lang_pred"] in {"en", "es", "fr"} and 0 <= got[8]["score"] <= 1
    assert langid.fit_languages(none) is None
    assert {r["lang_pred"] for r in langid.identify_languages(odd, None).collect()} == {"und"}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_language_id_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify_languages(docs, langid.fit_languages(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_language_rejection_is_calibrated(spark):
    words = {"aa": ["casa", "perro", "gato", "mesa"], "bb": ["haus", "hund", "katze", "tisch"]}
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(words[lang], 60)), lang) for i in range(300) for lang in (["aa", "bb"][i % 2],)]
    odd_ones = [(1000, "zqxj wvkk jjzq xxqw " * 20, None), (1001, "", None)]
    docs = spark.createDataFrame(rows + odd_ones, "doc_id long, text string, lang string")
    model = langid.fit_languages(docs, reject_share=0.05)
    got = by_id(langid.identify_languages(docs, model))
    assert got[1000]["rejected"] and got[1001]["rejected"] and got[1000]["lang_pred"] != "und"
    assert 0 < sum(got[i]["rejected"] for i in range(300)) < 45
    strict = by_id(langid.identify_languages(docs, model, reject=True))
    assert strict[1000]["lang_pred"] == "und" and strict[1000]["score"] == 0.0
    assert all(strict[i]["lang_pred"] == ["aa", "bb"][i % 2] for i in range(300) if not got[i]["rejected"])


def test_language_models_keep_every_ngram(spark):
    rng = np.random.default_rng(5)
    letters = np.array([chr(0x4E00 + i) for i in range(4000)])
    rows = [(i, "".join(rng.choice(letters, 4500)), "zz") for i in range(160)] + [(1000 + i, f"rare{chr(0x1000 + i)} word", f"l{i}") for i in range(230)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_languages(docs, held_fold=-1)
    assert len(model.langs) == 231
    want = set()
    for _, t, _ in rows:
        want |= {x for c in langid.code_pieces(t) for x in langid.ngram_hashes(c, 4).tolist()}
    assert len(want) > 400_000 and want <= set(model.prob[4].h.tolist())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).join(labels, "doc_id").where("held_out")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.8 and n.get((0, 1), 0) / n[0, 0] < 0.02


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    assert toxicity.fit_toxicity(none, labels) is None
    model = toxicity.fit_toxicity(odd, labels)
    rows = toxicity.score_toxicity(odd, model).collect()
    assert len(rows) == 10 and all(0 <= r["score"] <= 1 for r in rows)
    clean = [(i, text(30, i)) for i in range(400)]
    bad = [(i, text(15, i) + " rotten vile " + text(15, i + 1)) for i in range(400, 500)]
    docs = spark.createDataFrame(clean + bad, "doc_id long, text string")
    marks = docs.select("doc_id", (F.col("doc_id") >= 400).cast("int").alias("toxic"))
    model = toxicity.fit_toxicity(docs, marks)
    got = toxicity.score_toxicity(docs, model)
    assert got.where("(predicted = 1) <> (doc_id >= 400)").count() == 0
    assert got.where("doc_id = 450").first()["passages"][0]["start"] == 15
    assert toxicity.drop_toxic(docs, model).count() == 400


def test_vectors_odd_rows_and_brute_force(spark):
    nan, inf = float("nan"), float("inf")
    x = RNG.normal(size=(60, 6))
    x = np.concatenate((x, x[:25] + RNG.normal(size=(25, 6)) * 0.03, x[:5])).astype(np.float32)
    rows = [(i, [float(v) for v in r], int(i % 3)) for i, r in enumerate(x)]
    rows += [(200, None, 1), (201, [0.0] * 6, 1), (202, [nan] + [1.0] * 5, 1), (203, [inf] + [1.0] * 5, 1), (204, [None] + [1.0] * 5, 1), (205, rows[0][1], None), (206, [1.0, 2.0], 0), (None, rows[1][1], 1), (7, rows[7][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    good = [(i, np.array(v, np.float64), y) for i, v, y in rows if i is not None and y is not None and v and all(e is not None and np.isfinite(e) for e in v) and any(v)]
    links = {}
    parent = {i: i for i, _, _ in good}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(good)):
        for b in range(len(good)):
            (i, v, y), (j, w, z) = good[a], good[b]
            if a != b and y == z and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                links[a] = links.get(a, 0) + 1
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    for cell_rows, block in ((2000, 2048), (20, 16)):
        got = embedding_dedup.near_vectors(df, cell_rows=cell_rows, block=block, margin_deg=180).collect()
        assert len(got) == len(rows)
        have = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got if r["vec_id"] in parent)
        assert have == sorted((i, links.get(a, 0), find(i)) for a, (i, _, _) in enumerate(good))
        assert all(r["n_links"] == 0 and r["component_id"] == r["vec_id"] and r["kept"] for r in got if r["vec_id"] not in parent)
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_vectors_in_double_precision(spark):
    rows = [(1, [1e200, 1.0, 0.0]), (2, [2e200, 3.0, 0.0]), (3, [1e-200, 2e-200, 0.0]), (4, [1.0, 2.0, 0.0]), (5, [1.0, 0.0, 1e-60])]
    a = np.array([1.0, 0.0])
    angle = np.arccos(0.98)
    rows += [(10, [float(e) for e in a] + [0.0]), (11, [float(np.cos(angle - 1e-9)), float(np.sin(angle - 1e-9)), 0.0]), (12, [float(np.cos(angle + 1e-9)), -float(np.sin(angle + 1e-9)), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "CASE WHEN vec_id < 10 THEN 'a' ELSE 'b' END AS label", "1 AS cid", "2 AS v", "3 AS size", "4 AS cell", "5 AS n")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_vectors(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 5: (2, 1), 3: (1, 3), 4: (1, 3), 10: (1, 10), 11: (1, 10), 12: (0, 12)}


def test_vector_recall_with_many_cells(spark):
    x = RNG.normal(size=(1500, 32))
    x = np.concatenate((x, x + RNG.normal(size=x.shape) * 0.12))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = int((u @ u.T >= 0.98).sum() - len(u))
    df = spark.createDataFrame([(i, [float(e) for e in v], 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = embedding_dedup.near_vectors(df, cell_rows=100).agg(F.sum("n_links")).first()[0]
    assert true > 500 and got >= 0.95 * true


def test_default_margin_loses_no_link(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 6))
    x = np.concatenate((x, x + rng.normal(size=x.shape) * 0.12))
    u = x.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    true = int((u @ u.T >= 0.98).sum() - len(u))
    df = spark.createDataFrame([(i, [float(e) for e in v], 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    count = lambda **kw: embedding_dedup.near_vectors(df, cell_rows=20, **kw).agg(F.sum("n_links")).first()[0]
    assert count(margin_deg=5.0) < true == count()


def test_warc_odd_rows(spark):
    rows = [(3, "u", "same"), (1, None, "same"), (2, "u\nx", None), (4, "u", ""), (None, "u", "same"), (5, "u", "é" * 100_000), (1, "again", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("id", F.lit(1))
    archives = warc.write_warc(pages, archive_bytes=200)
    got = warc.read_warc(archives).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got) == [(0, "revisit", 1), (1, "response", None), (1, "response", None), (2, "response", None), (3, "revisit", 1), (4, "revisit", 2), (5, "response", None)]
    assert {r["payload_bytes"] for r in got if r["page_id"] == 5} == {200_000}
    assert warc.read_warc(warc.write_warc(pages.limit(0))).count() == 0


def test_warc_judges_each_row_on_its_payload(spark):
    rows = [(5, "u", "X"), (None, "u", "X"), (None, "u", "Y"), (6, "u", "Z"), (8, "u", "X"), (8, "u", "W"), (None, "u", "Z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.read_warc(warc.write_warc(pages)).select("page_id", "payload_digest", "refers_to").collect()
    digest = lambda x: warc.b32_sha1(x.encode())
    want = [(5, "X", None), (None, "X", 5), (None, "Y", None), (6, "Z", None), (8, "X", 5), (8, "W", None), (None, "Z", 6)]
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, digest(x), r)) for i, x, r in want)


def test_mixing_marginals(spark, odd, none):
    rows = [(i, text(20 + i % 30, i), ["en", "fr"][i % 3 == 0], ["a", "b", "c"][i % 7 % 3]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix_sources(docs, alpha={"source": 0.5, "lang": 0.5, "topic": 1.0}).cache()
    total = got.agg(F.sum("n_tokens")).first()[0]
    nat = {r["source"]: r["t"] / total for r in got.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    target = {k: v**0.5 for k, v in nat.items()}
    mass = {r["source"]: r["t"] for r in got.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("probability")).alias("t")).collect()}
    for k in nat:
        assert abs(mass[k] / sum(mass.values()) - target[k] / sum(target.values())) < 1e-3
    assert abs(got.agg(F.max("probability")).first()[0] - 1) < 1e-6
    assert mixing.mix_sources(odd).count() == 10 and mixing.mix_sources(none).count() == 0
    assert mixing.sample_mix(odd).columns == odd.columns and mixing.sample_mix(none).count() == 0
    picked = mixing.mix_sources(docs).where("selected").select("doc_id")
    assert picked.exceptAll(mixing.sample_mix(docs).select("doc_id")).count() == 0


def test_mixing_to_given_targets(spark):
    rows = [(i, text(20 + i % 30, i), ["en", "fr", None][i % 3], f"host{i % 200}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"lang": {"en": 3, "fr": 1, None: 1}}
    got = mixing.mix_sources(docs, targets=targets)
    mass = {r["lang"]: r["t"] for r in got.groupBy("lang").agg(F.sum(F.col("n_tokens") * F.col("probability")).alias("t")).collect()}
    assert abs(mass["en"] / sum(mass.values()) - 0.6) < 1e-5 and abs(mass[None] / sum(mass.values()) - 0.2) < 1e-5
    light = docs.select(*mixing.document_cells(docs, "text", "source", "lang", None))
    report = mixing.marginals(mixing.raked_cells(light, mixing.ALPHA, targets)).collect()
    assert len(report) == 200 + 3 + 1 and max(abs(r["target"] - r["reached"]) for r in report) < 1e-6
    only = mixing.sample_mix(docs, targets={"lang": {"fr": 1}})
    assert {r["lang"] for r in only.select("lang").distinct().collect()} == {"fr"}
    # targets that no weights can meet: en has one source only, which shall have nothing
    none = mixing.mix_sources(docs.where("source = 'host0'"), targets={"source": {"other": 1}})
    assert none.where("selected AND n_tokens > 0").count() == 0


def test_packing_batches(spark, odd, none):
    docs = spark.createDataFrame([(i, "w " * (i * 37 % 300)) for i in range(500)], "doc_id long, text string")
    got = packing.pack_buckets(docs, max_len=128, n_buckets=4, token_budget=1024, shard_rows=50).collect()
    sums, slots = {}, {}
    for r in got:
        sums[r["doc_id"]] = sums.get(r["doc_id"], 0) + r["n_tokens"]
        assert r["padding"] == r["bucket_len"] - r["n_tokens"] >= 0
        slots.setdefault((r["bucket_len"], r["batch_id"]), []).append(r["slot"])
    assert sums == {i: i * 37 % 300 for i in range(500)}
    for (length, _), s in slots.items():
        assert sorted(s) == list(range(len(s))) and len(s) <= max(1, 1024 // max(length, 1))
    for length in {k[0] for k in slots}:
        short = [k for k in slots if k[0] == length and len(slots[k]) < max(1, 1024 // max(length, 1))]
        assert len(short) <= 1
    rows = packing.pack_buckets(odd).collect()
    assert sum(r["n_tokens"] for r in rows) == 2 * 4 + 1 + 60_000 + 4
    assert packing.pack_buckets(none).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_pipeline_stages(spark, odd, none):
    labels = f"{DATA}"
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, none):
            out = stage(spark, docs, labels)
            assert name == "packing" or out.columns == docs.columns
            assert (out.count() == 0) == (docs is none)
    final = corpus_pipeline.run(spark, DATA)
    assert final.count() > 0


def test_stages_keep_the_smallest(spark):
    base = text(200, 1)
    near = base.split()
    near[50] = "edited"
    rows = [(5, base), (3, base.replace(" ", "  ")), (9, " ".join(near)), (1, text(150, 2)), (2, "short one"), (4, "short one")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    once = corpus_pipeline.exact(spark, docs, DATA)
    assert {r["doc_id"] for r in once.collect()} == {3, 9, 1, 2}
    assert {r["doc_id"] for r in corpus_pipeline.near(spark, once, DATA).collect()} == {3, 1, 2}


def test_stages_judge_each_row_on_its_text(spark):
    base = text(200, 1).split()
    other = [*base[:50], "edited", *base[51:]]
    full = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = lambda stage, rows: sorted(((r["doc_id"] or 0, r["text"]) for r in stage(spark, full(rows), DATA).collect()))
    exact = [(None, "A"), (None, "B"), (5, "B"), (7, "C"), (7, "D"), (3, "D"), (None, "E e"), (None, "E e"), (None, "E  e"), (9, "F"), (9, "F")]
    got = left(corpus_pipeline.exact, exact)
    assert [(i, " ".join(t.split())) for i, t in got] == [(0, "A"), (0, "E e"), (3, "D"), (5, "B"), (7, "C"), (9, "F")]
    a, b, c, d = " ".join(base), " ".join(other), text(150, 2), text(150, 3)
    got = left(corpus_pipeline.near, [(None, a), (None, b), (None, c), (7, d), (7, text(90, 4)), (3, d + " end")])
    assert len(got) == 4 and set(got) - {(0, a), (0, b)} == {(0, c), (7, text(90, 4)), (3, d + " end")}
    rows = full([(None, text(20 + i % 9, i)) for i in range(300)] + [(i, text(20 + i % 9, 1000 + i)) for i in range(300)])
    rows = rows.withColumn("source", F.when(F.col("doc_id") < 290, "t").otherwise("s"))
    kept = corpus_pipeline.mixing(spark, rows, DATA).where("doc_id IS NULL").count()
    assert 0 < kept < 300


def test_visits_of_template_texts_grow_with_the_rows(spark, monkeypatch):
    """Texts of four out of 100 common sentences, none linked: a shared sentence or two opens no group."""
    rng = np.random.default_rng(21)
    sentences = [" ".join(rng.choice(WORDS, 12)) for _ in range(100)]
    visits = []
    real = ngram_join.materialize

    def seen(df):
        out = real(df)
        if out.columns == ["doc_id", "f1", "n", "component", "at", "at_blk"]:
            visits.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "materialize", seen)
    for n in (400, 2000):
        docs = [(i, " ".join(sentences[j] for j in rng.choice(100, 4, replace=False))) for i in range(n)]
        got = ngram_join.ngram_join(spark.createDataFrame(docs, "doc_id long, text string"), words=4, percent=85)
        want = brute_components(docs[:400], 4, 85) if n == 400 else None
        if want:
            assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == want
    assert visits[1] <= 8 * max(visits[0], 25), visits


def test_prefix_overlap_bound_holds(spark):
    """For random linked pairs under one order, the prefixes share what the bound says."""
    rng = np.random.default_rng(6)
    for t, shared in ((85, 8), (80, 3), (85, 3)):
        rows = []
        for _ in range(400):
            n = int(rng.integers(1, 120))
            a = set(rng.choice(400, n, replace=False).tolist())
            b = set(a)
            for x in rng.choice(sorted(a), int(rng.integers(0, max(1, n // 7) + 1)), replace=False).tolist():
                b.discard(x)
            b |= set((400 + rng.choice(60, int(rng.integers(0, max(1, n // 9) + 1)), replace=False)).tolist())
            if not b or 100 * len(a & b) < t * len(a | b):
                continue
            rank = {x: r for r, x in enumerate(rng.permutation(sorted(a | b)).tolist())}
            prefix = lambda s: set(sorted(s, key=rank.get)[: len(s) - ngram_join.least_shared(len(s), t) + min(shared, ngram_join.least_shared(len(s), t))])  # noqa: E731, B023
            rows.append((len(a), len(b), int(max(1, len(b) - rng.integers(0, 9))), int(len(b) + rng.integers(0, 9)), len(prefix(a) & prefix(b))))
        df = spark.createDataFrame(rows, "n long, m long, low long, high long, c long")
        bound = lambda low, high: ngram_join.prefix_overlap(F.col("n"), F.col(low), F.col(high), t, shared)  # noqa: E731, B023
        assert len(rows) > 100
        assert df.where((F.col("c") < bound("m", "m")) | (F.col("c") < bound("low", "high")) | (bound("m", "m") > ngram_join.most_overlap(F.col("n"), t, shared)) | (bound("m", "m") > ngram_join.most_overlap(F.col("m"), t, shared))).count() == 0


def test_exchange_lists_stay_long(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 4000).cast("string")).alias("text")).coalesce(1)
    got = exact_dedup.exact_dedup(docs, owner_rows=100, block_rows=10)  # 64 owners
    assert got.where("kept").count() == 4000 and got.where("group_size = 2").count() == 4000


def test_packing_of_many_null_ids(spark):
    docs = spark.range(900).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 40).cast("int")).alias("text"))
    got = packing.pack_buckets(docs, max_len=64, n_buckets=3, token_budget=256, shard_rows=50)
    slots = got.groupBy("batch_id", "slot").count()
    assert got.count() == 900 and slots.where("count > 1").count() == 0


def joined_rows(spark, mark):
    """Output rows of all joins so far whose text holds the mark, by run and node."""
    store, rows = spark._jsparkSession.sharedState().statusStore(), {}
    runs = store.executionsList()
    for e in (runs.apply(i).executionId() for i in range(runs.size())):
        values, nodes = store.executionMetrics(e), store.planGraph(e).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            for x in (node.metrics().apply(m) for m in range(node.metrics().size()) if "Join" in node.name() and mark in node.desc()):
                if x.name() == "number of output rows" and values.contains(x.accumulatorId()):
                    rows[e, node.id()] = int(values.get(x.accumulatorId()).get().replace(",", ""))
    return rows


def test_ngram_join_of_many_alike_that_do_not_link(spark):
    """Their prefixes meet blocks, not each other one by one, and links among them are still found."""
    base, docs = [f"b{i}" for i in range(60)], []
    for i in range(400):
        words = list(base)
        for k, at in enumerate(np.random.default_rng(i).choice(range(4, 56, 8), 2, replace=False)):
            words[at] = f"e{i}_{k}"
        docs += [(i, " ".join(words)), (i + 1_000, " ".join([*words[:-2], f"x{i}", f"y{i}"]))][: 2 if i % 40 == 0 else 1]
    before = joined_rows(spark, "crowd")
    got = by_id(ngram_join.ngram_join(spark.createDataFrame(docs, "doc_id long, text string"), words=4, percent=85))
    made = sum(v for k, v in joined_rows(spark, "crowd").items() if k not in before)
    assert {k: r["component_id"] for k, r in got.items()} == {k: k % 1_000 for k, _ in docs}
    assert 0 < made < 20 * len(docs) * 10, made
