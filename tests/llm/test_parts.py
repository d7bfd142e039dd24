"""Building blocks against brute force."""

import io
import random
import re

import numpy as np
import pytest

from mnemolith.llm import common, embedding_dedup, exact_dedup, langid, license_scan, ngram_join, packing, substring_dedup, toxicity, warc

RNG = np.random.default_rng(5)


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_connected_components(spark):
    pairs = [(int(a), int(b)) for a, b in RNG.integers(0, 300, (150, 2))] + [(i, i + 1) for i in range(500, 560)] + [(900, i) for i in range(901, 950)]
    got = common.connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()
    want = union_find([p for p in pairs if p[0] != p[1]])
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)
    assert common.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 50, 3000])
def test_golomb_round_trip(n):
    values = np.sort(RNG.integers(0, 1 << 58, n).astype(np.uint64))
    if n > 2:
        values[1] = values[0]
    for bits in (exact_dedup.rice_bits(n, 58), exact_dedup.rice_bits(n, 58) + 3):
        blob = exact_dedup.golomb_encode(values, bits)
        assert (exact_dedup.golomb_decode(blob, n, bits) == values).all()


@pytest.mark.parametrize("window", [3, 8, 50])
def test_window_owners_equal_brute_force(window):
    pool = RNG.integers(1, 1 << 62, 300).astype(np.uint64)
    units = [pool[s : s + window + RNG.integers(0, 30)] for s in RNG.integers(0, 200, 80)] + [np.repeat(pool[:1], window + 5)]
    docs = RNG.integers(0, 40, len(units))
    best = {}
    for u, d in zip(units, docs, strict=True):
        for i in range(len(u) - window + 1):
            k = u[i : i + window].tobytes()
            best[k] = min(best.get(k, 99), d)
    got = substring_dedup.window_owners(units, docs, window)
    for u, g in zip(units, got, strict=True):
        assert g.tolist() == [best[u[i : i + window].tobytes()] for i in range(len(u) - window + 1)]


def test_equal_windows_share_an_anchor():
    words = RNG.integers(0, 6, 4000).astype(np.uint64)
    h = common.mix(words + np.uint64(1))
    anchor, first, last = substring_dedup.units_of(h, 50, chunk=512)
    assert first[0] == 0 and last[-1] == len(h) - 50 and (first[1:] == last[:-1] + 1).all()
    shifted = substring_dedup.units_of(np.concatenate((h[100:400], h[:10])), 50)
    of = lambda a, f, t: {w: a[i] for i in range(len(a)) for w in range(f[i], t[i] + 1)}
    one, two = of(anchor, first, last), of(*shifted)
    assert all(two[i] == one[100 + i] for i in range(0, 250))


def test_wavelet_rank():
    s = RNG.integers(0, 37, 1000)
    w = substring_dedup.WaveletMatrix(s, 37)
    c, i = RNG.integers(0, 37, 500), RNG.integers(0, 1001, 500)
    assert w.rank(c, i).tolist() == [int((s[:b] == a).sum()) for a, b in zip(c, i, strict=True)]


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_buckets_are_optimal(k):
    lengths, counts = np.array([1, 3, 4, 9, 10, 12]), np.array([5, 1, 7, 2, 2, 1])
    from itertools import combinations

    def cost(bounds):
        return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts, strict=True))

    best = min(cost([*cut, 12]) for cut in combinations(lengths[:-1], min(k, 6) - 1))
    got = packing.optimal_buckets(lengths, counts, k)
    assert got[-1] == 12 and len(got) <= k and cost(got) == best
    assert packing.optimal_buckets(np.array([], int), np.array([], int), 3) == []


def test_maximal_segments_equal_brute_force():
    def brute(x, lo, hi):
        best = max(((sum(x[i:j]), -(j - i), -i, i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0,))
        if best[0] <= 1e-9:
            return []
        return brute(x, lo, best[3]) + [(best[3], best[4])] + brute(x, best[4], hi)

    rnd = random.Random(1)
    for _ in range(60):
        x = [rnd.choice([-0.75, -0.75, 1.0, 2.5, 0.5]) for _ in range(rnd.randint(0, 14))]
        got = toxicity.maximal_segments(np.array(x))
        assert sorted((s, e) for s, e, _ in got) == sorted(brute(x, 0, len(x)))


def test_log_odds_equal_plain_code():
    import math

    c, t, n_c, n_t = [30, 0, 5, 1000], [1, 4, 5, 60], 4000, 250
    odds, z = toxicity.log_odds(np.array(c, float), np.array(t, float), n_c, n_t)
    for i in range(4):
        a = n_t * (c[i] + t[i]) / (n_c + n_t)  # the prior has the pooled share and the weight of the toxic texts
        ours, theirs = t[i] + a, c[i] + a
        want = math.log(ours / (n_t + n_t - ours)) - math.log(theirs / (n_c + n_t - theirs))
        assert abs(odds[i] - want) < 1e-12 and abs(z[i] - want / math.sqrt(1 / ours + 1 / theirs)) < 1e-12
    assert odds[1] > 0 > odds[0] and abs(z[1]) > 1


def test_extreme_value_law():
    scores, counts = np.array([-1.0, 0.5, 2.0]), np.array([80.0, 15.0, 5.0])
    lam = toxicity.drift_root(scores, counts)
    assert lam > 0.01 and abs((counts / 100 * np.exp(lam * scores)).sum() - 1) < 1e-6
    # clean text reaches a score about as often as K n exp(-lambda S) says, once K is fitted
    rng = np.random.default_rng(1)
    top = [max((s for _, _, s in toxicity.maximal_segments(rng.choice(scores, 500, p=counts / 100))), default=0.0) for _ in range(400)]
    k = -np.log((np.array(top) < 8).mean()) / 500 * np.exp(lam * 8)
    for s in (6, 10):
        assert abs((np.array(top) >= s).mean() - (1 - np.exp(-k * 500 * np.exp(-lam * s)))) < 0.12


def test_segments_add_up():
    one = toxicity.sum_surprise([3.0])
    assert one == 3.0 and toxicity.sum_surprise([-2.0, -5.0]) == -2.0
    assert toxicity.sum_surprise([3.0, -1.0]) == one < toxicity.sum_surprise([3.0, 3.0]) < toxicity.sum_surprise([3.0, 3.0, 3.0])


def test_clean_tokens_count_by_their_own_odds():
    known = {"bad": (3.0, 9.0), "fine": (-2.0, -9.0), "badl*": (2.5, 8.0), "badlands": (-1.0, -6.0), "rare": (0.2, 0.5)}
    s, z = np.array(list(known.values())).T
    model = toxicity.ToxicityModel(np.array([toxicity.feature_hash(f) for f in known], np.uint64), s, z, 4.0, 0.1, 1.0, 1e-3, 1.0, 0.0)
    assert [round(float(v), 6) for v in model.scores("bad fine badly badlands rare new")] == [2.9, -2.1, 2.4, -1.1, 0.1, -0.1]
    assert model.evaluate("bad " * 3)[0] > model.evaluate("bad fine bad fine bad")[0] > model.evaluate("fine " * 5)[0]


def test_template_automaton():
    a = license_scan.TemplateAutomaton({"t": "a <<opt>>b c<<end>> <<one:d|e>> <<any:1-2>> f"})
    yes = ["a d x f", "a b c e x y f", "z a d f f"]
    no = ["a b d x f", "a d f", "a d x y z f", "a", ""]
    for text, ok in [*((t, True) for t in yes), *((t, False) for t in no)]:
        words = license_scan.words_of(text.encode())
        assert bool(a.match(words, [i for i, w in enumerate(words) if w in a.first])) == ok, text


def test_license_catalogue_equals_its_patterns():
    """Filled, broken and joined templates: the automaton finds what the patterns of the SQL find."""
    rng = random.Random(1)
    a = license_scan.TemplateAutomaton(license_scan.TEMPLATES)
    assert list(license_scan.TEMPLATES) == list(license_scan._PATTERNS)

    def filled(markup):
        run = lambda m: " ".join(rng.choice(["x", "c", "all", "the"]) for _ in range(rng.randint(max(0, int(m[1]) - 1), int(m[2]) + 1)))
        markup = re.sub(r"<<any:(\d+)-(\d+)>>", run, markup)
        markup = re.sub(r"<<one:([^>]*)>>", lambda m: rng.choice(m[1].split("|")), markup)
        words = re.sub(r"<<opt>>(.*?)<<end>>", lambda m: m[1] if rng.random() < 0.5 else "", markup).split()
        if rng.random() < 0.3:
            del words[rng.randrange(len(words))]
        return " ".join(words)

    met = set()
    for _ in range(3000):
        text = " ".join(filled(rng.choice(list(license_scan.TEMPLATES.values()))) for _ in range(2))
        words = license_scan.words_of(text.encode())
        got = {x for _, _, x in a.match(words, [j for j, w in enumerate(words) if w in a.first])}
        joined = f" {b' '.join(words).decode()} "
        assert got == {x for x, p in license_scan._PATTERNS.items() if re.search(p, joined)}, joined
        met |= got
    assert met == set(license_scan.TEMPLATES)


def test_warc_round_trip_and_damage():
    rows = [(1, "http://a\r\nb", "é".encode() * 70_000, None), (2, None, b"", None), (None, "u", b"x", None), (3, "u", b"x" * 9, 2)]
    data = b"".join(warc.warc_record(*r) for r in rows)
    got = [warc.parse(h, b) for h, b in warc.read_records(io.BytesIO(data))]
    assert [g["page_id"] for g in got] == [1, 2, None, 3]
    assert [g["payload"] for g in got] == [r[2] if r[3] is None else None for r in rows]
    assert [g["payload_bytes"] for g in got] == [len(r[2]) for r in rows]
    assert (got[3]["record_type"], got[3]["refers_to"]) == ("revisit", 2)
    with pytest.raises(Exception):
        list(warc.read_records(io.BytesIO(data[:-5])))
    import zlib

    raw = zlib.decompress(warc.warc_record(5, "u", b"hello", None), 31).replace(b"hello", b"jello")
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_records(io.BytesIO(z.compress(raw) + z.flush())))


def plain_kneser_ney(counts, order, alphabet):
    """Interpolated Kneser-Ney by its definition: probability of a character after a context."""
    from collections import Counter

    levels, now = {}, Counter(counts)
    for k in range(order, 0, -1):
        levels[k] = now
        now = Counter(g[1:] for g in now)
    d = {}
    for k, c in levels.items():
        n1, n2 = (sum(v == i for v in c.values()) for i in (1, 2))
        d[k] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5

    def p(ctx, ch, k):
        if k == 0:
            return 1 / alphabet
        own = {g: v for g, v in levels[k].items() if g[:-1] == ctx}
        lower = p(ctx[1:], ch, k - 1)
        if not own:
            return lower
        total = sum(own.values())
        return max(own.get(ctx + ch, 0) - d[k], 0) / total + d[k] * len(own) / total * lower

    return lambda ctx, ch: p(ctx, ch, order)


def test_kneser_ney_sums_to_one():
    counts = {"x": {"aaa": 3, "aab": 1, "aba": 2, "bab": 1, "baa": 1}, "y": {"bbb": 4, "bba": 1, "bab": 2}}
    model = langid.KneserNey(counts, order=3)
    for i, lang in enumerate(model.langs):
        for ctx in {g[:2] for g in counts[lang]}:
            total = 0.0
            for ch in "ab":
                c = np.frombuffer((ctx + ch).encode("utf-32-le"), np.uint32)
                total += float(np.exp(model.log_probs(c)[0, i]))
            unseen = float(np.exp(model.log_probs(np.frombuffer((ctx + "z").encode("utf-32-le"), np.uint32))[0, i]))
            assert abs(total + unseen - 1) < 1e-5


def test_kneser_ney_equals_plain_code():
    from collections import Counter

    rnd = random.Random(3)
    counts = {lang: Counter() for lang in ("x", "y")}
    for lang, letters in (("x", "aabcd "), ("y", "bcdee ")):
        s = "".join(rnd.choice(letters) for _ in range(600))
        counts[lang].update(s[i : i + 4] for i in range(len(s) - 3))
    model = langid.KneserNey(counts, order=4)
    alphabet = len({g[-1] for c in counts.values() for g in c}) + 1
    for i, lang in enumerate(model.langs):
        plain = plain_kneser_ney(counts[lang], 4, alphabet)
        for _ in range(300):
            g = "".join(rnd.choice("abcde z") for _ in range(4))
            got = float(model.log_probs(np.frombuffer(g.encode("utf-32-le"), np.uint32))[0, i])
            assert abs(got - np.log(plain(g[:3], g[3]))) < 1e-4, (lang, g)


def test_code_pieces_are_those_of_the_whole(monkeypatch):
    texts = ["", None, "12 . 3", "Ein Satz, zwei -- Sätze!", "12345678901234 a", "abc" * 40 + " 1 " * 9 + "Z", " x"]
    whole = [list(langid.code_pieces(t)) for t in texts]
    assert [len(w) for w in whole] == [0, 0, 0, 1, 1, 1, 1]
    assert "".join(map(chr, whole[3][0])) == "   ein satz zwei sätze "
    grams = lambda pieces: [g for c in pieces for g in langid.ngram_hashes(c, 4).tolist()]
    for step in (1, 2, 7):
        monkeypatch.setattr(langid, "STEP", step)
        assert [grams(langid.code_pieces(t)) for t in texts] == [grams(w) for w in whole]


def test_long_texts_score_alike_whatever_the_step(monkeypatch):
    counts = {"x": {"aaab": 3, "aabb": 1, "abba": 2, "bbab": 1}, "y": {"bbbb": 4, "bbba": 1}}
    model = langid.KneserNey(counts, order=4)
    text = "ab ba aab b" * 110_000
    n, h = model.entropies([text])
    monkeypatch.setattr(langid, "STEP", 123_457)
    m, g = model.entropies([text])
    assert n == m and np.allclose(h, g, atol=1e-9)


def noisy_sets(n=40):
    base = np.unique(RNG.integers(0, 1 << 62, 200).astype(np.uint64))
    keep = lambda: base[RNG.random(len(base)) > RNG.choice([0.02, 0.08, 0.3])]
    return [np.unique(np.concatenate((keep(), RNG.integers(0, 1 << 62, 5).astype(np.uint64)))) for _ in range(n)]


def test_group_links_equal_brute_force():
    sets = noisy_sets()
    is_link = lambda i, j: bool(100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j])))
    pairs = [(i, j) for i in range(40) for j in range(i) if is_link(i, j)]
    want = union_find([(i, i) for i in range(40)] + pairs)
    asked = []
    found = ngram_join.link_group(np.arange(40), sets, np.ones(40, bool), lambda q, x: asked.append((q, x)) or is_link(q, x), 85)
    assert all(is_link(q, x) for q, x in found) and len(found) < 40
    assert union_find([(i, i) for i in range(40)] + found) == want
    host = np.arange(40) < 15
    label = np.where(host, 100, np.arange(40))
    found = ngram_join.link_group(label, sets, host, is_link, 85)
    assert {q for q, _ in found} == {q for q in range(15, 40) if any(is_link(q, x) for x in range(15))}
    # a link that the words refuse isn't made, and the next member is asked
    refuse = ngram_join.link_group(np.arange(40), sets, np.ones(40, bool), lambda q, x: x > 3 and q > 3 and is_link(q, x), 85)
    assert union_find([(i, i) for i in range(40)] + refuse) == union_find([(i, i) for i in range(40)] + [p for p in pairs if min(p) > 3])


def test_prefixes_of_similar_sets_share_enough():
    sets = noisy_sets(60)
    for shared in (1, 3):
        cut = [s[: len(s) - ngram_join.least_shared(len(s), 85) + min(shared, ngram_join.least_shared(len(s), 85))] for s in sets]
        for i in range(60):
            for j in range(i):
                if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j])):
                    assert len(np.intersect1d(cut[i], cut[j])) >= shared


def test_shingles_are_exact():
    texts = [b"", b" ", b"One", b"one  two\tthree", b"a b c d a b c d a b c", b"x " * 3000, "É é ü a b".encode()]
    for t in texts:
        w = t.lower().split()
        want = {b" ".join(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({b" ".join(w)} if w else set())
        sh = ngram_join.Shingles(t, 3)
        assert set(sh.at(slice(None))) == want
        u, n = ngram_join.distinct_tokens(sh, sh.tokens())
        assert n == len(want) == len(u)
        few = sh.tokens() % np.uint64(2)
        assert ngram_join.distinct_tokens(sh, few)[1] == len(want)
    a, b = ngram_join.Shingles(b"a b c d e f g h", 2), ngram_join.Shingles(b"a b c d e f g x", 2)
    assert ngram_join.linked(a, b, (a.tokens(), b.tokens()), 75) and not ngram_join.linked(a, b, (a.tokens(), b.tokens()), 76)


def test_long_texts_are_compared_in_passes(monkeypatch):
    monkeypatch.setattr(ngram_join, "STEP", 7)
    words = [f"w{i % 50}" for i in range(200)]
    a, b = (ngram_join.Shingles(" ".join(w).encode(), 3) for w in (words, words[3:]))
    whole = lambda s: set(s.at(slice(None)))
    j = 100 * len(whole(a) & whole(b)) // len(whole(a) | whole(b))
    assert ngram_join.linked(a, b, (a.tokens(), b.tokens()), j) and not ngram_join.linked(a, b, (a.tokens(), b.tokens()), j + 1)
    assert ngram_join.distinct_tokens(a, a.tokens())[1] == len(whole(a))


def test_link_counts_once_across_cells():
    x = RNG.normal(size=(30, 8))
    x = np.concatenate((x, x + RNG.normal(size=x.shape) * 0.02))
    ids, sizes = np.arange(60), np.ones(60, int)
    homes, probes = RNG.integers(0, 3, 60), [[0, 1, 2]] * 60
    total = sum(embedding_dedup.link_blocks(ids, sizes, x, homes == c, homes, probes, 0.98) for c in range(3))
    u = embedding_dedup.unit_rows(x)
    want = (u @ u.T >= 0.98) & ~np.eye(60, dtype=bool)
    assert (total == want).all()


def test_word_hashes_follow_the_words(monkeypatch):
    texts = [b"", b"  ", b"a", b" a b\ta\n", b"aa a a\x0baa \xc3\xa9 \x1c x", b"word " * 50 + b"tail"]
    seen = {}
    for piece in (1 << 20, 7):
        monkeypatch.setattr(common, "_PIECE", piece)
        for t in texts:
            words, h = t.split(), common.word_hashes(t)
            assert len(words) == len(h)
            for w, x in zip(words, h.tolist(), strict=True):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    assert len(common.word_hashes(None)) == 0


def test_gram_hashes_are_distinct_by_order():
    h = common.word_hashes(b"a b c a b d b a c")
    g = common.gram_hashes(h, 2)
    assert len(g) == 8 and g[0] == g[3] and len(set(g.tolist())) == 7
    assert common.sorted_distinct(g).tolist() == np.unique(g).tolist() and len(common.sorted_distinct(g[:0])) == 0
