"""The classifier and the language models against plain versions of their arithmetic, and token counts of odd letters."""

import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandframe.llm import gam, langid, prefix_tokens


def plain_tree(g, h, leaves, least, ridge):
    """Greedy cuts by trying each one anew."""

    def gain(a, b):
        return sum(g[a:b]) ** 2 / (sum(h[a:b]) + ridge)

    ranges = [(0, len(g))]
    while len(ranges) < leaves:
        options = [(gain(a, c) + gain(c, b) - gain(a, b), i, c) for i, (a, b) in enumerate(ranges) for c in range(a + 1, b) if sum(h[a:c]) >= least and sum(h[c:b]) >= least]
        if not options or max(options)[0] <= 1e-9:
            break
        _, i, c = max(options, key=lambda o: o[0])
        a, b = ranges[i]
        ranges[i : i + 1] = [(a, c), (c, b)]
    out = [0.0] * len(g)
    for a, b in ranges:
        out[a:b] = [sum(g[a:b]) / (sum(h[a:b]) + ridge)] * (b - a)
    return out


def test_boosting_steps_and_scores():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    x[:, 3] = rng.integers(0, 3, 300)
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] == 1)).astype(float)
    rounds, rate = 3, 0.1
    model = gam.fit(x, y, rounds=rounds, pair_rounds=2, n_pairs=2, rate=rate)
    bins = [[sum(v >= e for e in model.edges[j]) for v in x[:, j]] for j in range(4)]
    start = math.log(y.mean() / (1 - y.mean()))
    odds, tables = [start] * 300, [[0.0] * (len(e) + 1) for e in model.edges]

    def residuals():
        p = [1 / (1 + math.exp(-o)) for o in odds]
        return [t - q for t, q in zip(y, p)], [max(q * (1 - q), 1e-6) for q in p]

    for _ in range(rounds):
        for j in range(4):
            r, w = residuals()
            g, h = [0.0] * len(tables[j]), [0.0] * len(tables[j])
            for b, a, c in zip(bins[j], r, w):
                g[b] += a
                h[b] += c
            step = plain_tree(g, h, 3, 2.0, 1.0)
            tables[j] = [t + rate * s for t, s in zip(tables[j], step)]
            odds = [o + rate * step[b] for o, b in zip(odds, bins[j])]
    for j in range(4):
        assert np.allclose(model.tables[j], tables[j])
    cells = [[b * 8 // (len(model.edges[j]) + 1) for b in bins[j]] for j in range(4)]
    grids = {}
    for i, j in combinations(range(4), 2):
        g, h = np.zeros((8, 8)), np.zeros((8, 8))
        for a, b, r, w in zip(cells[i], cells[j], *residuals()):
            g[a, b] += r
            h[a, b] += w
        best = -1.0
        for cut in range(1, 8):
            parts = [(rows, plain_tree(list(g[rows].sum(0)), list(h[rows].sum(0)), 2, 2.0, 1.0)) for rows in (slice(0, cut), slice(cut, 8))]
            best = max(best, sum(float(np.dot(leaf, g[rows].sum(0))) for rows, leaf in parts))
        grids[i, j] = best
    assert set(model.pairs) == set(sorted(grids, key=grids.get)[-2:])
    want = [start + sum(model.tables[j][bins[j][k]] for j in range(4)) + sum(t[cells[i][k], cells[j][k]] for (i, j), t in zip(model.pairs, model.pair_tables)) for k in range(300)]
    assert np.allclose(model.log_odds(x), want) and np.allclose(model.score(x), [1 / (1 + math.exp(-o)) for o in want])


def plain_kneser_ney(text, chars, discount=0.75):
    """p(last of four | three before), from dictionaries of counts and continuation counts."""
    padded = "   " + text
    levels = [Counter(padded[i : i + 4] for i in range(len(text)))]
    for _ in range(3):
        levels.append(Counter(gram[1:] for gram in levels[-1]))
    sums, kinds = [defaultdict(float) for _ in levels], [Counter() for _ in levels]
    for k, counts in enumerate(levels):
        for gram, n in counts.items():
            sums[k][gram[:-1]] += n
            kinds[k][gram[:-1]] += 1

    def p(gram, k=0):
        lower = 1 / (len(chars) + 1) if k == 3 else p(gram[1:], k + 1)
        total = sums[k].get(gram[:-1])
        if not total:
            return lower
        return max(levels[k].get(gram, 0) - discount, 0) / total + discount * kinds[k][gram[:-1]] / total * lower

    return p


@pytest.mark.parametrize("texts", [["the cat sat on the mat and the hat", "le chat est la et le rat la"], ["ab", "𐌰𐌱𐌲 𐌰𐌱 ab"], ["aaaa", "b"]])
def test_kneser_ney_by_dictionaries(texts):
    counts = {}
    for i, t in enumerate(texts):
        codes, n = np.unique(langid.grams(langid.letters(t)), return_counts=True)
        counts[str(i)] = codes, n
    model = langid.KneserNey([str(i) for i in range(len(texts))], counts)
    chars = set("".join(texts))
    models = [plain_kneser_ney(t, chars) for t in texts]
    for probe in (*texts, "that the rat 𐌲𐌰 est", "bb aa"):
        probe = " ".join("".join(c for c in probe if c in chars).split())
        got = model.log_probs(langid.grams(langid.letters(probe)))
        padded = "   " + probe
        for i in range(len(probe)):
            for k, p in enumerate(models):
                assert math.isclose(got[i, k], math.log(p(padded[i : i + 4])), rel_tol=1e-4, abs_tol=1e-4), (probe, i, k)


def test_letters_beyond_the_basic_plane_stay_apart():
    adlam, gothic, deseret = ([chr(c) for c in range(a, b) if chr(c).isalpha()] for a, b in ((0x1E900, 0x1E944), (0x10330, 0x1034B), (0x10400, 0x10450)))
    for script in (adlam, gothic, deseret):
        codes = {c: langid.letters(c).tolist() for c in script}
        assert len({tuple(v) for v in codes.values()}) == len({c.lower() for c in script})
    assert langid.letters("a🙂b").tolist() == [97, 32, 98] and langid.letters("𐐀").tolist() == langid.letters("𐐨").tolist()
    assert not set(langid.letters("".join(gothic)).tolist()) & set(langid.letters("".join(adlam)).tolist())


def test_token_counts_of_letters_that_tables_know_otherwise():
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    counter, library, rng = prefix_tokens.PrefixCounter(path), Tokenizer.from_file(path), random.Random(7)
    pools = [range(0x20, 0x7F), range(0xA0, 0x600), range(0x10000, 0x1FF00), range(0x20000, 0x33FFF), [0x130, 0x18F19, 0x44B, 0x10954, 0x20, 0x27]]
    texts = ["".join(chr(rng.choice(rng.choice(pools))) for _ in range(rng.randint(1, 12))) for _ in range(20_000)] + ["İ𘼙", "ы𐥔"]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [counter.count_and_cut(t, 2048)[0] for t in texts] == want
    assert all(counter.table(t)[-1] == n for t, n in zip(texts[::40], want[::40]))


def test_every_left_out_text_sets_centers_and_limit(spark):
    rng = np.random.default_rng(3)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 20, 5)) for _ in range(400)]
    texts = [" ".join(rng.choice(words, 3)) for _ in range(20_000)]
    model = langid.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' lang"))
    out = [zlib.crc32(t.encode()) % 4 == 3 for t in texts]
    codes, n = np.unique(np.concatenate([langid.grams(langid.letters(t)) for t, o in zip(texts, out) if not o]), return_counts=True)
    first = langid.KneserNey(["x"], {"x": (codes, n)})
    seen = [first.cross_entropy(t) for t in sorted({t for t, o in zip(texts, out) if o})]
    size, entropy = np.array([k for k, _ in seen]), np.array([e[0] for _, e in seen])
    assert len(seen) > 4500
    assert abs(model.center["x"] - np.average(entropy, weights=size)) < 1e-9
    assert abs(model.spread["x"][0] - max(0.05, entropy[size >= np.median(size)].std())) < 1e-9
    surprises = [model.surprise("x", k, e) for k, e in zip(size, entropy)]
    exact = langid._quantile(spark.createDataFrame([("x", int(k), float(e)) for k, e in zip(size, entropy)], "lang string, n long, entropy double"), model, 0.998)
    assert 0 <= exact - max(0, np.quantile(surprises, 0.998, method="inverted_cdf")) <= 1 / langid.STEPS
