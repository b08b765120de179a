"""Pruning and components on panels that are large enough to need several blocks and rounds."""

import numpy as np
import pytest

from strandframe.operators import ancestry


def panel(spark, chrom, pos, calls):
    rows = [(i, c, int(p), s, None if x < 0 else int(x)) for i, (c, p, row) in enumerate(zip(chrom, pos, calls)) for s, x in enumerate(row)]
    return spark.createDataFrame(rows, "variant_id long, chrom string, pos_grch37 long, sample_id int, dosage int").repartition(7)


def squared(x, y):
    both = (x >= 0) & (y >= 0)
    x, y, n = x[both].astype(float), y[both].astype(float), both.sum()
    vx, vy = n * (x * x).sum() - x.sum() ** 2, n * (y * y).sum() - y.sum() ** 2
    cov = n * (x * y).sum() - x.sum() * y.sum()
    return round(cov * cov / (vx * vy), 6) if vx > 0 and vy > 0 else 0.0


def greedy(chrom, pos, calls, window, r2):
    kept = []
    for i in sorted(range(len(pos)), key=lambda i: (chrom[i], pos[i], i)):
        if not any(chrom[j] == chrom[i] and pos[i] - pos[j] <= window and squared(calls[j], calls[i]) > r2 for j in kept[-80:]):
            kept.append(i)
    return set(kept)


def test_pruning_a_chain(spark):
    # each site is linked to the next one only, all along the chromosome: what goes depends on the very first
    rng = np.random.default_rng(2)
    calls = np.zeros((1000, 60), dtype=int)
    for i in range(1000):
        calls[i] = rng.integers(0, 3, 60)
    for i in range(1, 1000):
        calls[i, :34] = calls[i - 1, -34:] if i % 2 else calls[i, :34]
        calls[i, -34:] = calls[i, -34:]
        calls[i, 20:] = np.where(rng.random(40) < 0.75, calls[i - 1, 20:], calls[i, 20:])
    chrom, pos = ["1"] * 1000, np.arange(1000) * 100 + 1
    want = greedy(chrom, pos, calls, 150, 0.2)
    assert 300 < len(want) < 700
    got = {r[0] for r in ancestry.ld_prune(panel(spark, chrom, pos, calls), 150, 0.2).collect()}
    assert got == want


@pytest.mark.parametrize("walk", [1, 16])
def test_pruning_dense_sites(spark, walk, monkeypatch):
    monkeypatch.setattr(ancestry, "WALK_WINDOWS", walk)
    rng = np.random.default_rng(walk)
    base = rng.integers(0, 3, (12, 40))
    calls = np.array([np.where(rng.random(40) < 0.3, rng.integers(-1, 3, 40), base[rng.integers(0, 12)]) for _ in range(400)])
    chrom = [str(rng.integers(1, 4)) for _ in range(400)]
    pos = rng.integers(1, 3000, 400)
    got = {r[0] for r in ancestry.ld_prune(panel(spark, chrom, pos, calls), 300, 0.2).collect()}
    assert got == greedy(chrom, pos, calls, 300, 0.2) and len(got) < 390


def test_dense_sites_are_never_held_as_pairs(spark, monkeypatch):
    # all sites lie within one window: the pairs that are linked are many times the sites
    rng = np.random.default_rng(5)
    base = rng.integers(0, 3, (3, 40))
    calls = np.array([np.where(rng.random(40) < 0.2, rng.integers(-1, 3, 40), base[i % 3]) for i in range(150)])
    chrom, pos, stored = ["1"] * 150, rng.integers(1, 280, 150), []
    monkeypatch.setattr(ancestry, "checkpointed", lambda df, f=ancestry.checkpointed: (stored.append(df.count()), f(df))[1])
    frame = panel(spark, chrom, pos, calls)
    assert {r[0] for r in ancestry.ld_prune(frame, 300, 0.2).collect()} == greedy(chrom, pos, calls, 300, 0.2)
    assert max(stored) <= 2 * 150
    monkeypatch.setattr(ancestry, "MOST_CELLS", 900)
    got = {frozenset((r["keep_id"], r["drop_id"])) for r in ancestry.linked_pairs(frame, 300, 0.2).collect()}
    want = {frozenset((i, j)) for i in range(150) for j in range(i) if squared(calls[i], calls[j]) > 0.2}
    assert got == want and len(want) > 2000


@pytest.mark.parametrize("samples,sites,k", [(70, 400, 10), (180, 300, 3), (12, 40, 10)])
def test_components_span_the_dense_ones(spark, samples, sites, k):
    rng = np.random.default_rng(samples)
    groups = rng.integers(0, 5, samples)
    rates = rng.uniform(0.1, 0.9, (sites, 5))
    calls = rng.binomial(2, rates[:, groups])
    calls[rng.random(calls.shape) < 0.02] = -1
    calls[0] = 1
    frame = panel(spark, ["1"] * sites, np.arange(sites) + 1, calls)
    rows = ancestry.reference_components(frame, k, 0, 0).collect()
    there = calls >= 0
    f = np.where(there, calls, 0).sum(1) / (2 * there.sum(1))
    used = (f > 0) & (f < 1)
    z = np.where(there, calls - 2 * f[:, None], 0)[used] / np.sqrt(2 * f * (1 - f))[used][:, None]
    left, size, _ = np.linalg.svd(z, full_matrices=False)
    k = min(k, int((size**2 > 1e-10 * size[0] ** 2).sum()))
    got, ids = np.zeros((used.sum(), k)), np.flatnonzero(used)
    for r in rows:
        got[np.searchsorted(ids, r["variant_id"]), r["component"] - 1] = r["weight"]
    assert len(rows) == k * used.sum() and abs(got.T @ got - np.eye(k)).max() < 1e-6
    assert abs(abs((got * left[:, :k]).sum(0)) - 1).max() < 1e-6
    assert all(column[abs(column).argmax()] > 0 for column in got.T)


def test_small_panels_are_refused_unless_asked_for(spark):
    calls = np.random.default_rng(1).integers(0, 3, (20, 30))
    frame = panel(spark, ["1"] * 20, np.arange(20) + 1, calls)
    with pytest.raises(ValueError, match="30 samples"):
        ancestry.reference_components(frame)
    with pytest.raises(ValueError, match="markers"):
        ancestry.reference_components(frame, least_samples=30)
    assert ancestry.reference_components(frame, 2, 0, 0).count() == 40
