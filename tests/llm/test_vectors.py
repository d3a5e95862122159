"""Recall of the lattice near the threshold, and how its candidates grow."""

from collections import Counter

import numpy as np
import pytest

from factlake.llm import vectors
from factlake.llm.vectors import cells, lattice_for, most_different, near_vectors, signs


def _unit(rng, n, dim):
    x = rng.standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pairs(rng, n, dim, cosine):
    a, b = _unit(rng, n, dim), rng.standard_normal((n, dim))
    b -= (a * b).sum(1, keepdims=True) * a
    return a, cosine * a + np.sqrt(1 - cosine**2) * b / np.linalg.norm(b, axis=1, keepdims=True)


@pytest.mark.parametrize("dim", [32, 64, 256])
@pytest.mark.parametrize(("n", "least"), [(2_000, 0.93), (5_000, 0.93), (200_000, 0.93), (10**8, 0.93), (20_000, 0.85), (20_000, 0.97)])
def test_recall_at_the_threshold(dim, n, least):
    rng, lattice = np.random.default_rng(1), lattice_for(n, least, dim)
    a, b = _pairs(rng, 2_000, dim, least + 1e-4)
    x, y = cells(a, lattice), cells(b, lattice)
    meets = ((x[:, :, :1] == y).any(2) | (y[:, :, :1] == x).any(2)).any(1)
    near = np.bitwise_count(signs(a) ^ signs(b)).sum(1) <= most_different(least)
    assert (meets & near).mean() >= 0.99


def _share(rng, n, sample=4_000):
    """The share of random pairs that meet in the lattice for n vectors, by a sample."""
    x, lattice = _unit(rng, sample, 64), lattice_for(n, 0.93, 64)
    own, met = cells(x, lattice), 0
    for t in range(lattice.tables):
        home = Counter(own[:, t, 0].tolist())
        met += sum(home[c] for c in own[:, t].ravel().tolist())
    return (met - sample * lattice.tables) / sample**2


def test_candidates_grow_more_slowly_than_pairs():
    shares = [_share(np.random.default_rng(2), n) for n in (5_000, 200_000, 10**7)]
    assert shares[0] < 0.02 and shares[1] < shares[0] / 5 and shares[2] <= shares[1]
    assert [lattice_for(n, 0.93, 64).tables < vectors.MOST_TABLES for n in (10, 10**5, 10**9)] == [True] * 3
    rng = np.random.default_rng(2)
    x = _unit(rng, 4_000, 64)
    differ = np.bitwise_count(signs(x[:2_000]) ^ signs(x[2_000:])).sum(1)
    assert (differ <= most_different(0.93)).mean() < 0.01
    assert most_different(0.8) > most_different(0.93) > most_different(0.99) >= 1
    with pytest.raises(ValueError, match="too far"):
        lattice_for(10**6, 0.2, 64)


@pytest.mark.parametrize("n", [None, 10**6])
def test_pairs_at_the_threshold_link_by_exact_cosine(spark, monkeypatch, n):
    if n:
        monkeypatch.setattr(vectors, "lattice_for", lambda _, least, dim: lattice_for(n, least, dim))
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for k, cosine in enumerate([0.9, 0.925, 0.9299, 0.9301, 0.935, 0.95, 0.99] * 6):
        a, b = _pairs(rng, 1, 48, cosine)
        rows += [(2 * k, a[0].tolist(), k % 2), (2 * k + 1, b[0].tolist(), k % 2)]
        x, y = a[0] / np.linalg.norm(a[0]), b[0] / np.linalg.norm(b[0])
        linked = x @ y >= 0.93
        want[2 * k], want[2 * k + 1] = (int(linked), 2 * k), (int(linked), 2 * k if linked else 2 * k + 1)
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(d).collect()} == want
