"""Kernels against hand-computed cases and brute force."""

import itertools
import math

import numpy as np
import pytest

from reprolens.functions import agreement, grid, kernels, stats


def test_hops_of_small_grids():
    h = grid.hops(3, 2, "rectangular")
    assert h[0, 1] == 1 and h[0, 5] == 2
    assert grid.hops(4, 2, "rectangular", toroidal=True)[0, 3] == 1
    assert grid.hops(3, 2, "hexagonal")[0, 5] == 2
    assert grid.adjacency(4, 3, "hexagonal", toroidal=True)[0, 8]
    assert len(grid.hexagon(0, 0)) == 6


def test_quantile8():
    assert stats.quantile8_values([3.0, 1.0, 2.0], 0.5) == 2
    assert stats.quantile8_values([], 0.5) is None
    x = list(range(1, 11))
    assert stats.quantile8_values(x, 0.25) == pytest.approx(1 / 3 + 0.25 * (10 + 1 / 3))
    assert stats.quantile8_values([5.0, float("nan"), None], 0.9) == 5


def test_assignment_is_optimal_and_first():
    r = np.random.default_rng(1)
    for _ in range(60):
        k = int(r.integers(2, 6))
        m = r.integers(0, 4, (k, k))
        best = max(sum(m[i, p[i]] for i in range(k)) for p in itertools.permutations(range(k)))
        first = next(p for p in itertools.permutations(range(k)) if sum(m[i, p[i]] for i in range(k)) == best)
        assert tuple(kernels.assignment(m)) == first
    assert kernels.align(np.array([[1, 0], [1, 0]])) == [1, None]


def test_ward_and_average_linkage_against_brute_force():
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(0, 0.2, (6, 2)), r.normal(4, 0.2, (5, 2)), r.normal((0, 5), 0.2, (4, 2))])
    got = kernels.ward(x, [2, 3])
    assert got[3].tolist() == [1] * 6 + [2] * 5 + [3] * 4
    d = kernels.euclidean(x)
    merges = kernels.linkage(d, "average")
    groups = {i: [i] for i in range(len(x))}
    for step, (a, b, h) in enumerate(merges):
        pairs = {(i, j): d[np.ix_(groups[i], groups[j])].mean() for i, j in itertools.combinations(groups, 2)}
        assert h == pytest.approx(min(pairs.values()))
        groups[len(x) + step] = groups.pop(a) + groups.pop(b)
    assert kernels.cut_tree(merges, len(x), 1).tolist() == [1] * len(x)


def test_ari_and_ami_cases():
    n = 100_000
    assert agreement.table_indices(np.array([[n]])) == (n, 1.0, 1.0)
    assert agreement.table_indices(np.array([[1]]))[1:] == (None, None)
    x, y = [int(c) for c in "111122223333"], [int(c) for c in "112212231333"]

    def table(a, b):
        t = np.zeros((3, 3))
        for i, j in zip(a, b, strict=True):
            t[i - 1, j - 1] += 1
        return t

    assert agreement.table_indices(table(x, x))[2] == pytest.approx(1)
    assert agreement.table_indices(table(x, y))[2] == pytest.approx(agreement.table_indices(table(y, x))[2], abs=1e-12)
    perm = table(x, y)[[2, 0, 1]]
    assert agreement.table_indices(perm)[1] == pytest.approx(agreement.table_indices(table(x, y))[1])


def test_expected_mutual_information_by_permutations():
    x, y = [0, 0, 1, 1, 2], [0, 1, 1, 1, 0]
    total = []
    for p in itertools.permutations(y):
        t = np.zeros((3, 2))
        for i, j in zip(x, p, strict=True):
            t[i, j] += 1
        total.append(sum(t[i, j] / 5 * math.log(5 * t[i, j] / (t[i].sum() * t[:, j].sum())) for i in range(3) for j in range(2) if t[i, j]))
    assert agreement.expected_mi_margins(np.array([2, 2, 1]), np.array([2, 3])) == pytest.approx(np.mean(total))


def test_kmeans_gmm_and_maps():
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(0, 0.3, (20, 2)), r.normal(5, 0.3, (20, 2))])
    label, centre = kernels.kmeans(x, 2, 7, starts=3)
    assert label.tolist() == [1] * 20 + [2] * 20 and centre.shape == (2, 2)
    labels, model, bic = kernels.gaussian_mixture(x, 2, 7)
    assert labels.tolist() == [1] * 20 + [2] * 20 and math.isfinite(bic) and model in ("spherical", "diagonal", "full")
    d = grid.distances(3, 2)
    a = kernels.train_map([x], [1.0], d, 10, 5)[0]
    assert np.array_equal(a, kernels.train_map([x], [1.0], d, 10, 5)[0])
    assert kernels.map_distance([x], [a], [1.0]).min(1).mean() < x.var(0).sum()
    assert kernels.sample_seed(1, "ab") == 1 + ord("a") * 2 + ord("b") * 3 + 1


def test_ward_without_distances():
    r = np.random.default_rng(1)
    for n in (2, 5, 60, 300):
        x = r.normal(size=(n, 3))
        full, chain = kernels.linkage(kernels.euclidean(x), "ward"), kernels.ward_chain(x)
        assert np.allclose([m[2] for m in full], [m[2] for m in chain])
        for k in range(1, min(n, 6)):
            assert (kernels.cut_tree(full, n, k) == kernels.cut_tree(chain, n, k)).all()
    assert kernels.cut_tree(kernels.ward_chain(np.repeat(r.normal(size=(20, 3)), 5, 0)), 100, 3).max() == 3


def _ward_distance(c, s):
    d = 2 * (s[:, None] * s) / (s[:, None] + s) * sum((c[:, None, j] - c[None, :, j]) ** 2 for j in range(c.shape[1]))
    np.fill_diagonal(d, np.inf)
    return d


def test_ward_tree_of_many_rows():
    """Rounds of nearest pairs give the tree of the chains, without a pass over all rows for each merge."""
    r = np.random.default_rng(1)
    for n, whole in ((2, False), (30, False), (700, False), (700, True)):
        c, s = r.normal(size=(n, 3)), np.floor(r.pareto(1, n) * 3 + 1)
        c = np.round(3 * c) if whole else c
        ask = np.sort(r.choice(n, n // 2, replace=False))
        assert (kernels.ward_nearest(c, s, ask) == _ward_distance(c, s).argmin(1)[ask]).all()
    one = r.normal(size=(2500, 3)) * [1, 3, 0.1]
    copies = np.repeat(r.normal(size=(600, 3)), 5, 0)[r.permutation(3000)]
    for x in (one, copies):
        chain, tree = kernels.ward_chain(x), kernels.ward_tree(x, few=40)
        assert np.allclose([m[2] for m in chain], [m[2] for m in tree])
        for k in (1, 2, 3, 10, 100):
            assert (kernels.cut_tree(chain, len(x), k) == kernels.cut_tree(tree, len(x), k)).all()
    ties = kernels.ward_tree(r.integers(0, 12, (4000, 3)).astype(float), few=10)
    assert len(ties) == 3999 and len({c for m in ties for c in m[:2]}) == 2 * 3999


def test_kmeans_moves_are_those_of_one_point_after_the_other():
    r = np.random.default_rng(5)
    x = np.column_stack([r.normal(size=6000), r.normal(size=6000) ** 2, np.round(r.normal(size=6000), 1)])
    k, label = 4, r.integers(0, 4, 6000)
    centre = np.array([x[label == c].mean(0) for c in range(k)])
    got, at = label.copy(), centre.copy()
    kernels._refine(np.ascontiguousarray(x.T), got, at)
    moved = True
    while moved:
        moved, n = False, np.bincount(label, minlength=k).astype(float)
        for i in range(len(x)):
            own = label[i]
            if n[own] <= 1:
                continue
            d = ((x[i] - centre) ** 2).sum(1)
            gain = n / (n + 1) * d
            gain[own] = n[own] / (n[own] - 1) * d[own]
            to = int(np.argmin(gain))
            if to != own and gain[to] < gain[own] - 1e-12:
                centre[own] -= (x[i] - centre[own]) / (n[own] - 1)
                centre[to] += (x[i] - centre[to]) / (n[to] + 1)
                n[own] -= 1
                n[to] += 1
                label[i], moved = to, True
    assert (got == label).all() and np.allclose(at, centre, rtol=1e-12)
