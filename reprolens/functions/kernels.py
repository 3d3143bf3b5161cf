"""Small dense numeric kernels, run inside grouped tasks: hierarchical clustering,
k-means, Gaussian mixtures, optimal assignment and batch map training."""

from __future__ import annotations

import itertools
import math

import numpy as np


def _first_appearance(labels: np.ndarray) -> np.ndarray:
    """Cluster numbers from 1 by first appearance."""
    _, first, inverse = np.unique(labels, return_index=True, return_inverse=True)
    rank = np.empty(len(first), int)
    rank[np.argsort(first)] = np.arange(1, len(first) + 1)
    return rank[inverse]


def linkage(d: np.ndarray, method: str) -> list[tuple[int, int, float]]:
    """Merges (a, b, height) of observations 0..n-1, new clusters numbered from n.

    ``average`` takes dissimilarities, ``ward`` Euclidean distances (squared inside).
    Ties merge the clusters that come first.
    """
    n = len(d)
    d = (d.astype(float) ** 2 if method == "ward" else d.astype(float)).copy()
    np.fill_diagonal(d, np.inf)
    ids, size, merges = list(range(n)), np.ones(n), []
    alive = np.ones(n, bool)
    for step in range(n - 1):
        sub = np.where(alive[:, None] & alive[None, :], d, np.inf)
        i, j = divmod(int(np.argmin(sub)), n)
        i, j = min(i, j), max(i, j)
        h = d[i, j]
        merges.append((ids[i], ids[j], math.sqrt(max(h, 0)) if method == "ward" else float(h)))
        if method == "ward":
            t = size + size[i] + size[j]
            new = ((size + size[i]) * d[i] + (size + size[j]) * d[j] - size * h) / t
        else:
            new = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = new, new
        d[i, i] = np.inf
        size[i] += size[j]
        alive[j] = False
        ids[i] = n + step
    return merges


def ward_chain(x: np.ndarray) -> list[tuple[int, int, float]]:
    """``linkage(euclidean(x), "ward")`` by nearest-neighbour chains on centres and sizes:
    memory for the rows instead of their distances. Merges are sorted by height; at
    equal heights their order may differ."""
    n = len(x)
    return _in_order(_chain(x.astype(float).copy(), np.ones(n), np.zeros(n), np.arange(n)), n)


def _chain(centre: np.ndarray, size: np.ndarray, height: np.ndarray, slot: np.ndarray) -> list[tuple[float, int, int]]:
    """Merges (squared height, slot, slot) of clusters with these centres and sizes; the
    lower slot goes on. Time grows with the square of their number."""
    n = len(centre)
    alive = np.ones(n, bool)
    chain: list[int] = []
    found: list[tuple[float, int, int]] = []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.argmax(alive))]
        while True:
            i = chain[-1]
            d = 2 * size * size[i] / (size + size[i]) * ((centre - centre[i]) ** 2).sum(1)
            d[~alive] = np.inf
            d[i] = np.inf
            j = int(np.argmin(d))
            # of equals the one before in the chain, or it would not end
            if len(chain) > 1 and d[chain[-2]] <= d[j]:
                j = chain[-2]
                h = float(d[j])
                break
            chain.append(j)
        chain = chain[:-2]
        i, j = min(i, j), max(i, j)
        # rounding must not put a merge before those inside it
        height[i] = max(h, height[i], height[j])
        found.append((float(height[i]), int(slot[i]), int(slot[j])))
        centre[i] = (size[i] * centre[i] + size[j] * centre[j]) / (size[i] + size[j])
        size[i] += size[j]
        alive[j] = False
    return found


def _in_order(found: list[tuple[float, int, int]], n: int) -> list[tuple[int, int, float]]:
    """Merges of slots, each after those inside it, as merges of numbered clusters by height."""
    ids, merges = list(range(n)), []
    for step, (h, i, j) in enumerate(sorted(found, key=lambda m: m[0])):
        merges.append((ids[i], ids[j], math.sqrt(h)))
        ids[i] = n + step
    return merges


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after the other."""
    return np.repeat(start - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


def _leaves(x: np.ndarray, size: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows, and first place and length of each leaf in it: halved along the
    widest column down to ``most`` rows, within powers of two of the size."""
    kind = np.floor(np.log2(size)).astype(int)
    order = np.argsort(kind, kind="stable")
    start = np.flatnonzero(np.diff(kind[order], prepend=-1))
    count = np.diff(start, append=len(x))
    while (count > most).any():
        y = x[order]
        column = np.argmax(np.maximum.reduceat(y, start) - np.minimum.reduceat(y, start), 1)
        leaf = np.repeat(np.arange(len(start)), count)
        order = order[np.lexsort((y[np.arange(len(y)), column[leaf]], leaf))]
        left = np.where(count > most, count // 2, count)
        count = np.column_stack([left, count - left]).ravel()
        count = count[count > 0]
        start = np.cumsum(count) - count
    return order, start, count


def ward_nearest(centre: np.ndarray, size: np.ndarray, ask: np.ndarray, most: int = 24, group: int = 64) -> np.ndarray:
    """The cluster that each of ``ask`` is nearest to in Ward's distance (the first of
    equals), exactly: leaves whose boxes are too far, at their smallest size, are left out."""
    order, start, count = _leaves(centre, size, most)
    x, s = centre[order], size[order]
    low, high, least = np.minimum.reduceat(x, start), np.maximum.reduceat(x, start), np.minimum.reduceat(s, start)
    place = np.empty(len(order), int)
    place[order] = np.arange(len(order))
    own = np.repeat(np.arange(len(start)), count)
    q = np.sort(place[ask])
    best, who = np.full(len(q), np.inf), np.full(len(q), len(x))
    columns = range(x.shape[1])

    def look(i: np.ndarray, leaf: np.ndarray) -> None:
        """Queries i (sorted) against the rows of a leaf each."""
        ends = np.cumsum(count[leaf])
        cuts = [0, *np.searchsorted(ends, np.arange(1_000_000, ends[-1] if len(ends) else 0, 1_000_000)).tolist(), len(i)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            n = count[leaf[a:b]]
            j, k = _spread(start[leaf[a:b]], n), np.repeat(i[a:b], n)
            at = q[k]
            d = 2 * (s[at] * s[j]) / (s[at] + s[j]) * sum((x[at, c] - x[j, c]) ** 2 for c in columns)
            d[at == j] = np.inf
            first = np.flatnonzero(np.diff(k, prepend=-1))
            m, to = np.minimum.reduceat(d, first), k[first]
            name = np.minimum.reduceat(np.where(d == np.repeat(m, np.diff(first, append=len(k))), order[j], len(x)), first)
            better = (m < best[to]) | ((m == best[to]) & (name < who[to]))
            best[to[better]], who[to[better]] = m[better], name[better]

    def bound(a: np.ndarray, b: np.ndarray, sa: np.ndarray, sb: np.ndarray, leaf) -> np.ndarray:
        gap = sum(np.maximum(np.maximum(a[..., c] - high[leaf, c], low[leaf, c] - b[..., c]), 0) ** 2 for c in columns)
        # less a little for rounding
        return 2 * (sa * sb) / (sa + sb) * gap * (1 - 1e-9)

    look(np.arange(len(q)), own[q])
    asked = np.flatnonzero(np.diff(own[q], prepend=-1))
    home = own[q[asked]]
    many = np.diff(asked, append=len(q))
    for f in range(0, len(home), group):
        h, n = home[f : f + group], many[f : f + group]
        i = np.arange(asked[f], asked[f] + n.sum())
        first = asked[f : f + group] - asked[f]
        small = np.minimum.reduceat(s[q[i]], first)
        far = bound(low[h].min(0), high[h].max(0), small.min(), least, slice(None))
        near = np.flatnonzero(far <= best[i].max())
        table = bound(low[h][:, None], high[h][:, None], small[:, None], least[near], near)
        table[near == h[:, None]] = np.inf
        row = np.repeat(np.arange(len(h)), n)
        # the nearest other leaf first, for less to be left
        next_ = np.argmin(table, 1)
        there = np.isfinite(table[np.arange(len(h)), next_])
        use = there[row]
        look(i[use], near[next_[row[use]]])
        table[np.arange(len(h)), next_] = np.inf
        a, b = np.nonzero(table <= np.where(np.isfinite(t := np.maximum.reduceat(best[i], first)), t, np.finfo(float).max)[:, None])
        pairs = np.bincount(a, minlength=len(h))
        mine = pairs[row]
        leaf = near[b[_spread((np.cumsum(pairs) - pairs)[row], mine)]]
        i = np.repeat(i, mine)
        keep = bound(x[q[i]], x[q[i]], s[q[i]], least[leaf], leaf) <= best[i]
        look(i[keep], leaf[keep])
    out = np.empty(len(x), int)
    out[order[q]] = who
    return out[ask]


def ward_tree(x: np.ndarray, few: int = 1000) -> list[tuple[int, int, float]]:
    """``ward_chain(x)`` for many rows: equal rows first, then in rounds all pairs that are
    nearest to each other, which Ward's distance allows at once; a cluster looks again only
    when its nearest was merged. The last ``few``, and what is left when a round finds
    hardly any pair, go on as chains."""
    n = len(x)
    if n <= few:
        return ward_chain(x)
    x = x.astype(float) + 0.0
    order = np.lexsort((np.arange(n), *x.T))
    new = np.ones(n, bool)
    new[1:] = (x[order][1:] != x[order][:-1]).any(1)
    first = np.flatnonzero(new)
    slot = order[first]
    size = np.diff(first, append=n).astype(float)
    found = [(0.0, int(a), int(b)) for a, b in zip(np.repeat(slot, size.astype(int) - 1), order[~new], strict=True)]
    by = np.argsort(slot)
    slot, size = slot[by], size[by]
    centre, height = x[slot], np.zeros(len(slot))
    nearest = np.full(len(slot), -1)
    while len(slot) > few:
        ask = np.flatnonzero(nearest < 0)
        nearest[ask] = ward_nearest(centre, size, ask)
        every = np.arange(len(slot))
        i = every[(nearest[nearest] == every) & (every < nearest)]
        if len(i) * 500 < len(slot):
            if len(ask) == len(slot):
                break
            # ties may have been settled otherwise since
            nearest[:] = -1
            continue
        j = nearest[i]
        d = 2 * (size[i] * size[j]) / (size[i] + size[j]) * ((centre[i] - centre[j]) ** 2).sum(1)
        height[i] = np.maximum(d, np.maximum(height[i], height[j]))
        found += zip(height[i].tolist(), slot[i].tolist(), slot[j].tolist(), strict=True)
        centre[i] = (size[i, None] * centre[i] + size[j, None] * centre[j]) / (size[i] + size[j])[:, None]
        size[i] += size[j]
        gone = np.zeros(len(slot), bool)
        gone[j] = True
        again = gone.copy()
        again[i] = True
        nearest[again[nearest]] = -1
        nearest[i] = -1
        kept = ~gone
        to = np.cumsum(kept) - 1
        nearest = np.where(nearest < 0, -1, to[nearest])[kept]
        slot, size, centre, height = slot[kept], size[kept], centre[kept], height[kept]
    return _in_order(found + _chain(centre, size, height, slot), n)


def cut_tree(merges: list[tuple[int, int, float]], n: int, k: int) -> np.ndarray:
    """Labels of k clusters, numbered by first appearance."""
    top = list(range(2 * n))
    for step in range(n - k - 1, -1, -1):
        a, b, _ = merges[step]
        top[a] = top[b] = top[n + step]
    return _first_appearance(np.array(top[:n]))


def euclidean(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((x[:, None, :] - x[None, :, :]) ** 2).sum(2), 0))


def ward(x: np.ndarray, ks: list[int]) -> dict[int, np.ndarray]:
    """Ward partitions of the rows of x: one tree, cut at each k."""
    merges = linkage(euclidean(x), "ward")
    return {k: cut_tree(merges, len(x), k) for k in ks}


def assignment(score: np.ndarray) -> list[int]:
    """Column of each row of a square matrix that maximises the sum; of several optima
    the lexicographically first. Shortest augmenting paths; ties broken by a second
    pass that fixes rows in order."""
    n = len(score)

    def best(sub: np.ndarray) -> float:
        m = len(sub)
        if m == 0:
            return 0.0
        cost = sub.max() - sub
        u, v, p, way = np.zeros(m + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
        for i in range(1, m + 1):
            p[0], j0 = i, 0
            low, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
            while True:
                used[j0] = True
                i0, delta, j1 = p[j0], np.inf, 0
                for j in range(1, m + 1):
                    if not used[j]:
                        c = cost[i0 - 1, j - 1] - u[i0] - v[j]
                        if c < low[j]:
                            low[j], way[j] = c, j0
                        if low[j] < delta:
                            delta, j1 = low[j], j
                for j in range(m + 1):
                    if used[j]:
                        u[p[j]] += delta
                        v[j] -= delta
                    else:
                        low[j] -= delta
                j0 = j1
                if p[j0] == 0:
                    break
            while j0:
                p[j0] = p[way[j0]]
                j0 = way[j0]
        return float(sum(sub[p[j] - 1, j - 1] for j in range(1, m + 1)))

    score = np.asarray(score, float)
    rows, columns, out, total = list(range(n)), list(range(n)), [], best(score)
    for i in range(n):
        rest = rows[i + 1 :]
        for c in columns:
            others = [x for x in columns if x != c]
            if abs(score[i, c] + best(score[np.ix_(rest, others)]) - total) < 1e-9:
                out.append(c)
                columns, total = others, total - score[i, c]
                break
    return out


def align(table: np.ndarray) -> list[int | None]:
    """New label (from 1) of each row label of a contingency table with the reference in
    columns; None where the matched cell is empty."""
    found = assignment(table)
    return [c + 1 if table[i, c] > 0 else None for i, c in enumerate(found)]


def squares(columns: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distances, a row for each centre; ``columns`` has a row for each column."""
    return np.array([sum((v - m) ** 2 for v, m in zip(columns, c, strict=True)) for c in centre])


def nearest(columns: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Number of the nearest centre (the first of equals) of each point; few rows at a time
    keep what is allocated below the size that the system gives back each time."""
    best = sum((v - m) ** 2 for v, m in zip(columns, centre[0], strict=True))
    out = np.zeros(len(best), int)
    for c in range(1, len(centre)):
        d = sum((v - m) ** 2 for v, m in zip(columns, centre[c], strict=True))
        out[d < best] = c
        np.minimum(best, d, out=best)
    return out


def _refine(columns: np.ndarray, label: np.ndarray, centre: np.ndarray) -> None:
    """Moves single points, in their order, while that lowers the sum of squares. Points
    are looked at in runs that end with the first to be moved, so the moves are those of
    one point after the other."""
    k, total = len(centre), len(label)
    moved = True
    while moved:
        moved = False
        n = np.bincount(label, minlength=k).astype(float)
        i, run = 0, 4096
        while i < total:
            own = label[i : i + run]
            at = np.arange(len(own))
            d = squares(columns[:, i : i + run], centre)
            gain = (n / (n + 1))[:, None] * d
            gain[own, at] = (n / np.maximum(n - 1, 1))[own] * d[own, at]
            to = np.argmin(gain, 0)
            hit = (to != own) & (gain[to, at] < gain[own, at] - 1e-12) & (n[own] > 1)
            f = int(np.argmax(hit))
            if not hit[f]:
                i, run = i + len(own), min(2 * run, 8192)
                continue
            x, old, new = columns[:, i + f], own[f], to[f]
            centre[old] -= (x - centre[old]) / (n[old] - 1)
            centre[new] += (x - centre[new]) / (n[new] + 1)
            n[old] -= 1
            n[new] += 1
            label[i + f], moved = new, True
            i, run = i + f + 1, min(max(64, 2 * f), 8192)


def kmeans(x: np.ndarray, k: int, seed: int, starts: int = 50, iterations: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Best of several Lloyd runs, refined by single-point moves that lower the sum of
    squares: labels from 1 by first appearance, and centres in that order."""
    r = np.random.default_rng(seed)
    best = (np.inf, None)
    columns, block = np.ascontiguousarray(x.T), 8192
    for _ in range(starts):
        centre = x[r.choice(len(x), k, replace=False)].copy()
        label = np.full(len(x), -1)
        for _ in range(iterations):
            same, n, total = True, np.zeros(k), np.zeros((len(columns), k))
            for i in range(0, len(x), block):
                part = columns[:, i : i + block]
                new = nearest(part, centre)
                same = same and bool((new == label[i : i + block]).all())
                label[i : i + block] = new
                n += np.bincount(new, minlength=k)
                for row, v in zip(total, part, strict=True):
                    row += np.bincount(new, v, k)
            if same:
                break
            centre = np.where(n[:, None] > 0, total.T / np.maximum(n, 1)[:, None], centre)
        _refine(columns, label, centre)
        loss = sum(((x[label == c] - centre[c]) ** 2).sum() for c in range(k))
        if loss < best[0] - 1e-12:
            best = (loss, label.copy())
    label = _first_appearance(best[1])
    return label, np.array([x[label == c].mean(0) if (label == c).any() else np.full(x.shape[1], np.nan) for c in range(1, k + 1)])


def gaussian_mixture(x: np.ndarray, k: int, seed: int, models: tuple[str, ...] = ("spherical", "diagonal", "full"), iterations: int = 200):
    """EM for each covariance model, the best by BIC: (labels, model, bic).

    Starts from k-means. The covariance models are a documented subset of those that
    model-based clustering packages offer. Rows are passed in blocks."""
    n, p = x.shape
    start, _ = kmeans(x, k, seed, starts=5)
    blocks = [slice(i, i + 4096) for i in range(0, n, 4096)]
    best = None
    for model in models:
        z = np.eye(k)[start - 1]
        value = -np.inf
        for _ in range(iterations):
            w = z.sum(0) + 1e-12
            mean = (z.T @ x) / w[:, None]
            spread = np.zeros((k, p, p))
            for b in blocks:
                for c in range(k):
                    e = x[b] - mean[c]
                    spread[c] += (z[b, c, None] * e).T @ e
            white, level = [], []
            for c in range(k):
                s = spread[c] / w[c]
                if model == "spherical":
                    s = np.eye(p) * np.trace(s) / p
                elif model == "diagonal":
                    s = np.diag(np.diag(s))
                f = np.linalg.cholesky(s + 1e-6 * np.eye(p))
                white.append(np.linalg.inv(f).T)
                level.append(np.log(w[c] / n) - np.log(np.diag(f)).sum() - 0.5 * p * np.log(2 * np.pi))
            whole = 0.0
            for b in blocks:
                log = np.array([level[c] - 0.5 * (((x[b] - mean[c]) @ white[c]) ** 2).sum(1) for c in range(k)])
                top = log.max(0)
                total = top + np.log(np.exp(log - top).sum(0))
                z[b] = np.exp(log - total).T
                whole += total.sum()
            if abs(whole - value) < 1e-8 * (1 + abs(value)):
                break
            value = whole
        free = k - 1 + k * p + {"spherical": k, "diagonal": k * p, "full": k * p * (p + 1) // 2}[model]
        bic = 2 * value - free * np.log(n)
        if best is None or bic > best[2]:
            best = (_first_appearance(z.argmax(1)), model, float(bic))
    return best


def sample_seed(seed: int, key: str) -> int:
    """A seed for one task from the run's seed and the task's key."""
    return int((seed + sum(ord(c) * ((i % 104729) + 1) for i, c in enumerate(key, 1))) % (2**31 - 2) + 1)


def train_map(layers: list[np.ndarray], weights: list[float], unit_distance: np.ndarray, steps: int, seed: int, kind: str = "gaussian") -> list[np.ndarray]:
    """Batch-trained codebooks, one per layer. Starts from random training rows; the
    radius falls linearly to 0 from the value that covers two thirds of the unit
    distances; a unit becomes the neighbourhood-weighted mean of the rows, missing
    values skipped."""
    r = np.random.default_rng(seed)
    n, units = len(layers[0]), len(unit_distance)
    picked = r.choice(n, units, replace=False)
    # a start row's gaps take the column's mean
    codes = [np.where(np.isnan(x[picked]), np.nan_to_num(np.nanmean(x, 0)), x[picked]) for x in layers]
    start = float(np.quantile(unit_distance, 2 / 3))
    for step in range(steps):
        radius = start * (1 - step / steps)
        best = np.argmin(map_distance(layers, codes, weights), 1)
        h = (unit_distance <= max(radius, 0.5)).astype(float) if kind == "bubble" else np.exp(-(unit_distance**2) / (2 * max(radius, 0.1) ** 2))
        for x, c in zip(layers, codes, strict=True):
            seen = ~np.isnan(x)
            top, bottom = np.zeros_like(c), np.zeros_like(c)
            np.add.at(top, best, np.where(seen, x, 0))
            np.add.at(bottom, best, seen.astype(float))
            top, bottom = h @ top, h @ bottom
            np.divide(top, bottom, out=c, where=bottom > 1e-12)
    return codes


def map_distance(layers: list[np.ndarray], codes: list[np.ndarray], weights: list[float]) -> np.ndarray:
    """Weighted mean over layers of the squared distances, each scaled up for missing
    values; NaN where a row has no value at all."""
    total, used = 0.0, 0.0
    for x, c, w in zip(layers, codes, weights, strict=True):
        seen = ~np.isnan(x)
        n = seen.sum(1)
        d = ((np.nan_to_num(x)[:, None, :] - c[None]) ** 2 * seen[:, None, :]).sum(2)
        has = (n > 0)[:, None]
        total = total + np.where(has, w * d * x.shape[1] / np.maximum(n, 1)[:, None], 0)
        used = used + np.where(has, w, 0.0)
    return np.where(used > 0, total / np.where(used > 0, used, 1), np.nan)


def subsets(n: int) -> list[tuple[int, int]]:
    """All pairs i < j, the first varying slowest."""
    return list(itertools.combinations(range(n), 2))
