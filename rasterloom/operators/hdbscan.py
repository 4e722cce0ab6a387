"""Density-based clustering of one bounded sample, and prediction of any number of points from it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..errors import FlowError


@dataclass
class Fitted:
    points: np.ndarray
    core: np.ndarray
    labels: np.ndarray
    probabilities: np.ndarray
    min_samples: int
    home: np.ndarray  # the condensed cluster each point leaves
    leaves_at: np.ndarray  # and the density at which it does
    parent: np.ndarray  # of each condensed cluster, -1 for the root
    born_at: np.ndarray
    chosen: np.ndarray  # label of each condensed cluster, -1 where not selected
    peak: np.ndarray  # largest density in each selected cluster

    @property
    def n_clusters(self) -> int:
        return int(self.labels.max(initial=-1)) + 1


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def core_distances(x: np.ndarray, k: int, cells: int = 1 << 23) -> np.ndarray:
    """Distance to the k-th nearest point, the point itself counting as the first; about ``cells`` distances at a time."""
    k, chunk = min(k, len(x)) - 1, max(1, min(1024, cells // max(len(x), 1)))
    return np.concatenate([np.partition(_distances(x[i : i + chunk], x), k, axis=1)[:, k] for i in range(0, len(x), chunk)])


def fit(x: np.ndarray, min_cluster_size: int, min_samples: int = 0, most_points: int | None = None) -> Fitted:
    """Mutual-reachability spanning tree, condensed tree, excess-of-mass selection without the root.

    Exact for any number of points: memory grows with the points, time with their square.
    A caller that cannot wait sets ``most_points``, above which the fit is refused.
    """
    x = np.asarray(x, dtype=np.float64)
    n, k = len(x), min_samples or min_cluster_size
    if most_points is not None and n > most_points:
        raise FlowError(f"a fit of {n} points in one task is refused (limit {most_points}); set subsample_n")
    nothing = Fitted(x, np.zeros(n), np.full(n, -1), np.zeros(n), k, np.zeros(n, int), np.zeros(n), np.array([-1]), np.zeros(1), np.array([-1]), np.zeros(1))
    if n < max(2, min_cluster_size):
        return nothing
    core = core_distances(x, k)
    # Prim: the row of the point just taken is the only one in memory; taken points are swept out at each halving.
    ids, xs, cs = np.arange(n), x, core
    left, near, best = np.ones(n, dtype=bool), np.zeros(n, dtype=int), np.full(n, np.inf)
    at, edges, swept = 0, np.zeros((n - 1, 3)), n
    for i in range(n - 1):
        left[at] = False
        here, x_here, core_here = ids[at], xs[at], cs[at]
        if n - 1 - i <= swept // 2:
            ids, xs, cs, near, best = ids[left], xs[left], cs[left], near[left], best[left]
            left = np.ones(len(ids), dtype=bool)
            swept = len(ids)
        d = np.maximum(np.maximum(np.sqrt(((xs - x_here) ** 2).sum(1)), cs), core_here)
        closer = left & (d < best)
        best[closer], near[closer] = d[closer], here
        at = int(np.where(left, best, np.inf).argmin())
        edges[i] = near[at], ids[at], best[at]
    edges = edges[np.argsort(edges[:, 2], kind="stable")]
    # Single linkage: node n + i joins two nodes at height[i].
    up, size = np.arange(2 * n - 1), np.concatenate([np.ones(n, int), np.zeros(n - 1, int)])
    kids, height = np.zeros((n - 1, 2), int), edges[:, 2]

    def top(v):
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    for i, (a, b, _) in enumerate(edges):
        a, b = top(int(a)), top(int(b))
        kids[i], size[n + i] = (a, b), size[a] + size[b]
        up[a] = up[b] = n + i

    def points_under(node):
        out, stack = [], [node]
        while stack:
            v = stack.pop()
            if v < n:
                out.append(v)
            else:
                stack += kids[v - n].tolist()
        return out

    parent, born, mass = [-1], [0.0], [0.0]
    home, leaves = np.zeros(n, int), np.zeros(n)
    stack = [(2 * n - 2, 0)]
    while stack:
        node, cluster = stack.pop()
        if node < n:
            home[node], leaves[node] = cluster, np.inf
            continue
        density = 1 / height[node - n] if height[node - n] > 0 else np.inf
        big = [v for v in kids[node - n].tolist() if size[v] >= min_cluster_size]
        for v in kids[node - n].tolist():
            if len(big) == 2:
                parent.append(cluster)
                born.append(density)
                mass.append(0.0)
                stack.append((v, len(parent) - 1))
            elif v in big:
                stack.append((v, cluster))
            else:
                under = points_under(v)
                home[under], leaves[under] = cluster, density
    parent, born = np.array(parent), np.array(born)
    inside = np.bincount(home, minlength=len(parent))
    finite = np.where(np.isfinite(leaves), leaves, np.max(leaves[np.isfinite(leaves)], initial=1.0))
    mass = np.bincount(home, weights=finite - np.minimum(born[home], finite), minlength=len(parent))
    total = inside.astype(float)
    for c in range(len(parent) - 1, 0, -1):  # children have larger numbers
        total[parent[c]] += total[c]
    for c in range(1, len(parent)):
        span = min(born[c], finite.max()) - min(born[parent[c]], finite.max())
        mass[parent[c]] += total[c] * max(0.0, span)
    pick, value = np.zeros(len(parent), dtype=bool), mass.copy()
    for c in range(len(parent) - 1, 0, -1):
        below = value[parent == c].sum()
        pick[c] = mass[c] >= below or not (parent == c).any()
        value[c] = max(mass[c], below)
    chosen = np.full(len(parent), -1)
    for c in range(1, len(parent)):
        above = parent[c]
        while above > 0 and not pick[above]:
            above = parent[above]
        pick[c] &= above <= 0
    chosen[pick] = np.arange(pick.sum())
    owner = np.full(len(parent), -1)
    for c in range(1, len(parent)):
        owner[c] = c if pick[c] else owner[parent[c]]
    labels = np.where(owner[home] >= 0, chosen[owner[home]], -1)
    peak = np.zeros(len(parent))
    some = labels >= 0
    np.maximum.at(peak, owner[home][some], finite[some])
    prob = np.zeros(n)
    prob[some] = np.where(peak[owner[home][some]] > 0, np.minimum(finite[some] / np.maximum(peak[owner[home][some]], 1e-300), 1), 1)
    return Fitted(x, core, labels, prob, k, home, finite, parent, born, np.where(owner >= 0, chosen[np.maximum(owner, 0)], -1), peak[np.maximum(owner, 0)])


def predict(m: Fitted, x: np.ndarray, chunk: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Label and probability of each point: its nearest fitted point by mutual reachability, up the condensed tree."""
    labels, prob = np.full(len(x), -1), np.zeros(len(x))
    if not len(m.points) or m.n_clusters == 0:
        return labels, prob
    k = min(2 * m.min_samples, len(m.points))
    for lo in range(0, len(x), chunk):
        d = _distances(np.asarray(x[lo : lo + chunk], dtype=np.float64), m.points)
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        dn = np.take_along_axis(d, near, 1)
        own = np.partition(dn, min(m.min_samples, k) - 1, axis=1)[:, min(m.min_samples, k) - 1]
        reach = np.maximum(np.maximum(dn, m.core[near]), own[:, None])
        best = reach.argmin(axis=1)
        j, r = near[np.arange(len(near)), best], reach[np.arange(len(near)), best]
        density = np.where(r > 0, 1 / np.maximum(r, 1e-300), np.inf)
        cluster = m.home[j].copy()
        while True:
            rise = (m.born_at[cluster] > density) & (m.parent[cluster] >= 0)
            if not rise.any():
                break
            cluster[rise] = m.parent[cluster[rise]]
        labels[lo : lo + chunk] = m.chosen[cluster]
        ok = m.chosen[cluster] >= 0
        prob[lo : lo + chunk] = np.where(ok, np.minimum(density, np.maximum(m.peak[cluster], 1e-300)) / np.maximum(m.peak[cluster], 1e-300), 0)
    return labels, prob
