"""The density fit at any number of points."""

import numpy as np

from rasterloom.operators import hdbscan


def test_more_points_than_the_old_limit_are_taken():
    x = np.zeros((60_001, 2))
    assert (hdbscan.fit(x, min_cluster_size=70_000).labels == -1).all()


def test_blocks_and_sweeps_change_nothing():
    x = np.concatenate([np.random.default_rng(i).normal(4 * i, 0.5, (150, 3)) for i in range(3)])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, 9]
    assert np.allclose(hdbscan.core_distances(x, 10, cells=1000), core, atol=1e-6)
    m = hdbscan.fit(x, 30, 10)
    truth = np.repeat(np.arange(3), 150)
    assert m.n_clusters == 3
    assert all(len(set(truth[m.labels == c])) == 1 for c in range(3)) and (m.labels >= 0).mean() > 0.8
