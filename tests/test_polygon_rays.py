"""Points in rings of many edges: against each edge one by one, and without comparing each with each."""

import time

import numpy as np

from placeweave.operators import labels


def _one_by_one(lat, lon, lat1, lon1, lat2, lon2):
    with np.errstate(all="ignore"):
        return [int((((lat1 > y) != (lat2 > y)) & (x < lon1 + (y - lat1) / (lat2 - lat1) * (lon2 - lon1))).sum()) for y, x in zip(lat, lon, strict=True)]


def test_rays_cross_the_edges_that_each_alone_says():
    rng = np.random.default_rng(3)
    for digits, flat, n, m in ((16, 1.0, 1, 1), (2, 1.0, 600, 900), (16, 1e-3, 600, 2000), (3, 1.0, 900, 1500)):
        lat, lon, at, on = (np.round(rng.random(k) * scale, digits) for k, scale in ((n, 1.0), (n, flat), (m, 1.0), (m, flat)))
        edges = (at, on, np.roll(at, -1), np.roll(on, -1))
        assert labels._rays_crossed(lat, lon, *edges).tolist() == _one_by_one(lat, lon, *edges)


def test_a_band_of_many_points_and_edges_takes_seconds():
    """20,000 points and 60,000 edges are 1.2 billion pairs."""
    rng = np.random.default_rng(4)
    lat, lon, at, on = 0.5 + 0.01 * rng.random(20_000), rng.random(20_000), rng.random(60_000), rng.random(60_000)
    began = time.process_time()
    labels._rays_crossed(lat, lon, at, on, np.roll(at, -1), np.roll(on, -1))
    assert time.process_time() - began < 10
