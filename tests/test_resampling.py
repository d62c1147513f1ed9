"""Nearest-rank percentiles and the bootstrap's tree against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest

from placeweave.operators import resampling as N
from placeweave.operators.scale import dense_index


@pytest.mark.parametrize("limit,bins", [(50_000, 1024), (5, 4), (0, 2)])
def test_nearest_rank(spark, monkeypatch, limit, bins):
    monkeypatch.setattr(N, "SORTED_ROWS", limit)
    monkeypatch.setattr(N, "BINS", bins)
    rng = random.Random(1)
    rows = [("a", rng.random()) for _ in range(301)] + [("b", float(rng.randrange(5))) for _ in range(100)] + [("c", 7.0)] * 40 + [("d", None), ("d", float("nan"))]
    rows += [(None, 2.0 ** e * (-1) ** e) for e in range(-300, 300, 7)] + [("e", -1.7e308), ("e", 1.7e308), ("e", 0.0)]
    got = {(r.g, r.share): (r.value, r.n) for r in N.nearest_rank(spark.createDataFrame(rows, "g string, x double").repartition(5), ["g"], "x", (0.01, 0.5, 0.95, 1.0)).collect()}
    want = {}
    for g in {r[0] for r in rows} - {"d"}:
        ordered = sorted(x for k, x in rows if k == g)
        for p in (0.01, 0.5, 0.95, 1.0):
            want[g, p] = (ordered[max(0, math.ceil(p * len(ordered)) - 1)], len(ordered))
    assert got == want
    assert N.nearest_rank(spark.createDataFrame([], "g string, x double"), ["g"], "x", (0.5,)).count() == 0


def test_known_percentiles(spark):
    frame = spark.createDataFrame([(float(x),) for x in (5, 1, 4, 2, 3)], "x double")
    assert {r.share: r.value for r in N.nearest_rank(frame, [], "x", (0.5, 0.95)).collect()} == {0.5: 3.0, 0.95: 5.0}


def test_binomial_counts_follow_their_distribution():
    u = (np.arange(20_000) + 0.5) / 20_000
    for m, p in ((1, 0.5), (10, 0.3), (1000, 0.5), (10 ** 9, 0.25)):
        got = N.binomial(np.full(len(u), m), p, u)
        assert abs(got.mean() - m * p) < 0.02 * math.sqrt(m * p * (1 - p)) + 1e-3 and abs(got.var() / (m * p * (1 - p)) - 1) < 0.02
        assert (np.diff(got) >= 0).all() and got.min() >= 0 and got.max() <= m
    assert list(N.binomial(np.array([0, 3, 3]), 1.0, np.array([0.1, 0.2, 0.9]))) == [0, 3, 3]


def test_blocks_are_parts_of_one_draw():
    counts = np.concatenate([N.block_counts(29, b, 200, 3, 8) for b in range(4)], 1)
    assert counts.shape == (200, 29) and (counts.sum(1) == 29).all() and abs(counts.var() - 1) < 0.1
    assert (N.block_counts(29, 0, 200, 3, 64) == counts).all()


def test_bootstrap_detects_a_gain_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(N, "UNIT_BLOCK", 16)
    rows = [("same", i, 0.0) for i in range(40)] + [("gain", i, 0.1 + 0.01 * (i % 5)) for i in range(40)] + [("mixed", i, (-1.0) ** i) for i in range(50)]
    frame = spark.createDataFrame(rows, "g string, q int, diff double").repartition(4)
    one, other = ({r.g: tuple(r) for r in N.paired_bootstrap(frame, ["g"], "q", 400).collect()} for _ in range(2))
    assert one == other and one["same"][1:] == (40, 0.0, 0.0, 0.0)
    assert one["gain"][3] > 0.1 and one["mixed"][3] < 0 < one["mixed"][4]
    numbers = {r.q: r.i for r in dense_index(frame.filter("g = 'mixed'"), [], "q", "i").collect()}
    diffs = np.zeros(50)
    for q, i in numbers.items():
        diffs[i] = (-1.0) ** q
    means = np.sort(np.concatenate([N.block_counts(50, b, 400, 0, 16) for b in range(4)], 1) @ diffs / 50)
    assert np.allclose(one["mixed"][3:], (means[10], means[389]))


def test_numbers_do_not_depend_on_the_ranges(spark, monkeypatch):
    frame = spark.createDataFrame([(i % 3, f"k{i}") for i in range(200)], "g int, k string")
    want = {}
    for g in range(3):
        keys = sorted((f"k{i}" for i in range(200) if i % 3 == g), key=lambda k: (int(hashlib.md5(k.encode()).hexdigest()[:7], 16), k))
        want |= {k: n for n, k in enumerate(keys)}
    for rows in (100_000, 7):
        monkeypatch.setattr("placeweave.operators.scale.NUMBERED_ROWS", rows)
        assert {r.k: r.n for r in dense_index(frame, ["g"], "k", "n").collect()} == want
