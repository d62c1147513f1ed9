import math
import random

import numpy as np
from fixtures import SF, by_row
from pyspark.sql import functions as F

from placeweave.llm import bond_negatives as B
from placeweave.llm import queries

SCHEMA = "vec_id long, label int, embedding array<double>, row long, home string, anchor int, cell string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "h", 2, "c") for r in rows], SCHEMA).repartition(3)


def brute(rows, every=50, positives=5, negatives=3, low=50, high=95):
    good = []
    for n, (i, label, v) in enumerate(rows):
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((n, i, label, [math.floor(256 * x) for x in v]))
    out = []
    for n, i, label, v in good:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, m, other) for m, j, other, w in good if len(w) == len(v) and m != n]
        near = sorted(s for s in scored if s[3] == label)[:positives]
        for p, pid, _, _ in near:
            fit = sorted(s for s in scored if s[3] != label and low * -p <= 100 * -s[0] <= high * -p)[:negatives]
            out += [(i, pid, rank, j, -p, -s) for rank, (s, j, _, _) in enumerate(fit, 1)]
    return by_row(out)


def result(df):
    return by_row(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def clustered(n, dim, seed, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.1, (labels, dim))
    return [(i, i % labels, (centres[i % (labels - 1)] + rng.normal(0, 0.05, dim)).tolist()) for i in range(n)]


def hard_rows():
    rows = clustered(300, 12, 1)
    rows += [(1000 + i, 2, [0.5] * 12) for i in range(40)] + [(2000 + 50 * i, 1, [0.5] * 12) for i in range(4)]  # ties
    rows += [(50, 1, [0.1] * 12), (50, 1, [0.1] * 12), (100, 3, [-0.2] * 12), (7, 0, [0.3] * 12)]  # repeated ids
    rows += [(3000, None, [0.1] * 12), (3050, 1, None), (3100, 1, [0.1] * 11 + [None]), (3150, 1, [float("nan")] * 12), (3200, 1, [float("inf")] * 12),
             (None, 1, [0.1] * 12), (3250, 1, []), (3300, 9, [0.2] * 12), (3350, 1, [0.0] * 12)]
    rows += [(3400 + i, i % 2, [0.1 * i, -0.3, 0.2]) for i in range(20)]  # another length
    return rows


def test_negatives_against_brute_force(spark):
    rows = hard_rows()
    got = B.hard_negatives(frame(spark, rows), F.col("vec_id") % 50 == 0)
    assert result(got) == brute(rows)
    assert B.hard_negatives(frame(spark, rows).limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_many_cells_give_the_same_rows(spark, monkeypatch):
    for name, size in (("SHARD_ROWS", 16), ("SHARDS_A_CELL", 2), ("ANCHORS_A_CELL", 4), ("STEP", 3)):
        monkeypatch.setattr(B, name, size)
    rows = hard_rows()
    assert result(B.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, 3, 2, 20, 110)) == brute(rows, 10, 3, 2, 20, 110)


def test_components_beyond_doubles_that_add_exactly(spark):
    rng = random.Random(2)
    rows = [(i, i % 3, [rng.uniform(-1, 1) * 2.0 ** 22 for _ in range(6)]) for i in range(120)]
    assert result(B.hard_negatives(frame(spark, rows), F.col("vec_id") % 50 == 0)) == brute(rows)


def test_bounds_hold_and_shrink_the_bitmap():
    rng = np.random.default_rng(4)
    columns = np.floor(256 * rng.normal(0, 0.2, (32, 500)))
    columns[:, :3] *= 5
    shard = B.Shard(columns, np.arange(500), np.zeros(500, int), np.arange(500))
    anchor = np.floor(256 * rng.normal(0, 0.2, 32) * np.geomspace(4, 0.05, 32))
    scores, sizes = anchor @ columns, []
    left = np.arange(500)

    def keep(lower, upper):
        nonlocal left
        assert (lower <= scores[left]).all() and (scores[left] <= upper).all()
        stays = upper >= np.sort(lower)[-5]
        sizes.append(len(lower))
        left = left[stays]
        return stays

    rows, found = B.bond(anchor, shard, np.ones(500, bool), keep)
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] < 250
    assert set(np.argsort(-scores)[:5]) <= set(rows) and (found == scores[rows]).all()


def test_whole_table(spark):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding)
            for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert result(queries.op13_bond_negatives(spark, SF)) == brute(rows)
