"""Exact percentiles and bootstrap intervals of groups of any size."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeweave.operators.scale import dense_index
from placeweave.session import cut_lineage, stored

#: Bins of a round of narrowing, and the rows that may be left in a range when it is sorted.
BINS = 1024
SORTED_ROWS = 50_000
#: Units of a block of the bootstrap's tree.
UNIT_BLOCK = 1024


def nearest_rank(values: DataFrame, by: Sequence[str], column: str, shares: Sequence[float]) -> DataFrame:
    """``by, share, value, n``: the value of rank ``ceil(share * n)`` in its group (the first at least); nulls and NaN take no part.

    The range that holds the rank is narrowed by histograms: the rows of a range are counted in bins, the bin with the rank becomes the range,
    until few enough rows are left to be sorted. A group of any size sends bin counts only."""
    by = list(by)
    rows = values.select(*by, F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    rows = cut_lineage(rows)
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    share = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    # Ranges are written, so that Spark knows their size when it plans the joins with the rows.
    ranges = stored(sizes.select("*", share).withColumns({
        "rank": F.greatest(F.ceil(F.col("share") * F.col("n")), F.lit(1)), "held": F.col("n")}))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"g.{c}")) for c in by]

    def inside(groups: DataFrame) -> DataFrame:
        on = (F.col("r.v") >= F.col("g.lo")) & (F.col("r.v") <= F.col("g.hi"))
        for s in same:
            on = on & s
        return rows.alias("r").join(groups.alias("g"), on).select("g.*", "r.v")

    key = [*by, "share"]
    done = None
    while True:
        open_ranges = (F.col("held") > SORTED_ROWS) & (F.col("lo") < F.col("hi"))
        settled = ranges.filter(~open_ranges)
        done = settled if done is None else done.unionByName(settled)
        ranges = stored(ranges.filter(open_ranges))
        if ranges.isEmpty():
            break
        # Halves are subtracted, so the width of a range of any size is finite.
        width = F.col("hi") / 2 - F.col("lo") / 2
        bin_no = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / width * BINS), F.lit(BINS - 1)).cast("int")
        counted = inside(ranges).groupBy(*key, "n", "rank", bin_no.alias("bin")).agg(
            F.count(F.lit(1)).alias("held"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.sum("held").over(Window.partitionBy(*key).orderBy("bin")) - F.col("held")
        ranges = stored(counted.withColumn("_before", before).filter(
            (F.col("_before") < F.col("rank")) & (F.col("rank") <= F.col("_before") + F.col("held"))).withColumn(
            "rank", F.col("rank") - F.col("_before")).select(*by, "n", "lo", "hi", "share", "rank", "held"))
    done = stored(done)
    single = done.filter("lo = hi").select(*key, F.col("lo").alias("value"), "n")
    place = F.row_number().over(Window.partitionBy(*key).orderBy("v"))
    sorted_rows = inside(done.filter("lo < hi")).withColumn("_place", place).filter(F.col("_place") == F.col("rank"))
    return single.unionByName(sorted_rows.select(*key, F.col("v").alias("value"), "n"))


# Bootstrap --------------------------------------------------------------------------------------------------------------


def _log_factorials(most: int) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, most + 1, dtype=float)))])


_TABLE = _log_factorials(1 << 16)


def _log_factorial(n: np.ndarray) -> np.ndarray:
    """From a table for small numbers, by Stirling's series beyond."""
    x = np.maximum(n, 1).astype(float)
    series = x * np.log(x) - x + 0.5 * np.log(2 * np.pi * x) + 1 / (12 * x) - 1 / (360 * x ** 3)
    return np.where(n < len(_TABLE), _TABLE[np.minimum(n, len(_TABLE) - 1)], series)


def binomial(draws: np.ndarray, share: float, uniform: np.ndarray) -> np.ndarray:
    """The number of ``draws`` that fall in a part of the given share: the smallest count whose distribution function reaches ``uniform``.

    Sums run over twelve standard deviations about the mean; what lies beyond is less than 1e-30."""
    out = np.zeros(len(draws), np.int64)
    for m in np.unique(draws):
        at = draws == m
        if m == 0 or share >= 1.0:
            out[at] = m if share >= 1.0 else 0
            continue
        reach = 12 * np.sqrt(m * share * (1 - share)) + 12
        low, high = max(0, int(m * share - reach)), min(int(m), int(m * share + reach) + 1)
        k = np.arange(low, high + 1)
        logs = _log_factorial(np.array([m]))[0] - _log_factorial(k) - _log_factorial(m - k) + k * np.log(share) + (m - k) * np.log1p(-share)
        out[at] = np.minimum(low + np.searchsorted(np.cumsum(np.exp(logs)), uniform[at]), high)
    return out


def _uniform(seed: int, resamples: int, low: int, high: int) -> np.ndarray:
    """A number in [0, 1) for each resample at a node of the tree."""
    text = [hashlib.md5(f"{seed}:{r}:{low}:{high}".encode()).hexdigest()[:13] for r in range(resamples)]
    return np.array([int(t, 16) for t in text], float) / float(1 << 52)


def block_counts(n: int, block: int, resamples: int, seed: int, size: int) -> np.ndarray:
    """How often each unit of a block is drawn in each resample (rows: resamples). The ``n`` draws among ``n`` units go down a binary tree, by a
    conditional binomial at every node; a block follows the path from the root to itself and the nodes below, so no draw leaves its task."""
    first, last = block * size, min(n, (block + 1) * size)
    counts = np.zeros((resamples, last - first), np.int64)
    nodes = [(0, n, np.full(resamples, n, np.int64))]
    while nodes:
        low, high, drawn = nodes.pop()
        if high <= first or low >= last:
            continue
        if high - low == 1:
            counts[:, low - first] = drawn
            continue
        middle = (low + high) // 2
        left = binomial(drawn, (middle - low) / (high - low), _uniform(seed, resamples, low, high))
        nodes += [(low, middle, left), (middle, high, drawn - left)]
    return counts


def paired_bootstrap(diffs: DataFrame, keys: Sequence[str], unit: str, resamples: int = 2000, seed: int = 0) -> DataFrame:
    """``keys, n, mean_diff, low, high``: the mean paired difference of each group with its 95% percentile interval.

    Units are drawn with replacement; groups of equally many units share draws. A task holds one block of units with its counts in all resamples
    and sends one sum a resample, so neither draws nor units travel."""
    keys, size = list(keys), UNIT_BLOCK
    numbered = dense_index(diffs.select(*keys, unit, "diff"), keys, unit, "_idx")
    sizes = cut_lineage(diffs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("diff").alias("mean_diff")))
    units = numbered.join(sizes.select(*keys, "n"), keys).withColumn("_block", F.floor(F.col("_idx") / size))
    types = {f.name: f.dataType.simpleString() for f in units.schema}

    def sums(frame: pd.DataFrame) -> pd.DataFrame:
        one = frame.iloc[0]
        counts = block_counts(int(one["n"]), int(one["_block"]), resamples, seed, size)
        total = counts[:, frame["_idx"].to_numpy() - int(one["_block"]) * size] @ frame["diff"].to_numpy(float)
        return pd.DataFrame({**{k: [one[k]] * resamples for k in keys}, "n": int(one["n"]), "_r": np.arange(resamples), "_sum": total})

    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], "n long", "_r int", "_sum double"])
    means = units.groupBy(*keys, "n", "_block").applyInPandas(sums, schema).groupBy(*keys, "n", "_r").agg(
        (F.sum("_sum") / F.col("n")).alias("_mean"))
    spread = means.withColumn("_pos", F.row_number().over(Window.partitionBy(*keys).orderBy("_mean", "_r")) - 1)

    def bound(pos: int) -> Column:
        return F.max(F.when(F.col("_pos") == pos, F.col("_mean")))

    bounds = spread.groupBy(*keys).agg(bound(int(0.025 * resamples)).alias("low"), bound(int(0.975 * resamples) - 1).alias("high"))
    return sizes.join(bounds, keys)
