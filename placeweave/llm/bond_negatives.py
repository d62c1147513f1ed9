"""Hard negatives by BOND: a vertical scan over columnar vectors with shrinking candidate bitmaps.

Vectors become integers, ``floor(256 * x)``, and are packed by label into shards of about ``SHARD_ROWS`` rows, a column of numbers
per dimension with its smallest and largest value. An anchor reads the dimensions in the order of its own descending magnitudes,
``STEP`` at a time. What the unread dimensions can still add lies between the sums of the smaller and of the larger of
``anchor x smallest`` and ``anchor x largest``, so every candidate has a lower and an upper bound, and the bitmap loses those that
cannot be in the answer; when all dimensions are read the bounds are the scores.

1. Positives: the best rows of the anchor's label. A candidate goes when its upper bound is below the kth lower bound.
2. Negatives: for each positive a window of allowed scores. A candidate goes when its bounds miss all windows, or when enough others
   surely lie in the window above it.

The kth score found in a shard is carried to the next ones of the same cell. A cell is a group of anchors and a group of shards;
anchors are held, shards stream by. Every shard goes to each group of anchors once and every anchor to each group of shards: some
2 MB are shuffled for ``ANCHORS_A_CELL x SHARDS_A_CELL`` scans, which take seconds. Positives only meet shards of their own label;
labels with few rows share shards.

Defined results: a row with a null id, label or vector, or with an empty vector or a null or non-finite component takes no part;
vectors of different lengths are not compared; equal scores go to the smaller id; a repeated row is another row, as anchor,
positive and negative; an anchor without positives, and a positive whose window holds nothing (always so below zero), give no row;
scores beyond 64 bits are cut to their ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeweave.llm.host_words import meet
from placeweave.session import cut_lineage

SHARD_ROWS = 4096
SHARDS_A_CELL = 4
ANCHORS_A_CELL = 1024
STEP = 16
_EXACT = float(1 << 53)
_LONG = (-2 ** 63, 2 ** 63 - 1)

Keep = Callable[[np.ndarray, np.ndarray], np.ndarray]


class Shard:
    """Rows of a shard by dimension: ``columns[d]`` are all rows' numbers of dimension d."""

    def __init__(self, columns: np.ndarray, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
        self.columns, self.ids, self.labels, self.rows = columns, ids, labels, rows
        self.low, self.high = columns.min(1), columns.max(1)
        self.largest = max(abs(self.low.min()), abs(self.high.max()))

    def exact_for(self, anchor: np.ndarray) -> tuple[Shard, np.ndarray]:
        """Both as they are where doubles add up exactly, else as Python integers."""
        if float(np.abs(anchor).max()) * float(self.largest) * len(anchor) < _EXACT:
            return self, anchor
        whole = np.frompyfunc(int, 1, 1)
        return Shard(whole(self.columns), self.ids, self.labels, self.rows), whole(anchor)


def bond(anchor: np.ndarray, shard: Shard, alive: np.ndarray, keep: Keep) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the shard, their scores) of the bitmap ``alive`` that ``keep(lower, upper)`` never gave up."""
    order = np.argsort(-np.abs(anchor.astype(float)), kind="stable")
    ends = np.stack([anchor * shard.low, anchor * shard.high])[:, order]
    least, most = (np.append(np.cumsum(e[::-1])[::-1], 0) for e in (ends.min(0), ends.max(0)))
    rows = np.flatnonzero(alive)
    partial = np.zeros(len(rows), anchor.dtype)
    for read in range(0, len(order), STEP):
        stays = keep(partial + least[read], partial + most[read])
        if not stays.all():
            rows, partial = rows[stays], partial[stays]
        if not len(rows):
            break
        now = order[read:read + STEP]
        columns = shard.columns[now] if len(rows) == shard.columns.shape[1] else shard.columns[np.ix_(now, rows)]
        partial = partial + anchor[now] @ columns
    stays = keep(partial, partial)
    return rows[stays], partial[stays]


def _kth(values: np.ndarray, k: int) -> float:
    return np.partition(values, len(values) - k)[len(values) - k] if values.dtype != object else sorted(values)[-k]


class Best:
    """The k best (score, id, row) seen so far, ties to the smaller id."""

    def __init__(self, k: int) -> None:
        self.k, self.held = k, []

    def add(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        found = zip((-int(s) for s in scores), ids.tolist(), rows.tolist(), strict=True)
        self.held = sorted([*self.held, *found])[:self.k]

    @property
    def floor(self) -> int | None:
        return -self.held[-1][0] if len(self.held) == self.k else None


def _top(anchor: np.ndarray, shard: Shard, alive: np.ndarray, best: Best) -> None:
    """Into ``best`` what the shard has of the highest scores."""
    floor = best.floor

    def keep(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        stays = np.ones(len(lower), bool) if floor is None else upper >= floor
        return stays & (upper >= _kth(lower, best.k)) if len(lower) > best.k else stays

    rows, scores = bond(anchor, shard, alive, keep)
    best.add(scores, shard.ids[rows], shard.rows[rows])


def _within(anchor: np.ndarray, shard: Shard, alive: np.ndarray, windows: list[tuple[int, int]], best: list[Best]) -> None:
    """Into each window's ``best`` what the shard has of its highest scores."""
    floors = [low if b.floor is None else max(low, b.floor) for (low, _), b in zip(windows, best, strict=True)]

    least, most = min(floors), max(high for _, high in windows)

    def keep(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        stays = (upper >= least) & (lower <= most)
        at = np.flatnonzero(stays)
        lower, upper = lower[at], upper[at]
        fits = np.zeros(len(at), bool)
        for (low, high), floor, b in zip(windows, floors, best, strict=True):
            possible = (upper >= floor) & (lower <= high)
            sure = (lower >= low) & (upper <= high)
            if np.count_nonzero(sure) > b.k:
                possible &= upper >= _kth(lower[sure], b.k)
            fits |= possible
        stays[at] = fits
        return stays

    rows, scores = bond(anchor, shard, alive, keep)
    for (low, high), b in zip(windows, best, strict=True):
        inside = (scores >= low) & (scores <= high)
        b.add(scores[inside], shard.ids[rows[inside]], shard.rows[rows[inside]])


# Packing ----------------------------------------------------------------------------------------------------------------


def usable(vectors: DataFrame) -> DataFrame:
    """``row, vec_id, label, v, dim``: integer-valued double components of the rows that take part."""
    # Scaling by 256 is exact; beyond 2^53 a double has no fraction, and floor() would leave the range of a long.
    scaled = F.transform("embedding", lambda x: x.cast("double") * 256.0)
    whole = F.transform(scaled, lambda x: F.when(F.abs(x) < _EXACT, F.floor(x).cast("double")).otherwise(x))
    finite = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    given = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    return vectors.filter(given).filter(finite).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        whole.alias("v"), F.size("embedding").cast("long").alias("dim"))


def placed(rows: DataFrame, is_anchor: Column) -> DataFrame:
    """``rows`` with ``anchor`` and the place of their shard: ``home`` (a frequent label, or a pool of rare ones) and ``bucket``, and the
    numbers of buckets and anchors of the home."""
    marked = rows.withColumn("anchor", is_anchor)
    labels = cut_lineage(marked.groupBy("dim", "label").agg(F.count(F.lit(1)).alias("uses"), F.count_if("anchor").alias("asked")))
    rare = F.col("uses") < SHARD_ROWS
    pools = labels.filter(rare).groupBy("dim").agg(F.ceil(F.sum("uses") / SHARD_ROWS).alias("pools"))
    home = F.struct("dim", F.when(~rare, F.col("label")).alias("label"), F.when(rare, F.pmod(F.xxhash64("label"), F.col("pools"))).alias("pool"))
    housed = labels.join(pools, "dim", "left").withColumn("home", F.xxhash64(home.getField("dim"), rare, F.coalesce(home.getField("label"), home.getField("pool"))))
    sizes = housed.groupBy("home").agg(F.sum("uses").alias("held"), F.sum("asked").alias("asked_here"))
    known = cut_lineage(housed.join(sizes, "home").select(
        F.struct("dim", "label").alias("kind"), "home", "uses", "asked_here", F.greatest(F.ceil(F.col("held") / SHARD_ROWS), F.lit(1)).alias("buckets")))
    return meet(marked.withColumn("kind", F.struct("dim", "label")), known, "kind").drop("kind", "uses").withColumn(
        "bucket", F.pmod(F.xxhash64("row"), F.col("buckets")))


PACKED = "dim long, home long, bucket long, asked_here long, kind string, columns binary, ids binary, labels binary, rows binary"


def _pack(frame: pd.DataFrame) -> pd.DataFrame:
    columns = np.stack(frame["v"].to_list(), 1)
    most = np.abs(columns).max()
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
    longs = [frame[c].to_numpy(np.int64).tobytes() for c in ("vec_id", "label", "row")]
    first = frame.iloc[0]
    return pd.DataFrame([(first["dim"], first["home"], first["bucket"], first["asked_here"], kind, columns.astype(kind).tobytes(), *longs)],
                        columns=[c.split()[0] for c in PACKED.split(", ")])


def _unpack(row: tuple) -> Shard:
    ids, labels, rows = (np.frombuffer(b, np.int64) for b in (row.ids, row.labels, row.rows))
    return Shard(np.frombuffer(row.columns, row.kind).reshape(-1, len(ids)).astype(float), ids, labels, rows)


# Cells ------------------------------------------------------------------------------------------------------------------

ANCHORS = "row long, vec_id long, label long, v array<double>, wanted array<struct<row:bigint,score:bigint>>"
FOUND = "anchor long, positive long, row long, vec_id long, score long"


def _cells(anchors: DataFrame, shards: DataFrame) -> DataFrame:
    """Both sides of every cell as rows, the anchors of a cell before its shards. Both have ``cell``."""
    def nulls(schema: list[str]) -> list[Column]:
        return [F.lit(None).cast(kind).alias(name) for name, kind in map(str.split, schema)]

    anchor_columns, shard_columns = ANCHORS.split(", "), PACKED.split(", ")[4:]
    sides = anchors.select("cell", F.lit(0).alias("side"), *[c.split()[0] for c in anchor_columns], *nulls(shard_columns)).unionByName(
        shards.select("cell", F.lit(1).alias("side"), *nulls(anchor_columns), *[c.split()[0] for c in shard_columns]))
    return sides.repartition("cell").sortWithinPartitions("cell", "side", "row")


def _scan(cells: DataFrame, k: int, low: int | None = None, high: int | None = None) -> DataFrame:
    """What the cells hold of the best rows: of the anchor's own label, or with ``low`` and ``high`` of the others in each window."""
    def windows_of(wanted: list[dict]) -> list[tuple[int, int]]:
        return [(-(-low * w["score"] // 100), high * w["score"] // 100) for w in wanted]

    def rows_of(held: list[tuple]) -> pd.DataFrame:
        out = [(row, positive, found, name, min(max(-score, _LONG[0]), _LONG[1]))
               for row, keys, bests in held for positive, best in zip(keys, bests, strict=True) for score, name, found in best.held]
        return pd.DataFrame(out, columns=["anchor", "positive", "row", "vec_id", "score"]).astype("int64")

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, held, asked = None, [], []
        for frame in frames:
            for part in frame.itertuples(index=False):
                if part.cell != cell:
                    yield rows_of(held)
                    cell, held, asked = part.cell, [], []
                if part.side == 0:
                    wanted = [] if low is None else [dict(w) if isinstance(w, dict) else w.asDict() for w in part.wanted]
                    keys = [-1] if low is None else [w["row"] for w in wanted]
                    asked.append((np.asarray(part.v, float), int(part.label), int(part.row), [] if low is None else windows_of(wanted)))
                    held.append((int(part.row), keys, [Best(k) for _ in keys]))
                    continue
                shard = _unpack(part)
                for (v, label, row, windows), (_, _, bests) in zip(asked, held, strict=True):
                    alive = (shard.labels == label) & (shard.rows != row) if low is None else shard.labels != label
                    if not alive.any():
                        continue
                    exact, anchor = shard.exact_for(v)
                    if low is None:
                        _top(anchor, exact, alive, bests[0])
                    else:
                        _within(anchor, exact, alive, windows, bests)
        yield rows_of(held)

    return cells.mapInPandas(scan, FOUND)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each anchor and each of its first ``positives``
    rows of the same label, the first ``negatives`` rows of other labels that score from ``low`` to ``high`` percent of the positive."""
    rows = cut_lineage(placed(cut_lineage(usable(vectors)), is_anchor))
    shards = cut_lineage(rows.groupBy("home", "bucket").applyInPandas(_pack, PACKED))
    asked = rows.filter("anchor")

    def groups(n: Column, size: int) -> Column:
        return F.greatest(F.ceil(n / size), F.lit(1))

    def every(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))

    def cell(*parts: str) -> Column:
        return F.concat_ws(":", *[F.col(p).cast("string") for p in parts])

    no_windows = F.lit(None).cast("array<struct<row:bigint,score:bigint>>").alias("wanted")
    anchor_group = F.pmod(F.xxhash64("row"), groups(F.col("asked_here"), ANCHORS_A_CELL)).alias("a")
    own_anchors = asked.select("*", anchor_group, no_windows).withColumn("s", every(groups(F.col("buckets"), SHARDS_A_CELL)))
    own_shards = shards.filter("asked_here > 0").withColumn("s", F.floor(F.col("bucket") / SHARDS_A_CELL)).withColumn(
        "a", every(groups(F.col("asked_here"), ANCHORS_A_CELL)))
    own = _scan(_cells(own_anchors.withColumn("cell", cell("home", "a", "s")), own_shards.withColumn("cell", cell("home", "a", "s"))), positives)
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id", "row")
    found = cut_lineage(own.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= positives).select(
        "anchor", F.col("row").alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    # At most ``positives`` windows an anchor.
    wanted = found.filter("positive_score >= 0").groupBy(F.col("anchor").alias("row")).agg(
        F.collect_list(F.struct(F.col("positive").alias("row"), F.col("positive_score").alias("score"))).alias("wanted"))
    asking = cut_lineage(asked.join(wanted, "row"))
    parts = shards.groupBy("dim").agg(F.count(F.lit(1)).alias("shards")).join(
        asking.groupBy("dim").agg(F.count(F.lit(1)).alias("askers")), "dim").select(
        "dim", groups(F.col("shards"), SHARDS_A_CELL).alias("s_groups"), groups(F.col("askers"), ANCHORS_A_CELL).alias("a_groups"))
    all_anchors = asking.join(parts, "dim").withColumn("a", F.pmod(F.xxhash64("row"), F.col("a_groups"))).withColumn("s", every(F.col("s_groups")))
    all_shards = shards.join(parts, "dim").withColumn("s", F.pmod(F.xxhash64("home", "bucket"), F.col("s_groups"))).withColumn("a", every(F.col("a_groups")))
    others = _scan(_cells(all_anchors.withColumn("cell", cell("dim", "a", "s")), all_shards.withColumn("cell", cell("dim", "a", "s"))), negatives, low, high)
    nearest = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "vec_id", "row")
    ranked = others.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= negatives).select(
        "anchor", "positive", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = asked.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return ranked.join(found, ["anchor", "positive"]).join(names, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
