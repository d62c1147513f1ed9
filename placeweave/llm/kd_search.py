"""Exact top-k by inner product with one KD-tree per shard.

Vectors become integers, ``floor(256 * x)``. A shard is a bounded number of vectors of one length in a KD-tree: median splits
on the widest column, a tight bounding box for every node. The tree is built once, where its shard is put together, and travels
with it as arrays. For a query the best score a box allows is the sum over columns of the larger of ``q * low`` and ``q * high``;
nodes are taken best bound first and the search of a shard ends when the best bound left cannot reach the kth score known so far.

That kth score is propagated: a query first searches one shard, its home. Then it is sent only to groups of shards whose common box
can reach its kth score; there it raises that score from shard to shard, and shards whose root box cannot reach it are passed over.
A cell is a group of queries and a group of shards: the queries are held, the shards stream by.

Defined results: a vector that is null, empty or holds a null or non-finite component takes no part, as query or as
candidate; vectors of different lengths are not compared; equal scores go to the smaller id; a query's own row is skipped, a
repeat of it with another id is not; rows that repeat an id count once each, as queries with a list of their own each; scores
beyond 64 bits are cut to their ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placeweave.session import cut_lineage

SHARD_ROWS = 4096
SHARDS_A_CELL = 4
QUERIES_A_CELL = 1024
LEAF = 64
_EXACT = float(1 << 53)
_LONG = (-2 ** 63, 2 ** 63 - 1)
_whole = np.frompyfunc(int, 1, 1)


class KDTree:
    """Nodes in breadth-first order; ``rows[begin:end]`` and ``ids[begin:end]`` are a node's vectors, ``child`` its first child or -1."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, nodes: np.ndarray, child: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.rows, self.ids, self.nodes, self.child, self.low, self.high = rows, ids, nodes, child, low, high

    @classmethod
    def build(cls, vectors: np.ndarray, ids: np.ndarray) -> KDTree:
        order = np.arange(len(vectors))
        nodes, low, high, child = [(0, len(vectors))], [], [], []
        for begin, end in nodes:  # grows while it is read
            rows = order[begin:end]
            box = vectors[rows]
            low.append(box.min(0))
            high.append(box.max(0))
            wide = int((high[-1] - low[-1]).argmax())
            if end - begin <= LEAF or low[-1][wide] == high[-1][wide]:
                child.append(-1)
                continue
            middle = (end - begin) // 2
            order[begin:end] = rows[np.argsort(box[:, wide], kind="stable")]
            child.append(len(nodes))
            nodes += [(begin, begin + middle), (begin + middle, end)]
        return cls(vectors[order], ids[order], np.array(nodes, np.int32), np.array(child, np.int32), np.array(low), np.array(high))

    def packed(self) -> dict[str, bytes]:
        return {name: getattr(self, name).tobytes() for name in _ARRAYS}

    @classmethod
    def unpacked(cls, row: tuple) -> KDTree:
        found = {name: np.frombuffer(getattr(row, name), kind) for name, kind in _ARRAYS.items()}
        n = len(found["ids"])
        dim = len(found["rows"]) // n
        shape = {"rows": (n, dim), "nodes": (-1, 2), "low": (-1, dim), "high": (-1, dim)}
        return cls(**{name: a.reshape(shape[name]) if name in shape else a for name, a in found.items()})

    def exact_for(self, queries: np.ndarray) -> tuple[KDTree, np.ndarray]:
        """Both as they are where doubles add up exactly, else as Python integers."""
        largest = max(abs(float(self.low[0].min())), abs(float(self.high[0].max())))
        if 2 * largest * float(np.abs(queries).max()) * queries.shape[1] < _EXACT:
            return self, queries
        return KDTree(_whole(self.rows), self.ids, self.nodes, self.child, _whole(self.low), _whole(self.high)), _whole(queries)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Highest inner product of each query with anything in each node's box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T


_ARRAYS = {"rows": np.float64, "ids": np.int64, "nodes": np.int32, "child": np.int32, "low": np.float64, "high": np.float64}


def _top(tree: KDTree, query: np.ndarray, own: int, bound: np.ndarray, best: list[tuple], k: int, floor: float) -> list[tuple]:
    """The k best (-score, id) of ``best`` and the tree; nothing below ``floor`` is looked for."""
    open_nodes = [(-bound[0], 0)]
    if len(best) == k:
        floor = max(floor, -best[-1][0])
    while open_nodes and -open_nodes[0][0] >= floor:
        node = heappop(open_nodes)[1]
        child = int(tree.child[node])
        if child >= 0:
            for c in (child, child + 1):
                if bound[c] >= floor:
                    heappush(open_nodes, (-bound[c], c))
            continue
        begin, end = tree.nodes[node]
        found, held = tree.rows[begin:end] @ query, tree.ids[begin:end]
        near = np.flatnonzero((found >= floor) & (held != own))
        best = sorted([*best, *((-int(found[i]), int(held[i])) for i in near)])[:k]
        if len(best) == k:
            floor = max(floor, -best[-1][0])
    return best


def usable(vectors: DataFrame) -> DataFrame:
    """``row, vec_id, v, dim``: integer-valued double components of the vectors that take part."""
    whole = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("double"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * 256.0) != float("inf")))
    # floor() gives a long: components beyond its range would wrap, so they keep their double value.
    large = F.exists("embedding", lambda x: F.abs(x.cast("double")) >= float(1 << 54))
    kept = F.when(large, F.transform("embedding", lambda x: x.cast("double") * 256.0)).otherwise(whole)
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).filter(
        finite).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), kept.alias("v"), F.size("embedding").alias("dim"))


SHARDS = "dim int, shard long, low_corner array<double>, high_corner array<double>, " + ", ".join(f"{name} binary" for name in _ARRAYS)


def _build(frame: pd.DataFrame) -> pd.DataFrame:
    tree = KDTree.build(np.stack(frame["v"].to_list()).astype(float), frame["vec_id"].to_numpy(np.int64))
    first = frame.iloc[0]
    return pd.DataFrame([{"dim": first["dim"], "shard": first["shard"], "low_corner": tree.low[0], "high_corner": tree.high[0], **tree.packed()}])


QUERIES = "row long, vec_id long, v array<double>, floor double, home long"


def _cells(queries: DataFrame, shards: DataFrame) -> DataFrame:
    """Both sides of every cell as rows, its queries before its shards; both have ``cell``."""
    def nulls(columns: dict[str, str]) -> list[F.Column]:
        return [F.lit(None).cast(kind).alias(name) for name, kind in columns.items()]

    asked = dict(part.split() for part in QUERIES.split(", "))
    held = {"shard": "long"} | dict.fromkeys(_ARRAYS, "binary")
    return queries.select("cell", F.lit(0).alias("side"), *asked, *nulls(held)).unionByName(
        shards.select("cell", F.lit(1).alias("side"), *nulls(asked), *held)).repartition("cell").sortWithinPartitions("cell", "side", "row", "shard")


def _search(cells: DataFrame, k: int) -> DataFrame:
    """``row, query_id, vec_id, score``: the k best of every query in every cell, at least those that reach its floor."""
    def told(asked: list[tuple], best: list[list[tuple]]) -> pd.DataFrame:
        out = [(row, own, name, min(max(-score, _LONG[0]), _LONG[1])) for (row, own, *_), found in zip(asked, best, strict=True) for score, name in found]
        return pd.DataFrame(out, columns=["row", "query_id", "vec_id", "score"]).astype("int64")

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, asked, best, matrix = None, [], [], None
        for frame in frames:
            for part in frame.itertuples(index=False):
                if part.cell != cell:
                    yield told(asked, best)
                    cell, asked, best, matrix = part.cell, [], [], None
                if part.side == 0:
                    floor = -np.inf if pd.isna(part.floor) else float(part.floor)
                    asked.append((int(part.row), int(part.vec_id), floor, -1 if pd.isna(part.home) else int(part.home), np.asarray(part.v, float)))
                    best.append([])
                    continue
                if not asked:
                    continue
                if matrix is None:
                    matrix = np.stack([q[-1] for q in asked])
                tree, queries = KDTree.unpacked(part).exact_for(matrix)
                bounds = tree.bounds(queries)
                for n, (_, own, floor, home, _) in enumerate(asked):
                    if home != part.shard:
                        best[n] = _top(tree, queries[n], own, bounds[n], best[n], k, floor)
        yield told(asked, best)

    return cells.mapInPandas(search, "row long, query_id long, vec_id long, score long")


def _highest(low: str, high: str) -> F.Column:
    """Highest inner product of ``v`` with anything in a box."""
    each = F.zip_with(F.col("v"), F.arrays_zip(F.col(low).alias("l"), F.col(high).alias("h")), lambda x, box: F.greatest(x * box["l"], x * box["h"]))
    return F.aggregate(each, F.lit(0.0), lambda total, x: total + x)


def nearest(vectors: DataFrame, is_query: F.Column, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest inner products of every query with all other rows."""
    rows = cut_lineage(usable(vectors).withColumn("asked", F.coalesce(is_query, F.lit(False))))
    sizes = cut_lineage(rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).alias("shards"), F.count_if("asked").alias("askers")))
    placed = rows.join(F.broadcast(sizes), "dim")  # one row a vector length
    shards = cut_lineage(placed.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.col("shards"))).groupBy("dim", "shard").applyInPandas(_build, SHARDS))
    asked = placed.filter("asked").select("row", "vec_id", "v", "dim", "shards", "askers", F.pmod(F.xxhash64("row"), F.col("shards")).alias("home"))

    def cell(*parts: str) -> F.Column:
        return F.concat_ws(":", *[F.col(p).cast("string") for p in parts]).alias("cell")

    at_home = asked.select("row", "vec_id", "v", F.lit(None).cast("double").alias("floor"), F.lit(None).cast("long").alias("home"), cell("dim", "home"))
    first = cut_lineage(_search(_cells(at_home, shards.withColumn("cell", cell("dim", "shard"))), k))
    # The kth score at home, where there are k: no lower score can enter the result.
    kth = first.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("floor")).filter(F.col("n") >= k)
    grouped = shards.withColumn("s", F.floor(F.col("shard") / SHARDS_A_CELL))
    boxes = cut_lineage(grouped.select("dim", "s", F.posexplode(F.arrays_zip("low_corner", "high_corner")).alias("d", "c")).groupBy("dim", "s", "d").agg(
        F.min("c.low_corner").alias("l"), F.max("c.high_corner").alias("h")).groupBy("dim", "s").agg(
        F.array_sort(F.collect_list(F.struct("d", "l", "h"))).alias("b")).select("dim", "s", F.col("b.l").alias("low"), F.col("b.h").alias("high")))
    groups = F.ceil(F.col("shards") / SHARDS_A_CELL)
    far = asked.join(kth.select("row", "floor"), "row", "left").withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), groups - 1)))
    # The bound is summed in doubles: a share of it makes up for their rounding.
    bound = _highest("low", "high")
    reach = F.col("floor").isNull() | (bound + F.abs(bound) * 1e-9 + 1e-6 >= F.col("floor")) | F.isnan(bound)
    sent = far.join(boxes, ["dim", "s"]).filter(reach).withColumn("a", F.pmod(F.xxhash64("row", F.lit(1)), F.ceil(F.col("askers") / QUERIES_A_CELL)))
    held = grouped.join(F.broadcast(sizes), "dim").filter("askers > 0").withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("askers") / QUERIES_A_CELL) - 1)))
    others = _search(_cells(sent.select("row", "vec_id", "v", "floor", "home", cell("dim", "a", "s")), held.withColumn("cell", cell("dim", "a", "s"))), k)
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return first.unionByName(others).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
