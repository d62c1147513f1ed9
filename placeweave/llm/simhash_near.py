"""Near-duplicate documents by SimHash and a Gray-ordered hierarchical index.

1. Fingerprint: 64 bits over 3-word shingles (XXH64, seed 42); a bit is set when more than half the shingle
   hashes have it. Words are runs of other than ASCII white space, A-Z lower-cased.
2. Routing: equal fingerprints are one from here on. The 64 bits are cut into five blocks; two fingerprints with
   at most three differing bits agree on two whole blocks at least, so each goes to its ten (block, block) buckets.
3. Index: in a bucket the fingerprints are sorted by Gray rank and packed into a tree. A node keeps the bits all
   below it share, without those its ancestors keep; a query adds up differences on the way down and drops a
   whole node once they exceed the radius.
4. A bucket reports a spanning forest of its links, never all pairs; components of the forests give the groups.

Defined results: null or blank text has fingerprint zero and links like any other; a text below three words is one
shingle; repeated rows stay rows; an empty table gives an empty result; null ids give no smallest id.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placeweave.llm import words as W
from placeweave.llm.components import components
from placeweave.session import cut_lineage

RADIUS = 3
SHINGLE = 3
SEED = 42
FANOUT = 16
QUERIES_AT_ONCE = 2048
PAIRS_AT_ONCE = 1 << 20
#: Fixed bit ranges of the five blocks.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
PIECE = 1 << 16


def _normalised(data: np.ndarray, at: np.ndarray) -> tuple[bytes, W.Words]:
    """The texts lower-cased with one space after each word, and the words' places in them."""
    found = W.split(data, at)
    length = found.end - found.start
    start = np.cumsum(length + 1) - (length + 1)
    out = np.full(int((length + 1).sum()), 32, np.uint8)
    inside = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(np.cumsum(length) - length, length)
    out[inside + np.repeat(start, length)] = W.LOWER[data[inside + np.repeat(found.start, length)]]
    return out.tobytes(), W.Words(out, start, start + length, found.doc, found.first)


def fingerprints(column: pa.Array) -> np.ndarray:
    """uint64 SimHash of each text."""
    result = np.zeros(len(column), np.uint64)
    digest = xxhash.xxh64_intdigest
    for row, data, at in W.slices(column):
        text, found = _normalised(data, at)
        view = memoryview(text)
        count = np.diff(found.first)
        shingles = np.where(count > 0, np.maximum(count - SHINGLE + 1, 1), 0)
        total = int(shingles.sum())
        if not total:
            continue
        doc = np.repeat(np.arange(len(count)), shingles)
        begin = np.arange(total) - np.repeat(np.cumsum(shingles) - shingles, shingles) + found.first[doc]
        last = np.minimum(begin + SHINGLE - 1, found.first[doc + 1] - 1)
        ones = np.zeros((len(count), 64), np.int64)
        for p in range(0, total, PIECE):
            s, e = found.start[begin[p:p + PIECE]].tolist(), found.end[last[p:p + PIECE]].tolist()
            h = np.array([digest(view[i:j], SEED) for i, j in zip(s, e, strict=True)], np.uint64)
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            here = doc[p:p + PIECE]
            heads = np.flatnonzero(np.r_[True, here[1:] != here[:-1]])
            ones[here[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
        packed = np.packbits(2 * ones > shingles[:, None], axis=1, bitorder="little")
        result[row:row + len(count)] = np.ascontiguousarray(packed).view(np.uint64).ravel()
    return result


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """``doc_id`` and the fingerprint as a signed long."""
    schema = docs.select("doc_id").schema.add(out, "long")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array(fingerprints(batch.column(1)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], names=["doc_id", out])

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(scan, schema)


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of each bit pattern in the Gray sequence, where neighbours differ by one bit."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Tree over fingerprints in Gray order. Level 0 holds the fingerprints, each upper level groups of ``FANOUT``."""

    def __init__(self, fps: np.ndarray) -> None:
        self.fps = fps[np.argsort(gray_rank(fps), kind="stable")]
        all_set, any_set = [self.fps], [self.fps]
        while len(all_set[-1]) > FANOUT:
            heads = np.arange(0, len(all_set[-1]), FANOUT)
            all_set.append(np.bitwise_and.reduceat(all_set[-1], heads))
            any_set.append(np.bitwise_or.reduceat(any_set[-1], heads))
        self.bits = all_set
        shared = [~(o ^ a) for o, a in zip(any_set, all_set, strict=True)]
        #: Bits a node settles itself; its ancestors have settled the rest of the shared ones.
        self.own = [
            own & ~np.repeat(above, FANOUT)[:len(own)] if above is not None else own
            for own, above in zip(shared, [*shared[1:], None], strict=True)]

    def links(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pieces of (query position, member position) of all members within the radius, ``PAIRS_AT_ONCE`` held."""
        top = len(self.bits) - 1
        width = len(self.bits[top])
        q = np.repeat(np.arange(len(queries)), width)
        open_pairs = [(top, q, np.tile(np.arange(width), len(queries)), np.zeros(len(q), np.int64))]
        while open_pairs:
            level, q, node, off = open_pairs.pop()
            off = off + np.bitwise_count((queries[q] ^ self.bits[level][node]) & self.own[level][node])
            near = off <= radius
            q, node, off = q[near], node[near], off[near]
            if not level:
                yield q, node
                continue
            for p in range(0, len(q), PAIRS_AT_ONCE // FANOUT):
                part = slice(p, p + PAIRS_AT_ONCE // FANOUT)
                below = (node[part, None] * FANOUT + np.arange(FANOUT)).ravel()
                real = below < len(self.bits[level - 1])
                open_pairs.append((level - 1, np.repeat(q[part], FANOUT)[real], below[real],
                                   np.repeat(off[part], FANOUT)[real]))


def join_sets(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union the pairs into ``parent`` (every entry points at a smaller or equal one); returns it flattened."""
    while True:
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, root) edges that connect what the radius connects among distinct ``fps``."""
    index = GrayIndex(fps)
    parent = np.arange(len(index.fps))
    for p in range(0, len(index.fps), QUERIES_AT_ONCE):
        for q, member in index.links(index.fps[p:p + QUERIES_AT_ONCE], radius):
            parent = join_sets(parent, q + p, member)
    linked = parent != np.arange(len(parent))
    return index.fps[linked], index.fps[parent[linked]]


def _bucket_keys(fp: F.Column) -> F.Column:
    keys = []
    for n, (i, j) in enumerate(combinations(range(len(BLOCKS)), len(BLOCKS) - RADIUS)):
        (s, w), (t, v) = BLOCKS[i], BLOCKS[j]
        left = F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << w) - 1))
        right = F.shiftrightunsigned(fp, t).bitwiseAND(F.lit((1 << v) - 1))
        keys.append(F.shiftleft(F.lit(n).cast("bigint"), 32).bitwiseOR(F.shiftleft(left, v)).bitwiseOR(right))
    return F.array(*keys)


def _bucket_forests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by bucket; the bucket open at the end of a batch waits for the next one."""
    def solve(key: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
        heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[heads, len(key)])
        found = [(np.zeros(0, np.uint64),) * 2]
        for h, n in zip(heads[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            found.append(forest(fp[h:h + n], RADIUS))
        two = heads[size == 2]  # an index of two members is one comparison
        near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= RADIUS
        found.append((fp[two][near], fp[two + 1][near]))
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
        return pd.DataFrame({"a": a, "b": b})

    held: list[tuple[np.ndarray, np.ndarray]] = []  # parts of the open bucket, put together once it ends
    for frame in frames:
        key, fp = frame["bucket"].to_numpy(np.int64), frame["fp"].to_numpy(np.int64).view(np.uint64)
        if not len(key):
            continue
        if held and key[0] != held[0][0][0]:
            yield solve(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held = []
        open_from = int(np.searchsorted(key, key[-1], "left"))
        if open_from:
            yield solve(*(np.concatenate(x) for x in zip(*held, (key[:open_from], fp[:open_from]), strict=True)))
            held = []
        held.append((key[open_from:], fp[open_from:]))
    if held:
        yield solve(*(np.concatenate(x) for x in zip(*held, strict=True)))


def near_links(distinct: DataFrame) -> DataFrame:
    """``a, b``: links between distinct fingerprints whose components are those of all links within the radius."""
    dealt = distinct.select(F.explode(_bucket_keys(F.col("fp"))).alias("bucket"), "fp")
    buckets = dealt.repartition("bucket").sortWithinPartitions("bucket", "fp")
    return buckets.mapInPandas(_bucket_forests, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable over links."""
    prints = cut_lineage(with_fingerprint(docs))
    per_print = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(near_links(per_print.select("fp"))).withColumnRenamed("node", "fp")
    owned = per_print.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = cut_lineage(owned.groupBy("root").agg(F.min("least").alias("component_id")))
    named = cut_lineage(owned.join(least, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of every group: the smallest id's. Rows are told apart by id and text, so rows that share an id but are not
    linked both stay; equal rows are one; rows without an id stay."""
    free = f"row_{uuid.uuid4().hex}"
    told = docs.filter("doc_id IS NOT NULL").withColumn(free, F.xxhash64("text"))
    named = near_duplicates(told.select(F.struct("doc_id", free).alias("doc_id"), "text"))
    kept = told.join(named.filter("doc_id = component_id").select("doc_id.*").distinct(), ["doc_id", free], "left_semi")
    order = Window.partitionBy("doc_id", free).orderBy(F.lit(1))
    first = kept.withColumn(f"{free}_n", F.row_number().over(order)).filter(F.col(f"{free}_n") == 1)
    return first.select(docs.columns).unionByName(docs.filter("doc_id IS NULL"))
