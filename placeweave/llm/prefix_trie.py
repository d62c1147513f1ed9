"""The trie of rebuilt conversations, from fingerprints that compose; no rebuilt text is ever put together.

Conversation c is rebuilt from the first h turns of its base (c - c % 100) and its own turns after its first h. A sequence of
turns is fingerprinted by the pair (length n, sum of turn hash x B^place modulo a prime); pairs multiply as

    (n1, a1) (n2, a2) = (n1 + n2, a1 + B^n1 a2),

which is a monoid. So the running products of the stored turns are all that is needed: a range-sorted scan numbers the turns and
multiplies within each partition, the few conversations that cross a border get the product of what lies before, and a rebuilt
prefix is the base's product times the own product without its first h turns. Three primes near 2^31 make a fingerprint.

Equality is verified, not assumed. A rebuilt turn is a reference to a stored turn; a stored turn has a 128-bit class, and the
smallest and largest (role, text) of every class must be the same. All members of a prefix group must refer to one class in their
last turn and have one parent group; by induction their turns are equal. If any check fails, everything is computed again with
other hashes and bases.

A node's sums over its subtree need no walk: each node is counted at its smallest member, the member's rows get the sum of all
nodes counted at it from their depth on (the same scan, backwards), and a node adds up these over its members. A conversation of
any length is cut over partitions; hot nodes are sums with partial aggregation. The list of ends of a node is put into pieces (one
an Arrow batch) by range, so the task that hashes it, byte after byte as SHA-256 demands, reads few rows and keeps none.

Defined results: a null role or text is empty; null turns come first, equal turns are ordered by role and text; repeated rows are
turns of their own; rows without a conv_id belong to no conversation; % keeps the sign of a negative conv_id; an empty table has
no nodes, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from placeweave.llm.host_words import meet
from placeweave.session import cut_lineage

HEAD_TURNS = 6
BASE_STEP = 100
PRIMES = (2_147_483_647, 2_147_483_629, 2_147_483_587)
NODE = ["depth", "hi", "lo"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class Fingerprint:
    """Moduli and a seed from which turn hashes and bases follow."""

    seed: int
    primes: tuple[int, int, int] = PRIMES

    @property
    def bases(self) -> list[int]:
        return [int.from_bytes(hashlib.sha256(f"{self.seed}:{p}".encode()).digest()[:8], "big") % (p - 3) + 2 for p in self.primes]

    def turn_columns(self) -> dict[str, Column]:
        """The class of a turn (two 64-bit hashes) and its hash for each prime."""
        one, other = F.xxhash64(F.lit(self.seed), "role", "text"), F.xxhash64("text", F.lit(~self.seed), "role")
        mixed = (one, other, F.xxhash64(one, other))
        return {"class1": one, "class2": other} | {f"t{m}": F.pmod(h, F.lit(p)) for m, (h, p) in enumerate(zip(mixed, self.primes, strict=True))}


def _power(base: int, exponents: np.ndarray, prime: int) -> np.ndarray:
    out, square, left = np.ones(len(exponents), np.int64), base, exponents.copy()
    while left.any():
        out = np.where(left & 1, out * square % prime, out)
        square = square * square % prime
        left >>= 1
    return out


def _segments(ids: np.ndarray, before: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(where each row's run of equal ids begins, whether that run continues one with id ``before``)."""
    opens = np.ones(len(ids), bool)
    opens[1:] = ids[1:] != ids[:-1]
    begin = np.maximum.accumulate(np.where(opens, np.arange(len(ids)), 0))
    return begin, (begin == 0) & (len(ids) > 0 and before is not None and ids[0] == before)


def _crossing(rows: DataFrame) -> DataFrame:
    """``conv, part`` and the last row of each part, for the conversations that several parts hold: at most two rows a partition."""
    ends = rows.groupBy("part").agg(F.min("conv").alias("low"), F.max("conv").alias("high"))
    both = ends.select("part", F.explode(F.array_distinct(F.array("low", "high"))).alias("conv"))
    shared = both.groupBy("conv").agg(F.count(F.lit(1)).alias("parts")).filter("parts > 1").select("conv")
    values = [c for c in rows.columns if c not in ("conv", "part", "pos")]
    return rows.join(F.broadcast(shared), "conv").groupBy("conv", "part").agg(
        F.max("pos").alias("pos"), F.max_by(F.struct(*values), "pos").alias("last")).select("conv", "part", "pos", "last.*")


def _carries(rows: DataFrame, add: Callable[[tuple, Row], tuple], columns: Sequence[str], empty: tuple) -> DataFrame:
    """``conv, part`` and what comes before that part, by ``add``ing the last rows in the order of the parts."""
    before, out, now = None, [], empty
    for row in sorted(_crossing(rows).collect(), key=lambda r: (r.conv, r.part)):
        now = empty if row.conv != before else now
        out.append((row.conv, row.part, *now))
        before, now = row.conv, add(now, row)
    schema = ", ".join(["conv long", "part int", *[f"{name} long" for name in columns]])
    return F.broadcast(rows.sparkSession.createDataFrame(out, schema))


# The stored turns -------------------------------------------------------------------------------------------------------


def _turns(conversations: DataFrame) -> DataFrame:
    return conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def stored_products(turns: DataFrame, by: Fingerprint) -> DataFrame:
    """``conv, pos, class1, class2, size, a0..a2, w0..w2``: every stored turn with the product up to it and its own part of it."""
    ties = cut_lineage(turns.groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("conv", "turn"))
    if ties.isEmpty():  # texts are sorted only where equal turns need it
        known = turns.withColumns({"tie_role": F.lit(None).cast("string"), "tie_text": F.lit(None).cast("string")})
    else:
        mark = ties.select(F.col("conv").alias("_c"), F.col("turn").alias("_t"), F.lit(True).alias("_tied"))
        known = turns.join(mark, (F.col("conv") == F.col("_c")) & F.col("turn").eqNullSafe(F.col("_t")), "left").withColumns(
            {f"tie_{c}": F.when(F.col("_tied"), F.col(c)) for c in ("role", "text")})
    hashes = by.turn_columns()
    order = ["conv", F.asc_nulls_first("turn"), "tie_role", "tie_text"]
    narrow = known.select("conv", "turn", "tie_role", "tie_text", *[c.alias(n) for n, c in hashes.items()], F.length("text").alias("size"))
    sorted_turns = narrow.repartitionByRange(*order).sortWithinPartitions(*order)
    bases, primes = by.bases, by.primes

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, conv, count, products = TaskContext.get().partitionId(), None, 0, [0] * len(primes)
        for frame in frames:
            if not len(frame):
                continue
            ids = frame["conv"].to_numpy()
            begin, continued = _segments(ids, conv)
            pos = np.arange(1, len(ids) + 1) - begin + np.where(continued, count, 0)
            out = {"conv": ids, "part": np.int32(part), "pos": pos} | {c: frame[c] for c in ("class1", "class2", "size")}
            for m, (base, prime) in enumerate(zip(bases, primes, strict=True)):
                weighed = frame[f"t{m}"].to_numpy() * _power(base, pos, prime) % prime
                summed = np.cumsum(weighed)
                out[f"a{m}"] = (summed - (summed - weighed)[begin] + np.where(continued, products[m], 0)) % prime
                out[f"w{m}"] = weighed
                products[m] = int(out[f"a{m}"][-1])
            conv, count = ids[-1], int(pos[-1])
            yield pd.DataFrame(out)

    longs = ", ".join(f"{c}{m} long" for c in "aw" for m in range(len(primes)))
    local = cut_lineage(sorted_turns.drop("turn", "tie_role", "tie_text").mapInPandas(
        scan, f"conv long, part int, pos long, class1 long, class2 long, size long, {longs}"))

    n = len(primes)

    def product(before: tuple, row: Row) -> tuple:
        powers, sums = before[1:1 + n], before[1 + n:]
        return (before[0] + row.pos, *[x * pow(b, row.pos, p) % p for x, b, p in zip(powers, bases, primes, strict=True)],
                *[(sums[m] + powers[m] * row[f"a{m}"]) % primes[m] for m in range(n)])

    given = ["n", *[f"p{m}" for m in range(n)], *[f"b{m}" for m in range(n)]]
    before = _carries(local, product, given, (0, *[1] * n, *[0] * n))
    moved = {"pos": F.col("pos") + F.coalesce("n", F.lit(0))}
    for m, prime in enumerate(primes):
        shifted = {c: F.col(f"p{m}") * F.col(f"{c}{m}") for c in "aw"}
        moved[f"a{m}"] = F.when(F.col("n").isNull(), F.col(f"a{m}")).otherwise((F.col(f"b{m}") + shifted["a"]) % prime)
        moved[f"w{m}"] = F.when(F.col("n").isNull(), F.col(f"w{m}")).otherwise(shifted["w"] % prime)
    return local.join(before, ["conv", "part"], "left").withColumns(moved).drop("part", *given)


# Rebuilt prefixes -------------------------------------------------------------------------------------------------------


def rebuilt_prefixes(stored: DataFrame, by: Fingerprint) -> DataFrame:
    """``conv, depth, hi, lo, up_hi, up_lo, class1, class2, size``: the fingerprint of every prefix of every rebuilt conversation and
    of its parent, with the class and length of the stored turn that its last turn refers to."""
    n = len(by.primes)
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % HEAD_TURNS
    own = stored.withColumn("h", h)
    convs = own.groupBy("conv", "h").agg(
        F.max("pos").alias("uses"), *[F.coalesce(F.max(F.when(F.col("pos") == F.col("h"), F.col(f"a{m}"))), F.lit(0)).alias(f"skip{m}") for m in range(n)])
    turn = F.struct("pos", "class1", "class2", "size", *[f"{c}{m}" for c in "aw" for m in range(n)])
    heads = stored.filter((F.col("conv") % BASE_STEP == 0) & (F.col("pos") < HEAD_TURNS)).groupBy(F.col("conv").alias("base")).agg(
        F.array_sort(F.collect_list(turn)).alias("head"))  # at most HEAD_TURNS - 1 turns
    joined = convs.withColumn("base", F.col("conv") - F.col("conv") % BASE_STEP).join(heads, "base", "left")
    with_head = cut_lineage(joined.withColumn("head", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h").cast("int")))
                            .withColumn("k", F.size("head")))
    values = ["class1", "class2", "size"]
    from_head = with_head.select("conv", F.explode("head").alias("t")).select(
        "conv", F.col("t.pos").alias("depth"), *[f"t.{c}" for c in values], *[f"t.{c}{m}" for c in "aw" for m in range(n)])
    root = with_head.select("conv", F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(c) for c in [*values, *[f"{c}{m}" for c in "aw" for m in range(n)]]])
    known = with_head.select("conv", "uses", "h", "k", *[f"skip{m}" for m in range(n)],
                             *[F.when(F.col("k") > 0, F.col("head")[F.col("k") - 1][f"a{m}"]).otherwise(0).alias(f"head{m}") for m in range(n)])
    rest = meet(own.filter(F.col("pos") > F.col("h")).drop("h"), known, "conv")
    moved = {"depth": F.col("k") + F.col("pos") - F.col("h")}
    for m, (base, prime) in enumerate(zip(by.bases, by.primes, strict=True)):
        back = F.array(*[F.lit(pow(base, -e, prime)).cast("long") for e in range(HEAD_TURNS)])[(F.col("h") - F.col("k")).cast("int")]
        moved[f"a{m}"] = (F.col(f"head{m}") + F.pmod(F.col(f"a{m}") - F.col(f"skip{m}"), F.lit(prime)) * back) % prime
        moved[f"w{m}"] = F.col(f"w{m}") * back % prime
    from_own = rest.withColumns(moved).select(*from_head.columns)
    every = from_head.unionByName(from_own).unionByName(root)
    up = [F.pmod(F.col(f"a{m}") - F.col(f"w{m}"), F.lit(p)) for m, p in enumerate(by.primes)]
    return every.select("conv", "depth", (F.shiftleft("a0", 31) + F.col("a1")).alias("hi"), F.col("a2").alias("lo"),
                        (F.shiftleft(up[0], 31) + up[1]).alias("up_hi"), up[2].alias("up_lo"), *values)


def _same(column: str) -> Column:
    return F.min(column) == F.max(column)


def prefix_groups(prefixes: DataFrame) -> DataFrame:
    """One row per node, with ``verified``: its members agree in the class of their last turn and in their parent."""
    checks = [_same(c) for c in ("class1", "class2", "up_hi", "up_lo")]
    return prefixes.groupBy(*NODE).agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.max("size").alias("size"), F.min("up_hi").alias("up_hi"),
        F.min("up_lo").alias("up_lo"), (checks[0] & checks[1] & checks[2] & checks[3]).alias("verified"))


def classes_hold(turns: DataFrame, by: Fingerprint) -> bool:
    """No class of stored turns has two different turns: compared by their roles and texts, not by another hash."""
    hashes = by.turn_columns()
    said = F.struct("role", "text")
    classes = turns.select(hashes["class1"].alias("class1"), hashes["class2"].alias("class2"), said.alias("said")).groupBy("class1", "class2").agg(
        F.min("said").alias("low"), F.max("said").alias("high"))
    return classes.filter("low <> high").isEmpty()


# Sums and lists over the trie -------------------------------------------------------------------------------------------


def sums_from_depth(prefixes: DataFrame, values: Sequence[str]) -> DataFrame:
    """``prefixes`` with ``values`` replaced by their sums over the same conversation's rows from that depth on, and ``last``."""
    order = ["conv", F.desc("depth")]

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, conv, count, sums = TaskContext.get().partitionId(), None, 0, dict.fromkeys(values, 0)
        for frame in frames:
            if not len(frame):
                continue
            ids = frame["conv"].to_numpy()
            begin, continued = _segments(ids, conv)
            frame["part"], frame["pos"] = np.int32(part), np.arange(1, len(ids) + 1) - begin + np.where(continued, count, 0)
            for c in values:
                own = frame[c].to_numpy()
                summed = np.cumsum(own)
                frame[c] = summed - (summed - own)[begin] + np.where(continued, sums[c], 0)
                sums[c] = int(frame[c].iloc[-1])
            conv, count = ids[-1], int(frame["pos"].iloc[-1])
            yield frame

    schema = ", ".join(f"{c} long" for c in prefixes.columns)
    local = cut_lineage(prefixes.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(scan, f"{schema}, part int, pos long"))
    given = [f"before_{c}" for c in ["n", *values]]

    def plus(now: tuple, row: Row) -> tuple:
        return (now[0] + row.pos, *[x + row[c] for x, c in zip(now[1:], values, strict=True)])

    before = _carries(local.select("conv", "part", "pos", *values), plus, given, (0,) * len(given))
    summed = {c: F.col(c) + F.coalesce(f"before_{c}", F.lit(0)) for c in values}
    last = (F.col("pos") == 1) & (F.coalesce("before_n", F.lit(0)) == 0)
    return local.join(before, ["conv", "part"], "left").withColumns(summed | {"last": last}).drop("part", "pos", *given)


def ends_digests(ends: DataFrame) -> DataFrame:
    """``depth, hi, lo, ends_sha256`` of the nodes at which conversations end."""
    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                groups = frame.groupby(NODE, sort=False)["conv"]
                yield groups.agg(first="first", text=lambda ids: ",".join(map(str, ids))).reset_index()

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, hasher = None, None
        for frame in frames:
            done = []
            for *key, text in frame[[*NODE, "text"]].itertuples(index=False):
                if key != node:
                    if node is not None:
                        done.append((*node, hasher.hexdigest()))
                    node, hasher = key, hashlib.sha256(text.encode())
                else:
                    hasher.update(f",{text}".encode())
            yield pd.DataFrame(done, columns=[*NODE, "ends_sha256"])
        if node is not None:
            yield pd.DataFrame([(*node, hasher.hexdigest())], columns=[*NODE, "ends_sha256"])

    key = "depth long, hi long, lo long"
    order = [*NODE, "conv"]
    parts = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(pieces, f"{key}, first long, text string")
    return parts.repartition(*NODE).sortWithinPartitions(*NODE, "first").select(*NODE, "text").mapInPandas(digest, f"{key}, ends_sha256 string")


def prefix_trie(conversations: DataFrame, tries: Sequence[Fingerprint] = tuple(Fingerprint(seed) for seed in range(1, 6))) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of every node."""
    turns = _turns(conversations)
    for by in tries:
        prefixes = cut_lineage(rebuilt_prefixes(cut_lineage(stored_products(turns, by)), by))
        groups = cut_lineage(prefix_groups(prefixes))
        if groups.filter(~F.col("verified")).isEmpty() and classes_hold(turns, by):
            break
    else:
        raise ValueError("different prefixes share a fingerprint in every try")
    below = groups.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = cut_lineage(groups.join(below, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    parents = nodes.filter("n_children > 0").select(F.struct(*NODE).alias("up"), F.col("conv").alias("parent_conv"), F.col("n_children").alias("uses"))
    children = nodes.filter("depth > 0").select(*NODE, F.struct((F.col("depth") - 1).alias("depth"), F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo")).alias("up"))
    parent = meet(children, parents, "up").select(*NODE, "parent_conv")
    counted = nodes.select("conv", "depth", ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"), (F.col("n_children") == 0).cast("long").alias("n_leaves"))
    rows = prefixes.select("conv", *NODE).join(counted, ["conv", "depth"], "left").fillna(0, ["saved_tokens", "n_leaves"])
    summed = cut_lineage(sums_from_depth(rows, ["saved_tokens", "n_leaves"]))
    sums = summed.groupBy(*NODE).agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))
    whole = nodes.join(sums, NODE).join(parent, NODE, "left").join(ends_digests(summed.filter("last")), NODE, "left")
    return whole.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
                        "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
