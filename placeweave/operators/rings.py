"""Boundary rings out of ways that are stored in any order and direction."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.session import cut_lineage

# States of an assembly and the fewest points of a ring.
RING, UNJOINED, BRANCHING, TOO_FEW = "ring", "unjoined", "branching", "too_few_points"
MIN_POINTS = 3


def smallest_unit(units: DataFrame) -> DataFrame:
    """``area, region``: per area the region of the highest ``level``, the smallest region on ties (a missing level counts as 0)."""
    level = F.coalesce("level", F.lit(0))
    return units.groupBy("area").agg(F.min_by("region", F.struct(-level, F.col("region"))).alias("region"))


def _arcs(ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(arcs, branches)``. An arc is a way in one direction (``arc = 2 way + 1`` as stored, ``2 way`` reversed) with ``up``, the arc that
    leads to its first point; branches are regions with a point where more than two way ends meet."""
    touch = ends.select("region", "way", "n", F.explode(F.array(
        F.struct(F.col("head").alias("point"), F.lit(0).alias("tail")), F.struct(F.col("tail").alias("point"), F.lit(1).alias("tail")))).alias("t")).select(
        "region", F.col("t.point").alias("point"), F.struct("way", "t.tail", "n").alias("end"))
    met = touch.groupBy("region", "point").agg(
        F.count(F.lit(1)).alias("degree"), F.min("end").alias("one"), F.max("end").alias("other"))
    itself = F.col("one.way") == F.col("other.way")
    branches = met.filter("degree > 2").select("region").distinct()

    def entering(end: Column) -> Column:
        return end["way"] * 2 + 1 - end["tail"]

    def leaving(end: Column) -> Column:
        return end["way"] * 2 + end["tail"]

    def arc(end: Column, up: Column) -> Column:
        return F.struct(entering(end).alias("arc"), F.when(F.col("degree") == 2, leaving(up)).alias("up"),
                        F.when(F.col("degree") == 2, up["n"] - 1).otherwise(0).alias("before"))

    one, other = F.col("one"), F.col("other")
    both = F.when(F.col("degree") == 1, F.array(arc(one, one))).otherwise(F.array(arc(one, other), arc(other, one)))
    arcs = met.filter((F.col("degree") <= 2) & ~(itself & (F.col("degree") == 2))).select("region", F.explode(both).alias("a")).select("region", "a.*")
    return arcs, branches


def _ranked(arcs: DataFrame, first: DataFrame, most_ways: int) -> DataFrame:
    """``region, arc, before`` of the arcs that a walk from each region's first way reaches, with the points passed before them.

    Pointer jumping: every round an arc takes over the pointer of the arc it points to and adds that one's points, so chains of n ways take
    log2(n) rounds, each checkpointed. A pointer is met by one arc only, so no key is hot."""
    marked = arcs.join(first, "region").withColumns({
        "reached": F.col("arc") == F.col("start"),
        "up": F.when(F.floor(F.col("arc") / 2) != F.floor(F.col("start") / 2), F.col("up"))})  # the walk begins here: nothing leads to it
    now = cut_lineage(marked.select("region", "arc", "up", F.when(F.col("up").isNotNull(), F.col("before")).otherwise(0).alias("before"), "reached"))
    for _ in range(math.ceil(math.log2(2 * max(most_ways, 1))) + 1):
        ahead = now.select("region", F.col("arc").alias("up"), F.col("up").alias("further"), F.col("before").alias("more"), F.col("reached").alias("done"))
        moved = now.filter("up IS NOT NULL").join(ahead, ["region", "up"], "left").select(
            "region", "arc", F.col("further").alias("up"), (F.col("before") + F.coalesce("more", F.lit(0))).alias("before"), F.coalesce("done", F.lit(False)).alias("reached"))
        now = cut_lineage(now.filter("up IS NULL").unionByName(moved))
        if now.filter("up IS NOT NULL").isEmpty():
            break
    return now.filter("reached AND up IS NULL").select("region", "arc", "before")


def assemble_rings(ways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(points, states)`` of closed rings joined end to end from ``region, way, pos, lat, lon`` (``pos`` gapless from 0 within a way).

    A ring begins with the region's first way as stored and goes on with the way that begins or ends where it stands; ``points`` are
    ``region, seq, lat, lon``, the first point repeated at the end. ``states`` are ``region, ways, joined, points, state``: ``unjoined`` where
    ways are left over, ``branching`` where the next way is not certain, ``too_few_points``; only ``ring`` has points. A chain whose ends
    differ is closed by a straight edge. No region, way or ring is gathered in one row or task."""
    point = F.struct("lat", "lon")
    single = ways.groupBy("region", "way").agg(
        F.min_by(point, "pos").alias("head"), F.max_by(point, "pos").alias("tail"), F.count(F.lit(1)).alias("n"))
    counts = cut_lineage(single.groupBy("region").agg(F.count(F.lit(1)).alias("ways"), F.min("way").alias("first")))
    ends = cut_lineage(single.join(counts, "region"))
    arcs, branches = _arcs(ends)
    start = counts.select("region", (F.col("first") * 2 + 1).alias("start"))
    reached = _ranked(arcs, start, counts.agg(F.max("ways")).first()[0] or 1)
    # A first way that meets itself has no arcs: it is the whole walk.
    alone = ends.filter("way = first AND head = tail").select("region", (F.col("way") * 2 + 1).alias("arc"), F.lit(0).cast("bigint").alias("before"))
    walked = reached.join(alone.select("region"), "region", "left_anti").select("region", "arc", F.col("before").cast("bigint").alias("before")).unionByName(alone)
    placed = cut_lineage(walked.withColumns({"way": F.floor(F.col("arc") / 2), "forward": F.col("arc") % 2 == 1}).join(
        ends.select("region", "way", "n", "head", "tail"), ["region", "way"]))
    last = F.max_by(F.when(F.col("forward"), F.col("tail")).otherwise(F.col("head")), "before")
    summed = placed.groupBy("region").agg(
        F.count(F.lit(1)).alias("joined"), F.max(F.col("before") + F.col("n")).alias("points"), last.alias("end"), F.min_by("head", "before").alias("begin"))
    state = (F.when(F.col("branch"), BRANCHING).when(F.col("joined") < F.col("ways"), UNJOINED).when(F.col("points") < MIN_POINTS, TOO_FEW).otherwise(RING))
    judged = cut_lineage(counts.join(branches.withColumn("branch", F.lit(True)), "region", "left").join(summed, "region", "left").withColumn(
        "branch", F.coalesce("branch", F.lit(False))).withColumn("joined", F.coalesce("joined", F.lit(0))).withColumn("state", state))
    rings = judged.filter(F.col("state") == RING)
    kept = placed.join(rings.select("region"), "region", "left_semi").select("region", "way", "before", "forward", "n")
    at = F.col("before") + F.when(F.col("forward"), F.col("pos")).otherwise(F.col("n") - 1 - F.col("pos"))
    within = ways.join(kept, ["region", "way"]).withColumn("seq", at).filter((F.col("before") == 0) | (F.col("seq") > F.col("before"))).select(
        "region", "seq", "lat", "lon")
    closing = rings.filter("begin <> end").select("region", F.col("points").alias("seq"), "begin.lat", "begin.lon")
    return within.unionByName(closing), judged.select("region", "ways", "joined", "points", "state")
