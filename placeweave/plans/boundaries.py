"""Registered queries on boundary rings: the lines of a supplier are the points of a ring that is cut into ways, shuffled and turned round."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placeweave.operators import labels as L
from placeweave.operators import rings as G
from placeweave.plans.registry import query, table

WAY_POINTS = 5


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``region, way, pos, lat, lon, role``. Some regions lack a way, have a single way, a side branch, or inner ways to be left out."""
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")
    nodes = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("region"), F.row_number().over(order).cast("bigint").alias("p"),
        F.count(F.lit(1)).over(Window.partitionBy("l_suppkey")).alias("total"))
    last = F.floor((F.col("total") - 1) / WAY_POINTS)
    w, at = F.floor((F.col("p") - 1) / WAY_POINTS), (F.col("p") - 1) % WAY_POINTS
    own = F.struct(w.alias("w"), at.alias("at"))
    joint = F.when(F.col("p") == 1, F.struct(last.alias("w"), (F.col("total") - WAY_POINTS * last).alias("at"))).when(
        at == 0, F.struct((w - 1).alias("w"), F.lit(WAY_POINTS).cast("bigint").alias("at")))
    placed = nodes.withColumn("last", last).withColumn("place", F.explode(F.array_compact(F.array(own, joint)))).select(
        "region", "p", "total", "last", "place.w", "place.at")
    size = F.when(F.col("w") < F.col("last"), WAY_POINTS + 1).otherwise(F.col("total") - WAY_POINTS * F.col("last") + 1)
    turned = (F.col("w") * 7 + F.col("region")) % 3 == 0
    pos = F.when(turned, size - 1 - F.col("at")).otherwise(F.col("at"))
    lat, lon = 16 + F.col("p") / F.lit(1000.0), 107 + (F.col("p") * F.col("p") % 997) / F.lit(1000.0)
    kept = ~((F.col("region") % 7 == 3) & (F.col("w") == 1)) & ~((F.col("region") % 11 == 4) & (F.col("w") > 0))
    stored = placed.filter(kept).select("region", ((F.col("w") * 7919 + F.col("region")) % 1000003).alias("way"), pos.alias("pos"), lat.alias("lat"),
                                        lon.alias("lon"), F.lit("outer").alias("role"))

    def extra(chosen: F.Column, way: int, role: str) -> DataFrame:
        far = F.struct(F.lit(1).cast("bigint").alias("pos"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"))
        near = F.struct(F.lit(0).cast("bigint").alias("pos"), lat.alias("lat"), lon.alias("lon"))
        return nodes.filter(chosen & (F.col("p") == WAY_POINTS + 1)).select(
            "region", F.lit(way).cast("bigint").alias("way"), F.explode(F.array(near, far)).alias("e")).select("region", "way", "e.*", F.lit(role).alias("role"))

    return stored.unionByName(extra(F.col("region") % 13 == 6, 2000000, "outer")).unionByName(extra(F.col("region") % 5 == 0, 2000001, "inner"))


_SQL_WAYS = f"""
nodes AS (
  SELECT l_suppkey AS region, count(*) OVER (PARTITION BY l_suppkey) AS total,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) AS p
  FROM lineitem),
placed AS (
  SELECT region, p, total, (total - 1) // {WAY_POINTS} AS last, (p - 1) // {WAY_POINTS} AS w, (p - 1) % {WAY_POINTS} AS spot FROM nodes
  UNION ALL SELECT region, p, total, (total - 1) // {WAY_POINTS}, (p - 1) // {WAY_POINTS} - 1, {WAY_POINTS} FROM nodes
    WHERE (p - 1) % {WAY_POINTS} = 0 AND p > 1
  UNION ALL SELECT region, p, total, (total - 1) // {WAY_POINTS}, (total - 1) // {WAY_POINTS}, total - {WAY_POINTS} * ((total - 1) // {WAY_POINTS})
  FROM nodes WHERE p = 1),
sized AS (SELECT *, CASE WHEN w < last THEN {WAY_POINTS + 1} ELSE total - {WAY_POINTS} * last + 1 END AS size FROM placed),
ways AS (
  SELECT region, (w * 7919 + region) % 1000003 AS way, CASE WHEN (w * 7 + region) % 3 = 0 THEN size - 1 - spot ELSE spot END AS pos,
         16 + p / 1000.0::DOUBLE AS lat, 107 + (p * p % 997) / 1000.0::DOUBLE AS lon
  FROM sized WHERE NOT (region % 7 = 3 AND w = 1) AND NOT (region % 11 = 4 AND w > 0)
  UNION ALL SELECT region, 2000000, 0, 16 + p / 1000.0::DOUBLE, 107 + (p * p % 997) / 1000.0::DOUBLE FROM nodes WHERE region % 13 = 6
    AND p = {WAY_POINTS + 1}
  UNION ALL SELECT region, 2000000, 1, 0, 0 FROM nodes WHERE region % 13 = 6 AND p = {WAY_POINTS + 1}),
ends AS (
  SELECT region, way, arg_min({{'lat': lat, 'lon': lon}}, pos) AS head, arg_max({{'lat': lat, 'lon': lon}}, pos) AS tail, count(*) AS n,
         count(*) OVER (PARTITION BY region) AS ways, min(way) OVER (PARTITION BY region) AS first
  FROM ways GROUP BY region, way),
branches AS (
  SELECT DISTINCT region FROM (
    SELECT region, point, count(*) AS degree FROM (SELECT region, way, unnest([head, tail]) AS point FROM ends) GROUP BY region, point)
  WHERE degree > 2),
walk AS (
  SELECT region, way, true AS forward, head AS begin, tail AS spot, [way] AS used, 0::BIGINT AS before, n FROM ends WHERE way = first
  UNION ALL
  SELECT w.region, e.way, e.head = w.spot, w.begin, CASE WHEN e.head = w.spot THEN e.tail
    ELSE e.head END, list_append(w.used, e.way), w.before + w.n - 1, e.n
  FROM walk w JOIN ends e ON e.region = w.region AND (e.head = w.spot OR e.tail = w.spot) AND NOT list_contains(w.used, e.way)
  WHERE w.region NOT IN (SELECT region FROM branches)),
reach AS (SELECT region, max(len(used)) AS joined, max(before + n) AS points, arg_max(spot, before) AS last, any_value(begin) AS begin
  FROM walk GROUP BY region),
states AS (
  SELECT r.region, ways, joined, points, last, begin, CASE WHEN r.region IN (SELECT region FROM branches) THEN 'branching'
    WHEN joined < ways THEN 'unjoined'
         WHEN points < 3 THEN 'too_few_points' ELSE 'ring' END AS state
  FROM reach r JOIN (SELECT DISTINCT region, ways FROM ends) USING (region)),
rings AS (
  SELECT k.region, k.before + CASE WHEN k.forward THEN s.pos ELSE k.n - 1 - s.pos END AS seq, s.lat, s.lon
  FROM walk k JOIN states w0 ON w0.region = k.region AND w0.state = 'ring' JOIN ways s ON s.region = k.region AND s.way = k.way
  WHERE k.before = 0 OR CASE WHEN k.forward THEN s.pos ELSE k.n - 1 - s.pos END > 0
  UNION ALL SELECT region, points, begin.lat, begin.lon FROM states WHERE state = 'ring' AND begin <> last)
"""


def _outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ways(spark, sf_dir).filter("role = 'outer'").drop("role")


@query("boundary_rings", f"WITH RECURSIVE {_SQL_WAYS} SELECT region, seq, round(lat, 6) AS lat, round(lon, 6) AS lon FROM rings")
def boundary_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, _ = G.assemble_rings(_outer(spark, sf_dir))
    return points.select("region", "seq", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("boundary_states", f"""WITH RECURSIVE {_SQL_WAYS}
SELECT region, ways, CASE WHEN state <> 'branching' THEN joined END AS joined, CASE
  WHEN state <> 'branching' THEN points END AS points, state FROM states""")
def boundary_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, states = G.assemble_rings(_outer(spark, sf_dir))
    certain = F.col("state") != G.BRANCHING
    return states.select("region", "ways", *[F.when(certain, F.col(c)).alias(c) for c in ("joined", "points")], "state")


_SQL_UNITS = "units AS (SELECT s_nationkey AS area, s_suppkey AS region, CASE WHEN s_suppkey % 9 <> 0 THEN s_suppkey % 4 + 4 END AS level FROM supplier)"


@query("boundary_points", f"""WITH RECURSIVE {_SQL_WAYS}, {_SQL_UNITS},
chosen AS (SELECT area, arg_min(region, {{'l': -coalesce(level, 0), 'r': region}}) AS region FROM units GROUP BY area),
edges AS (
  SELECT region, lat AS lat1, lon AS lon1, coalesce(lead(lat) OVER w, first_value(lat) OVER w) AS lat2,
    coalesce(lead(lon) OVER w, first_value(lon) OVER w) AS lon2
  FROM rings WINDOW w AS (PARTITION BY region ORDER BY seq)),
points AS (
  SELECT c_custkey AS place, region, 16 + (c_custkey * 7919 % 641) / 1000.0::DOUBLE + 0.00025::DOUBLE AS lat, 107 + (c_custkey * 104729 % 997) / 1000.0::DOUBLE + 0.00025::DOUBLE AS lon
  FROM customer JOIN chosen ON c_nationkey = area)
SELECT place, p.region FROM points p JOIN edges e ON e.region = p.region AND (lat1 > p.lat) <> (lat2 > p.lat)
  AND p.lon < (lon2 - lon1) * (p.lat - lat1) / (lat2 - lat1) + lon1
GROUP BY ALL HAVING count(*) % 2 = 1""")
def boundary_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers inside the boundary of their nation's smallest unit, the assembled ring."""
    level = F.when(F.col("s_suppkey") % 9 != 0, F.col("s_suppkey") % 4 + 4)
    units = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("area"), F.col("s_suppkey").alias("region"), level.alias("level"))
    chosen = G.smallest_unit(units)
    rings, _ = G.assemble_rings(_outer(spark, sf_dir).join(chosen.select("region"), "region", "left_semi"))
    key = F.col("c_custkey")
    points = table(spark, sf_dir, "customer").join(chosen, F.col("c_nationkey") == F.col("area")).select(
        key.alias("place"), "region", (16 + (key * 7919 % 641) / F.lit(1000.0) + 0.00025).alias("lat"), (107 + (key * 104729 % 997) / F.lit(1000.0) + 0.00025).alias("lon"))
    return L.within_polygon(points, rings)
