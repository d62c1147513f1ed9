"""Registered queries on trip enumeration, visit slots and their weather."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placeweave.functions import hours
from placeweave.functions import weather_rules as R
from placeweave.operators import legs as G
from placeweave.operators import slots as S
from placeweave.operators import weather
from placeweave.plans.catalogue import _SQL_TEXT, SQL_FLAGS, SQL_HOURLY, _sql_haversine, hourly, places
from placeweave.plans.registry import query, table
from placeweave.plans.routes import _SQL_ZONES, _sql_hits, zones
from placeweave.plans.trips import END, HOTEL, SQL_TRIPS, TODAY, schedules, trip_frames


def wishes(spark: SparkSession, sf_dir: str, accepted: bool | None = None) -> DataFrame:
    """Wished places of the trips; with ``accepted`` only those that some line accepted, or that none did. ``copies`` is how often a place is told."""
    known = places(spark, sf_dir).select(
        "place", "visit_minutes", "indoor_ratio", "unsafe", (F.col("place") % 16).alias("cell"), "lat", "lon", F.count(F.lit(1)).over(Window.partitionBy("place")).alias("copies"))
    lines = schedules(spark, sf_dir)
    if accepted:
        asked = lines.filter("l_returnflag = 'A'").select("trip", "place").distinct()
    elif accepted is None:
        asked = lines.select("trip", "place").distinct()
    else:
        asked = lines.groupBy("trip", "place").agg(F.max(F.coalesce(F.col("l_returnflag") == "A", F.lit(False))).alias("_went")).filter(~F.col("_went")).drop("_went")
    return asked.join(known, "place")


def _slots(spark: SparkSession, sf_dir: str, wished: DataFrame) -> tuple[DataFrame, DataFrame]:
    written = places(spark, sf_dir).select(F.col("place").alias("place_id"), F.expr(_SQL_TEXT).alias("opening_hours_raw"))
    intervals = hours.opening_intervals(written).withColumnRenamed("place_id", "place")
    tier = R.tier(F.col("day") - TODAY)
    open_slots, closed = S.visit_slots(wished, trip_frames(spark, sf_dir), intervals, tier == R.TIER_HOURLY)
    return open_slots.withColumn("tier", tier), closed


def _weathered(spark: SparkSession, sf_dir: str, wished: DataFrame) -> tuple[DataFrame, DataFrame]:
    open_slots, closed = _slots(spark, sf_dir, wished)
    by_hour = hourly(spark, sf_dir)
    daily = weather.daily_weather(by_hour).withColumn("rain_prob", F.col("code").cast("double"))
    return S.slot_weather(open_slots, by_hour, daily), closed


_SQL_SLOTS = f"""{SQL_TRIPS},
wish AS MATERIALIZED (SELECT DISTINCT trip, place FROM tv WHERE place >= 0),
dated AS MATERIALIZED (SELECT w.trip, w.place, fr.day, lo AS dlo, hi AS dhi, size, visit_minutes, indoor_ratio, unsafe, (fr.day + 3) % 7 AS dow,
  CASE WHEN fr.day - {TODAY} < 0 THEN 'none' WHEN fr.day - {TODAY} <= 3 THEN 'hourly' WHEN fr.day - {TODAY} <= 10 THEN 'daily'
    ELSE 'climate' END AS tier
  FROM wish w JOIN fr ON fr.trip = w.trip JOIN places p ON p.place = w.place),
win AS (SELECT *, unnest(CASE WHEN size % 7 = 0 THEN [[0, 1440]] WHEN dow < 5 THEN [[(6 + size % 4) * 60, (14 + size % 6) * 60 + 30]]
  WHEN dow = 5 AND size % 3 = 0 THEN [[480, 720], [780, 915]] ELSE [] END) AS w FROM dated),
span AS (SELECT * FROM (SELECT *, greatest(w[1], dlo) AS a, least(w[2], dhi) - visit_minutes AS b FROM win) WHERE b >= a),
slot AS MATERIALIZED (SELECT trip, place, day, tier, visit_minutes, indoor_ratio, unsafe, a AS lo, b AS hi FROM span WHERE tier <> 'hourly'
  UNION ALL SELECT trip, place, day, tier, visit_minutes, indoor_ratio, unsafe, greatest(a, h * 60), least(b, h * 60 + 59)
    FROM (SELECT *, unnest(range(a // 60, b // 60 + 1)) AS h FROM span WHERE tier = 'hourly'))"""
_SQL_COST = "least((1 - indoor_ratio) * (0.5 * {rain} + 0.5 * least(greatest((temp_c - 32.0) / 6.0, 0.0), 1.0) + 0.2 * least(greatest((wind_kmh - 20.0) / 30.0, 0.0), 1.0)), 1.0)"
_SQL_HIT = "((storm AND list_contains(unsafe, 'bao')) OR (heavy AND list_contains(unsafe, 'mua_lon')) OR (rough AND list_contains(unsafe, 'song_lon')))"
_SQL_FACTOR = "CASE WHEN storm THEN 1.8 WHEN heavy THEN 1.4 WHEN raining THEN 1.2 ELSE 1.0 END"
_SQL_WEATHERED = f"""{_SQL_SLOTS}, {SQL_HOURLY}, {SQL_FLAGS},
dflags AS MATERIALIZED (SELECT *, p >= 5 AS raining, wind_kmh >= 50 OR code IN (95, 96, 99) AS storm, p >= 50
  OR code IN (65, 82) AS heavy, wind_kmh >= 40 AS rough FROM (
  SELECT cell, hour // 24 AS day, sum(precip_mm) AS p, max(temp_c) AS temp_c, max(wind_kmh) AS wind_kmh, max(code) AS code FROM hourly
    GROUP BY ALL)),
stay AS MATERIALIZED (SELECT *, (lo + hi) // 2 AS mid, unnest(range(lo // 60, (hi + visit_minutes - 1) // 60 + 1)) AS h FROM slot
  WHERE tier = 'hourly'),
seen AS MATERIALIZED (SELECT trip, place, day, lo, min(h) FILTER ({_SQL_HIT}) AS blocked_hour,
    sum({_SQL_COST.format(rain="greatest(least(precip_mm / 5.0, 1.0), 0.7 * code / 100.0)")} * share) / nullif(sum(share), 0) AS cost,
    max({_SQL_FACTOR}) FILTER (h = mid // 60) AS factor, max((storm OR heavy)::INT) FILTER (h = mid // 60) = 1 AS stormy
  FROM (SELECT *, greatest(least(mid + visit_minutes, (h + 1) * 60) - greatest(mid, h * 60), 0) / 60.0::DOUBLE AS share FROM stay) s
    JOIN flags f ON f.cell = s.place % 16 AND f.hour = s.day * 24 + h GROUP BY ALL),
judged AS (SELECT s.trip, s.place, s.day, s.tier, s.lo, s.hi, visit_minutes, blocked_hour, blocked_hour IS NOT NULL AS blocked, cost, factor, stormy FROM slot s LEFT JOIN seen USING (trip, place, day, lo) WHERE tier <> 'daily'
  UNION ALL SELECT s.trip, s.place, s.day, tier, lo, hi, visit_minutes, NULL, coalesce({_SQL_HIT}, false), CASE
    WHEN p IS NOT NULL THEN {_SQL_COST.format(rain="greatest(least(p / 30.0, 1.0), 0.7 * code / 100.0)")} END,
    CASE WHEN p IS NULL THEN 1.0 ELSE {_SQL_FACTOR} END, storm OR heavy FROM slot s LEFT JOIN dflags f ON f.cell = s.place % 16
      AND f.day = s.day WHERE tier = 'daily')"""


@query("enumerate_trips", """SELECT n_regionkey AS config, n_name AS scenario, start_day::INT AS start_day, (start_day + n_nationkey % 4)::INT AS end_day FROM (
  SELECT *, unnest(range(19723 + n_regionkey * 10, 19723 + n_regionkey * 10 + 12 - n_nationkey % 4 + 1, 1 + n_nationkey % 3)) AS start_day
    FROM nation)""")
def enumerate_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenarios = table(spark, sf_dir, "nation").select(
        F.col("n_regionkey").alias("config"), F.col("n_name").alias("scenario"), (1 + F.col("n_nationkey") % 4).alias("trip_days"), (1 + F.col("n_nationkey") % 3).alias("step_days"))
    start = 19723 + F.col("r_regionkey") * 10
    periods = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("config"), F.lit(0).alias("period"), start.alias("period_start"), (start + 12).alias("period_end"))
    return S.enumerate_trips(scenarios, periods).drop("period")


@query("visit_slots", f"WITH {_SQL_SLOTS} SELECT trip, place, day::INT AS day, tier, lo::INT AS lo, hi::INT AS hi FROM slot")
def visit_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_slots, _ = _slots(spark, sf_dir, wishes(spark, sf_dir))
    return open_slots.select("trip", "place", "day", "tier", "lo", "hi")


@query("slot_weather", f"""WITH {_SQL_WEATHERED} SELECT trip, place, day::INT AS day, lo::INT AS lo, hi::INT AS hi, blocked, blocked_hour,
  CASE WHEN blocked THEN 0 ELSE round_even(round(coalesce(cost, 0) * 120 * visit_minutes / 60, 9), 0) END::INT AS weather_cost, CASE
    WHEN blocked THEN 1 ELSE coalesce(factor, 1) END::DOUBLE AS factor,
  NOT blocked AND coalesce(stormy, false) AS stormy FROM judged""")
def slot_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = _weathered(spark, sf_dir, wishes(spark, sf_dir).drop("lat", "lon", "copies"))
    return judged.select("trip", "place", "day", "lo", "hi", "blocked", "blocked_hour", "weather_cost", "factor", "stormy")


_SQL_GRAPH = f"""{_SQL_WEATHERED}, {_SQL_ZONES},
taken AS MATERIALIZED (SELECT DISTINCT trip, place FROM tv WHERE l_returnflag = 'A'),
open AS MATERIALIZED (
  SELECT j.trip, j.day, j.place, lo, hi, j.visit_minutes, round_even(round(coalesce(cost, 0) * 120 * j.visit_minutes / 60, 9), 0)::INT AS weather_cost,
         coalesce(factor, 1) AS factor, coalesce(stormy, false) AS stormy, lat, lon
  FROM judged j JOIN taken USING (trip, place) JOIN places p ON p.place = j.place WHERE NOT blocked),
node AS MATERIALIZED (
  SELECT trip, day, 1 AS kind, place, lo, hi, visit_minutes, weather_cost, factor, stormy, lat, lon FROM open
  UNION ALL SELECT trip, day, 0, NULL, lo, hi, 0, 0, 1, false, {HOTEL[0]}, {HOTEL[1]} FROM fr
  UNION ALL SELECT trip, day, 2, NULL, lo, hi, 0, 0, 1, false, {END[0]}, {END[1]} FROM fr),
met AS MATERIALIZED (
  SELECT a.trip, a.day, a.kind AS from_kind, a.place AS from_place, a.lo + a.visit_minutes AS leaves, b.kind AS to_kind, b.place AS to_place, b.hi AS until,
         b.weather_cost, CASE WHEN b.kind = 2 THEN a.factor ELSE b.factor END AS factor, CASE WHEN b.kind = 2 THEN a.stormy
           ELSE b.stormy END AS stormy,
         a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2,
           coalesce(a.place::VARCHAR, 'start') || '>' || coalesce(b.place::VARCHAR, 'end') AS path
  FROM node a JOIN node b ON a.trip = b.trip AND a.day = b.day WHERE a.kind < 2 AND b.kind > 0 AND NOT (a.kind = 1 AND b.kind = 1
    AND a.place = b.place)),
far AS MATERIALIZED (
  SELECT path, {_sql_haversine('a.', 'b.')} / 1000 * 1.3::DOUBLE AS km
  FROM (SELECT path, any_value(lat1) AS lat1, any_value(lon1) AS lon1, any_value(lat2) AS lat2, any_value(lon2) AS lon2 FROM met
    GROUP BY path) d,
       LATERAL (SELECT d.lat1 AS lat, d.lon1 AS lon) a, LATERAL (SELECT d.lat2 AS lat, d.lon2 AS lon) b),
timed AS MATERIALIZED (
  SELECT * FROM (
    SELECT met.*, ceil((ceil(km / speed * 60) + CASE WHEN ceil(km / speed * 60) > 0 THEN 3 ELSE 0 END) * factor)::INT AS minutes
    FROM met JOIN (SELECT DISTINCT trip, speed FROM fr) USING (trip) JOIN far USING (path)) WHERE leaves + minutes <= until),
seg AS MATERIALIZED (SELECT DISTINCT path, lat1, lon1, lat2, lon2 FROM timed WHERE stormy),
{_sql_hits('seg')}, wet AS (SELECT DISTINCT path FROM hits),
legs AS (
  SELECT t.*, stormy AND w.path IS NOT NULL AS flooded, minutes + weather_cost + CASE WHEN stormy AND w.path IS NOT NULL THEN 30
    ELSE 0 END AS cost
  FROM timed t LEFT JOIN wet w USING (path))"""


@query("leg_choices", f"""WITH {_SQL_GRAPH}
SELECT trip, day::INT AS day, from_kind, from_place, to_kind, to_place, count(*) AS slots, min(minutes) AS minutes, min(cost)::INT AS cost,
  count(*) FILTER (flooded) AS flooded
FROM legs GROUP BY trip, day, from_kind, from_place, to_kind, to_place""")
def leg_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legs between the slots of the places that were accepted (``from_kind`` 0 is the day's start, ``to_kind`` 2 its end)."""
    judged, _ = _weathered(spark, sf_dir, wishes(spark, sf_dir, accepted=True))
    # A place that the tables tell twice has its slots twice.
    open_slots = judged.filter(~F.col("blocked")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).drop("copies", "copy")
    return G.leg_choices(G.slot_legs(open_slots, trip_frames(spark, sf_dir), zones(spark, sf_dir)))


@query("unvisited", f"""WITH {_SQL_WEATHERED}, went AS (SELECT DISTINCT trip, place FROM tv WHERE l_returnflag = 'A'),
tried AS (SELECT trip, place, count(*) FILTER (NOT blocked) AS free, count(*) FILTER (blocked) AS avoided FROM judged GROUP BY ALL),
shut AS (SELECT DISTINCT trip, place FROM dated WHERE size % 7 <> 0 AND (dow = 6 OR (dow = 5 AND size % 3 <> 0)))
SELECT w.trip, w.place, CASE WHEN free > 0 THEN 'no_room' WHEN avoided > 0 THEN 'weather' WHEN s.trip IS NOT NULL THEN 'closed'
  ELSE 'too_short' END AS reason, coalesce(avoided, 0) AS avoided
FROM wish w LEFT JOIN tried t ON t.trip = w.trip AND t.place = w.place LEFT JOIN shut s ON s.trip = w.trip AND s.place = w.place
WHERE (w.trip, w.place) NOT IN (SELECT (trip, place) FROM went)""")
def unvisited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schedule holds the lines that were accepted."""
    went = schedules(spark, sf_dir).filter("l_returnflag = 'A'").select("trip", "place").distinct()
    wished = wishes(spark, sf_dir, accepted=False).drop("lat", "lon", "copies")
    judged, closed = _weathered(spark, sf_dir, wished)
    return S.explain_unvisited(wished, judged, closed, went)


@query("request_priority", f"WITH {SQL_TRIPS} SELECT trip, place, 1 - (visit - 1) / (2.0::DOUBLE * count(*) OVER (PARTITION BY trip)) AS priority FROM tv")
def request_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.request_priority(schedules(spark, sf_dir).select("trip", F.col("visit").alias("pos"), "place"))


@query("hour_table", f"""WITH {SQL_HOURLY}, {SQL_FLAGS}, seen AS (SELECT (cell + 1) % 16 AS cell, hour, round_even(precip_mm, 1) AS observed_mm FROM hourly)
SELECT coalesce(f.cell, s.cell) AS cell,
  coalesce(f.hour, s.hour) AS hour, round_even(precip_mm, 1) AS forecast_mm, round_even(temp_c, 0) AS temp_c, round_even(wind_kmh, 0) AS wind_kmh,
  CASE WHEN f.cell IS NOT NULL THEN concat_ws(',', CASE WHEN storm THEN 'bao' END, CASE WHEN heavy THEN 'mua_lon' END, CASE
    WHEN rough THEN 'song_lon' END) END AS hazards, observed_mm
FROM flags f FULL JOIN seen s ON s.cell = f.cell AND s.hour = f.hour WHERE coalesce(f.hour, s.hour) % 24 BETWEEN 6 AND 20""")
def hour_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbouring cell stands in for what was observed."""
    told = hourly(spark, sf_dir)
    return S.hour_table(told, told.withColumn("cell", (F.col("cell") + 1) % 16))
