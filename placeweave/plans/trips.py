"""Registered queries on trip schedules: audit, scoring, travel and the weather to decide by.

Every order is planned twice: as it stands (even ``trip``) and three hours later (odd ``trip``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placeweave.functions import geo, hours
from placeweave.functions import weather_rules as R
from placeweave.operators import trips as T
from placeweave.operators import weather
from placeweave.plans.catalogue import _SQL_TEXT, SQL_FLAGS, SQL_HOURLY, SQL_PLACES, _sql_haversine, hourly, places
from placeweave.plans.registry import query, table

#: Points of our own choosing where the derived trips begin and end.
HOTEL, END = (16.45, 107.57), (16.47, 107.58)
TODAY = 19733


# Views ------------------------------------------------------------------------------------------------------------------


def schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four visits a day in line order; a line of 49 or 50 pieces names a place that does not exist."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus", F.row_number().over(order).alias("visit"))
    slot = F.col("visit") - 1
    return lines.withColumn("variant", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        (F.col("l_orderkey") * 2 + F.col("variant")).alias("trip"), "visit",
        F.when(F.col("l_quantity") >= 49, -1 - F.col("l_partkey")).otherwise(F.col("l_partkey")).alias("place"),
        (19723 + F.col("l_orderkey") % 28 + F.floor(slot / 4)).cast("int").alias("day"),
        (480 + 110 * (slot % 4) + F.col("l_partkey") % 30 + 180 * F.col("variant")).cast("int").alias("arrive"),
        (520 + 110 * (slot % 4) + F.col("l_partkey") % 30 + 180 * F.col("variant") + F.col("l_partkey") % 50).cast("int").alias("leave"),
        "l_returnflag", "l_linestatus")


def trip_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    start = (19723 + key % 28).cast("int")
    mode = F.element_at(F.array(F.lit("motorbike"), F.lit("car"), F.lit("walking")), (key % 3 + 1).cast("int"))
    return table(spark, sf_dir, "orders").withColumn("variant", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        (key * 2 + F.col("variant")).alias("trip"), "variant", F.col("o_orderstatus").alias("scenario"), start.alias("start_day"),
        (start + key % 2).cast("int").alias("end_day"), (480 + 60 * (key % 3)).alias("start_min"), (960 + 60 * (key % 5)).alias("end_min"),
        F.lit(480).alias("day_start"), (1140 + 60 * (key % 3)).alias("day_end"), mode.alias("mode"), (3 + key % 2).alias("max_places"),
        F.when(key % 5 > 0, 1500 * (key % 5)).alias("budget"), (key % 16).alias("cell"),
        F.lit(HOTEL[0]).alias("from_lat"), F.lit(HOTEL[1]).alias("from_lon"), F.lit(END[0]).alias("to_lat"), F.lit(END[1]).alias("to_lon"))


def audited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    here = places(spark, sf_dir)
    prices = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("place"), F.floor("p_retailprice").alias("price"))
    written = here.select(F.col("place").alias("place_id"), F.expr(_SQL_TEXT).alias("opening_hours_raw"))
    intervals = hours.opening_intervals(written).withColumnRenamed("place_id", "place")
    return T.audit_feasibility(schedules(spark, sf_dir), here.join(prices, "place"), trip_frames(spark, sf_dir), intervals)


def grid_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 16 cells of the weather view as a 4 x 4 block that does not reach the northern places."""
    return hourly(spark, sf_dir).withColumns({
        "grid_lat": (162 + F.floor(F.col("cell") / 4)).cast("int"), "grid_lon": (1074 + F.col("cell") % 4).cast("int")})


def _sql_minutes(a: str, b: str) -> str:
    whole = f"ceil({_sql_haversine(a, b)} / 1000 * 1.3::DOUBLE / speed * 60)"
    return f"({whole} + CASE WHEN {whole} > 0 THEN 3 ELSE 0 END)::BIGINT"


SQL_TRIPS = f"""{SQL_PLACES},
tv AS (SELECT trip * 2 + variant AS trip, variant, visit, CASE WHEN l_quantity >= 49 THEN -1 - l_partkey
  ELSE l_partkey END AS place, 19723 + trip % 28 + (visit - 1) // 4 AS day,
    480 + 110 * ((visit - 1) % 4) + l_partkey % 30 + 180 * variant AS arrive, 520 + 110 * ((visit - 1) % 4) + l_partkey % 30 + 180 * variant + l_partkey % 50 AS leave,
    l_returnflag, l_linestatus
      FROM (SELECT l_orderkey AS trip, l_partkey, l_quantity, l_returnflag, l_linestatus, unnest([0, 1]) AS variant, row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) AS visit FROM lineitem)),
tr AS (SELECT o_orderkey * 2 + variant AS trip, variant, o_orderstatus AS scenario, 19723 + o_orderkey % 28 AS start_day, 19723 + o_orderkey % 28 + o_orderkey % 2 AS end_day,
    480 + 60 * (o_orderkey % 3) AS start_min, 960 + 60 * (o_orderkey % 5) AS end_min, 1140 + 60 * (o_orderkey % 3) AS day_end,
    ([25.0, 30.0, 4.5]::DOUBLE[])[o_orderkey % 3 + 1] AS speed, 3 + o_orderkey % 2 AS max_places, CASE
      WHEN o_orderkey % 5 > 0 THEN 1500 * (o_orderkey % 5) END AS budget,
    o_orderkey % 16 AS cell FROM (SELECT *, unnest([0, 1]) AS variant FROM orders)),
fr AS (SELECT trip, speed, max_places, day, CASE WHEN day = start_day THEN greatest(480, start_min) ELSE 480 END AS lo,
    greatest(CASE WHEN day = end_day THEN least(day_end, end_min) ELSE day_end END, CASE WHEN day = start_day THEN greatest(480, start_min)
      ELSE 480 END) AS hi
  FROM (SELECT *, unnest(range(start_day, end_day + 1)) AS day FROM tr))"""

_SQL_AUDIT = f"""{SQL_TRIPS},
fv AS (SELECT tv.*, lo, hi, speed, max_places, lat, lon, size, visit_minutes, indoor_ratio, unsafe, floor(p_retailprice)::BIGINT AS price, (tv.day + 3) % 7 AS dow,
    {HOTEL[0]}::DOUBLE AS flat, {HOTEL[1]}::DOUBLE AS flon, {END[0]}::DOUBLE AS tlat, {END[1]}::DOUBLE AS tlon
  FROM tv LEFT JOIN fr ON fr.trip = tv.trip AND fr.day = tv.day LEFT JOIN places p ON p.place = tv.place
    LEFT JOIN part ON p_partkey = tv.place),
leg AS (SELECT * REPLACE (coalesce(lag(lat) OVER w, flat) AS flat, coalesce(lag(lon) OVER w, flon) AS flon),
  coalesce(lag(leave) OVER w, lo) AS left_at
  FROM fv WHERE lo IS NOT NULL AND lat IS NOT NULL WINDOW w AS (PARTITION BY trip, day ORDER BY arrive, visit)),
timed AS (SELECT *, {_sql_minutes('f', '')} AS need, size % 7 = 0 AS unknown, size % 7 <> 0 AND (dow = 6 OR (dow = 5
  AND size % 3 <> 0)) AS closed,
  CASE WHEN dow < 5 THEN (6 + size % 4) * 60 - 5 <= arrive AND leave <= (14 + size % 6) * 60 + 35 ELSE (475 <= arrive AND leave <= 725)
    OR (775 <= arrive AND leave <= 920) END AS fits FROM leg),
ended AS (SELECT trip, day, lo, hi, speed, max_places, stops, tlat, tlon, coalesce(l.lat, flat) AS lat, coalesce(l.lon, flon) AS lon,
  coalesce(l.leave, lo) AS left_at FROM (
  SELECT trip, day, lo, hi, speed, max_places, tlat, tlon, flat, flon,
    count(*) AS stops, arg_max({{'lat': lat, 'lon': lon, 'leave': leave}}, arrive * 1000 + visit) FILTER (lat IS NOT NULL) AS l
  FROM fv WHERE lo IS NOT NULL GROUP BY ALL)),
bad AS (SELECT trip, 'duplicate' AS kind, NULL::BIGINT AS day, place FROM tv GROUP BY trip, place HAVING count(*) > 1
UNION ALL SELECT DISTINCT trip, 'outside_trip', day, NULL FROM fv WHERE lo IS NULL
UNION ALL SELECT trip, 'unknown_place', day, place FROM fv WHERE lo IS NOT NULL AND lat IS NULL
UNION ALL SELECT trip, 'max_places', day, NULL FROM ended WHERE stops > max_places
UNION ALL SELECT trip, 'day_window', day, NULL FROM ended WHERE left_at + {_sql_minutes('', 't')} > hi + 5
UNION ALL SELECT trip, 'budget', NULL, NULL FROM (SELECT trip, sum(price) AS spent FROM timed GROUP BY trip) JOIN tr USING (trip)
  WHERE spent > budget
UNION ALL SELECT trip, 'travel', day, place FROM timed WHERE arrive + 5 < left_at + need
UNION ALL SELECT trip, 'day_window', day, place FROM timed WHERE arrive < lo - 5 OR leave > hi + 5
UNION ALL SELECT trip, 'visit_too_short', day, place FROM timed WHERE leave - arrive < 0.5 * visit_minutes
UNION ALL SELECT trip, 'closed', day, place FROM timed WHERE closed
UNION ALL SELECT trip, 'opening_hours', day, place FROM timed WHERE NOT unknown AND NOT closed AND NOT fits),
audit AS (SELECT trip, coalesce(v.n, 0) AS visits, coalesce(b.n, 0) AS violations, coalesce(kinds, '') AS kinds,
  coalesce(u.n, 0)::BIGINT AS unverified_hours,
    coalesce(took, 0)::BIGINT AS travel_minutes, coalesce(b.n, 0) = 0 AS feasible FROM tr
  LEFT JOIN (SELECT trip, count(*) AS n FROM tv GROUP BY 1) v USING (trip) LEFT JOIN (SELECT trip,
    count(*) AS n, string_agg(DISTINCT kind, ';' ORDER BY kind) AS kinds FROM bad GROUP BY 1) b USING (trip)
  LEFT JOIN (SELECT trip, count(*) FILTER (unknown) AS n, sum(need) AS took FROM timed GROUP BY 1) u USING (trip))"""

_SQL_RAIN = """
wet AS (SELECT tr.trip, d.day, count(*) FILTER (raining) AS wet
  FROM tr, unnest(range(start_day, end_day + 1)) d(day), unnest(range(8, day_end // 60)) h(hour_no)
  LEFT JOIN flags f ON f.cell = tr.cell AND f.hour = d.day * 24 + hour_no GROUP BY ALL),
rain AS (SELECT trip, sum(wet)::BIGINT AS rain_hours, max(wet) >= 2 AS rainy FROM wet GROUP BY trip)"""

# Audit ------------------------------------------------------------------------------------------------------------------


@query("feasibility", f"WITH {_SQL_AUDIT} SELECT trip, kind, day, place FROM bad")
def feasibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    violations, _ = audited(spark, sf_dir)
    return violations


@query("feasibility_summary", f"WITH {_SQL_AUDIT} SELECT * FROM audit")
def feasibility_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, summary = audited(spark, sf_dir)
    return summary.select("trip", "visits", "violations", "kinds", "unverified_hours", "travel_minutes", "feasible")


@query("violation_kinds", f"WITH {_SQL_AUDIT} SELECT variant::INT AS variant, kind, count(*) AS n FROM bad JOIN tr USING (trip) GROUP BY ALL")
def violation_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    violations, _ = audited(spark, sf_dir)
    return T.violation_kinds(violations, trip_frames(spark, sf_dir).select("trip", "variant"))


@query("trip_windows", f"WITH {SQL_TRIPS} SELECT trip, day::INT AS day, lo AS day_lo, hi AS day_hi FROM fr")
def trip_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.trip_days(trip_frames(spark, sf_dir)).select("trip", "day", "day_lo", "day_hi")


@query("trip_rain", f"WITH {SQL_TRIPS}, {SQL_HOURLY}, {SQL_FLAGS}, {_SQL_RAIN} SELECT * FROM rain")
def trip_rain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.rain_hours(trip_frames(spark, sf_dir), hourly(spark, sf_dir))


_SQL_SCORED = f"""{_SQL_AUDIT}, {SQL_HOURLY}, {SQL_FLAGS}, {_SQL_RAIN},
spent AS (SELECT trip, visit, place % 16 AS cell, day, indoor_ratio, unsafe, arrive, leave, unnest(range(arrive // 60, (leave - 1) // 60 + 1)) AS hour_no FROM fv WHERE lat IS NOT NULL),
outcome AS (SELECT trip, round(sum(rain_h), 3) AS outdoor_rain_hours, sum(hazard)::BIGINT AS hazard_visits, count(*) AS seen FROM (
  SELECT trip, visit, sum(CASE
    WHEN raining THEN (least(leave, (hour_no + 1) * 60) - greatest(arrive, hour_no * 60)) / 60.0::DOUBLE * (1 - indoor_ratio)
    ELSE 0 END) AS rain_h,
    max(CASE WHEN (storm AND list_contains(unsafe, 'bao')) OR (heavy AND list_contains(unsafe, 'mua_lon')) OR (rough
      AND list_contains(unsafe, 'song_lon')) THEN 1 ELSE 0 END) AS hazard
  FROM spent LEFT JOIN flags f ON f.cell = spent.cell AND f.hour = day * 24 + hour_no GROUP BY trip, visit) GROUP BY trip),
scored AS (SELECT scenario, trip, CASE variant WHEN 0 THEN 'early' ELSE 'late' END AS variant, rainy,
  coalesce(outdoor_rain_hours, 0) AS outdoor_rain_hours,
    coalesce(hazard_visits, 0) AS hazard_visits, coalesce(seen, 0) AS visits, travel_minutes, feasible FROM tr JOIN audit USING (trip)
      JOIN rain USING (trip) LEFT JOIN outcome USING (trip))"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, summary = audited(spark, sf_dir)
    known = places(spark, sf_dir).select("place", "indoor_ratio", "unsafe")
    stays = schedules(spark, sf_dir).join(known, "place").withColumns({
        "start_min": F.col("arrive"), "end_min": F.col("leave"), "cell": F.col("place") % 16})
    spent = weather.visit_hours(stays).withColumn("hour", F.col("day") * 24 + F.col("hour_no"))
    outcome = weather.weather_outcome(spent, hourly(spark, sf_dir)).select("trip", "outdoor_rain_hours", "hazard_visits", "visits")
    frames = trip_frames(spark, sf_dir)
    rain = T.rain_hours(frames, hourly(spark, sf_dir)).select("trip", "rainy")
    return frames.select("scenario", "trip", F.when(F.col("variant") == 0, "early").otherwise("late").alias("variant")).join(
        summary.select("trip", "travel_minutes", "feasible"), "trip").join(rain, "trip").join(outcome, "trip", "left").fillna(
        0, ["outdoor_rain_hours", "hazard_visits", "visits"])


@query("variant_scores", f"WITH {_SQL_SCORED} SELECT * FROM scored")
def variant_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir)


@query("experiment_summary", f"""WITH {_SQL_SCORED},
cells AS (SELECT scenario, subset, variant, count(*) AS trips, avg(outdoor_rain_hours) AS rain_hours,
  sum(hazard_visits)::BIGINT AS hazard_visits, avg(visits) AS visits,
    avg(travel_minutes) AS travel_minutes, avg(feasible::INT) AS feasible_share FROM (SELECT *, 'all' AS subset FROM scored
      UNION ALL SELECT *, 'rainy' FROM scored WHERE rainy) GROUP BY ALL)
SELECT scenario, subset, variant, trips, round(rain_hours + 1e-9, 5) AS rain_hours, hazard_visits, round(visits + 1e-9, 5) AS visits,
  round(travel_minutes + 1e-9, 5) AS travel_minutes,
  round(feasible_share + 1e-9, 5) AS feasible_share, round(CASE
    WHEN base > 0 THEN 100 * (rain_hours - base) / base END + 1e-9, 5) AS change_pct
FROM cells LEFT JOIN (SELECT scenario, subset, rain_hours AS base FROM cells WHERE variant = 'early') USING (scenario, subset)""")
def experiment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.summarise_experiment(scored(spark, sf_dir), "early")
    means = ("rain_hours", "visits", "travel_minutes", "feasible_share", "change_pct")
    return out.withColumns({c: F.round(F.col(c) + 1e-9, 5) for c in means})


# Travel -----------------------------------------------------------------------------------------------------------------


@query("travel_table", f"""WITH {SQL_TRIPS},
wished AS MATERIALIZED (SELECT DISTINCT trip, place FROM tv),
stops AS MATERIALIZED (SELECT trip, place, lat, lon FROM wished JOIN places USING (place)),
pairs AS MATERIALIZED (
  SELECT a.trip, a.place AS origin, a.lat AS flat, a.lon AS flon, b.place AS dest, b.lat, b.lon
  FROM stops a JOIN stops b ON a.trip = b.trip WHERE a.place <> b.place),
measured AS MATERIALIZED (SELECT trip, origin, dest, {_sql_haversine('f', '')} / 1000 * 1.3::DOUBLE AS km FROM pairs),
timed AS (SELECT *, ceil(km / 25.0::DOUBLE * 60) AS whole FROM measured)
SELECT trip, origin, dest, round(km, 5) AS km, (whole + CASE WHEN whole > 0 THEN 3 ELSE 0 END)::INT AS minutes FROM timed""")
def travel_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    stops = schedules(spark, sf_dir).select("trip", "place").join(places(spark, sf_dir).select("place", "lat", "lon"), "place")
    return T.travel_table(stops).withColumn("km", F.round("km", 5))


_SQL_LEGS = f"""{SQL_TRIPS},
stops AS MATERIALIZED (SELECT trip, visit, day, arrive, l_linestatus, l_returnflag, p.place, lat, lon FROM tv
  JOIN places p ON p.place = tv.place),
legs AS MATERIALIZED (
  SELECT trip, visit, lag(place) OVER w AS origin, place AS dest, CASE
    WHEN l_linestatus = 'F' THEN arrive END AS minute, l_returnflag AS flag,
         lag(lat) OVER w AS flat, lag(lon) OVER w AS flon, lat, lon, 25.0::DOUBLE AS speed
  FROM stops WINDOW w AS (PARTITION BY trip ORDER BY day, arrive, visit)),
buckets AS MATERIALIZED (SELECT DISTINCT origin, dest, hour, origin % 40 + hour AS took FROM legs, unnest([8, 12, 17]) h(hour)
  WHERE origin IS NOT NULL AND flag <> 'N' AND (flag = 'R' OR hour <> 12))"""


@query("nearest_bucket", f"""WITH {_SQL_LEGS}, near AS MATERIALIZED (
  SELECT trip, visit, arg_min(took, CASE WHEN minute IS NULL THEN hour ELSE abs(hour * 60 - minute) * 100 + hour END) AS took
  FROM legs JOIN buckets USING (origin, dest) GROUP BY trip, visit)
SELECT trip, visit, origin, dest, coalesce(took, {_sql_minutes('f', '')}) AS minutes, CASE WHEN took IS NULL THEN 'estimate'
  ELSE 'measured' END AS travel_source
FROM legs LEFT JOIN near USING (trip, visit) WHERE origin IS NOT NULL""")
def nearest_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legs between visits with the measured time of the nearest departure hour; a third of the legs were never measured."""
    order = Window.partitionBy("trip").orderBy("day", "arrive", "visit")
    stops = schedules(spark, sf_dir).join(places(spark, sf_dir).select("place", "lat", "lon"), "place")
    legs = stops.withColumns({"origin": F.lag("place").over(order), "_lat": F.lag("lat").over(order), "_lon": F.lag("lon").over(order)}).filter(
        "origin IS NOT NULL").select(
        "trip", "visit", "origin", F.col("place").alias("dest"), F.when(F.col("l_linestatus") == "F", F.col("arrive")).alias("minute"), "l_returnflag",
        geo.road_km(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")).alias("km"), F.lit(geo.DEFAULT_MODE).alias("mode"))
    hour = F.explode(F.when(F.col("l_returnflag") == "R", F.array(F.lit(8), F.lit(12), F.lit(17))).when(F.col("l_returnflag") == "A", F.array(F.lit(8), F.lit(17))))
    buckets = legs.select("origin", "dest", hour.alias("hour")).withColumn("minutes", F.col("origin") % 40 + F.col("hour"))
    return T.travel_at(legs, buckets).select("trip", "visit", "origin", "dest", "minutes", "travel_source")


# Weather to decide by ---------------------------------------------------------------------------------------------------


@query("weather_at", f"""WITH {SQL_TRIPS}, {SQL_HOURLY}, grid AS (SELECT *, 162 + cell // 4 AS glat, 1074 + cell % 4 AS glon FROM hourly),
daily AS (SELECT glat, glon, hour // 24 AS day, sum(precip_mm) AS precip_mm, max(code) AS code FROM grid GROUP BY ALL),
points AS (SELECT trip, visit, round_even(lat / 0.1::DOUBLE, 0)::INT AS plat, round_even(lon / 0.1::DOUBLE, 0)::INT AS plon, day, day * 24 + arrive // 60 AS hour, day - {TODAY} AS lead
  FROM tv JOIN places USING (place)),
near AS (SELECT plat, plon, glat, glon FROM (SELECT DISTINCT plat, plon FROM points), (SELECT DISTINCT glat, glon FROM grid)
  QUALIFY row_number() OVER (PARTITION BY plat, plon ORDER BY (plat - glat) ** 2 + (plon - glon) ** 2, glat, glon) = 1),
placed AS (SELECT p.*, glat, glon, CASE WHEN lead < 0 THEN 'none' WHEN lead <= 3 THEN 'hourly' WHEN lead <= 10 THEN 'daily'
  ELSE 'climate' END AS tier FROM points p JOIN near USING (plat, plon))
SELECT trip, visit, tier, glat AS cell_lat, glon AS cell_lon, round(CASE tier WHEN 'hourly' THEN h.precip_mm
  WHEN 'daily' THEN d.precip_mm END, 5) AS precip_mm,
  CASE tier WHEN 'hourly' THEN h.code WHEN 'daily' THEN d.code END AS code
FROM placed LEFT JOIN grid h USING (glat, glon, hour) LEFT JOIN daily d ON d.glat = placed.glat AND d.glon = placed.glon
  AND d.day = placed.day""")
def weather_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    table_h = grid_hourly(spark, sf_dir)
    table_d = weather.daily_weather(table_h.withColumn("cell", F.struct("grid_lat", "grid_lon"))).select("cell.*", "day", "precip_mm", "code")
    points = schedules(spark, sf_dir).join(places(spark, sf_dir).select("place", "lat", "lon"), "place").select(
        "trip", "visit", geo.cell(F.col("lat")).alias("grid_lat"), geo.cell(F.col("lon")).alias("grid_lon"), "day",
        (F.col("day") * 24 + F.floor(F.col("arrive") / 60)).alias("hour"), R.tier(F.col("day") - TODAY).alias("tier"))
    return T.weather_at(points, table_h, table_d, ["precip_mm", "code"]).select(
        "trip", "visit", "tier", "cell_lat", "cell_lon", F.round("precip_mm", 5).alias("precip_mm"), "code")


@query("weather_resolved", f"""WITH {SQL_TRIPS}, {SQL_HOURLY},
told AS (SELECT cell, hour + 24 AS hour, precip_mm, temp_c FROM hourly),
daily AS (SELECT cell, hour // 24 AS day, sum(precip_mm) AS precip_mm, max(temp_c) AS temp_c FROM told GROUP BY ALL),
normal AS (SELECT cell, month(DATE '1970-01-01' + day::INT) AS month, avg(precip_mm) AS precip_mm, avg(temp_mean) AS temp_c
  FROM (SELECT cell, hour // 24 AS day, sum(precip_mm) AS precip_mm, avg(temp_c) AS temp_mean FROM hourly GROUP BY ALL) GROUP BY ALL),
points AS (SELECT trip, visit, place % 20 AS cell, day, day * 24 + arrive // 60 AS hour, month(DATE '1970-01-01' + day::INT) AS month, day - {TODAY} AS lead FROM tv JOIN places USING (place))
SELECT trip, visit, round(CASE WHEN o.cell IS NOT NULL THEN o.precip_mm WHEN h.cell IS NOT NULL THEN h.precip_mm
  WHEN d.cell IS NOT NULL THEN d.precip_mm ELSE n.precip_mm END, 5) AS precip_mm,
  round(CASE WHEN o.cell IS NOT NULL THEN o.temp_c WHEN h.cell IS NOT NULL THEN h.temp_c WHEN d.cell IS NOT NULL THEN d.temp_c
    ELSE n.temp_c END, 5) AS temp_c,
  CASE WHEN o.cell IS NOT NULL THEN 'observed' WHEN h.cell IS NOT NULL THEN 'hourly' WHEN d.cell IS NOT NULL THEN 'daily'
    WHEN n.cell IS NOT NULL THEN 'climate' END AS source
FROM points p LEFT JOIN hourly o ON lead < 0 AND o.cell = p.cell AND o.hour = p.hour LEFT JOIN told h ON lead BETWEEN 0 AND 3
  AND h.cell = p.cell AND h.hour = p.hour
LEFT JOIN daily d ON lead BETWEEN 0 AND 10 AND d.cell = p.cell AND d.day = p.day LEFT JOIN normal n ON n.cell = p.cell
  AND n.month = p.month""")
def weather_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days past as observed, days ahead as forecast by the hour or the day, and the climate of the month where nothing else is known."""
    observed = hourly(spark, sf_dir)
    told = observed.withColumn("hour", F.col("hour") + 24)
    month = F.month(F.date_from_unix_date(F.col("day").cast("int")))
    normals = weather.climate_normals(weather.daily_weather(observed), month)
    points = schedules(spark, sf_dir).join(places(spark, sf_dir).select("place"), "place").select(
        F.struct("trip", "visit").alias("point"), (F.col("place") % 20).alias("cell"), "day", (F.col("day") * 24 + F.floor(F.col("arrive") / 60)).alias("hour"), month.alias("month"))
    lead = F.col("day") - TODAY
    sources = [("observed", "hour", observed, lead < 0), ("hourly", "hour", told, (lead >= 0) & (R.tier(lead) == R.TIER_HOURLY)),
               ("daily", "day", weather.daily_weather(told), (lead >= 0) & (lead <= 10)), ("climate", "month", normals, None)]
    return weather.resolve_weather(points, sources, ["precip_mm", "temp_c"]).select(
        "point.trip", "point.visit", F.round("precip_mm", 5).alias("precip_mm"), F.round("temp_c", 5).alias("temp_c"), "source")


@query("trip_tiers", f"""WITH {SQL_TRIPS}, {SQL_HOURLY}, noon AS (SELECT DISTINCT hour // 24 AS day FROM hourly WHERE hour % 24 = 12), led AS (SELECT trip, day, day - {TODAY} AS lead FROM fr)
SELECT trip, day::INT AS day, lead::INT AS lead, CASE WHEN lead < 0 THEN 'none' WHEN lead > 10 THEN 'climate' WHEN day NOT IN (SELECT day
  FROM noon) THEN 'none' WHEN lead <= 3 THEN 'hourly' ELSE 'daily' END AS tier,
  CASE WHEN lead < 0 THEN 'past' WHEN lead <= 10 AND day NOT IN (SELECT day FROM noon) THEN 'no_forecast' END AS reason FROM led""")
def trip_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = T.trip_days(trip_frames(spark, sf_dir)).select("trip", "day")
    return T.tier_days(days, hourly(spark, sf_dir), F.lit(TODAY)).select("trip", "day", "lead", "tier", "reason")


@query("fresh_cells", """WITH f AS (SELECT user_id AS cell, epoch_us(ts) // 3600000000 AS hour, min(1706140800 - regexp_extract(props, '"k": *(\\d+)', 1)::BIGINT * 240) AS fetched_s FROM events GROUP BY 1, 2),
ahead AS (SELECT * FROM f WHERE hour * 3600 >= 1706140800 - 3600)
SELECT cell, hour, fetched_s FROM ahead WHERE cell IN (SELECT cell FROM ahead GROUP BY cell HAVING 1706140800 - min(fetched_s) <= 21600)""")
def fresh_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = 1706140800
    age = F.get_json_object("props", "$.k").cast("bigint") * 240
    rows = table(spark, sf_dir, "events").groupBy(
        F.col("user_id").alias("cell"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("hour")).agg(F.min(now - age).alias("fetched_s"))
    return T.fresh_cells(rows, now)
