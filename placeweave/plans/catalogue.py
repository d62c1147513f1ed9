"""Registered queries on places, opening hours, weather and trips, over views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placeweave.functions import geo, hours
from placeweave.functions import weather_rules as R
from placeweave.operators import matching, weather
from placeweave.operators.scale import latest_per_key
from placeweave.plans.registry import query, table

CENTRE, CORE_KM = (16.4698, 107.5796), 15.0
#: The sources of the fixtures have no same-name pair within the usual 150 m.
MATCH_RADIUS_M = 3000.0


# Views ------------------------------------------------------------------------------------------------------------------


def _lat(key: F.Column) -> F.Column:
    return F.lit(16.335) + (key * 7919 % 2701) / F.lit(10000.0)


def _lon(key: F.Column) -> F.Column:
    return F.lit(107.435) + (key * 104729 % 2901) / F.lit(10000.0)


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    unsafe = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("bao"))).when(
        F.col("p_size") % 3 == 1, F.array(F.lit("mua_lon"), F.lit("song_lon"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "part").select(
        key.alias("place"), F.col("p_name").alias("name"), _lat(key).alias("lat"), _lon(key).alias("lon"),
        ((F.col("p_size") % 11) / 10.0).alias("indoor_ratio"), (30 + 15 * (F.col("p_size") % 7)).alias("visit_minutes"),
        unsafe.alias("unsafe"), F.col("p_size").alias("size"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    events = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 16).alias("cell"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("hour"), "value", k.alias("k"))
    return events.groupBy("cell", "hour").agg(
        F.round(F.sum("value") / 20, 6).alias("precip_mm"), F.round(F.max("k") * F.lit(0.6), 6).alias("wind_kmh"),
        F.round(20 + F.avg(F.col("k") % 20), 6).alias("temp_c"), F.max("k").alias("code")).withColumns(
        {"rain_prob": F.col("code").cast("double"), "period_h": F.lit(1)})


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order = trip on a day of January 2024, line item = visit, every 90 minutes from 08:00."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    seq = F.row_number().over(order)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trip"), F.col("l_partkey").alias("place"), seq.alias("visit"))
    known = places(spark, sf_dir).select("place", "lat", "lon", "indoor_ratio", "visit_minutes", "unsafe")
    start = 480 + 90 * (F.col("visit") - 1)
    return lines.join(known, "place").withColumns({
        "start_min": start, "end_min": start + F.col("visit_minutes"), "day": F.lit(19723) + F.col("trip") % 28, "cell": F.col("place") % 16})


SQL_PLACES = """
places AS (SELECT p_partkey AS place, p_name AS name, p_size AS size,
  16.335::DOUBLE + (p_partkey * 7919 % 2701) / 10000.0::DOUBLE AS lat, 107.435::DOUBLE + (p_partkey * 104729 % 2901) / 10000.0::DOUBLE AS lon,
  (p_size % 11) / 10.0::DOUBLE AS indoor_ratio, 30 + 15 * (p_size % 7) AS visit_minutes,
  CASE p_size % 3 WHEN 0 THEN ['bao'] WHEN 1 THEN ['mua_lon', 'song_lon'] ELSE [] END AS unsafe FROM part)"""
SQL_HOURLY = r"""
hourly AS (SELECT cell, hour, round(sum(value) / 20, 6) AS precip_mm, round(max(k) * 0.6::DOUBLE, 6) AS wind_kmh,
    round(20 + avg(k % 20), 6) AS temp_c, max(k) AS code FROM (
  SELECT user_id % 16 AS cell, epoch_us(ts) // 3600000000 AS hour, value, regexp_extract(props, '"k": *(\d+)', 1)::INT AS k FROM events)
  GROUP BY cell, hour)"""
SQL_FLAGS = """
flags AS (SELECT *, precip_mm >= 0.5 AS raining, wind_kmh >= 50 OR code IN (95, 96, 99) AS storm,
  precip_mm >= 7.5 OR code IN (65, 82) AS heavy, wind_kmh >= 40 AS rough FROM hourly)"""
SQL_VISITS = """
visits AS (SELECT trip, l.place, visit, p.*, 480 + 90 * (visit - 1) AS start_min, 480 + 90 * (visit - 1) + visit_minutes AS end_min,
    19723 + trip % 28 AS day, l.place % 16 AS cell FROM (
  SELECT l_orderkey AS trip, l_partkey AS place, row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS visit FROM lineitem) l
  JOIN (SELECT place AS part_place, lat, lon, indoor_ratio, visit_minutes, unsafe FROM places) p ON part_place = l.place)"""


def _sql_haversine(a: str, b: str) -> str:
    return (f"2 * 6371000.0::DOUBLE * asin(least(1.0, sqrt(pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * "
            f"cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))))")


# Places -----------------------------------------------------------------------------------------------------------------


@query("core_filter", f"""WITH {SQL_PLACES}, centre AS (SELECT {CENTRE[0]}::DOUBLE AS lat, {CENTRE[1]}::DOUBLE AS lon),
far AS (SELECT p.place, {_sql_haversine('p.', 'c.')} AS d FROM places p, centre c)
SELECT place, round(d, 3) AS distance_m FROM far WHERE d <= {CORE_KM * 1000}""")
def core_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places within the core radius; the bounding box around it comes first, as plain range predicates."""
    reach_lat = geo.degrees_for(CORE_KM * 1000) * 1.001
    box = F.col("lat").between(CENTRE[0] - reach_lat, CENTRE[0] + reach_lat) & F.col("lon").between(
        CENTRE[1] - 1.1 * reach_lat, CENTRE[1] + 1.1 * reach_lat)
    d = geo.haversine_m(F.lit(CENTRE[0]), F.lit(CENTRE[1]), F.col("lat"), F.col("lon"))
    return places(spark, sf_dir).filter(box).select("place", d.alias("d")).filter(F.col("d") <= CORE_KM * 1000).select(
        "place", F.round("d", 3).alias("distance_m"))


def _sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Even and odd parts as two sources that spell names in their own way, know some of the hours and websites, and tag differently."""
    even = F.col("id") % 2 == 0
    name = F.when(F.col("id") % 6 == 0, F.concat(F.lit("Chùa "), "name")).when(even, F.upper("name")).when(
        F.col("id") % 5 == 1, F.concat(F.lit("Nhà hàng  "), F.initcap("name"), F.lit("!"))).otherwise(F.col("name"))
    every = places(spark, sf_dir).withColumnRenamed("place", "id")
    tagged = every.select(
        "id", name.alias("name"), "lat", "lon", F.when(F.col("size") % 3 == 0, "Mo-Fr 08:00-17:00").when(F.col("size") % 3 == 1, "").alias("opening_hours_raw"),
        F.when(F.col("size") % 4 != 0, F.concat(F.lit("https://example.org/"), F.col("id").cast("string"))).alias("website"),
        F.when(even, F.create_map(F.lit("size"), F.col("size").cast("string"), F.lit("a"), F.lit("1"))).otherwise(
            F.create_map(F.lit("size"), F.col("size").cast("string"), F.lit("b"), F.lit("2"))).alias("tags"))
    return tagged.filter("id % 2 = 0"), tagged.filter("id % 2 = 1")


_SQL_NAMED = """CASE WHEN place % 6 = 0 THEN 'Chùa ' || name WHEN place % 2 = 0 THEN upper(name)
  WHEN place % 5 = 1 THEN 'Nhà hàng  ' || upper(string_split(name, ' ')[1][1]) || string_split(name, ' ')[1][2:] || ' ' || upper(string_split(name, ' ')[2][1]) || string_split(name, ' ')[2][2:] || '!'
  ELSE name END"""
_SQL_MATCHES = f"""
pairs AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY d, id_a, id_b) AS i FROM (
  SELECT a.name, a.place AS id_a, b.place AS id_b, {_sql_haversine('a.', 'b.')} AS d
  FROM places a JOIN places b ON a.name = b.name AND a.place % 2 = 0 AND b.place % 2 = 1) WHERE d < {MATCH_RADIUS_M}),
walk AS (
  SELECT name, 0::BIGINT AS i, []::BIGINT[] AS used_a, []::BIGINT[] AS used_b FROM (SELECT DISTINCT name FROM pairs)
  UNION ALL
  SELECT w.name, p.i,
    CASE WHEN list_contains(used_a, id_a) OR list_contains(used_b, id_b) THEN used_a ELSE list_append(used_a, id_a) END,
    CASE WHEN list_contains(used_a, id_a) OR list_contains(used_b, id_b) THEN used_b ELSE list_append(used_b, id_b) END
  FROM walk w JOIN pairs p ON p.name = w.name AND p.i = w.i + 1),
chosen AS (SELECT unnest(used_a) AS id_a, unnest(used_b) AS id_b
  FROM (SELECT name, arg_max(used_a, i) AS used_a, arg_max(used_b, i) AS used_b FROM walk GROUP BY name)),
matches AS (SELECT c.id_a, c.id_b, p.d FROM chosen c JOIN pairs p USING (id_a, id_b))"""


@query("entity_matches", f"WITH RECURSIVE {SQL_PLACES}, {_SQL_MATCHES} SELECT id_a, id_b, round(d, 3) AS distance_m FROM matches")
def entity_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_places(*_sources(spark, sf_dir), MATCH_RADIUS_M).withColumn("distance_m", F.round("distance_m", 3))


@query("entity_merged", f"""WITH RECURSIVE {SQL_PLACES}, {_SQL_MATCHES},
fact AS (
  SELECT place, {_SQL_NAMED} AS name, lat, lon, size, CASE size % 3 WHEN 0 THEN 'Mo-Fr 08:00-17:00' WHEN 1 THEN '' END AS hours,
         CASE WHEN size % 4 <> 0 THEN 'https://example.org/' || place END AS website FROM places)
SELECT a.place AS place_key, CASE WHEN id_b IS NULL THEN a.place::VARCHAR ELSE a.place || ',' || id_b END AS ids, a.name,
  round(a.lat, 6) AS lat, round(a.lon, 6) AS lon,
  coalesce(nullif(b.hours, ''), a.hours) AS opening_hours_raw, coalesce(b.website, a.website) AS website,
  CASE WHEN id_b IS NOT NULL THEN 'a=1,b=2,size=' || b.size WHEN a.place % 2 = 0 THEN 'a=1,size=' || a.size
    ELSE 'b=2,size=' || a.size END AS tags
FROM fact a LEFT JOIN matches ON a.place = id_a LEFT JOIN fact b ON b.place = id_b WHERE a.place % 2 = 0 OR a.place NOT IN (SELECT id_b
  FROM matches)""")
def entity_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sources(spark, sf_dir)
    merged = matching.merge_places(a, b, matching.match_places(a, b, MATCH_RADIUS_M))
    tags = F.array_join(F.array_sort(F.transform(F.map_entries("tags"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return merged.select("place_key", F.array_join("ids", ",").alias("ids"), "name", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"),
                         "opening_hours_raw", "website", tags.alias("tags"))


@query("entity_review", f"""WITH RECURSIVE {SQL_PLACES}, {_SQL_MATCHES}, side AS (SELECT *, {_SQL_NAMED} AS told, CASE place % 2 WHEN 0 THEN 'a' ELSE 'b' END AS side FROM places)
SELECT s.side, s.place AS id, s.told AS name, count(*) AS candidates FROM side s JOIN side o ON o.name = s.name AND o.side <> s.side
WHERE s.place NOT IN (SELECT id_a FROM matches UNION ALL SELECT id_b FROM matches) GROUP BY ALL""")
def entity_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sources(spark, sf_dir)
    return matching.review_names(a, b, matching.match_places(a, b, MATCH_RADIUS_M))


_SQL_TEXT = """CASE WHEN size % 7 = 0 THEN 'by appointment' ELSE
  'Mo-Fr 0' || (6 + size % 4) || ':00-1' || (4 + size % 6) || ':30' || CASE WHEN size % 3 = 0 THEN '; Sa 08:00-12:00,13:00-15:15'
    ELSE '' END END"""


@query("opening_intervals", f"""WITH {SQL_PLACES}, days AS (SELECT unnest(range(0, 5)) AS dow)
SELECT place AS place_id, true AS parse_ok, dow::INT AS dow, (6 + size % 4) * 60 AS open_min, (14 + size % 6) * 60 + 30 AS close_min
  FROM places, days WHERE size % 7 <> 0
UNION ALL SELECT place, true, 5, 480, 720 FROM places WHERE size % 7 <> 0 AND size % 3 = 0
UNION ALL SELECT place, true, 5, 780, 915 FROM places WHERE size % 7 <> 0 AND size % 3 = 0
UNION ALL SELECT place, false, NULL, NULL, NULL FROM places WHERE size % 7 = 0""")
def opening_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = places(spark, sf_dir).select(F.col("place").alias("place_id"), F.expr(_SQL_TEXT).alias("opening_hours_raw"))
    return hours.opening_intervals(written).select("place_id", "parse_ok", "dow", "open_min", "close_min")


# Weather ----------------------------------------------------------------------------------------------------------------


@query("daily_weather", f"""WITH {SQL_HOURLY}
SELECT cell, hour // 24 AS day, round(sum(precip_mm), 5) AS precip_mm, max(temp_c) AS temp_c, max(wind_kmh) AS wind_kmh, max(code) AS code
FROM hourly GROUP BY ALL""")
def daily_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weather.daily_weather(hourly(spark, sf_dir)).select(
        "cell", "day", F.round("precip_mm", 5).alias("precip_mm"), "temp_c", "wind_kmh", "code")


@query("climate_normals", f"""WITH {SQL_HOURLY},
daily AS (SELECT cell, hour // 24 AS day, sum(precip_mm) AS p, avg(temp_c) AS t, max(wind_kmh) AS w FROM hourly GROUP BY ALL)
SELECT cell, month(DATE '1970-01-01' + day::INT)::INT AS month, round(avg(t) + 1e-9, 5) AS temp_c, round(avg(p) + 1e-9, 5) AS precip_mm,
  round(avg(w) + 1e-9, 5) AS wind_kmh, round(avg(CASE WHEN p >= 1 THEN 1.0 ELSE 0.0 END) + 1e-9, 5) AS rain_days FROM daily GROUP BY ALL""")
def climate_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The added 1e-9 settles ties at the fifth decimal alike, whatever order the days are summed in."""
    daily = weather.daily_weather(hourly(spark, sf_dir))
    out = weather.climate_normals(daily, F.month(F.date_from_unix_date(F.col("day").cast("int"))))
    return out.select("cell", "month", *[F.round(F.col(c) + 1e-9, 5).alias(c) for c in ("temp_c", "precip_mm", "wind_kmh", "rain_days")])


@query("weather_rules", f"""WITH {SQL_HOURLY}, {SQL_FLAGS},
scores AS (SELECT *, greatest(least(precip_mm / 5.0, 1.0), 0.7 * code / 100.0) AS rain_score,
  least(greatest((temp_c - 32.0) / 6.0, 0.0), 1.0) AS heat_score, least(greatest((wind_kmh - 20.0) / 30.0, 0.0), 1.0) AS wind_score
    FROM flags)
SELECT cell, hour, raining, storm, concat_ws(',', CASE WHEN storm THEN 'bao' END, CASE WHEN heavy THEN 'mua_lon' END, CASE
  WHEN rough THEN 'song_lon' END) AS hazards,
  round(rain_score, 9) AS rain_score, round(heat_score, 9) AS heat_score, round(wind_score, 9) AS wind_score,
  round(least((1.0 - (code % 11) / 10.0) * (0.5 * rain_score + 0.5 * heat_score + 0.2 * wind_score), 1.0), 9)::DOUBLE AS cost,
  CASE WHEN storm THEN 1.8 WHEN heavy THEN 1.4 WHEN raining THEN 1.2 ELSE 1.0 END::DOUBLE AS travel_factor FROM scores""")
def weather_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    nothing = F.create_map().cast("map<string,double>")
    return hourly(spark, sf_dir).select(
        "cell", "hour", R.is_raining().alias("raining"), R.is_storm().alias("storm"), F.array_join(R.hazards(), ",").alias("hazards"),
        F.round(R.rain_score(), 9).alias("rain_score"), F.round(R.heat_score(), 9).alias("heat_score"), F.round(R.wind_score(), 9).alias("wind_score"),
        F.round(R.weather_cost((F.col("code") % 11) / 10.0, nothing), 9).alias("cost"), R.travel_factor().alias("travel_factor"))


@query("cells_dedupe", """WITH rows AS (SELECT round(16 + (user_id * 7919 % 300) / 1000.0::DOUBLE, 4) AS lat, epoch_us(ts) // 3600000000 AS hour, ts, event_id, value FROM events)
SELECT lat_cell, hour, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY lat_cell, hour ORDER BY ts DESC, event_id DESC) AS n
  FROM (
  SELECT *, round_even(lat * 10, 0)::INT AS lat_cell FROM rows)) WHERE n = 1""")
def cells_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat = F.round(F.lit(16.0) + (F.col("user_id") * 7919 % 300) / F.lit(1000.0), 4)
    rows = table(spark, sf_dir, "events").select(
        F.rint(lat * 10).cast("int").alias("lat_cell"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("hour"),
        F.col("ts").alias("fetched_at"), "event_id", "value")
    return latest_per_key(rows, ["lat_cell", "hour"], ["fetched_at", "event_id"]).select("lat_cell", "hour", "event_id", "value")


@query("lead_tiers", """SELECT o_orderkey AS trip, CASE WHEN lead < 0 THEN 'none' WHEN lead <= 3 THEN 'hourly' WHEN lead <= 10 THEN 'daily' ELSE 'climate' END AS tier
FROM (SELECT o_orderkey, o_orderkey % 20 - 4 AS lead FROM orders)""")
def lead_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trip"), R.tier(F.col("o_orderkey") % 20 - 4).alias("tier"))


# Trips ------------------------------------------------------------------------------------------------------------------


@query("visit_hours", f"""WITH {SQL_PLACES}, {SQL_VISITS}, h AS (SELECT trip, visit, start_min, end_min, unnest(range(start_min // 60, (end_min - 1) // 60 + 1)) AS hour_no FROM visits)
SELECT trip, visit, hour_no, round((least(end_min, (hour_no + 1) * 60) - greatest(start_min, hour_no * 60)) / 60.0::DOUBLE, 5) AS overlap_h
  FROM h""")
def visit_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weather.visit_hours(visits(spark, sf_dir)).select("trip", "visit", "hour_no", F.round("overlap_h", 5).alias("overlap_h"))


@query("weather_outcome", f"""WITH {SQL_PLACES}, {SQL_VISITS}, {SQL_HOURLY}, {SQL_FLAGS},
h AS (SELECT *, unnest(range(start_min // 60, (end_min - 1) // 60 + 1)) AS hour_no FROM visits),
seen AS (SELECT h.*, (least(end_min, (hour_no + 1) * 60) - greatest(start_min, hour_no * 60)) / 60.0::DOUBLE AS overlap_h, f.cell IS NOT NULL AS known,
  coalesce(raining, false) AS wet, (coalesce(storm, false) AND list_contains(unsafe, 'bao')) OR (coalesce(heavy, false)
    AND list_contains(unsafe, 'mua_lon'))
  OR (coalesce(rough, false) AND list_contains(unsafe, 'song_lon')) AS hit
  FROM h LEFT JOIN flags f ON f.cell = h.cell AND f.hour = h.day * 24 + h.hour_no),
per_visit AS (SELECT trip, visit, sum(CASE WHEN wet THEN overlap_h * (1 - indoor_ratio) ELSE 0 END) AS rain_h, max(hit::INT) AS hazard,
  sum((NOT known)::INT) AS unseen FROM seen GROUP BY ALL)
SELECT trip, round(sum(rain_h), 3) AS outdoor_rain_hours, sum(hazard)::BIGINT AS hazard_visits, sum(unseen)::BIGINT AS unobserved_hours,
  count(*) AS visits FROM per_visit GROUP BY trip""")
def weather_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    spent = weather.visit_hours(visits(spark, sf_dir)).withColumn("hour", F.col("day") * 24 + F.col("hour_no"))
    return weather.weather_outcome(spent, hourly(spark, sf_dir))


@query("fill_travel", f"""WITH {SQL_PLACES}, {SQL_VISITS}, legs AS (
  SELECT trip, visit, place, lat, lon, lag(place) OVER w AS from_place, lag(lat) OVER w AS flat, lag(lon) OVER w AS flon
    FROM visits WINDOW w AS (PARTITION BY trip ORDER BY start_min, visit)),
km AS (SELECT *, {_sql_haversine('f', '').replace('fl', 'fl')} / 1000 * 1.3::DOUBLE AS km FROM legs WHERE from_place IS NOT NULL)
SELECT trip, visit, from_place, place, round(km, 5) AS km, CASE WHEN ceil(km / {geo.SPEED_KMH[geo.DEFAULT_MODE]}::DOUBLE * 60) > 0
  THEN (ceil(km / {geo.SPEED_KMH[geo.DEFAULT_MODE]}::DOUBLE * 60) + {geo.BUFFER_MINUTES})::INT ELSE 0 END AS minutes FROM km""")
def fill_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("trip").orderBy("start_min", "visit")
    legs = visits(spark, sf_dir).select("trip", "visit", "place", "lat", "lon", F.lag("place").over(order).alias("from_place"),
                                        F.lag("lat").over(order).alias("flat"), F.lag("lon").over(order).alias("flon")).filter("from_place IS NOT NULL")
    km = geo.road_km(F.col("flat"), F.col("flon"), F.col("lat"), F.col("lon"))
    return legs.withColumn("km", km).select(
        "trip", "visit", "from_place", "place", F.round("km", 5).alias("km"), geo.travel_minutes(F.col("km"), F.lit(geo.DEFAULT_MODE)).alias("minutes"))


@query("latest_raw", """SELECT event_type AS source, user_id AS key, event_id, sha256(props) AS content_hash FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def latest_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("user_id").alias("key"), "ts", "event_id", "props")
    newest = latest_per_key(raw, ["source", "key"], ["ts", "event_id"])
    return newest.select("source", "key", "event_id", F.sha2("props", 256).alias("content_hash"))


@query("label_agreement", """WITH rule AS (SELECT doc_id, CASE WHEN regexp_matches(text, '!! |[$#%&*]{3}| \\| ') THEN 0.0 ELSE 1.0 END AS auto FROM documents)
SELECT count(*) FILTER (abs(auto - quality) <= 0.2) AS matched, count(*) AS total,
  round(count(*) FILTER (abs(auto - quality) <= 0.2) / count(*)::DOUBLE, 5) AS ratio
FROM labels JOIN rule USING (doc_id)""")
def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of manual labels that a text rule meets within 0.2; 0 when there is no label."""
    auto = F.when(F.col("text").rlike(r"!! |[$#%&*]{3}| \| "), 0.0).otherwise(1.0)
    rule = table(spark, sf_dir, "documents").select("doc_id", auto.alias("auto"))
    near = F.count_if(F.abs(F.col("auto") - F.col("quality")) <= 0.2)
    return table(spark, sf_dir, "labels").join(rule, "doc_id").agg(
        near.alias("matched"), F.count(F.lit(1)).alias("total"), F.round(F.coalesce(near / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)), 5).alias("ratio"))
