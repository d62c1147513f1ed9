"""Registered queries on raw service payloads and repeatable loads. Payloads are built from table rows, a bounded number of them each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.operators import loads
from placeweave.plans.catalogue import SQL_HOURLY, SQL_PLACES, hourly, places
from placeweave.plans.registry import query, table
from placeweave.session import new_folder
from placeweave.streaming import weather as stream
from placeweave.sources import payloads


def _json(*fields: F.Column) -> F.Column:
    return F.to_json(F.struct(*fields)).alias("payload")


# Payloads ---------------------------------------------------------------------------------------------------------------


@query("map_elements", f"""WITH {SQL_PLACES} SELECT CASE WHEN place % 2 = 0 THEN 'node/' ELSE 'way/' END || place AS external_id, name, round(lat, 6) AS lat, round(lon, 6) AS lon,
  CASE size % 3 WHEN 0 THEN 'http://w/' || place WHEN 1 THEN 'http://c/' || place END AS website FROM places WHERE size % 9 <> 0""")
def map_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    node, size = F.col("place") % 2 == 0, F.col("size")
    tags = F.map_filter(F.create_map(
        F.lit("name"), F.when(size % 9 != 0, F.col("name")), F.lit("website"), F.when(size % 3 == 0, F.concat(F.lit("http://w/"), "place")).when(size % 3 == 1, ""),
        F.lit("contact:website"), F.when(size % 3 == 1, F.concat(F.lit("http://c/"), "place"))), lambda k, v: v.isNotNull())
    element = F.struct(
        F.when(node, "node").otherwise("way").alias("type"), F.col("place").alias("id"), F.when(node, F.col("lat")).alias("lat"), F.when(node, F.col("lon")).alias("lon"),
        F.when(~node, F.struct("lat", "lon")).alias("center"), tags.alias("tags"))
    raw = places(spark, sf_dir).groupBy(F.floor(F.col("place") / 10).alias("part")).agg(_json(F.collect_list(element).alias("elements")))
    return payloads.read_map_elements(raw).select("external_id", "name", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "website")


@query("kb_bindings", f"""WITH {SQL_PLACES} SELECT 'Q' || (place // 2) AS qid, arg_min(name, place) AS name, round(arg_min(lat, place), 6) AS lat, round(arg_min(lon, place), 6) AS lon,
  arg_min('Q' || size || ',Q' || (size + 1), place) AS classes, arg_min(CASE WHEN size % 2 = 0 THEN 'http://i/' || place
    ELSE '' END, place) AS image
FROM places WHERE size % 9 <> 0 GROUP BY 1""")
def kb_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    def value(c: F.Column | str, name: str) -> F.Column:
        held = c if isinstance(c, F.Column) else F.expr(c)
        return F.when(held.isNotNull(), F.struct(held.alias("value"))).alias(name)

    binding = F.struct(
        "place", value("'http://kb/entity/Q' || (place div 2)", "item"), value(F.col("name"), "itemLabel"),
        value("CASE WHEN size % 9 <> 0 THEN 'Point(' || lon || ' ' || lat || ')' ELSE 'none' END", "coord"),
        value("'http://kb/entity/Q' || size || '|http://kb/entity/Q' || (size + 1)", "classes"), value("CASE WHEN size % 2 = 0 THEN 'http://i/' || place END", "image"))
    raw = places(spark, sf_dir).groupBy(F.floor(F.col("place") / 10).alias("part")).agg(
        _json(F.struct(F.sort_array(F.collect_list(binding)).alias("bindings")).alias("results")))
    return payloads.read_kb_bindings(raw, ["part"]).select(
        "qid", "name", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.array_join("classes", ",").alias("classes"),
        F.coalesce(F.try_element_at("tags", F.lit("image_url")), F.lit("")).alias("image"))


def _hourly_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payload per cell and day, at most 24 hours long; its precipitation array is one hour short."""
    hour = F.struct("hour", "temp_c", "precip_mm", "wind_kmh", "code")
    days = hourly(spark, sf_dir).groupBy("cell", F.floor(F.col("hour") / 24).alias("day")).agg(F.sort_array(F.collect_list(hour)).alias("h"))
    time = F.transform("h", lambda x: F.date_format(F.timestamp_seconds(x["hour"] * 3600), "yyyy-MM-dd'T'HH:mm"))
    return days.select("cell", _json(F.lit(25200).alias("utc_offset_seconds"), F.struct(
        time.alias("time"), F.col("h.temp_c").alias("temperature_2m"), F.slice("h.precip_mm", 1, F.size("h") - 1).alias("precipitation"),
        F.col("h.wind_kmh").alias("wind_speed_10m"), F.col("h.code").cast("array<double>").alias("weather_code")).alias("hourly")))


_SQL_SHORT = f"{SQL_HOURLY}, last AS (SELECT *, hour = max(hour) OVER (PARTITION BY cell, hour // 24) AS cut FROM hourly)"


@query("hourly_payload", f"""WITH {_SQL_SHORT} SELECT cell, hour * 3600 - 25200 AS time_s, temp_c, CASE WHEN NOT cut THEN precip_mm END AS precip_mm, wind_kmh, code FROM last""")
def hourly_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = payloads.read_hourly(_hourly_payloads(spark, sf_dir), ["cell"])
    return rows.select("cell", F.unix_seconds("time").alias("time_s"), "temp_c", "precip_mm", "wind_kmh", "code")


@query("hourly_payload_strict", f"WITH {_SQL_SHORT} SELECT cell, hour * 3600 - 25200 AS time_s, precip_mm, code FROM last WHERE NOT cut")
def hourly_payload_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = payloads.read_hourly(_hourly_payloads(spark, sf_dir), ["cell"], strict=True)
    return rows.select("cell", F.unix_seconds("time").alias("time_s"), "precip_mm", "code")


@query("daily_payload", """SELECT user_id AS cell, strftime(ts, '%Y-%m-%d') AS date, round(sum(value), 3) AS precip_mm FROM events GROUP BY ALL""")
def daily_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payload per user and month."""
    when = F.col("ts").cast("timestamp")
    days = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("cell"), F.date_format(when, "yyyy-MM-dd").alias("date")).agg(F.sum("value").alias("mm"))
    month = days.groupBy("cell", F.substring("date", 1, 7).alias("month")).agg(F.sort_array(F.collect_list(F.struct("date", "mm"))).alias("d"))
    raw = month.select("cell", _json(F.struct(F.col("d.date").alias("time"), F.col("d.mm").alias("precipitation_sum")).alias("daily")))
    return payloads.read_daily(raw, ["cell"]).select("cell", F.col("date").cast("string").alias("date"), F.round("precip_mm", 3).alias("precip_mm"))


@query("page_extracts", "SELECT doc_id, 'https://pages/' || replace('Page of ' || source, ' ', '_') AS url, sha256(text) AS content_hash FROM documents WHERE text <> ''")
def page_extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.struct(F.concat(F.lit("Page of "), "source").alias("title"), F.col("text").alias("extract"))
    raw = table(spark, sf_dir, "documents").select("doc_id", _json(F.struct(F.create_map(F.col("doc_id").cast("string"), page).alias("pages")).alias("query")))
    return payloads.read_extracts(raw, ["doc_id"], "https://pages/").select("doc_id", "url", F.sha2("content", 256).alias("content_hash"))


@query("image_info", """SELECT page_id, url || '.png' AS image_url, CASE WHEN page_id % 3 <> 0 THEN 'CC & ' || page_id END AS license, 'User ' || page_id AS author FROM pages""")
def image_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.expr("CASE WHEN page_id % 3 <> 0 THEN 'CC &amp; ' || page_id ELSE ' <br> ' END")
    meta = F.struct(F.struct(held.alias("value")).alias("LicenseShortName"),
                    F.struct(F.expr("'<a href=\"/u\">User ' || page_id || '</a>'").alias("value")).alias("Artist"))
    info = F.struct(F.array(F.struct(F.concat("url", F.lit(".png")).alias("url"), meta.alias("extmetadata"))).alias("imageinfo"))
    raw = table(spark, sf_dir, "pages").filter("url IS NOT NULL").select(
        "page_id", _json(F.struct(F.create_map(F.col("page_id").cast("string"), info).alias("pages")).alias("query")))
    return payloads.read_image_info(raw, ["page_id"]).select("page_id", "image_url", "license", "author")


@query("schedule_documents", """SELECT o_orderkey AS trip, o_orderstatus <> 'P' AS valid, CASE WHEN o_orderstatus <> 'P' THEN l_partkey::VARCHAR END AS place_id,
  CASE WHEN o_orderstatus <> 'P' THEN strftime(l_shipdate, '%Y-%m-%d') END AS day, CASE
    WHEN o_orderstatus <> 'P' THEN '0' || (l_linenumber % 10) || ':00' END AS arrival
FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, false, NULL, NULL, NULL
  FROM orders WHERE o_orderstatus = 'P'""")
def schedule_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans as a model writes them: JSON in a fence, or an answer without any."""
    visit = F.struct(F.col("l_partkey").cast("string").alias("place_id"), F.expr("'0' || (l_linenumber % 10) || ':00'").alias("arrival"))
    days = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("date")).agg(F.collect_list(visit).alias("visits"))
    plans = days.groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list(F.struct("date", "visits")).alias("days"))).alias("plan"))
    text = F.when(F.col("o_orderstatus") == "P", F.lit("No plan today.")).otherwise(F.concat(F.lit("Here it is:\n```json\n"), "plan", F.lit("\n```")))
    orders = table(spark, sf_dir, "orders").join(plans, F.col("o_orderkey") == F.col("l_orderkey"), "left").filter("o_orderstatus = 'P' OR plan IS NOT NULL")
    out = payloads.read_schedules(orders.select(F.col("o_orderkey").alias("trip"), text.alias("payload")), ["trip"])
    return out.select("trip", "valid", "place_id", F.col("day").cast("string").alias("day"), "arrival")


# Loads ------------------------------------------------------------------------------------------------------------------


@query("forecast_upsert", r"""WITH e AS (SELECT user_id % 16 AS cell, epoch_us(ts) // 3600000000 AS hour, event_id, value, regexp_extract(props, '"k": *(\d+)', 1)::INT AS k, event_type < 'm' AS batch FROM events),
old AS (SELECT cell, hour, round(sum(value), 3) AS precip_mm, max(k) AS uv_index FROM e WHERE NOT batch GROUP BY ALL),
new AS (SELECT cell, hour, round(sum(value), 3) AS precip_mm, max(k) FILTER (k >= 50) AS uv_index FROM e WHERE batch GROUP BY ALL)
SELECT cell, hour, coalesce(new.precip_mm, old.precip_mm) AS precip_mm, coalesce(new.uv_index, old.uv_index) AS uv_index FROM old
  FULL JOIN new USING (cell, hour)""")
def forecast_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 16).alias("cell"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("hour"), "value", k.alias("k"), "event_type")

    def hours(part: DataFrame, uv: F.Column) -> DataFrame:
        return part.groupBy("cell", "hour").agg(F.round(F.sum("value"), 3).alias("precip_mm"), F.max(uv).alias("uv_index"))

    stored = hours(rows.filter("event_type >= 'm'"), F.col("k"))
    batch = hours(rows.filter("event_type < 'm'"), F.when(F.col("k") >= 50, F.col("k")))
    return loads.upsert_forecast(stored, batch)


_BATCHES = 4


@query("forecast_replay", rf"""
WITH e AS (
  SELECT user_id AS cell, epoch_us(ts) // 3600000000 AS hour, event_id, round(value, 3) AS precip_mm, event_id // 7 % {_BATCHES} AS batch,
         CASE WHEN regexp_extract(props, '"k": *(\d+)', 1)::INT >= 30 THEN regexp_extract(props, '"k": *(\d+)', 1)::INT END AS uv_index
           FROM events),
newest AS (SELECT *, row_number() OVER (PARTITION BY cell, hour, batch ORDER BY event_id DESC) AS n FROM e)
SELECT cell, hour, arg_max(precip_mm, batch) AS precip_mm, arg_max(uv_index, batch) FILTER (uv_index IS NOT NULL) AS uv_index, arg_max(event_id, batch) AS fetched_s
FROM newest WHERE n = 1 GROUP BY cell, hour""")
def forecast_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as forecast rows in four batches, one of them repeated as after a failure: the table they leave behind."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("cell"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("hour"), F.round("value", 3).alias("precip_mm"),
        F.when(k >= 30, k).alias("uv_index"), F.col("event_id").alias("fetched_s"))
    folder = new_folder(spark, "forecast")
    for n in (0, 1, 2, 2, 3):
        stream.apply_batch(rows.filter(F.floor(F.col("fetched_s") / 7) % _BATCHES == n), folder, n, 16)
    return stream.read_forecast(spark, folder, rows.schema)


@query("climate_upsert", """WITH e AS (SELECT user_id AS cell, month(ts)::INT AS month, value, event_type < 'm' AS batch FROM events)
SELECT cell, month, round(CASE WHEN bool_or(batch) THEN max(value) FILTER (batch) ELSE max(value) END, 5) AS wind_kmh FROM e
  GROUP BY ALL""")
def climate_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumns({"cell": F.col("user_id"), "month": F.month("ts")})
    normals = [rows.filter(side).groupBy("cell", "month").agg(F.max("value").alias("wind_kmh")) for side in ("event_type >= 'm'", "event_type < 'm'")]
    return loads.upsert_by_key(*normals, ["cell", "month"])


@query("insert_absent", """SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL
  AND text NOT IN (SELECT text FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL) GROUP BY text""")
def insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are loaded into a store that holds the labelled ones; a text is written once."""
    batch = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    stored = batch.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return loads.insert_absent(stored, batch, ["content_hash"], ["doc_id"]).select("content_hash", "doc_id")


_SQL_UPSERT = """
link AS (SELECT 'a:' || p_partkey AS key, p_partkey AS place_id FROM part UNION ALL SELECT 'b:' || p_partkey, p_partkey FROM part),
batch AS (SELECT s_suppkey AS record, s_name AS name, CASE WHEN s_suppkey % 4 = 0 THEN ['n:' || s_suppkey]
  ELSE ['a:' || (s_suppkey * 3), 'b:' || (s_suppkey * 5)] END AS ids FROM supplier),
hit AS (SELECT record, min(place_id) AS place_id, string_agg(DISTINCT place_id::VARCHAR, ',' ORDER BY place_id::VARCHAR) AS matched,
  count(DISTINCT place_id) AS n
  FROM (SELECT record, unnest(ids) AS key FROM batch) JOIN link USING (key) GROUP BY record),
fresh AS (SELECT record, (SELECT max(p_partkey)
  FROM part) + row_number() OVER (ORDER BY ('0x' || substr(md5(record::VARCHAR), 1, 7))::BIGINT, record) AS place_id
  FROM batch WHERE record NOT IN (SELECT record FROM hit)),
placed AS (SELECT b.*, coalesce(h.place_id, f.place_id) AS place_id FROM batch b LEFT JOIN hit h USING (record)
  LEFT JOIN fresh f USING (record))"""


def _places_load(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("place_id"), F.col("p_name").alias("name"))
    links = part.select(F.explode(F.expr("array('a:' || place_id, 'b:' || place_id)")).alias("key"), "place_id")
    ids = F.expr("CASE WHEN s_suppkey % 4 = 0 THEN array('n:' || s_suppkey) ELSE array('a:' || (s_suppkey * 3), 'b:' || (s_suppkey * 5)) END")
    batch = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("record"), F.col("s_name").alias("name"), ids.alias("ids"))
    return loads.upsert_places(part, links, batch)


@query("places_upsert", f"""WITH {_SQL_UPSERT}, newest AS (SELECT place_id, arg_max(name, record) AS name FROM placed GROUP BY 1)
SELECT * FROM newest UNION ALL SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT place_id FROM newest)""")
def places_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, _, _ = _places_load(spark, sf_dir)
    return stored.select("place_id", "name")


@query("places_links", f"""WITH {_SQL_UPSERT} SELECT * FROM link UNION ALL SELECT key, min(place_id) FROM (SELECT unnest(ids) AS key, place_id FROM placed)
  WHERE key NOT IN (SELECT key FROM link) GROUP BY key""")
def places_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, links, _ = _places_load(spark, sf_dir)
    return links


@query("places_conflicts", f"WITH {_SQL_UPSERT} SELECT record, place_id, n AS places FROM hit WHERE n > 1")
def places_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, conflicts = _places_load(spark, sf_dir)
    return conflicts.select("record", "place_id", F.size(F.split("matched", ",")).alias("places"))


@query("image_routes", """WITH s AS (SELECT p_partkey AS place, 0 AS route, 0 AS pos, 'p/' || p_partkey AS image_url FROM part WHERE p_type < 'P'
  UNION ALL SELECT l_partkey, 1, l_linenumber, 'c/' || l_orderkey || '/' || l_linenumber || '/' || l_suppkey FROM lineitem)
SELECT place, image_url, route, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY route, pos, image_url) AS n FROM s)
  WHERE n <= 30""")
def image_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    single = table(spark, sf_dir, "part").filter("p_type < 'P'").select(
        F.col("p_partkey").alias("place"), F.lit(0).alias("pos"), F.concat(F.lit("p/"), "p_partkey").alias("image_url"))
    listed = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("place"), F.col("l_linenumber").alias("pos"), F.concat_ws("/", F.lit("c"), "l_orderkey", "l_linenumber", "l_suppkey").alias("image_url"))
    return loads.image_candidates(single, listed)
