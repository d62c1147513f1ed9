"""Raw JSON answers of map, knowledge-base, weather, encyclopedia, image and model services, one payload per row, to typed rows.

Every reader takes ``raw`` with a string column ``payload`` (and keeps the columns named in ``keep``). A payload that does not parse gives
no rows, except in :func:`read_schedules`, which reports it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_VALUE = "struct<value:string>"
_MAP_ELEMENTS = ("elements array<struct<type:string,id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>")
_BINDINGS = (f"results struct<bindings:array<struct<item:{_VALUE},itemLabel:{_VALUE},coord:{_VALUE},classes:{_VALUE},"
             f"commons:{_VALUE},image:{_VALUE},viTitle:{_VALUE}>>>")
_IMAGES = ("query struct<pages:map<string,struct<imageinfo:array<struct<url:string,"
           f"extmetadata:struct<LicenseShortName:{_VALUE},Artist:{_VALUE}>>>>>>")
_EXTRACTS = "query struct<pages:map<string,struct<title:string,extract:string>>>"
_SCHEDULE = "days array<struct<date:string,visits:array<struct<place_id:string,arrival:string,departure:string>>>>"


def read_map_elements(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Named elements with a position of their own or of their centre."""
    el = raw.select(*keep, F.explode(F.from_json("payload", _MAP_ELEMENTS)["elements"]).alias("el"))
    tag = lambda name: F.try_element_at("el.tags", F.lit(name))
    return el.select(
        *keep, tag("name").alias("name"), tag("name:en").alias("name_en"), F.concat_ws("/", "el.type", F.col("el.id").cast("string")).alias("external_id"),
        F.coalesce("el.lat", "el.center.lat").alias("lat"), F.coalesce("el.lon", "el.center.lon").alias("lon"),
        tag("opening_hours").alias("opening_hours_raw"),
        F.coalesce(F.nullif(tag("website"), F.lit("")), tag("contact:website")).alias("website"), F.col("el.tags").alias("tags")).filter(
        "name <> '' AND lat IS NOT NULL AND lon IS NOT NULL")


def _last_part(uri: Column) -> Column:
    return F.element_at(F.split(uri, "/"), -1)


def read_kb_bindings(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per item with a point: the item's first binding of its payload. ``keep`` names the payload."""
    b = raw.select(*keep, F.posexplode(F.from_json("payload", _BINDINGS)["results"]["bindings"]).alias("pos", "b"))
    number = r"^Point\(([-0-9.]+) ([-0-9.]+)\)"
    rows = b.select(
        *keep, "pos", _last_part(F.col("b.item.value")).alias("qid"), F.col("b.itemLabel.value").alias("name"),
        F.regexp_extract("b.coord.value", number, 2).try_cast("double").alias("lat"), F.regexp_extract("b.coord.value", number, 1).try_cast("double").alias("lon"),
        F.transform(F.filter(F.split(F.coalesce("b.classes.value", F.lit("")), r"\|"), lambda c: c != ""), _last_part).alias("classes"),
        F.map_filter(F.create_map(F.lit("commons_category"), F.col("b.commons.value"), F.lit("image_url"), F.col("b.image.value"),
                                  F.lit("vi_title"), F.col("b.viTitle.value")), lambda k, v: v.isNotNull()).alias("tags")).filter("lat IS NOT NULL AND lon IS NOT NULL")
    fields = ("name", "lat", "lon", "classes", "tags")
    return rows.groupBy(*keep, "qid").agg(F.min_by(F.struct(*fields), "pos").alias("_row")).select(*keep, "qid", "_row.*")


def _columns(raw: DataFrame, keep: Sequence[str], part: str, fields: dict[str, str], times: str) -> DataFrame:
    """Parallel arrays of ``part`` to rows; an array that is short or missing gives nulls, one that is too long is cut at ``time``."""
    shape = ",".join(f"`{source}`:array<double>" for source in fields.values())
    parsed = raw.withColumn("_p", F.from_json("payload", f"utc_offset_seconds int, {part} struct<time:array<string>,{shape}>"))
    at = parsed.select(*keep, F.col("_p.utc_offset_seconds").alias("_offset"), F.col(f"_p.{part}").alias("_a"),
                                       F.posexplode(f"_p.{part}.time").alias("_pos", times))
    return at.select(*keep, times, "_offset", *[F.get(F.col("_a")[source], F.col("_pos")).alias(name) for name, source in fields.items()])


def read_hourly(raw: DataFrame, keep: Sequence[str] = (), suffix: str = "", strict: bool = False) -> DataFrame:
    """Hourly forecast with ``time`` as an instant. ``suffix`` picks a variant of the variables (an earlier model run); ``strict`` drops hours
    without precipitation and fills temperature 27, wind 0 and code 0, as planning needs."""
    fields = {"temp_c": "temperature_2m", "precip_mm": "precipitation", "rain_prob": "precipitation_probability",
              "wind_kmh": "wind_speed_10m", "code": "weather_code", "uv_index": "uv_index"}
    rows = _columns(raw, keep, "hourly", {k: v + suffix for k, v in fields.items()}, "_time")
    local = F.unix_timestamp(F.to_timestamp_ntz("_time", F.lit("yyyy-MM-dd'T'HH:mm")).cast("timestamp"))
    shift = F.unix_timestamp(F.lit("1970-01-01 00:00:00"))
    rows = rows.withColumn("time", F.timestamp_seconds(local - shift - F.coalesce("_offset", F.lit(0))))
    if strict:
        rows = rows.filter("precip_mm IS NOT NULL").fillna({"temp_c": 27.0, "wind_kmh": 0.0, "code": 0.0})
    return rows.select(*keep, "time", *[F.col(c).cast("int").alias(c) if c == "code" else c for c in fields])


def read_daily(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    fields = {"temp_mean_c": "temperature_2m_mean", "precip_mm": "precipitation_sum", "wind_kmh": "wind_speed_10m_max"}
    return _columns(raw, keep, "daily", fields, "_time").select(*keep, F.to_date("_time").alias("date"), *fields)


def read_extracts(raw: DataFrame, keep: Sequence[str] = (), base_url: str = "") -> DataFrame:
    """Page texts that are not empty, with their address."""
    page = raw.select(*keep, F.explode(F.map_values(F.from_json("payload", _EXTRACTS)["query"]["pages"])).alias("p"))
    return page.filter("p.extract <> ''").select(
        *keep, F.col("p.title").alias("title"), F.col("p.extract").alias("content"), F.concat(F.lit(base_url), F.replace(F.col("p.title"), F.lit(" "), F.lit("_"))).alias("url"))


def plain_text(html: Column) -> Column:
    """Text of a short HTML value: tags dropped, the five common entities decoded, blank as null."""
    text = F.regexp_replace(html, "<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.nullif(F.trim(text), F.lit(""))


def read_image_info(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    info = raw.select(*keep, F.explode(F.map_values(F.from_json("payload", _IMAGES)["query"]["pages"])).alias("p")).select(
        *keep, F.get("p.imageinfo", F.lit(0)).alias("i"))
    return info.filter("i.url <> ''").select(
        *keep, F.col("i.url").alias("image_url"), plain_text(F.col("i.extmetadata.LicenseShortName.value")).alias("license"),
        plain_text(F.col("i.extmetadata.Artist.value")).alias("author"))


def read_schedules(raw: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Visits of schedules that a model wrote, wherever its JSON stands in the answer: ``valid, day, place_id, arrival, departure``.
    An answer without a readable schedule is one row with ``valid = false``."""
    first, last = F.instr("payload", "{"), F.length("payload") - F.instr(F.reverse("payload"), "}") + 1
    inner = F.when((first > 0) & (last > first), F.substring("payload", first, last - first + 1))
    plan = raw.withColumn("_days", F.from_json(inner, _SCHEDULE)["days"])
    days = plan.select(*keep, F.col("_days").isNotNull().alias("valid"), F.explode_outer("_days").alias("d"))
    visit = days.select(*keep, "valid", F.to_date("d.date").alias("day"), F.explode_outer("d.visits").alias("v"))
    return visit.filter("NOT valid OR v IS NOT NULL").select(*keep, "valid", "day", F.col("v.place_id").alias("place_id"), F.col("v.arrival").alias("arrival"), F.col("v.departure").alias("departure"))
