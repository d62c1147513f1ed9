"""Slots of a trip: which visits are possible when, what the weather makes of them, and why a place was left out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeweave.functions import weather_rules as R
from placeweave.operators.trips import open_on, opening_weeks, trip_days
from placeweave.session import shared_if_small

# Fixed values.
WEATHER_WEIGHT = 120
DAY_MINUTES = 1440
FIRST_HOUR, LAST_HOUR = 6, 20


def enumerate_trips(scenarios: DataFrame, periods: DataFrame, limit: int | None = None) -> DataFrame:
    """``config, scenario, start_day, end_day``: every start, ``step_days`` apart, at which a trip fits into a period of its configuration.
    ``limit`` keeps the first trips of a scenario (periods in order of ``period``)."""
    trips = scenarios.join(periods, "config").filter("period_end - trip_days + 1 >= period_start").withColumn(
        "start_day", F.explode(F.sequence("period_start", F.col("period_end") - F.col("trip_days") + 1, "step_days"))).withColumn(
        "end_day", F.col("start_day") + F.col("trip_days") - 1)
    if limit is not None:
        n = F.row_number().over(Window.partitionBy("config", "scenario").orderBy("period", "start_day"))
        trips = trips.withColumn("_n", n).filter(F.col("_n") <= limit)
    return trips.select("config", "scenario", "period", "start_day", "end_day")


def visit_slots(candidates: DataFrame, trips: DataFrame, intervals: DataFrame, hourly_day: Column) -> tuple[DataFrame, DataFrame]:
    """``(slots, closed)``. A slot is a range ``lo..hi`` of arrival minutes such that the visit ends before closing and before the day's end;
    where ``hourly_day`` holds it is cut at full hours. Unknown hours count as always open. ``closed`` lists ``trip, place, day``.

    ``candidates`` are ``trip, place, visit_minutes`` and more columns, which the slots keep. They meet their places first and their trips
    last, and leave with all slots of a trip in one partition: what is grouped by trip stays there."""
    days = trip_days(trips).select("trip", "day", "day_lo", "day_hi")
    dated = candidates.join(opening_weeks(intervals), "place", "left").join(days, "trip").withColumn("windows", open_on(F.col("day"))).drop("week")
    always = F.array(F.struct(F.lit(0).alias("open_min"), F.lit(DAY_MINUTES).alias("close_min")))
    opened = dated.withColumn("w", F.explode(F.coalesce("windows", always)))
    span = opened.withColumns({"lo": F.greatest("w.open_min", "day_lo"), "hi": F.least("w.close_min", "day_hi") - F.col("visit_minutes")}).filter("hi >= lo")
    hours = F.when(hourly_day, F.sequence(F.floor(F.col("lo") / 60), F.floor(F.col("hi") / 60))).otherwise(F.array(F.lit(-1).cast("bigint")))
    cut = span.withColumn("_h", F.explode(hours)).withColumns({
        "lo": F.when(F.col("_h") >= 0, F.greatest("lo", F.col("_h") * 60)).otherwise(F.col("lo")).cast("int"),
        "hi": F.when(F.col("_h") >= 0, F.least("hi", F.col("_h") * 60 + 59)).otherwise(F.col("hi")).cast("int")})
    return cut.drop("_h", "w", "windows", "day_lo", "day_hi"), dated.filter("size(windows) = 0").select("trip", "place", "day")


def slot_weather(slots: DataFrame, hourly: DataFrame, daily: DataFrame) -> DataFrame:
    """Slots (with ``cell, tier, indoor_ratio, unsafe``) and their ``blocked, blocked_hour, weather_cost, factor, stormy``.

    Hourly tier: blocked when any hour of a possible stay is unsafe; the cost is the mean of the hours of a visit that starts mid-slot. Daily
    tier: the day's record. Other tiers cost nothing. Costs are whole minutes, half to even; nine decimals are
    looked at, so the order in which the hours are summed settles no tie."""
    plain = F.create_map().cast("map<string,double>")
    fields = ["precip_mm", "rain_prob", "temp_c", "wind_kmh", "code", "period_h"]
    hourly_slot = F.col("tier") == R.TIER_HOURLY

    def told_by(tier: str, rows: DataFrame, at: str) -> DataFrame:
        return rows.select("cell", F.lit(tier).alias("tier"), F.col(at).cast("bigint").alias("_at"), *fields, F.lit(True).alias("_told"))

    # A slot sends one row per hour of a possible stay, or one for its day, and is put together again with all its columns: it is read once.
    # It meets a small table of the weather in its own task, and is put together there if slots come by trip.
    told = shared_if_small(told_by(R.TIER_HOURLY, hourly, "hour").unionByName(told_by(R.TIER_DAILY, daily, "day")))
    hours = F.when(hourly_slot, F.sequence(F.floor(F.col("lo") / 60), F.floor((F.col("hi") + F.col("visit_minutes") - 1) / 60)))
    stay = slots.withColumn("_h", F.explode_outer(hours)).withColumn(
        "_at", F.when(hourly_slot, F.col("day") * 24 + F.col("_h")).otherwise(F.col("day")).cast("bigint"))
    seen = stay.join(told, ["cell", "tier", "_at"], "left").withColumn("_mid", F.floor((F.col("lo") + F.col("hi")) / 2))
    unsafe = F.col("_told") & (F.size(R.hazard_overlap(R.hazards(), F.col("unsafe"))) > 0)
    cost = R.weather_cost(F.col("indoor_ratio"), plain)
    overlap = F.greatest(F.least(F.col("_mid") + F.col("visit_minutes"), (F.col("_h") + 1) * 60) - F.greatest("_mid", F.col("_h") * 60), F.lit(0)) / 60.0
    shared = F.when(F.col("_told"), F.when(hourly_slot, overlap).otherwise(1.0))
    decides = F.col("_told") & (~hourly_slot | (F.floor(F.col("_mid") / 60) == F.col("_h")))
    out = seen.groupBy(*slots.columns).agg(
        F.coalesce(F.bool_or(unsafe), F.lit(False)).alias("blocked"), F.min(F.when(unsafe, F.col("_h"))).alias("blocked_hour"),
        F.sum(cost * shared).alias("_w"), F.sum(shared).alias("_t"),
        F.max(F.when(decides, R.travel_factor())).alias("factor"), F.max(F.when(decides, R.is_stormy())).alias("stormy")).withColumn(
        "_cost", F.when(F.col("_t") > 0, F.col("_w") / F.col("_t"))).drop("_w", "_t")
    open_slot = ~F.col("blocked")
    return out.withColumns({
        "weather_cost": F.when(open_slot, F.rint(F.round(F.coalesce("_cost", F.lit(0.0)) * WEATHER_WEIGHT * F.col("visit_minutes") / 60, 9))).otherwise(0.0).cast("int"),
        "factor": F.when(open_slot, F.coalesce("factor", F.lit(1.0))).otherwise(1.0),
        "stormy": open_slot & F.coalesce("stormy", F.lit(False))}).drop("_cost")


def explain_unvisited(candidates: DataFrame, slots: DataFrame, closed: DataFrame, visited: DataFrame) -> DataFrame:
    """``trip, place, reason, avoided``: why a wished place is not in the schedule. It had a slot (``no_room``), or else the weather blocked all
    (``weather``), or it is closed on a day of the trip (``closed``), or its hours are too short. ``avoided`` counts blocked slots."""
    key = ["trip", "place"]

    def told(rows: DataFrame, **facts: Column) -> DataFrame:
        zero = F.lit(0).cast("bigint")
        return rows.select(*key, *[facts.get(c, zero).cast("bigint").alias(c) for c in ("_wish", "_went", "_free", "avoided", "_shut")])

    # All that is known of a wish meets in one shuffle; a row without a key is told of no wish.
    blocked = F.col("blocked").cast("bigint")
    parts = [told(rows.na.drop(subset=key), **facts) for rows, facts in (
        (visited, {"_went": F.lit(1)}), (slots, {"_free": 1 - blocked, "avoided": blocked}), (closed, {"_shut": F.lit(1)}))]
    every = reduce(DataFrame.unionByName, parts, told(candidates, _wish=F.lit(1))).groupBy(*key).agg(
        *[F.sum(c).alias(c) if c in ("_free", "avoided") else F.max(c).alias(c) for c in ("_wish", "_went", "_free", "avoided", "_shut")])
    return every.filter("_wish = 1 AND _went = 0").select(
        *key, F.when(F.col("_free") > 0, "no_room").when(F.col("avoided") > 0, "weather").when(F.col("_shut") > 0, "closed").otherwise("too_short").alias("reason"), "avoided")


def request_priority(wishes: DataFrame) -> DataFrame:
    """``trip, place, priority``: 1 for the first wish of a trip, falling evenly to just above one half. ``wishes`` are ``trip, pos, place``."""
    trip = Window.partitionBy("trip")
    rank = F.row_number().over(trip.orderBy("pos")) - 1
    return wishes.select("trip", "place", (1 - rank / (2 * F.count(F.lit(1)).over(trip))).alias("priority"))


def hour_table(forecast: DataFrame, observed: DataFrame) -> DataFrame:
    """``cell, hour, forecast_mm, temp_c, wind_kmh, hazards, observed_mm`` of the hours 6 to 20; an hour known to one side only is kept."""
    told = forecast.select("cell", "hour", F.bround("precip_mm", 1).alias("forecast_mm"), F.bround("temp_c", 0).alias("temp_c"),
                           F.bround("wind_kmh", 0).alias("wind_kmh"), F.array_join(F.array_sort(R.hazards()), ",").alias("hazards"))
    seen = observed.select("cell", "hour", F.bround("precip_mm", 1).alias("observed_mm"))
    return told.join(seen, ["cell", "hour"], "full_outer").filter((F.col("hour") % 24).between(FIRST_HOUR, LAST_HOUR))
