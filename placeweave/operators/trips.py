"""Audit and scoring of given trip schedules: day windows, feasibility, travel, weather, comparison of variants."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeweave.functions import geo
from placeweave.functions import weather_rules as R
from placeweave.session import cut_lineage, shared_if_small, stored

# Fixed values of the audit.
TOLERANCE_MINUTES = 5
MIN_VISIT_SHARE = 0.5
RAINY_HOURS = 2
FORECAST_DAYS = 16
NOON = 12


def day_frame(at: Callable[[str], Column], day: Column) -> tuple[Column, Column]:
    """First and last minute of a trip's day: the daily frame, cut by the start on the first day and by the end on the last, never negative."""
    lo = F.when(day == at("start_day"), F.greatest(at("day_start"), at("start_min"))).otherwise(at("day_start"))
    hi = F.when(day == at("end_day"), F.least(at("day_end"), at("end_min"))).otherwise(at("day_end"))
    return lo, F.greatest(lo, hi)


def trip_days(trips: DataFrame) -> DataFrame:
    """One row per day of a trip with ``day_lo, day_hi`` in minutes: the daily frame, cut by the start on the first day and by the end on
    the last, never negative. ``trips`` are ``trip, start_day, start_min, end_day, end_min, day_start, day_end`` and more."""
    days = trips.filter("start_day <= end_day").withColumn("day", F.explode(F.sequence("start_day", "end_day")))
    lo, hi = day_frame(F.col, F.col("day"))
    return days.withColumns({"day_lo": lo, "day_hi": hi})


def opening_weeks(intervals: DataFrame) -> DataFrame:
    """``place, week``: the hours of a place in one row, null where they are unknown. ``intervals`` are ``place, parse_ok, dow, open_min,
    close_min`` (Monday is 0)."""
    span = F.when(F.expr("parse_ok AND open_min IS NOT NULL"), F.struct("dow", "open_min", "close_min"))
    return intervals.groupBy("place").agg(F.bool_and("parse_ok").alias("_known"), F.sort_array(F.collect_set(span)).alias("week")).select(
        "place", F.when(F.col("_known"), F.col("week")).alias("week"))


def open_on(day: Column) -> Column:
    """The spans of ``week`` on a day, which is counted from 1970-01-01, a Thursday: null where hours are unknown, empty when closed."""
    dow = ((day + 3) % 7).cast("int")
    return F.transform(F.filter("week", lambda s: s["dow"] == dow), lambda s: F.struct(s["open_min"].alias("open_min"), s["close_min"].alias("close_min")))


def windows_on(visits: DataFrame, intervals: DataFrame) -> DataFrame:
    """``visits`` with ``windows``, the opening intervals of their place on their day. Visits are joined once, by their place."""
    return visits.join(opening_weeks(intervals), "place", "left").withColumn("windows", open_on(F.col("day"))).drop("week")


def _audited_visits(visits: DataFrame, places: DataFrame, trips: DataFrame, intervals: DataFrame) -> DataFrame:
    """Visits with their violations (``_found``) and what the summary adds up (``_known, _unverified, _need``), all visits of a trip in one partition.

    Visits are sent to their places once and to their trips once: whatever depends on the place is judged there and leaves as flags, a trip
    comes as one row with its frames, and duplicates, days and spending are windows of the trip's partition."""
    tolerance = TOLERANCE_MINUTES
    at_place = windows_on(visits.select("trip", "day", "visit", "place", "arrive", "leave").join(
        places.select("place", "lat", "lon", "visit_minutes", "price"), "place", "left"), intervals)
    fits = F.exists("windows", lambda w: (w["open_min"] - tolerance <= F.col("arrive")) & (F.col("leave") <= w["close_min"] + tolerance))
    told = at_place.select(
        "trip", "day", "visit", "place", "arrive", "leave", "lat", "lon", "price",
        F.coalesce(F.col("leave") - F.col("arrive") < MIN_VISIT_SHARE * F.col("visit_minutes"), F.lit(False)).alias("_short"),
        F.col("windows").isNull().alias("_unverified"), F.coalesce(F.size("windows") == 0, F.lit(False)).alias("_closed"),
        F.coalesce((F.size("windows") > 0) & ~fits, F.lit(False)).alias("_misses"))

    frame = ["mode", "max_places", "from_lat", "from_lon", "to_lat", "to_lon"]
    own = trips.groupBy("trip").agg(F.collect_list(F.struct("start_day", "start_min", "end_day", "end_min", "day_start", "day_end", *frame, "budget")).alias("_trips"))
    days = F.transform(F.filter("_trips", lambda t: (t["start_day"] <= F.col("day")) & (F.col("day") <= t["end_day"])), lambda t: F.struct(
        *[c.alias(n) for c, n in zip(day_frame(lambda name: t[name], F.col("day")), ("day_lo", "day_hi"))], *[t[c].alias(c) for c in frame]))
    framed = told.join(own, "trip", "left").withColumns({"_budgets": F.transform("_trips", lambda t: t["budget"]), "_f": F.explode_outer(days)}).select(
        "*", "_f.*").drop("_trips", "_f").withColumns({"_inside": F.col("day_lo").isNotNull()}).withColumns(
        {"_known": F.col("_inside") & F.col("lat").isNotNull()})

    again = F.row_number().over(Window.partitionBy("trip", "place").orderBy("day", "visit"))
    walk = Window.partitionBy("trip", "day", "_known").orderBy("arrive", "visit")
    day = Window.partitionBy("trip", "day", "_inside", "day_lo", "day_hi", *frame)
    last = F.max_by(F.struct("lat", "lon", "leave"), F.when(F.col("lat").isNotNull(), F.struct("arrive", "visit")))
    trip = Window.partitionBy("trip")
    seen = framed.withColumn("_again", again).withColumn("_before", F.lag(F.struct("lat", "lon", "leave")).over(walk)).withColumns({
        "_nth": F.row_number().over(day.orderBy("arrive")), "_stops": F.count(F.lit(1)).over(day), "_last": last.over(day)}).withColumns({
        "_first": F.row_number().over(trip.orderBy("day")), "_spent": F.sum(F.when(F.col("_known"), F.coalesce("price", F.lit(0)))).over(trip),
        "_nth_out": F.row_number().over(Window.partitionBy("trip", "day", "_inside").orderBy("day_lo"))})

    def minutes(lat1: Column, lon1: Column, left: Column, lat2: str, lon2: str) -> Column:
        return left + geo.travel_minutes(geo.road_km(lat1, lon1, F.col(lat2), F.col(lon2)), F.col("mode"))

    def since(before: str) -> list[Column]:
        return [F.coalesce(F.col(f"{before}.{c}"), first) for c, first in (("lat", "from_lat"), ("lon", "from_lon"), ("leave", "day_lo"))]

    left = F.coalesce(F.col("_before.leave"), "day_lo")
    seen = seen.withColumn("_there", F.when(F.col("_known"), minutes(*since("_before"), "lat", "lon")))
    known, ends = F.col("_known"), F.col("_inside") & (F.col("_nth") == 1)
    none, day_of, place_of = F.lit(None).cast("bigint"), F.col("day").cast("bigint"), F.col("place").cast("bigint")
    checks = [
        ("duplicate", F.col("_again") == 2, none, place_of),
        ("outside_trip", ~F.col("_inside") & (F.col("_nth_out") == 1), day_of, none),
        ("unknown_place", F.col("_inside") & F.col("lat").isNull(), day_of, place_of),
        ("max_places", ends & (F.col("_stops") > F.col("max_places")), day_of, none),
        ("day_window", F.when(ends, minutes(*since("_last"), "to_lat", "to_lon") > F.col("day_hi") + tolerance), day_of, none),
        ("travel", known & (F.col("arrive") + tolerance < F.col("_there")), day_of, place_of),
        ("day_window", known & ((F.col("arrive") < F.col("day_lo") - tolerance) | (F.col("leave") > F.col("day_hi") + tolerance)), day_of, place_of),
        ("visit_too_short", known & F.col("_short"), day_of, place_of),
        ("closed", known & F.col("_closed"), day_of, place_of),
        ("opening_hours", known & F.col("_misses"), day_of, place_of),
    ]

    def violation(kind: str, on: Column, at: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), on.alias("day"), at.alias("place"))

    spending = F.when((F.col("_first") == 1), F.transform(F.filter("_budgets", lambda b: F.col("_spent") > b), lambda b: violation("budget", none, none)))
    found = F.array_compact(F.array(*[F.when(F.coalesce(wrong, F.lit(False)), violation(kind, on, at)) for kind, wrong, on, at in checks]))
    return seen.select("trip", "_known", "_unverified", (F.col("_there") - left).alias("_need"),
                       F.concat(found, F.coalesce(spending, F.array().cast("array<struct<kind:string,day:bigint,place:bigint>>"))).alias("_found"))


def audit_feasibility(visits: DataFrame, places: DataFrame, trips: DataFrame, intervals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(violations, summary)`` of schedules, whoever wrote them.

    ``visits``: ``trip, day, visit, place, arrive, leave`` (minutes of the day); ``places``: ``place, lat, lon, visit_minutes, price``;
    ``trips``: as in :func:`trip_days`, with ``mode, max_places, budget`` and ``from_lat, from_lon, to_lat, to_lon``.
    A violation is ``trip, kind, day, place``. An unknown place is reported and does not move the traveller; a day outside the trip is
    reported once and not looked at further; travel is always the estimate. The summary has every trip of ``trips``."""
    # Both results come from one row per trip, which is written: the visits are neither planned nor joined twice.
    audited = stored(_audited_visits(visits, places, trips, intervals).groupBy("trip").agg(
        F.count(F.lit(1)).alias("visits"), F.flatten(F.collect_list("_found")).alias("_found"),
        F.count_if(F.col("_known") & F.col("_unverified")).alias("unverified_hours"), F.sum("_need").alias("travel_minutes")))
    violations = audited.select("trip", F.inline("_found"))
    kinds = F.array_join(F.array_sort(F.array_distinct("_found.kind")), ";")
    told = audited.select("trip", "visits", F.size("_found").cast("bigint").alias("violations"), kinds.alias("kinds"), "unverified_hours", "travel_minutes")
    summary = trips.select("trip").join(told, "trip", "left").fillna(
        0, ["visits", "violations", "unverified_hours", "travel_minutes"]).fillna("", ["kinds"]).withColumn("feasible", F.col("violations") == 0)
    return violations, summary


def travel_table(points: DataFrame, mode: str = geo.DEFAULT_MODE) -> DataFrame:
    """``trip, origin, dest, km, minutes`` between all stops of a trip. ``points`` are ``trip, place, lat, lon``; the join is on the trip."""
    stops = points.dropDuplicates(["trip", "place"])
    a = stops.select("trip", F.col("place").alias("origin"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = stops.select("trip", F.col("place").alias("dest"), "lat", "lon")
    km = geo.road_km(F.col("lat1"), F.col("lon1"), F.col("lat"), F.col("lon"))
    return a.join(b, "trip").filter("origin <> dest").select(
        "trip", "origin", "dest", km.alias("km"), geo.travel_minutes(km, F.lit(mode)).alias("minutes"))


def travel_at(legs: DataFrame, buckets: DataFrame) -> DataFrame:
    """``legs`` (``leg, origin, dest, minute, km, mode``) with ``minutes, travel_source``: the measured time whose departure hour is nearest
    (the earlier hour on a tie, the first hour when no time is given), the estimate where nothing was measured.

    ``buckets`` are ``origin, dest, hour, minutes``; an hour measured more than once counts with its fewest minutes, so the map a pair is
    folded to has one entry an hour."""
    per_hour = buckets.groupBy("origin", "dest", "hour").agg(F.min("minutes").alias("took"))
    per_pair = per_hour.groupBy("origin", "dest").agg(F.sort_array(F.collect_list(F.struct("hour", "took"))).alias("_all"))
    away = F.transform("_all", lambda b: F.struct(
        F.coalesce(F.abs(b["hour"] * 60 - F.col("minute")), F.lit(0)).alias("off"), b["hour"].alias("hour"), b["took"].alias("took")))
    nearest = F.array_min(away)["took"]
    estimate = geo.travel_minutes(F.col("km"), F.col("mode"))
    return legs.join(per_pair, ["origin", "dest"], "left").withColumns({
        "minutes": F.coalesce(nearest, estimate), "travel_source": F.when(F.col("_all").isNull(), "estimate").otherwise("measured")}).drop("_all")


def _coarser(blocks: DataFrame) -> DataFrame:
    """Blocks of twice the side, with the box of the cells inside."""
    return blocks.groupBy(F.shiftright("b_lat", 1).alias("b_lat"), F.shiftright("b_lon", 1).alias("b_lon")).agg(
        *[F.min(c).alias(c) for c in ("lat_lo", "lon_lo")], *[F.max(c).alias(c) for c in ("lat_hi", "lon_hi")])


def _around(asked: DataFrame, level: int) -> DataFrame:
    """``asked`` with its block at a level and the eight about it."""
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    return asked.withColumn("_i", F.explode(near)).withColumn("_j", F.explode(near)).select(
        "grid_lat", "grid_lon", (F.shiftright("grid_lat", level) + F.col("_i")).alias("b_lat"), (F.shiftright("grid_lon", level) + F.col("_j")).alias("b_lon"))


def nearest_cell(points: DataFrame, cells: DataFrame) -> DataFrame:
    """``cell_lat, cell_lon`` of each distinct grid cell of ``points`` (``grid_lat, grid_lon`` in tenths of a degree) to the cell with data
    that is closest in squared degrees (smaller latitude, then longitude on ties).

    Cells are coarsened to blocks of 1, 2, 4, ... cells a side. A cell goes up until its block or one of the eight about it holds data: then
    that data is within 2.9 sides, and the blocks of four sides about it hold all that may be nearer. From there it goes down again, a block
    of candidates being replaced by its quarters that hold data; blocks whose box is farther than another one's far corner leave. Every step is
    an equality join on blocks, a cell keeps a few blocks at a time, and steps end when no cell is left to move."""
    asked = points.select(F.col("grid_lat").cast("int").alias("grid_lat"), F.col("grid_lon").cast("int").alias("grid_lon")).distinct()
    b_lat, b_lon = F.col("grid_lat").cast("int"), F.col("grid_lon").cast("int")
    blocks = [cut_lineage(cells.select(b_lat.alias("b_lat"), b_lon.alias("b_lon")).distinct().select(
        "b_lat", "b_lon", F.col("b_lat").alias("lat_lo"), F.col("b_lon").alias("lon_lo"), F.col("b_lat").alias("lat_hi"), F.col("b_lon").alias("lon_hi")))]
    rest, entering = cut_lineage(asked), {}
    if blocks[0].isEmpty():
        return asked.select("*", F.lit(None).cast("int").alias("cell_lat"), F.lit(None).cast("int").alias("cell_lon")).limit(0)

    def block(level: int) -> DataFrame:
        while len(blocks) <= level:
            blocks.append(cut_lineage(_coarser(blocks[-1])))
        return blocks[level]

    level = 0
    while not rest.isEmpty():
        met = cut_lineage(_around(rest, level).join(block(level), ["b_lat", "b_lon"], "left_semi").select("grid_lat", "grid_lon").distinct())
        entering[level + 2] = met
        rest = cut_lineage(rest.join(met, ["grid_lat", "grid_lon"], "left_anti"))
        level += 1

    def squared(low: str, high: str, at: str, far: bool) -> Column:
        lo, hi, x = F.col(low).cast("bigint"), F.col(high).cast("bigint"), F.col(at).cast("bigint")
        off = F.greatest(F.abs(x - lo), F.abs(x - hi)) if far else F.greatest(lo - x, x - hi, F.lit(0).cast("bigint"))
        return off * off

    best_far = F.min("_far").over(Window.partitionBy("grid_lat", "grid_lon"))
    held = None
    for level in range(max(entering, default=-1), -1, -1):
        if level in entering:
            new = _around(entering[level], level)
            held = new if held is None else held.unionByName(new)
        boxed = held.join(block(level), ["b_lat", "b_lon"]).withColumns({
            "_far": squared("lat_lo", "lat_hi", "grid_lat", True) + squared("lon_lo", "lon_hi", "grid_lon", True),
            "_near": squared("lat_lo", "lat_hi", "grid_lat", False) + squared("lon_lo", "lon_hi", "grid_lon", False)})
        kept = boxed.withColumn("_best", best_far).filter("_near <= _best")
        if level == 0:
            return kept.groupBy("grid_lat", "grid_lon").agg(F.min(F.struct(F.col("_near"), F.col("b_lat").alias("cell_lat"), F.col("b_lon").alias("cell_lon"))).alias("b")).select(
                "grid_lat", "grid_lon", "b.cell_lat", "b.cell_lon")
        quarters = F.explode(F.array(*[F.struct((F.col("b_lat") * 2 + i).alias("b_lat"), (F.col("b_lon") * 2 + j).alias("b_lon")) for i in (0, 1) for j in (0, 1)]))
        held = cut_lineage(kept.select("grid_lat", "grid_lon", quarters.alias("q")).select("grid_lat", "grid_lon", "q.b_lat", "q.b_lon"))
    return asked.select("*", F.lit(None).cast("int").alias("cell_lat"), F.lit(None).cast("int").alias("cell_lon"))


def weather_at(points: DataFrame, hourly: DataFrame, daily: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``points`` (``grid_lat, grid_lon, day, hour, tier``; hours and days since 1970) with the weather ``fields`` to decide by: the exact hour
    in the hourly tier, the day's record in the daily tier, nothing otherwise. Tables are keyed ``grid_lat, grid_lon, hour`` or ``day``."""
    placed = points.join(nearest_cell(points, hourly), ["grid_lat", "grid_lon"], "left")

    def keyed(rows: DataFrame, when: str, prefix: str) -> DataFrame:
        return rows.select(F.col("grid_lat").alias("cell_lat"), F.col("grid_lon").alias("cell_lon"), when, *[F.col(f).alias(prefix + f) for f in fields])

    both = placed.join(keyed(hourly, "hour", "_h_"), ["cell_lat", "cell_lon", "hour"], "left").join(
        keyed(daily, "day", "_d_"), ["cell_lat", "cell_lon", "day"], "left")
    return both.select(*points.columns, "cell_lat", "cell_lon", *[
        F.when(F.col("tier") == R.TIER_HOURLY, F.col("_h_" + f)).when(F.col("tier") == R.TIER_DAILY, F.col("_d_" + f)).alias(f) for f in fields])


def tier_days(days: DataFrame, hourly: DataFrame, today: Column) -> DataFrame:
    """``days`` (``trip, day, ...``) with ``lead, tier, reason``. The hourly and daily tiers need a record at noon of that day in some cell
    and a lead below the forecast's reach; without one the tier is ``none``."""
    noons = hourly.filter(F.col("hour") % 24 == NOON).select(F.floor(F.col("hour") / 24).alias("day")).distinct().withColumn("_noon", F.lit(True))
    lead = F.col("day") - today
    wished = R.tier(F.col("lead"))
    served = F.coalesce("_noon", F.lit(False)) & (F.col("lead") < FORECAST_DAYS)
    short = wished.isin(R.TIER_HOURLY, R.TIER_DAILY)
    return days.withColumn("lead", lead).join(noons, "day", "left").withColumns({
        "tier": F.when(short & ~served, R.TIER_NONE).otherwise(wished),
        "reason": F.when(F.col("lead") < 0, "past").when(short & ~served, "no_forecast")}).drop("_noon")


def rain_hours(trips: DataFrame, observed: DataFrame) -> DataFrame:
    """``trip, rain_hours, rainy``: hours of rain at the hotel's ``cell`` inside the daily frame of ``trips``; a trip is rainy when any of
    its days has two such hours or more."""
    per_hour = observed.filter(R.is_raining()).groupBy("cell", "hour").agg(F.count(F.lit(1)).alias("n"))
    # A date's rainy hours are 24 entries at most, so a day of a trip is one row of the join, not one for each of its hours.
    wet = shared_if_small(per_hour.groupBy("cell", F.floor(F.col("hour") / 24).alias("date")).agg(F.collect_list(F.struct("hour", "n")).alias("rain")))
    frames = trip_days(trips).filter("day_end > day_start").select(
        "trip", "cell", "day", (F.col("day") * 24 + F.ceil(F.col("day_start") / 60)).alias("first"), (F.col("day") * 24 + F.ceil(F.col("day_end") / 60)).alias("end"))
    dates = F.sequence(F.floor(F.col("first") / 24), F.floor(F.greatest("first", F.col("end") - 1) / 24))
    inside = F.filter("rain", lambda r: (r["hour"] >= F.col("first")) & (r["hour"] < F.col("end")))
    met = frames.withColumn("date", F.explode(dates)).join(wet, ["cell", "date"], "left").select(
        "trip", "day", F.coalesce(F.aggregate(inside, F.lit(0).cast("bigint"), lambda total, r: total + r["n"]), F.lit(0)).alias("wet"))
    per_day = met.groupBy("trip", "day").agg(F.sum("wet").alias("wet"))
    return per_day.groupBy("trip").agg(F.sum("wet").alias("rain_hours"), (F.max("wet") >= RAINY_HOURS).alias("rainy"))


def fresh_cells(forecast: DataFrame, now: int, max_age_s: int = 6 * 3600) -> DataFrame:
    """Rows from an hour ago on of cells whose oldest such row was fetched within ``max_age_s`` (``cell, hour, fetched_s``; ``now`` in seconds)."""
    ahead = forecast.filter(F.col("hour") * 3600 >= now - 3600)
    oldest = ahead.groupBy("cell").agg(F.min("fetched_s").alias("_oldest")).filter(F.lit(now) - F.col("_oldest") <= max_age_s)
    return ahead.join(oldest.select("cell"), "cell")


def summarise_experiment(rows: DataFrame, baseline: str) -> DataFrame:
    """Means per ``scenario``, subset (all trips, rainy trips) and ``variant``, with the change of rain hours against the baseline variant.

    ``rows`` are ``scenario, trip, variant, rainy, outdoor_rain_hours, hazard_visits, visits, travel_minutes, feasible``."""
    subsets = F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("rainy"), F.lit("rainy"))))).alias("subset")
    cells = rows.select("*", subsets).groupBy("scenario", "subset", "variant").agg(
        F.count(F.lit(1)).alias("trips"), F.avg("outdoor_rain_hours").alias("rain_hours"), F.sum("hazard_visits").alias("hazard_visits"),
        F.avg("visits").alias("visits"), F.avg("travel_minutes").alias("travel_minutes"), F.avg(F.col("feasible").cast("int")).alias("feasible_share"))
    base = cells.filter(F.col("variant") == baseline).select("scenario", "subset", F.col("rain_hours").alias("_base"))
    return cells.join(base, ["scenario", "subset"], "left").withColumn(
        "change_pct", F.when(F.col("_base") > 0, 100 * (F.col("rain_hours") - F.col("_base")) / F.col("_base"))).drop("_base")


def violation_kinds(violations: DataFrame, runs: DataFrame) -> DataFrame:
    """How often each kind of violation occurs per variant; ``runs`` are ``trip, variant``."""
    return violations.join(runs, "trip").groupBy("variant", "kind").agg(F.count(F.lit(1)).alias("n"))
