"""Legs between slots and the nearest cell with data, against brute force."""

import math
import random

import pytest

from placeweave.functions import geo
from placeweave.operators import legs, trips

TRIP = ("trip int, start_day int, end_day int, start_min int, end_min int, day_start int, day_end int, mode string, from_lat double, from_lon double,"
        " to_lat double, to_lon double")
SLOT = "trip int, day int, place long, lo int, hi int, visit_minutes int, weather_cost int, factor double, stormy boolean, lat double, lon double"


def km_between(a, b):
    phi1, phi2 = math.radians(a[0]), math.radians(b[0])
    h = math.sin((phi2 - phi1) / 2) ** 2 + math.cos(phi1) * math.cos(phi2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(h)) * 1.3


def estimate(a, b, mode):
    whole = math.ceil(km_between(a, b) / geo.SPEED_KMH[mode] * 60)
    return whole + geo.BUFFER_MINUTES if whole > 0 else 0


def graph(slots, trip, crossed):
    day_of = {d: (max(trip[5], trip[3]) if d == trip[1] else trip[5], min(trip[6], trip[4]) if d == trip[2] else trip[6]) for d in range(trip[1], trip[2] + 1)}
    out = set()
    for day, (lo, hi) in day_of.items():
        hi = max(lo, hi)
        nodes = [(1, *s[2:]) for s in slots if s[0] == trip[0] and s[1] == day]
        start, end = (0, None, lo, hi, 0, 0, 1.0, False, trip[8], trip[9]), (2, None, lo, hi, 0, 0, 1.0, False, trip[10], trip[11])
        for a in [start, *nodes]:
            for b in [*nodes, end]:
                if a[1] is not None and a[1] == b[1]:
                    continue
                k = a if b[0] == 2 else b
                minutes = math.ceil(estimate(a[8:], b[8:], trip[7]) * k[6])
                if a[2] + a[4] + minutes <= b[3]:
                    wet = k[7] and crossed(a[8:], b[8:])
                    out.add((trip[0], day, a[0], a[1], a[2] if a[0] else lo, b[0], b[1], b[2] if b[0] == 1 else lo, minutes, minutes + b[5] + (30 if wet else 0), wet))
    return out


def test_legs_between_slots(spark):
    rng = random.Random(12)
    frames = [(1, 10, 11, 500, 1000, 480, 1200, "motorbike", 16.45, 107.55, 16.47, 107.58), (2, 10, 10, 480, 1140, 480, 1200, "walking", 16.46, 107.56, 16.46, 107.56),
              (3, 12, 12, 900, 700, 480, 1200, "car", 16.46, 107.56, 16.47, 107.58)]
    spots = {p: (16.44 + rng.random() * 0.05, 107.54 + rng.random() * 0.05) for p in range(8)}
    slots = []
    for t, day in ((1, 10), (1, 11), (2, 10), (3, 12)):
        for p in rng.sample(range(8), 5):
            for lo in (480, 540, 720, 960)[:rng.randrange(1, 5)]:
                slots.append((t, day, p, lo, lo + 59, 45 + 5 * p, rng.randrange(20), rng.choice([1.0, 1.2, 1.4, 1.8]), rng.random() < 0.6, *spots[p]))
    zone = (16.465, 107.565, 700.0)
    zones = spark.createDataFrame([(1, *zone)], "zone int, lat double, lon double, radius_m double")

    def crossed(a, b):
        k = geo.metres_per_degree()
        ax, ay, bx, by = ((a[1] - zone[1]) * k * math.cos(math.radians(zone[0])), (a[0] - zone[0]) * k, (b[1] - zone[1]) * k * math.cos(math.radians(zone[0])), (b[0] - zone[0]) * k)
        span = (bx - ax) ** 2 + (by - ay) ** 2
        t = 0 if span == 0 else min(1, max(0, (ax * (ax - bx) + ay * (ay - by)) / span))
        return math.hypot(ax + t * (bx - ax), ay + t * (by - ay)) <= zone[2]

    got = legs.slot_legs(spark.createDataFrame(slots, SLOT), spark.createDataFrame(frames, TRIP), zones)
    want = set().union(*(graph(slots, f, crossed) for f in frames))
    rows = {tuple(r) for r in got.collect()}
    assert rows == want and any(r[-1] for r in rows) and got.count() == len(want)
    chosen = {tuple(r[:6]): tuple(r[6:]) for r in legs.leg_choices(got).collect()}
    for key, (n, minutes, cost, wet) in chosen.items():
        group = [r for r in want if (r[0], r[1], r[2], r[3], r[5], r[6]) == key]
        assert (n, minutes, cost, wet) == (len(group), min(r[8] for r in group), min(r[9] for r in group), sum(r[10] for r in group))


def test_measured_minutes_of_the_slot_led_to(spark):
    frame = spark.createDataFrame([(1, 10, 10, 480, 1200, 480, 1200, "car", 16.45, 107.55, 16.45, 107.55)], TRIP)
    slots = spark.createDataFrame([(1, 10, 1, 480, 480, 30, 0, 1.0, False, 16.45, 107.55), (1, 10, 2, 960, 1080, 30, 7, 1.5, True, 16.46, 107.56)], SLOT)
    measured = spark.createDataFrame([(1, 2, 8, 10), (1, 2, 17, 21), (2, 1, 8, 5)], "origin long, dest long, hour int, minutes int")
    none = spark.createDataFrame([], "zone int, lat double, lon double, radius_m double")
    got = {(r.from_place, r.to_place): (r.minutes, r.cost) for r in legs.slot_legs(slots, frame, none, measured).collect()}
    assert got[1, 2] == (32, 39)  # the middle of the second slot, 17:00, is nearest to the second measurement: ceil(21 x 1.5)
    assert (2, 1) not in got and got[None, None] == (0, 0)


@pytest.mark.parametrize("seed", range(3))
def test_nearest_cell_by_rings(spark, seed):
    rng = random.Random(seed)
    spread = (8, 60, 3000)[seed]
    have = {(rng.randrange(-spread, spread), rng.randrange(-spread, spread)) for _ in range(40)}
    asked = {(rng.randrange(-spread, spread), rng.randrange(-spread, spread)) for _ in range(120)} | {(899, 1799), (-900, -1800)}
    points = spark.createDataFrame([(a, b) for a, b in asked for _ in range(2)], "grid_lat int, grid_lon int")
    cells = spark.createDataFrame([(a, b, 1) for a, b in have], "grid_lat int, grid_lon int, hour int")
    got = {(r.grid_lat, r.grid_lon): (r.cell_lat, r.cell_lon) for r in trips.nearest_cell(points, cells).collect()}
    assert got == {p: min(have, key=lambda c: ((c[0] - p[0]) ** 2 + (c[1] - p[1]) ** 2, c)) for p in asked}


def test_nearest_cell_of_nothing(spark):
    points = spark.createDataFrame([(1, 1)], "grid_lat int, grid_lon int")
    assert trips.nearest_cell(points, points.limit(0)).count() == 0
    assert trips.nearest_cell(points.limit(0), points).count() == 0


def test_slots_of_one_start_are_judged_apart_and_read_once(spark):
    """Two spans of hours that overlap begin with the same minute; the longer one meets a storm that the shorter one does not."""
    from pyspark.sql import functions as F
    from placeweave.operators.slots import slot_weather

    slots = spark.range(2).select(
        F.lit(1).alias("trip"), F.lit(5).alias("place"), F.lit(100).alias("day"), F.lit(480).alias("lo"), (F.lit(490) + F.col("id") * 120).cast("int").alias("hi"),
        F.lit("hourly").alias("tier"), F.lit(3).alias("cell"), F.lit(30).alias("visit_minutes"), F.lit(0.0).alias("indoor_ratio"), F.array(F.lit("bao")).alias("unsafe"))
    hour = F.col("id")
    hourly = spark.range(2400, 2424).select(
        F.lit(3).alias("cell"), hour.alias("hour"), F.lit(0.0).alias("precip_mm"), F.when(hour == 2410, 80.0).otherwise(0.0).alias("wind_kmh"),
        F.lit(20.0).alias("temp_c"), F.lit(0).alias("code"), F.lit(0.0).alias("rain_prob"), F.lit(1).alias("period_h"))
    daily = hourly.limit(0).withColumnRenamed("hour", "day")
    judged = slot_weather(slots, hourly, daily)
    assert sorted((r.hi, r.blocked, r.blocked_hour) for r in judged.collect()) == [(490, False, None), (610, True, 10)]
    assert judged._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 2,") == 1


def test_legs_of_a_trip_are_made_from_one_row(spark):
    frames = spark.createDataFrame([(1, 10, 11, 480, 1200, 480, 1200, "car", 16.45, 107.55, 16.45, 107.55)] * 2 + [(2, 10, 9, 480, 1200, 480, 1200, "car", 16.45, 107.55, 16.45, 107.55)], TRIP)
    slots = spark.createDataFrame([(1, 10, 5, 500, 600, 30, 4, 1.0, True, 16.45, 107.55), (3, 10, 5, 500, 600, 30, 4, 1.0, True, 16.45, 107.55)], SLOT)
    zones = spark.createDataFrame([(1, 16.45, 107.55, 300.0)], "zone int, lat double, lon double, radius_m double")
    found = legs.slot_legs(slots, frames, zones)
    chosen = {(r.trip, r.day, r.from_kind, r.to_kind): (r.slots, r.minutes, r.cost, r.flooded) for r in legs.leg_choices(found).collect()}
    # A trip told twice has two starts, two ends and two ways of travelling; one without days or without a trip has no legs.
    assert chosen == {(1, 10, 0, 1): (4, 0, 34, 4), (1, 10, 1, 2): (4, 0, 30, 4), (1, 10, 0, 2): (8, 0, 0, 0), (1, 11, 0, 2): (8, 0, 0, 0)}
    # Slots, pairs of places, legs and lines used to be written or shuffled one by one.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD[trip" in plan and "checkpoint" not in plan and plan.count("Exchange") <= 3


def test_unvisited_places_meet_what_is_known_of_them_once(spark):
    from placeweave.operators.slots import explain_unvisited

    pairs = "trip int, place int"
    wished = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (1, 3), (1, 4), (1, 5), (None, 6), (2, 1)], pairs)
    slots = spark.createDataFrame([(1, 1, False), (1, 1, True), (1, 2, True), (1, 2, True), (None, 6, False), (9, 9, False)], f"{pairs}, blocked boolean")
    shut = spark.createDataFrame([(1, 2, 5), (1, 3, 5), (1, 3, 6)], f"{pairs}, day int")
    out = explain_unvisited(wished, slots, shut, spark.createDataFrame([(1, 5), (7, 7)], pairs))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted((r.trip or 0, r.place, r.reason, r.avoided) for r in out.collect()) == [
        (0, 6, "too_short", 0), (1, 1, "no_room", 1), (1, 2, "weather", 2), (1, 3, "closed", 0), (1, 4, "too_short", 0), (2, 1, "too_short", 0)]


def test_slots_are_weathered_in_their_tasks(spark):
    from pyspark.sql import functions as F
    from placeweave.operators.slots import slot_weather

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    slots = spark.range(50).select(
        F.col("id").alias("trip"), F.lit(5).alias("place"), F.lit(100).alias("day"), F.lit(480).alias("lo"), F.lit(500).alias("hi"), F.lit("hourly").alias("tier"),
        F.lit(3).alias("cell"), F.lit(30).alias("visit_minutes"), F.lit(0.0).alias("indoor_ratio"), F.array(F.lit("bao")).alias("unsafe")).repartition("trip")
    hourly = spark.range(2400, 2424).select(F.lit(3).alias("cell"), F.col("id").alias("hour"), *[F.lit(0.0).alias(c) for c in ("precip_mm", "wind_kmh", "temp_c", "rain_prob")],
                                            F.lit(0).alias("code"), F.lit(1).alias("period_h"))
    try:
        plan = slot_weather(slots, hourly, hourly.withColumnRenamed("hour", "day"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning") == 1  # that of the slots themselves
