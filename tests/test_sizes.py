"""What joins are planned by: sizes in memory, not sizes of files."""

from pyspark.sql import functions as F

from placeweave.operators import labels, matching, routes, trips, weather
from placeweave.plans.registry import table
from placeweave.plans.trips import trip_frames


def test_a_table_of_few_bytes_and_many_rows_is_not_broadcast(spark, tmp_path):
    spark.conf.unset("spark.sql.sources.fileCompressionFactor")
    rows = spark.range(400_000).select(F.col("id").alias("o_orderkey"), F.lit("F").alias("o_orderstatus"))
    rows.repartition(1).write.parquet(f"{tmp_path}/orders.parquet")
    days = trips.trip_days(trip_frames(spark, str(tmp_path))).select("trip", "day", "day_lo", "day_hi", "mode")
    plan = spark.range(10**7).withColumnRenamed("id", "trip").join(days, "trip", "left")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_small_tables_are_still_broadcast(spark):
    nation = table(spark, "/root/testdata/sf0.001", "nation").withColumnRenamed("n_nationkey", "id")
    assert "BroadcastHashJoin" in spark.range(10**7).join(nation, "id")._jdf.queryExecution().executedPlan().toString()


def test_landmarks_are_ranked_where_they_are_joined(spark):
    places = spark.range(50).select(F.col("id").alias("photo"), F.col("id").alias("place"), (16 + F.col("id") / 1000).alias("lat"), F.lit(107.5).alias("lon"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = routes.landmarks_near(places.drop("place"), places.drop("photo"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 2  # those of the join


def test_matching_shuffles_places_not_pairs(spark):
    pairs = spark.createDataFrame([(1, 11, 5.0), (1, 12, 4.0), (2, 12, 3.0), (3, 13, 2.0), (4, 13, 2.0)], "id_a bigint, id_b bigint, distance_m double")
    best = matching.first_for_both(pairs)
    assert sorted(map(tuple, best.collect())) == [(2, 12, 3.0), (3, 13, 2.0)]
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Window" not in plan


def test_places_are_made_once_for_their_category(spark):
    places = spark.range(6).select(F.col("id").alias("place"), F.array(F.lit("Q1")).alias("classes"), F.create_map(F.lit("a"), F.lit("b")).alias("tags"))
    classes = spark.createDataFrame([("Q1", "chua")], "qid string, category string")
    rules = spark.createDataFrame([(1, {"a": "*"}, "song")], "priority int, match map<string,string>, category string")
    plan = labels.map_category(places, classes, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Range (" not in plan  # what makes the places is not part of the last join


def test_rain_of_a_frame_is_one_row_per_date(spark):
    rows = [(1, 5, 5, 485, 490, 7), (2, 5, 6, 480, 720, 7), (3, 5, 5, 1380, 1560, 7), (4, 5, 5, 480, 720, 8), (5, 5, 5, 720, 720, 7)]
    frames = spark.createDataFrame(rows, "trip int, start_day int, end_day int, day_start int, day_end int, cell int").withColumns(
        {"start_min": F.col("day_start"), "end_min": F.col("day_end")})
    rainy = [(7, 5 * 24 + h, 9.0) for h in (8, 9, 11, 12, 23, 24)] + [(7, 5 * 24 + 9, 9.0), (7, 5 * 24 + 10, 0.0)]
    observed = spark.createDataFrame(rainy, "cell int, hour bigint, precip_mm double").withColumns(
        {"rain_prob": F.lit(0.0), "temp_c": F.lit(20.0), "wind_kmh": F.lit(0.0), "code": F.lit(0), "period_h": F.lit(1)})
    out = trips.rain_hours(frames, observed)
    # No whole hour begins in the first frame; two records of one hour count twice; the third frame goes past midnight.
    assert {r.trip: (r.rain_hours, r.rainy) for r in out.collect()} == {1: (0, False), 2: (4, True), 3: (2, True), 4: (0, False)}


def test_visits_of_an_audit_are_made_once(spark):
    visits = spark.range(6).select(F.lit(1).alias("trip"), F.lit(5).alias("day"), F.col("id").alias("visit"), F.col("id").alias("place"), F.lit(600).alias("arrive"), F.lit(660).alias("leave"))
    places = spark.createDataFrame([(0, 16.4, 107.5, 60, 0)], "place int, lat double, lon double, visit_minutes int, price int")
    frame = spark.createDataFrame([(1, 5, 5, 0, 900, 480, 1200, "car", 3, 1, 0.0, 0.0, 0.0, 0.0)],
                                  "trip int, start_day int, end_day int, start_min int, end_min int, day_start int, day_end int, mode string, max_places int, budget int,"
                                  " from_lat double, from_lon double, to_lat double, to_lon double")
    hours = spark.createDataFrame([(0, True, 5, 0, 1440)], "place int, parse_ok boolean, dow int, open_min int, close_min int")
    for out in trips.audit_feasibility(visits, places, frame, hours):
        assert "Range (" not in out._jdf.queryExecution().executedPlan().toString()  # what makes the visits is not planned for each kind


def test_violations_of_a_trip_are_found_in_one_place(spark):
    visits = spark.createDataFrame([(1, 5, 1, 7, 500, 560), (1, 5, 2, 7, 600, 605), (1, 5, 3, 9, 700, 760), (1, 8, 4, 7, 600, 660), (2, 5, 1, 7, 600, 660)],
                                   "trip int, day int, visit int, place int, arrive int, leave int")
    places = spark.createDataFrame([(7, 16.4, 107.5, 60, 30)], "place int, lat double, lon double, visit_minutes int, price int")
    trip = "trip int, start_day int, end_day int, start_min int, end_min int, day_start int, day_end int, mode string, max_places int, budget int, from_lat double, from_lon double, to_lat double, to_lon double"
    frames = spark.createDataFrame([(n, 5, 5, 480, 1200, 480, 1200, "car", 2, 50, 16.4, 107.5, 16.4, 107.5) for n in (1, 3)], trip)
    hours = spark.createDataFrame([(7, True, 1, 480, 590)], "place int, parse_ok boolean, dow int, open_min int, close_min int")
    violations, summary = trips.audit_feasibility(visits, places, frames, hours)
    assert sorted(map(str, violations.collect())) == sorted(map(str, [
        spark.createDataFrame([r], "trip int, kind string, day bigint, place bigint").first() for r in [
            (1, "duplicate", None, 7), (1, "outside_trip", 8, None), (1, "unknown_place", 5, 9), (1, "max_places", 5, None), (1, "budget", None, None),
            (1, "visit_too_short", 5, 7), (1, "opening_hours", 5, 7), (2, "outside_trip", 5, None)]]))
    assert {r.trip: (r.visits, r.violations, r.unverified_hours, r.travel_minutes, r.feasible) for r in summary.collect()} == {1: (4, 7, 0, 0, False), 3: (0, 0, 0, 0, True)}
    # Each kind of violation used to shuffle the visits again.
    assert "Exchange" not in violations._jdf.queryExecution().executedPlan().toString()


def test_visits_meet_a_small_weather_table_where_they_are(spark):
    hours = spark.createDataFrame([(n, 1, 3, 9, 1.0, 0.5, ["bao"]) for n in range(40)], "trip int, visit int, cell int, hour int, overlap_h double, indoor_ratio double, unsafe array<string>")
    seen = spark.createDataFrame([(3, 9, 2.0)], "cell int, hour int, precip_mm double").withColumns(
        {"rain_prob": F.lit(0.0), "temp_c": F.lit(20.0), "wind_kmh": F.lit(60.0), "code": F.lit(0), "period_h": F.lit(1)})
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = weather.weather_outcome(hours, seen)
        plan = out._jdf.queryExecution().executedPlan().toString()
        rows = {(r.outdoor_rain_hours, r.hazard_visits, r.unobserved_hours, r.visits) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert rows == {(0.5, 1, 0, 1)}
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan, plan
