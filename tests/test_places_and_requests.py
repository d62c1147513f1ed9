"""Label layers, loads, requests and routes on tiny frames."""

import datetime
import re

from pyspark.sql import functions as F

from placeweave.operators import labels, loads, requests, routes, slots, trips
from placeweave.plans import requests as request_plans
from placeweave.sources import payloads
from placeweave.streaming import weather as streaming

TODAY = datetime.date(2024, 1, 11)


def test_category_rules(spark):
    places = spark.createDataFrame(
        [(1, ["Q9", "Q2", "Q1"], {}), (2, [], {"amenity": "cafe", "x": "1"}), (3, None, None), (4, ["Q9"], {"historic": "any"}), (5, [], {"amenity": "cafe", "kind": "b"})],
        "place int, classes array<string>, tags map<string,string>")
    classes = spark.createDataFrame([("Q1", "chua"), ("Q2", "song")], "qid string, category string")
    rules = spark.createDataFrame([(1, {"amenity": "cafe", "kind": "a"}, "no"), (2, {"amenity": "cafe"}, "quan"), (3, {"historic": "*"}, "di_tich"), (4, {"kind": "b"}, "late")],
                                  "priority int, match map<string,string>, category string")
    got = {r.place: r.category for r in labels.map_category(places, classes, rules).collect()}
    assert got == {1: "song", 2: "quan", 3: "khac", 4: "di_tich", 5: "quan"}


def test_label_layers(spark):
    base = spark.createDataFrame(
        [(1, "chua", {"building": "yes"}, ["a:1"]), (2, "di_tich", {"building": "yes"}, ["x:1", "b:2"]), (3, "new", {"leisure": "park"}, ["a:3", "b:2"])],
        "place int, category string, tags map<string,string>, ids array<string>")
    defaults = spark.createDataFrame([("chua", 0.5, 45), ("di_tich", 0.3, 90), ("khac", 0.6, None)], "category string, indoor_ratio double, visit_minutes int")
    entries = spark.createDataFrame([("a:3", None, 10), ("b:2", 0.2, None), ("z:9", 1.0, 1)], "key string, indoor_ratio double, visit_minutes int")
    ruled = labels.apply_tag_rules(labels.apply_defaults(base, defaults))
    out, unused = labels.apply_entries(ruled, entries, ["indoor_ratio", "visit_minutes"], ("label_source", "manual"))
    got = {r.place: (r.indoor_ratio, r.visit_minutes, r.label_source) for r in out.collect()}
    assert got == {1: (0.9, 45, "default"), 2: (0.2, 90, "manual"), 3: (0.05, 10, "manual")}
    assert [r.key for r in unused.collect()] == ["z:9"]


def test_quality_of_nothing(spark):
    places = spark.createDataFrame([], "place int, category string, has_hours boolean, label_source string, inside boolean")
    out = labels.quality_metrics(places, spark.createDataFrame([], "place int, source string"), spark.createDataFrame([], "place int")).collect()
    assert {r.metric for r in out} == {"categorised", "core_with_hours", "linked_with_image", "manual_labels", "five_images"}
    assert all(r.value == 0 for r in out)


def test_square(spark):
    ring = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 0.0, 1.0), (1, 2, 1.0, 1.0), (1, 3, 1.0, 0.0)], "region int, seq int, lat double, lon double")
    points = spark.createDataFrame([(1, 1, 0.5, 0.5), (2, 1, 1.5, 0.5), (3, 1, 0.5, -0.1), (4, 2, 0.5, 0.5), (5, 1, None, 0.5)], "place int, region int, lat double, lon double")
    assert [r.place for r in labels.within_polygon(points, ring).collect()] == [1]


def test_upsert_places(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "place_id bigint, name string")
    links = spark.createDataFrame([("x:1", 1), ("y:2", 2)], "key string, place_id bigint")
    batch = spark.createDataFrame([(10, "A", ["x:1", "n:1"]), (11, "AB", ["y:2", "x:1"]), (12, "C", ["n:2"])], "record bigint, name string, ids array<string>")
    stored, linked, conflicts = loads.upsert_places(target, links, batch)
    assert {(r.place_id, r.name) for r in stored.collect()} == {(1, "AB"), (2, "b"), (3, "C")}
    assert {(r.key, r.place_id) for r in linked.collect()} == {("x:1", 1), ("y:2", 2), ("n:1", 1), ("n:2", 3)}
    assert [(r.record, r.place_id, r.matched) for r in conflicts.collect()] == [(11, 1, "1,2")]


def test_payloads_that_do_not_parse(spark):
    raw = spark.createDataFrame([(1, "not json"), (2, None), (3, "{}"), (4, '{"elements": [{"type": "node", "id": 5, "lat": 1.0, "lon": 2.0, "tags": {}}]}')], "id int, payload string")
    for read in (payloads.read_map_elements, payloads.read_kb_bindings, payloads.read_hourly, payloads.read_daily, payloads.read_extracts, payloads.read_image_info):
        assert read(raw, ["id"]).count() == 0
    assert [r.valid for r in payloads.read_schedules(raw, ["id"]).collect()] == [False] * 4


def test_hourly_offset(spark):
    raw = spark.createDataFrame([('{"utc_offset_seconds": 25200, "hourly": {"time": ["2026-01-01T07:00", "2026-01-01T08:00"], "precipitation": [0.0, 1.2], "weather_code": [1, 61]}}',)], "payload string")
    rows = payloads.read_hourly(raw).withColumn("s", F.unix_seconds("time")).orderBy("s").collect()
    assert [(r.precip_mm, r.code, r.temp_c) for r in rows] == [(0.0, 1, None), (1.2, 61, None)]
    assert rows[0].s == int(datetime.datetime(2026, 1, 1, tzinfo=datetime.timezone.utc).timestamp())


def test_request_meaning(spark):
    texts = [(i, p) for i, p in enumerate(request_plans.PHRASES)] + [(90, None), (91, "Giờ mở cửa Đại Nội")]
    asked = spark.createDataFrame(texts, "request int, text string")
    named = requests.match_aliases(asked, spark.createDataFrame([("dai noi", 7), ("noi", 8)], "alias string, place int"))
    assert [(r.request, r.place, r["rank"]) for r in named.collect()] == [(91, 7, 1)]
    got = {r.request: (r.intent, (r.start - TODAY).days, r.days, r.mode, r.assumed) for r in requests.tag_requests(asked, named, F.lit(TODAY)).collect()}
    assert got == {
        0: ("plan", 25, 3, "walking", "places"), 1: ("ask", 2, 1, "motorbike", "days,places"), 2: ("weather", 1, 1, "motorbike", "days,places"),
        3: ("ask", 0, 2, "car", "places"), 4: ("plan", 2, 7, "motorbike", "places"), 5: ("ask", 1, 1, "motorbike", "date,days,places"),
        6: ("ask", 1, 1, "motorbike", "date,days,places"), 90: ("ask", 1, 1, "motorbike", "date,days,places"), 91: ("info", 1, 1, "motorbike", "date,days")}


def test_alias_hits_by_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    names = {}
    for r in request_plans.aliases(spark, sf).collect():
        names[r.alias] = min(r.place, names.get(r.alias, r.place))
    from placeweave.functions import text
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select(
        F.struct("conv_id", "turn").alias("request"), text.fold_ws(F.coalesce("text", F.lit(""))).alias("t")).collect()
    want = set()
    for turn in turns:
        words = re.findall(r"\w+", turn.t)
        hits = sorted((-len(" ".join(words[i:i + n])), i, i + n, names[" ".join(words[i:i + n])])
                      for n in (1, 2) for i in range(len(words) - n + 1) if " ".join(words[i:i + n]) in names)
        kept = []
        for hit in hits:
            if not any(hit[1] < k[2] and k[1] < hit[2] for k in kept):
                kept.append(hit)
        first = {}
        for _, i, _, place in kept:
            first[place] = min(i, first.get(place, i))
        want |= {(*turn.request, place, n) for n, (place, _) in enumerate(sorted(first.items(), key=lambda x: (x[1], x[0])), 1)}
    assert {tuple(r) for r in request_plans.alias_hits(spark, sf).select("conv_id", "turn", "place", "rank").collect()} == want


def test_long_conversations_stay_apart(spark, tmp_path):
    rows = [(1, 1000, "user", "alpha beta"), (2, 0, "user", "beta alpha beta"), (2, 1, "user", "nothing"), (1, 1001, "user", "beta")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    spark.createDataFrame([(5, "alpha beta gamma")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf = str(tmp_path)
    hits = {(r.conv_id, r.turn, r.place, r["rank"]) for r in request_plans.alias_hits(spark, sf).collect()}
    assert hits == {(1, 1000, 5, 1), (1, 1001, 5, 1), (2, 0, 5, 1)}
    counts = sorted((r.conv_id, r.turn, r.alias, r.n) for r in request_plans.alias_mentions(spark, sf).collect())
    assert counts == [(1, 1000, "alpha beta", 1), (1, 1000, "beta", 1), (1, 1001, "beta", 1), (2, 0, "alpha beta", 1), (2, 0, "beta", 2)]
    tags = {(r.conv_id, r.turn): "places" in r.assumed for r in request_plans.request_tags(spark, sf).collect()}
    assert tags == {(1, 1000): False, (2, 0): False, (2, 1): True, (1, 1001): False}


def test_known_line(spark):
    line = spark.createDataFrame([(1, "_p~iF~ps|U_ulLnnqC_mqNvxq`@"), (2, ""), (3, None)], "route int, polyline string")
    points = routes.polyline_points(line)
    assert [(r.lat, r.lon) for r in points.orderBy("seq").collect()] == [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]
    assert [r.polyline for r in routes.encode_lines(points).collect()] == ["_p~iF~ps|U_ulLnnqC_mqNvxq`@"]


def test_zone_and_route_choice(spark):
    zone = spark.createDataFrame([(1, 16.46, 107.57, 400.0)], "zone int, lat double, lon double, radius_m double")
    paths = spark.createDataFrame([(1, 0, 16.46, 107.55), (1, 1, 16.46, 107.59), (2, 0, 16.48, 107.55), (2, 1, 16.48, 107.59), (3, 0, 16.461, 107.57)],
                                  "path int, seq int, lat double, lon double")
    hits = routes.zones_on_paths(paths, zone)
    assert sorted(r.path for r in hits.collect()) == [1, 3]
    options = spark.createDataFrame([(1, 0, 1, 10), (1, 1, 2, 14), (2, 0, 1, 10), (2, 1, 3, 11), (3, 0, 1, 10)], "leg int, rank int, path int, minutes int")
    storm = spark.createDataFrame([(1,), (2,)], "leg int")
    got = {r.leg: (r["rank"], r.extra_minutes, r.note) for r in routes.choose_routes(options, hits, storm).collect()}
    assert got == {1: (1, 4, "detour"), 2: (0, 0, "all_flooded"), 3: (0, 0, None)}


def test_departure_bucket(spark):
    legs = spark.createDataFrame([(1, 1, 2, 540, 1.0), (2, 1, 2, 990, 1.0), (3, 1, 2, None, 1.0), (4, 2, 1, 540, 0.0)], "leg int, origin int, dest int, minute int, km double")
    buckets = spark.createDataFrame([(1, 2, 8, 80), (1, 2, 8, 95), (1, 2, 12, 120), (1, 2, 17, 170)], "origin int, dest int, hour int, minutes int")
    got = {r.leg: (r.minutes, r.travel_source) for r in trips.travel_at(legs.withColumn("mode", F.lit("car")), buckets).collect()}
    assert got == {1: (80, "measured"), 2: (170, "measured"), 3: (80, "measured"), 4: (0, "estimate")}


def test_empty_schedules(spark):
    visits = spark.createDataFrame([], "trip int, day int, visit int, place int, arrive int, leave int")
    places = spark.createDataFrame([], "place int, lat double, lon double, visit_minutes int, price int")
    frame = spark.createDataFrame([(1, 5, 5, 0, 900, 480, 1200, "car", 3, None, 0.0, 0.0, 0.0, 0.0)],
                                  "trip int, start_day int, end_day int, start_min int, end_min int, day_start int, day_end int, mode string, max_places int, budget int,"
                                  " from_lat double, from_lon double, to_lat double, to_lon double")
    hours = spark.createDataFrame([], "place int, parse_ok boolean, dow int, open_min int, close_min int")
    violations, summary = trips.audit_feasibility(visits, places, frame, hours)
    assert violations.count() == 0 and [(r.trip, r.visits, r.feasible) for r in summary.collect()] == [(1, 0, True)]
    assert [(r.day_lo, r.day_hi) for r in trips.trip_days(frame).collect()] == [(480, 900)]


def test_trip_cap(spark):
    scenarios = spark.createDataFrame([(1, "a", 2, 3)], "config int, scenario string, trip_days int, step_days int")
    periods = spark.createDataFrame([(1, 0, 10, 17), (1, 1, 30, 30)], "config int, period int, period_start int, period_end int")
    assert [(r.start_day, r.end_day) for r in slots.enumerate_trips(scenarios, periods).orderBy("start_day").collect()] == [(10, 11), (13, 14), (16, 17)]
    assert slots.enumerate_trips(scenarios, periods, 2).count() == 2


def test_streams_equal_batches(spark, tmp_path):
    rows = [(1, datetime.datetime(2024, 1, d, h), float(h), 20.0 + h, 5.0, h) for d in (1, 2, 3, 4) for h in (3, 9, 21)]
    shape = "cell int, time timestamp, precip_mm double, temp_c double, wind_kmh double, code int"
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, shape).coalesce(1).write.parquet(src)
    q = streaming.stream_daily(spark.readStream.schema(shape).parquet(src)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.date.day, r.precip_mm, r.temp_c) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(d, 33.0, 41.0) for d in (1, 2, 3)}  # the fourth day is still open

    forecast = "cell int, hour int, precip_mm double, uv_index double, fetched_s int"
    inbox, store = str(tmp_path / "f"), str(tmp_path / "store")
    for batch in ([(1, 1, 1.0, 5.0, 10), (1, 1, 2.0, 6.0, 20), (1, 2, 3.0, None, 10)], [(1, 1, 9.0, None, 30)]):
        spark.createDataFrame(batch, forecast).coalesce(1).write.mode("append").parquet(inbox)
        streaming.load_forecast(spark.readStream.schema(forecast).parquet(inbox), store, str(tmp_path / "cp2")).awaitTermination()
    rows = spark.createDataFrame([], forecast).schema
    assert {tuple(r) for r in streaming.read_forecast(spark, store, rows).select("hour", "precip_mm", "uv_index").collect()} == {(1, 9.0, 6.0), (2, 3.0, None)}


def test_a_batch_writes_only_the_buckets_it_touches(spark, tmp_path):
    shape = "cell int, hour int, precip_mm double, uv_index double, fetched_s int"
    store = str(tmp_path)
    first = [(c, h, float(c + h), 1.0, 1) for c in range(40) for h in range(3)]
    second = [(3, 1, 50.0, None, 2), (3, 9, 51.0, 4.0, 2)]
    want = {(c, h): (p, uv) for c, h, p, uv, _ in first} | {(3, 1): (50.0, 1.0), (3, 9): (51.0, 4.0)}
    empty = spark.createDataFrame([], shape)
    for n, batch in ((0, first), (1, second), (1, second), (2, []), (3, [(200, 0, 7.0, None, 1)])):
        streaming.apply_batch(spark.createDataFrame(batch, shape) if batch else empty, store, n, 8)
    written = {n: {p.name for p in (tmp_path / "data" / f"version={n}").iterdir() if p.name.startswith("bucket")} for n in (0, 1, 2, 3)}
    assert len(written[0]) == 8 and len(written[1]) == 1 and not written[2] and len(written[3]) == 1
    got = {(r.cell, r.hour): (r.precip_mm, r.uv_index) for r in streaming.read_forecast(spark, store, empty.schema).collect()}
    assert got == want | {(200, 0): (7.0, None)}
