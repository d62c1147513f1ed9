"""Golden values of FIXTURES.md, on tiny frames."""

import pytest
from pyspark.sql import functions as F

from placeweave.functions import geo, hours, text
from placeweave.functions import weather_rules as R
from placeweave.operators import matching, retrieval
from placeweave.operators.scale import latest_per_key

ALL = range(7)


def week(*intervals, days=ALL):
    return {(d, a, b) for d in days for a, b in intervals}


@pytest.mark.parametrize("raw,want", [
    ("24/7", week((0, 1440))),
    ("Mo-Su 07:00-17:00", week((420, 1020))),
    ("Mo-Fr 08:00-11:30,13:30-17:00", week((480, 690), (810, 1020), days=range(5))),
    ("Tu-Su 08:00-17:00; Mo off", week((480, 1020), days=range(1, 7))),
    ("Mo,We,Fr 09:00-12:00", week((540, 720), days=(0, 2, 4))),
    ("Sa-Mo 10:00-12:00", week((600, 720), days=(5, 6, 0))),
    ("Mo-Su off", set()),
    ("06:30-22:00,17:00-21:00", week((390, 1320))),
    ("Mo-Su 17:00-01:30", week((0, 90), (1020, 1440))),
    ("Mo-Su 18:00-00:00", week((1080, 1440))),
    *((bad, None) for bad in ("sunrise-sunset", "Apr-Oct Mo-Su 07:00-18:00", "week 1-53/2 Mo 08:00-09:00", "open daily", "", None, ";;;",
                              "0600-2300", "25:00-26:00", "Mo-Su 12:00-12:00", "10:00-10:00", "Tu-Su 07:30-11:30; 13:30-17:00")),
])
def test_opening_hours(spark, raw, want):
    frame = spark.createDataFrame([(1, raw)], "place_id int, opening_hours_raw string")
    rows = hours.opening_intervals(frame).collect()
    if want is None:
        assert [r.parse_ok for r in rows] == [False]
        return
    covered = {(r.dow, m) for r in rows if r.open_min is not None for m in range(r.open_min, r.close_min)}
    assert all(r.parse_ok for r in rows) and covered == {(d, m) for d, a, b in want for m in range(a, b)}


def test_names_and_folding(spark):
    names = {"Chùa Thiên Mụ": "thien mu", "Lăng Tự Đức": "tu duc", "Đại Nội": "dai noi", "Đền Huyền Trân": "huyen tran"}
    frame = spark.createDataFrame([(k,) for k in names], "n string")
    assert [r[0] for r in frame.select(text.norm_name(F.col("n"))).collect()] == list(names.values())
    folded = spark.createDataFrame([("ガぎ",), ("ﬁne Straße",), ("ǰ",)], "n string").select(text.fold(F.col("n"))).collect()
    assert [r[0] for r in folded] == ["カき", "fine strasse", "j"]


@pytest.mark.parametrize("row,hazards,raining,factor", [
    ((8.0, 0.0, 0, 1), ["mua_lon"], True, 1.4), ((3.0, 0.0, 0, 1), [], True, 1.2), ((0.0, 55.0, 0, 1), ["bao", "song_lon"], False, 1.8),
    ((0.0, 0.0, 95, 1), ["bao"], False, 1.8), ((30.0, 0.0, 0, 24), [], True, 1.2), ((60.0, 0.0, 0, 24), ["mua_lon"], True, 1.4),
    ((None, None, None, 1), [], None, 1.0)])
def test_weather_rules(spark, row, hazards, raining, factor):
    frame = spark.createDataFrame([row], "precip_mm double, wind_kmh double, code int, period_h int")
    got = frame.select(R.hazards().alias("h"), R.is_raining().alias("r"), R.travel_factor().alias("f")).first()
    assert (got.h, got.r, got.f) == (hazards, raining, factor)


def test_tiers(spark):
    leads = spark.createDataFrame([(d,) for d in (-1, 0, 3, 4, 10, 11)], "d int")
    assert [r[0] for r in leads.select(R.tier(F.col("d"))).collect()] == ["none", "hourly", "hourly", "daily", "daily", "climate"]


def test_distances(spark):
    one = spark.range(1)
    d = one.select(geo.haversine_m(F.lit(16.4698), F.lit(107.5796), F.lit(16.4698), F.lit(107.5896))).first()[0]
    assert 1000 < d < 1120
    lits = [F.lit(v) for v in (16.46, 107.56, 16.46, 107.58, 16.46, 107.57)]
    assert one.select(geo.segment_distance_m(*lits)).first()[0] == pytest.approx(0, abs=1e-6)
    lits[4] = F.lit(16.47)
    assert one.select(geo.segment_distance_m(*lits)).first()[0] == pytest.approx(1112, rel=0.01)
    same = [F.lit(v) for v in (16.46, 107.57, 16.46, 107.57, 16.46, 107.58)]
    assert one.select(geo.segment_distance_m(*same)).first()[0] == pytest.approx(1066, rel=0.01)


def places(spark, rows):
    shape = "id string, name string, lat double, lon double, opening_hours_raw string, website string, tags map<string,string>"
    facts = {"a1": ("Mo 08:00-09:00", "w1", {"k": "a", "x": "1"}), "b2": ("", "w2", {"k": "b"}), "a2": (None, None, None), "b1": ("24/7", None, {"z": "1"})}
    return spark.createDataFrame([(i, n, 16.47 + dy / 111_195, 107.58, *facts.get(i, (None, None, {}))) for i, n, dy in rows], shape)


def test_matching_takes_the_closest_pairs_once(spark):
    a = places(spark, [("a1", "Chùa Xá", 0.0), ("a2", "chùa  xá!", 60.0), ("a3", "y", 0.0), ("a4", "z", 0.0)])
    b = places(spark, [("b1", "Xa", 50.0), ("b2", "XÁ", 140.0), ("b3", "y", 500.0), ("b4", "other", 0.0)])
    got = matching.match_places(a, b, 150.0)
    assert {(r.id_a, r.id_b) for r in got.collect()} == {("a1", "b2"), ("a2", "b1")}
    assert {r.place_key: r.ids for r in matching.merge_places(a, b, got).collect()} == {
        "a1": ["a1", "b2"], "a2": ["a2", "b1"], "a3": ["a3"], "a4": ["a4"], "b3": ["b3"], "b4": ["b4"]}
    merged = {r.place_key: (r.name, r.opening_hours_raw, r.website, r.tags) for r in matching.merge_places(a, b, got).collect()}
    assert merged["a1"] == ("Chùa Xá", "Mo 08:00-09:00", "w2", {"k": "b", "x": "1"}) and merged["a2"] == ("chùa  xá!", "24/7", None, {"z": "1"})
    assert {(r.id, r.candidates) for r in matching.review_names(a, b, got).collect()} == {("a3", 1), ("b3", 1)}
    assert matching.match_places(a.limit(0), b).count() == 0


def test_latest_per_key(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (2, 2, "c")], "k int, t int, v string")
    assert {(r.k, r.v) for r in latest_per_key(rows, ["k"], ["t"]).collect()} == {(1, "b"), (2, "c")}


def test_dense_search_filters_and_string_ids(spark):
    chunks = spark.createDataFrame([("c1", "x", [1.0, 0.0], "m"), ("c2", "y", [1.0, 0.1], "m"), ("c3", "x", [0.0, 1.0], "m"), ("c4", "x", None, "m")],
                                   "chunk_id string, category string, embedding array<double>, embedding_model string")
    asked = spark.createDataFrame([(1, "q", "x", [1.0, 0.0]), (2, "q", "", [1.0, 0.0]), (3, " ", None, [1.0, 0.0]), (4, "q", None, None)],
                                  "query_id int, query string, category string, embedding array<double>")
    got = retrieval.dense_search(asked, chunks, 2, "m").collect()
    assert sorted((r.query_id, r["rank"], r.chunk_id) for r in got) == [(1, 1, "c1"), (1, 2, "c3"), (2, 1, "c1"), (2, 2, "c2")]


def test_rank_fusion(spark):
    ranking = "query_id int, rank int, chunk_id int"
    one, two = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], ranking), spark.createDataFrame([(1, 1, 2), (1, 2, 3)], ranking)
    got = retrieval.rrf([one, two], 5).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [2, 1, 3] and got[0].score == pytest.approx(1 / 62 + 1 / 61)


def test_matching_makes_few_pairs_at_a_time(spark, monkeypatch):
    import random

    rng, made = random.Random(3), []
    rows = [(i, rng.choice(["Chùa A", "chua a", "B"]), 16.4 + rng.randrange(40) * 2e-4, 107.5 + rng.randrange(40) * 2e-4) for i in range(500)]
    a, b = (spark.createDataFrame([r for r in rows if r[0] % 2 == side], "id long, name string, lat double, lon double") for side in (0, 1))
    left, right = (matching._by_key(df) for df in (a, b))
    every = sorted((r.distance_m, r.id_a, r.id_b) for r in matching.near_pairs(left, right, 400.0).collect())
    want, used = set(), (set(), set())
    for d, x, y in every:
        if x not in used[0] and y not in used[1]:
            want.add((x, y))
            used[0].add(x)
            used[1].add(y)
    kept = matching.cut_lineage

    def counted(df):
        out = kept(df)
        made.append(out.count())
        return out

    monkeypatch.setattr(matching, "cut_lineage", counted)
    assert {(r.id_a, r.id_b) for r in matching.match_places(a, b, 400.0).collect()} == want
    assert max(made) < 12 * 500 < len(every)  # all pairs used to be written at once
