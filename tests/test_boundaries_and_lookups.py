"""Boundary rings, name lookup and written hours on small frames."""

import random

import pytest
from pyspark.sql import functions as F

from placeweave.functions import hours
from placeweave.functions import text as X
from placeweave.operators import lookup, rings

WAYS = "region long, way long, pos long, lat double, lon double"


def ways_frame(spark, regions):
    rows = [(r, w, p, float(lat), float(lon)) for r, ways in regions.items() for w, way in enumerate(ways) for p, (lat, lon) in enumerate(way)]
    return spark.createDataFrame(rows, WAYS).repartition(4)


def assembled(spark, regions):
    points, states = rings.assemble_rings(ways_frame(spark, regions))
    out = {r: [] for r in regions}
    for p in sorted(points.collect()):
        out[p.region].append((p.lat, p.lon))
    return out, {s.region: s.state for s in states.collect()}


def chained(ways):
    """Way after way in a loop, as a brute-force reading of the definition; None where ways are left."""
    left, ring = [list(w) for w in ways[1:]], list(ways[0])
    while left:
        fits = [w for w in left if ring[-1] in (w[0], w[-1])]
        if not fits:
            return None
        left.remove(fits[0])
        ring += (fits[0] if fits[0][0] == ring[-1] else fits[0][::-1])[1:]
    return ring if ring[0] == ring[-1] else [*ring, ring[0]]


A, B, C, D, E5 = (0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (5.0, 5.0)


def test_rings_of_known_shapes(spark):
    shapes = {
        1: ([[A, B, C, D, A]], "ring"), 2: ([[A, B], [C, D], [D, A], [B, C]], "ring"), 3: ([[A, B], [C, B], [D, C], [D, A]], "ring"),
        4: ([[A, B], [B, C], [C, D]], "ring"), 5: ([[B, C], [A, B], [C, D]], "unjoined"), 6: ([[A, B, C, A], [D, E5]], "unjoined"),
        7: ([[A, B], [B, C], [C, A], [B, E5]], "branching"), 8: ([[A, B]], "too_few_points"), 9: ([[A, B], [B, A]], "ring"),
        10: ([[A, B], [D, C], [C, E5], [E5, D]], "unjoined"), 11: ([[A]], "too_few_points"), 12: ([[A, B, C]], "ring"), 13: ([[B, A], [B, C], [C, D]], "unjoined")}
    points, states = assembled(spark, {r: ways for r, (ways, _) in shapes.items()})
    assert states == {r: state for r, (_, state) in shapes.items()}
    for r, (ways, state) in shapes.items():
        assert points[r] == (chained(ways) if state == "ring" else []), r


def test_long_rings_take_few_rounds(spark):
    rng, regions = random.Random(1), {}
    for r in range(12):
        nodes = [(float(i), float(i * i % 101)) for i in range(rng.randrange(3, 400))]
        cuts = sorted(rng.sample(range(1, len(nodes)), rng.randrange(0, len(nodes) - 1))) if len(nodes) > 2 else []
        ring = [*nodes, nodes[0]]
        edges = [0, *cuts, len(nodes)]
        ways = [ring[a:b + 1] for a, b in zip(edges, edges[1:])]
        ways = [w[::-1] if rng.random() < 0.5 else w for w in ways]
        rng.shuffle(ways)
        if r % 4 == 3 and len(ways) > 2:
            ways.pop(rng.randrange(1, len(ways)))
        regions[r] = ways
    points, states = assembled(spark, regions)
    for r, ways in regions.items():
        want = chained(ways)
        assert points[r] == (want or []) and states[r] == ("ring" if want else "unjoined")
    empty = rings.assemble_rings(ways_frame(spark, regions).limit(0))
    assert [df.count() for df in empty] == [0, 0]


def test_smallest_unit(spark):
    units = spark.createDataFrame([(1, 10, 4), (1, 11, 6), (1, 12, 6), (2, 20, None)], "area long, region long, level int")
    assert {(r.area, r.region) for r in rings.smallest_unit(units).collect()} == {(1, 11), (2, 20)}


def looked_up(spark, asks, names):
    asked = spark.createDataFrame(list(enumerate(asks)), "ask long, text string")
    places = spark.createDataFrame(list(enumerate(names)), "place long, name string")
    return [r.place for r in sorted(lookup.find_by_name(asked, places).collect())]


def test_lookup_by_containment(spark):
    names = ["Hoàng thành Huế", "Lăng Khải Định", "Lăng Tự Đức", "Huế", "Cầu", None, "", "Lăng Khải Định"]
    assert looked_up(spark, ["lang khai dinh", "Tháp Eiffel", "đi Lăng Tự Đức nhé", "hue", "thanh", "u", "", None, "LĂNG"], names) == [1, None, 2, 3, 0, 3, None, None, 2]


def test_lookup_against_all_names(spark, monkeypatch):
    monkeypatch.setattr(lookup, "GRAM_NAMES", 3)
    rng = random.Random(8)
    names = ["".join(rng.choice("abc ") for _ in range(rng.randrange(0, 9))) for _ in range(150)] + ["x" * 300, "aaaa" * 20]
    asks = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(0, 14))) for _ in range(120)] + ["x" * 400, "a", "zz", "É"]
    want = []
    for ask in asks:
        ask = ask.lower()
        fits = [(abs(len(n) - len(ask)), p) for p, n in enumerate(names) if ask and n and (ask in n or n in ask)]
        want.append(min(fits)[1] if fits else None)
    assert looked_up(spark, asks, names) == want


def test_an_alias_comes_before_the_letters(spark):
    asked = spark.createDataFrame([(1, "Đại Nội"), (2, "noi")], "ask long, text string")
    places = spark.createDataFrame([(7, "Đại Nội"), (8, "Hoàng thành")], "place long, name string")
    named = spark.createDataFrame([(1, 8)], "ask long, place long")
    assert {(r.ask, r.place) for r in lookup.find_places(asked, places, named).collect()} == {(1, 8), (2, 7)}


WEEKS = {
    "Mo-Su 07:00-17:00": "Mo-Su 07:00-17:00", "24/7": "24/7", "Mo-Su 00:00-24:00": "24/7", "Mo-Su off": "Mo-Su off", "Sa-Mo 10:00-12:00": "Tu-Fr off; Sa-Mo 10:00-12:00",
    "Mo,We,Fr 09:00-12:00": "Mo 09:00-12:00; Tu off; We 09:00-12:00; Th off; Fr 09:00-12:00; Sa-Su off", "Mo-Su 17:00-01:30": "Mo-Su 17:00-01:30",
    "Fr-Sa 18:00-02:00; Su 10:00-12:00": "Mo-Th off; Fr-Sa 18:00-02:00; Su 10:00-12:00", "Su 22:00-05:00": "Mo-Sa off; Su 22:00-05:00",
    "Mo-Su 18:00-00:00": "Mo-Su 18:00-24:00", "Mo 00:00-24:00": "Mo 00:00-24:00; Tu-Su off", "Fr 20:00-03:00; Sa 00:00-04:00": None, "06:30-22:00,17:00-21:00": None,
    "Tu-Su 08:00-17:00; Mo off": "Mo off; Tu-Su 08:00-17:00", "Mo-We 20:00-20:00": None}


def test_weeks_read_back_to_the_same_hours(spark):
    rng = random.Random(6)
    made = []
    for _ in range(60):
        days = rng.sample(hours.DAY_TOKENS, rng.randrange(1, 8))
        made.append("; ".join(f"{d} " + rng.choice(["off", "08:00-12:00", "08:00-12:00,13:00-17:30", "18:00-02:00", "20:00-08:00", "00:00-24:00", "00:00-06:00,23:00-24:00"]) for d in days))
    frame = spark.createDataFrame([(t,) for t in [*WEEKS, *made]], "raw string")
    once = frame.select("raw", hours.parse_hours(F.col("raw"))["intervals"].alias("hours")).withColumn("week", hours.compact_hours(F.col("hours")))
    rows = once.withColumn("again", hours.parse_hours(F.col("week"))["intervals"]).collect()
    told = {r.raw: r.week for r in rows}
    assert {raw: told[raw] for raw, week in WEEKS.items() if week} == {raw: week for raw, week in WEEKS.items() if week}
    for r in rows:
        assert r.hours == r.again, r


def test_folding_of_lookups_is_that_of_texts(spark):
    assert spark.range(1).select(X.fold(F.lit("LĂNG Khải Định"))).first()[0] == "lang khai dinh"


@pytest.mark.parametrize("raw", [None, "by appointment"])
def test_unknown_hours_have_no_week(spark, raw):
    frame = spark.createDataFrame([(raw,)], "raw string")
    assert frame.select(hours.compact_hours(hours.parse_hours(F.col("raw"))["intervals"])).first()[0] is None
