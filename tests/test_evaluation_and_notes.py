"""Lexical search against brute force, metrics and audits of known answers, notes for travellers, weather from several sources."""

import math
import random
import re
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from placeweave.operators import evaluation as V
from placeweave.operators import notes, postings, retrieval, trips, weather

CORPUS = "chunk_id string, place_id long, place_name string, category string, content string"


def bm25(corpus, query, category=None, place=None, k1=1.5, b=0.75):
    docs = {c: re.findall(r"\w+", f"{name}: {text}".lower()) for c, _, name, _, text in corpus}
    n, average = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(w for words in docs.values() for w in set(words))
    out = []
    for c, p, _, kind, _ in corpus:
        if category not in (None, "", kind) or place not in (None, p):
            continue
        tf, score = Counter(docs[c]), 0.0
        for w in re.findall(r"\w+", query.lower()):
            if w in tf:
                score += math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(docs[c]) / average))
        if score > 0:
            out.append((-round(score, 9), c))
    return [c for _, c in sorted(out)]


@pytest.mark.parametrize("chunks_a_block,first", [(128, 6), (7, 1), (1, 2)])
def test_block_max_search_equals_a_full_scan(spark, monkeypatch, chunks_a_block, first):
    monkeypatch.setattr(postings, "BLOCK_CHUNKS", chunks_a_block)
    monkeypatch.setattr(postings, "FIRST_BLOCKS", first)
    rng = random.Random(14)
    words = [f"w{int(rng.paretovariate(0.9))}" for _ in range(4000)]
    corpus = [(f"c{i:03}", i % 40, f"place{i % 40}", rng.choice(["a", "b", None]), " ".join(rng.sample(words, rng.randrange(1, 40)))) for i in range(160)]
    corpus += [(f"d{i}", 99, "copy", "a", "the very same words w3 w4 w5") for i in range(12)]
    asked = [(i, " ".join(rng.sample(words, rng.randrange(1, 12))), rng.choice([None, "", "a", "b"]), rng.choice([None, None, 3, 99])) for i in range(25)]
    asked += [(100, "w3 w4 w5 w5", None, None), (101, "unheard of", None, None), (102, " ", None, None), (103, "copy", "a", 99)]
    queries = spark.createDataFrame(asked, "query_id int, query string, category string, place_id long")
    got = retrieval.bm25_search(queries, spark.createDataFrame(corpus, CORPUS).repartition(3), 4, "plain").collect()
    for i, query, category, place in asked:
        mine = [r.chunk_id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])]
        assert mine == (bm25(corpus, query, category, place)[:4] if query.strip() else []), (i, query)
    assert retrieval.bm25_search(queries.limit(0), spark.createDataFrame(corpus, CORPUS), 4).count() == 0
    assert retrieval.bm25_search(queries, spark.createDataFrame([], CORPUS), 4).count() == 0


def test_a_cell_of_equal_chunks_emits_k_rows_a_question():
    """Chunks that all tie with the kth would be a row for every pair of question and chunk."""
    asked = pd.DataFrame({"ids": [["q", "r"]], "categories": [[None, "b"]], "places": [[None, 7]], "words": [[[1, 2], [1]]], "weights": [[[0.5, 2.0], [1.0]]]})
    blocks = pd.DataFrame([{"category": c, "terms": [1] * 50, "chunks": list(range(n, n + 50)), "places": [7, 8] * 25, "gains": [1.25] * 50}
                           for c, n in (("b", 200), ("a", 100), ("b", 0))])
    got = postings._cell_scores(3)(asked, blocks)
    assert list(zip(got["query_id"], got["chunk"], got["score"], strict=True)) == [
        ("q", 0, 0.625), ("q", 1, 0.625), ("q", 2, 0.625), ("r", 0, 1.25), ("r", 2, 1.25), ("r", 4, 1.25)]


def test_metrics_of_known_rankings(spark):
    queries = spark.createDataFrame([("f", "fact", ["1601"]), ("m", "multi", None)], "query_id string, type string, answer_keywords array<string>")
    judged = spark.createDataFrame([("f", 1, 2), ("m", 1, 2), ("m", 2, 1)], "query_id string, place_id long, n_chunks long")
    results = spark.createDataFrame([("r", "f", 1, 1, "a tower"), ("r", "f", 2, 1, "built in 1601"), ("r", "f", 3, 7, "1601 elsewhere"), ("r", "m", 1, 1, "x"), ("r", "m", 2, 1, "y")],
                                    "retriever string, query_id string, rank int, place_id long, content string")
    got = {(r.query_id, r.metric): r.value for r in V.score_queries(results, queries, judged, ["r", "silent"], (1, 5)).filter("retriever = 'r'").collect()}
    assert (got["f", "hit@1"], got["f", "answer_hit@1"], got["f", "answer_hit@5"], got["f", "answer_mrr"]) == (1.0, 0.0, 1.0, 0.5)
    assert ("f", "recall@5") not in got and got["m", "recall@5"] == 0.5 and got["m", "precision@5"] == 0.4
    assert got["f", "ndcg@5"] == pytest.approx(1.0) and got["m", "ndcg@5"] == pytest.approx((1 + 1 / math.log2(3)) / (1 + 1 / math.log2(3) + 0.5))
    silent = V.score_queries(results, queries, judged, ["silent"], (5,)).filter("metric = 'hit@5'").collect()
    assert [r.value for r in silent] == [0.0, 0.0]


def test_judgements_part_gaps_in_the_data(spark):
    relevant = spark.createDataFrame([("ok", "Q1"), ("ok", "Q1"), ("nochunk", "Q9"), ("absent", "Q404")], "query_id string, external_id string")
    links = spark.createDataFrame([("Q1", 1), ("Q9", 9)], "external_id string, place_id long")
    corpus = spark.createDataFrame([(1,), (1,), (2,)], "place_id long")
    judged, missing, excluded = V.build_judgements(relevant, links, corpus)
    assert [tuple(r) for r in judged.collect()] == [("ok", 1, 2)] and [tuple(r) for r in missing.collect()] == [("absent", "Q404")]
    assert {r.query_id for r in excluded.collect()} == {"nochunk", "absent"}


FRAME = ("trip int, start_day int, end_day int, start_min int, end_min int, day_start int, day_end int, mode string, max_places int, budget int,"
         " from_lat double, from_lon double, to_lat double, to_lon double")


def audit(spark, visits, budget=None, max_places=4):
    day = 20736  # a Saturday
    places = [(1, 16.4713, 107.5819, 60, 80_000), (2, 16.3878, 107.5678, 60, 0), (3, 16.4325, 107.5660, 90, 0), (4, 16.4536, 107.5448, 45, 0)]
    hours = [(1, True, 5, 480, 660), (2, True, 5, 0, 1440), (4, True, 5, 0, 1440)]
    frame = [(1, day, day, 480, 1080, 480, 1080, "motorbike", max_places, budget, 16.4637, 107.5909, 16.4637, 107.5909)]
    violations, summary = trips.audit_feasibility(
        spark.createDataFrame([(1, day, n, p, a, b) for n, (p, a, b) in enumerate(visits, 1)], "trip int, day int, visit int, place int, arrive int, leave int"),
        spark.createDataFrame(places, "place int, lat double, lon double, visit_minutes int, price int"), spark.createDataFrame(frame, FRAME),
        spark.createDataFrame(hours, "place int, parse_ok boolean, dow int, open_min int, close_min int"))
    return Counter(r.kind for r in violations.collect()), summary.first()


def test_audit_names_every_kind(spark):
    kinds, summary = audit(spark, [(1, 630, 690), (2, 695, 710), (1, 1050, 1110)], 100_000, 2)
    assert {"opening_hours", "travel", "visit_too_short", "duplicate", "day_window", "max_places", "budget"} <= set(kinds) and not summary.feasible
    kinds, summary = audit(spark, [(3, 510, 600)])
    assert not kinds and summary.feasible and summary.unverified_hours == 1
    kinds, _ = audit(spark, [(3, 510, 600), (9, 660, 720)])
    assert set(kinds) == {"unknown_place"}
    kinds, _ = audit(spark, [(3, 510, 600), (4, 605, 660), (2, 700, 760)], max_places=2)
    assert kinds["max_places"] == 1 and kinds["travel"] >= 1


def test_outdoor_hours_in_the_rain(spark):
    hours = spark.createDataFrame([(1, 1, 0, 8, 0.5, 0.25, ["mua_lon"]), (1, 1, 0, 9, 1.0, 0.25, ["mua_lon"]), (1, 2, 0, 10, 0.5, 0.95, [])],
                                  "trip int, visit int, cell int, hour int, overlap_h double, indoor_ratio double, unsafe array<string>")
    seen = spark.createDataFrame([(0, h, 9.0 if h == 9 else 0.0, 5.0, 0, 1) for h in (8, 9, 10)], "cell int, hour int, precip_mm double, wind_kmh double, code int, period_h int")
    out = weather.weather_outcome(hours, seen).first()
    assert (out.visits, out.outdoor_rain_hours, out.hazard_visits, out.unobserved_hours) == (2, 0.75, 1, 0)


def test_notes_on_rain_and_heat(spark):
    day = 20736
    visits = [(1, 1, 0, day, 500, 600, 0.2), (1, 2, 0, day, 720, 780, 0.2), (1, 3, 1, day, 500, 600, 0.0), (1, 4, 0, day, 500, 600, 0.8), (1, 5, 2, day, 500, 600, 0.1),
              (1, 6, 3, day, 500, 600, 0.1), (1, 7, 0, day, 600, 600, 0.1)]
    records = [(0, day * 24 + 8, 0.6, 30.0, 1), (0, day * 24 + 9, 2.25, 30.0, 1), (0, day * 24 + 12, 0.0, 36.0, 1), (1, day * 24 + 8, 12.5, 20.0, 24), (1, day * 24 + 9, 12.5, 20.0, 24),
               (2, day * 24 + 8, 0.1, 34.9, 1)]
    got = {r.visit: r.note for r in notes.weather_notes(
        spark.createDataFrame(visits, "trip int, visit int, cell int, day int, start_min int, end_min int, indoor_ratio double"),
        spark.createDataFrame(records, "cell int, hour int, precip_mm double, temp_c double, period_h int")).collect()}
    assert got == {1: "Dự báo mưa tới 2.2 mm/h trong lúc tham quan; mang áo mưa.", 2: notes.HEAT, 3: "Dự báo ngày có mưa (~12 mm); mang áo mưa.", 4: None, 5: None, 6: None, 7: None}


def test_advice_on_stormy_legs(spark):
    legs = spark.createDataFrame([(1, "motorbike", True, 16.5, 107.5, 16.25, 107.0), (2, "car", True, 1.0, 2.0, 3.0, 4.0), (3, "motorbike", False, 1.0, 2.0, 3.0, 4.0), (4, "car", True, 1.0, 2.0, 3.0, 4.0)],
                                 "leg int, mode string, stormy boolean, from_lat double, from_lon double, to_lat double, to_lon double")
    hit = spark.createDataFrame([(1, 5, "B"), (1, 2, "A"), (2, 5, "B"), (3, 5, "B")], "leg int, zone int, name string")
    got = {r.leg: r.advice for r in notes.travel_advice(legs, hit).collect()}
    flood = "Đoạn đường có thể đi qua vùng dễ ngập: {}; nên hỏi đường tránh hoặc đợi ngớt mưa."
    link = "https://www.google.com/maps/dir/?api=1&origin=16.5%2C107.5&destination=16.25%2C107&travelmode=driving&dir_action=navigate"
    assert got == {1: f"{flood.format('A, B')} Dự báo mưa lớn/bão lúc di chuyển: nên đi taxi hoặc ô tô chặng này ({link}).", 2: flood.format("B"), 3: None, 4: None}


def test_the_first_source_that_knows(spark):
    points = spark.createDataFrame([(1, 0, 10, 0, 5), (2, 0, 11, 0, 5), (3, 0, 99, 4, 5), (4, 0, 99, 9, 7), (5, 0, 99, 9, 8), (6, 5, 10, 0, 5)], "point int, cell int, hour long, day long, month int")
    observed = spark.createDataFrame([(0, 10, 1.0, None)], "cell int, hour long, precip_mm double, temp_c double")
    daily = spark.createDataFrame([(0, 0, 2.0, 20.0), (0, 4, 3.0, 21.0)], "cell int, day long, precip_mm double, temp_c double")
    normal = spark.createDataFrame([(0, 5, 9.0), (0, 7, 8.0)], "cell int, month int, temp_c double")
    got = {r.point: (r.precip_mm, r.temp_c, r.source) for r in weather.resolve_weather(
        points, [("observed", "hour", observed, None), ("daily", "day", daily, F.col("day") < 5), ("climate", "month", normal, None)], ["precip_mm", "temp_c"]).collect()}
    assert got == {1: (1.0, None, "observed"), 2: (2.0, 20.0, "daily"), 3: (3.0, 21.0, "daily"), 4: (None, 8.0, "climate"), 5: (None, None, None), 6: (None, None, None)}
