"""Categories, label layers, polygons and quality figures of a place catalogue."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeweave.functions import geo
from placeweave.session import stored

#: Edges of a block of points that are compared one by one because they are widest, and the pairs held at a time.
WIDE_EDGES, PAIRS = 256, 1 << 20
# The fallback category, tags that move the indoor ratio, quality thresholds.
FALLBACK = "khac"
OUTDOOR_TAGS = [("leisure", "park", 0.05), ("leisure", "garden", 0.05), ("natural", "*", 0.05)]
INDOOR_TAGS = [("building", "yes", 0.9), ("indoor", "yes", 0.9), ("covered", "yes", 0.6)]
CORE_CATEGORIES = ("di_tich", "bao_tang", "lang_tam")
THRESHOLDS = {"inside_boundary": 0.98, "categorised": 0.90, "core_with_hours": 0.05, "linked_with_image": 0.25, "manual_labels": 100.0}


def map_category(places: DataFrame, class_rules: DataFrame, tag_rules: DataFrame) -> DataFrame:
    """``places`` (``place, classes, tags``) with ``category``: the first class that has a rule, else the first tag rule whose every
    pair holds (``*``: any value), else the fallback.

    ``class_rules`` are ``qid, category``; ``tag_rules`` are ``priority, match, category``. Rules are matched by joins on the class
    and on the tag key, so no place meets a rule that shares nothing with it. ``places`` are read three times and so written once: a task
    of the last join would otherwise hold the sorts of all that makes them, three times over."""
    places = stored(places)
    by_class = places.select("place", F.posexplode("classes").alias("pos", "qid")).join(class_rules, "qid").groupBy("place").agg(
        F.min_by("category", "pos").alias("by_class"))
    wanted = tag_rules.select("priority", F.col("category").alias("by_tag"), F.size("match").alias("pairs"), F.explode("match").alias("key", "wanted"))
    held = places.select("place", F.explode("tags").alias("key", "value")).join(wanted, "key").filter("wanted = '*' OR wanted = value")
    by_tag = held.groupBy("place", "priority", "by_tag", "pairs").agg(F.count(F.lit(1)).alias("met")).filter("met = pairs").groupBy("place").agg(
        F.min_by("by_tag", "priority").alias("by_tag"))
    return places.join(by_class, "place", "left").join(by_tag, "place", "left").withColumn(
        "category", F.coalesce("by_class", "by_tag", F.lit(FALLBACK))).drop("by_class", "by_tag")


def keep_categories(places: DataFrame, names: Sequence[str]) -> DataFrame:
    return places.filter(F.col("category").isin(*names))


def drop_categories(places: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows of other categories; a row without a category stays."""
    return places.filter(~F.coalesce(F.col("category").isin(*names), F.lit(False)))


def drop_counts(places: DataFrame, names: Sequence[str]) -> DataFrame:
    """``category, dropped``: how many places :func:`drop_categories` leaves out, and why."""
    return places.filter(F.col("category").isin(*names)).groupBy("category").agg(F.count(F.lit(1)).alias("dropped"))


def apply_defaults(places: DataFrame, defaults: DataFrame) -> DataFrame:
    """First layer: the fields that ``defaults`` hold for the category, or for the fallback category where it has no row."""
    known = defaults.select("category", F.col("category").alias("_row"))
    fields = defaults.withColumnRenamed("category", "_row")
    return places.join(known, "category", "left").fillna({"_row": FALLBACK}).join(fields, "_row", "left").drop("_row").withColumn(
        "label_source", F.lit("default"))


def _first_tag(rules: Sequence[tuple[str, str, float]]) -> Column:
    def holds(key: str, wanted: str) -> Column:
        value = F.try_element_at("tags", F.lit(key))
        return value.isNotNull() if wanted == "*" else value == wanted

    return F.coalesce(*[F.when(holds(key, wanted), ratio) for key, wanted, ratio in rules])


def apply_tag_rules(places: DataFrame) -> DataFrame:
    """Second layer: outdoor tags always lower the indoor ratio; indoor tags set it only where it is at least one half."""
    base = F.col("indoor_ratio")
    return places.withColumn("indoor_ratio", F.coalesce(_first_tag(OUTDOOR_TAGS), F.when(base >= 0.5, _first_tag(INDOOR_TAGS)), base))


def apply_entries(places: DataFrame, entries: DataFrame, fields: Sequence[str], stamp: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Third layer: ``(places, unused keys)``. The first of a place's ``ids`` (in order) that has an entry wins; its fields replace
    those of the place where they are not null. ``stamp`` is a column and the value it gets for such places."""
    best = places.select("place", F.posexplode("ids").alias("pos", "key")).join(entries, "key").groupBy("place").agg(
        F.min_by(F.struct("key", *fields), "pos").alias("_entry"))
    out = places.join(best, "place", "left").withColumns({f: F.coalesce(F.col("_entry")[f], F.col(f)) for f in fields})
    if stamp:
        column, value = stamp
        out = out.withColumn(column, F.when(F.col("_entry").isNotNull(), value).otherwise(F.col(column)))
    return out.drop("_entry"), entries.join(best.select(F.col("_entry.key").alias("key")), "key", "left_anti").select("key")


def ring_edges(rings: DataFrame) -> DataFrame:
    """Edges ``region, lat1, lon1, lat2, lon2`` of closed rings given as ``region, seq, lat, lon``; the last point meets the first."""
    walk = Window.partitionBy("region").orderBy("seq")
    whole = walk.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rings.select("region", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"),
                        F.coalesce(F.lead("lat").over(walk), F.first("lat").over(whole)).alias("lat2"),
                        F.coalesce(F.lead("lon").over(walk), F.first("lon").over(whole)).alias("lon2"))


def _rays_crossed(lat: np.ndarray, lon: np.ndarray, lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """How many edges the eastward ray of each point crosses, with the arithmetic of ``geo.crosses_ray``.

    Points are taken in blocks of neighbouring latitudes. An edge that goes through all of a block's latitudes crosses it between the longitudes
    at the lowest and the highest one (each step of the formula is monotone, rounded or not), so all but the edges at a point's own place are
    counted by two searches; edges that end in the block and the widest ones are compared one by one."""
    def at(edges: np.ndarray, y: np.ndarray | float) -> np.ndarray:
        return lon1[edges] + (y - lat1[edges]) / (lat2[edges] - lat1[edges]) * (lon2[edges] - lon1[edges])

    out = np.zeros(len(lat), np.int64)
    order = np.argsort(lat, kind="stable")
    low, high = np.minimum(lat1, lat2), np.maximum(lat1, lat2)
    size = int(max(64, len(lat) ** 0.5))
    for begin in range(0, len(order), size):
        block = order[begin:begin + size]
        bottom, top = lat[block[0]], lat[block[-1]]
        met = np.flatnonzero((low <= top) & (high > bottom))
        through = (low[met] <= bottom) & (high[met] > top)
        whole, single = met[through], met[~through]
        ends = np.sort(np.stack([at(whole, bottom), at(whole, top)]), axis=0)
        wide = np.zeros(len(whole), bool)
        if len(whole) > WIDE_EDGES:
            wide[np.argpartition(ends[1] - ends[0], -WIDE_EDGES)[-WIDE_EDGES:]] = True
            single, whole, ends = np.concatenate([single, whole[wide]]), whole[~wide], ends[:, ~wide]
        rank = np.argsort(ends[0], kind="stable")
        whole, left = whole[rank], ends[0][rank]
        reach = (ends[1] - ends[0]).max(initial=0.0)
        x, y = lon[block], lat[block]
        # Edges from ``last`` on lie east of the point, those before ``first`` west of it; twice the reach leaves room for its rounding.
        first, last = np.searchsorted(left, x - 2 * reach - 1e-9, "left"), np.searchsorted(left, x, "right")
        found = len(whole) - last
        near = last - first
        for part in np.array_split(np.arange(len(block)), max(1, int(near.sum()) // PAIRS)):
            of = np.repeat(part, near[part])
            edge = whole[np.arange(len(of)) - np.repeat(np.cumsum(near[part]) - near[part], near[part]) + np.repeat(first[part], near[part])]
            found[part] += np.bincount(of[x[of] < at(edge, y[of])] - part[0], minlength=len(part)) if len(part) else 0
        for part in np.array_split(single, max(1, len(single) * len(block) // PAIRS)):
            spans = (lat1[part][None, :] > y[:, None]) != (lat2[part][None, :] > y[:, None])
            of, e = np.nonzero(spans)
            found += np.bincount(of[x[of] < at(part[e], y[of])], minlength=len(block))
        out[block] = found
    return out


def within_polygon(points: DataFrame, rings: DataFrame, band_degrees: float = 0.01) -> DataFrame:
    """``place, region`` of points inside a ring (even-odd rule). ``points`` are ``place, region, lat, lon``.

    An edge is sent to the bands of latitude that it crosses, so a point meets only edges at its own height; of those in its band it is compared
    with few (:func:`_rays_crossed`), and no pair of them leaves the task."""
    def band(lat: Column) -> Column:
        return F.floor(lat / F.lit(band_degrees))

    edges = ring_edges(rings).withColumn("band", F.explode(F.sequence(band(F.least("lat1", "lat2")), band(F.greatest("lat1", "lat2")))))
    asked = points.filter("region IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL").select("place", "region", "lat", "lon", band(F.col("lat")).alias("band"))
    known = edges.dropna().select("region", "band", "lat1", "lon1", "lat2", "lon2")

    def inside(here: pd.DataFrame, walls: pd.DataFrame) -> pd.DataFrame:
        if not len(here) or not len(walls):
            return here[["place", "region"]].iloc[:0]
        crossed = _rays_crossed(*[here[c].to_numpy(float) for c in ("lat", "lon")], *[walls[c].to_numpy(float) for c in ("lat1", "lon1", "lat2", "lon2")])
        return here.loc[crossed % 2 == 1, ["place", "region"]]

    schema = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in ("place", "region"))
    return asked.groupBy("region", "band").cogroup(known.groupBy("region", "band")).applyInPandas(inside, schema)


def quality_metrics(places: DataFrame, links: DataFrame, images: DataFrame) -> DataFrame:
    """``metric, value, threshold, passed``; a share of nothing is 0, a metric without a threshold always passes.

    ``places`` are ``place, category, has_hours, label_source, inside`` (``inside`` null throughout: no boundary is known and that
    metric is left out), ``links`` ``place, source``, ``images`` ``place``."""
    core = F.col("category").isin(*CORE_CATEGORIES)

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(0.0)

    rows = F.count(F.lit(1))
    of_places = places.agg(
        F.when(F.count("inside") > 0, share(F.count_if("inside"), rows)).alias("inside_boundary"),
        share(F.count_if(F.col("category") != FALLBACK), rows).alias("categorised"),
        share(F.count_if(core & F.col("has_hours")), F.count_if(core)).alias("core_with_hours"),
        F.count_if(F.col("label_source") == "manual").cast("double").alias("manual_labels"))
    per_place = images.groupBy("place").agg(F.count(F.lit(1)).alias("images"))
    linked = links.filter("source = 'wikidata'").select("place").distinct().join(per_place, "place", "left").agg(
        share(F.count("images"), rows).alias("linked_with_image"))
    many = per_place.agg(F.count_if(F.col("images") >= 5).cast("double").alias("five_images"))
    return _long(of_places).unionByName(_long(linked)).unionByName(_long(many))


def _long(row: DataFrame) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value"), F.lit(THRESHOLDS.get(c)).cast("double").alias("threshold"))
                                for c in row.columns])).alias("m")
    return row.select(pairs).select("m.*").filter("value IS NOT NULL").withColumn("passed", F.coalesce(F.col("value") >= F.col("threshold"), F.lit(True)))


def sample_rows(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows in the order of a seeded hash of the key: the same sample for the same seed, whatever the partitioning."""
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return rows.withColumn("_draw", draw).orderBy("_draw", key).limit(n).drop("_draw")
