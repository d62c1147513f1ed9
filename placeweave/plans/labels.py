"""Registered queries on categories, label layers, boundaries and quality figures. Rules come from table rows, as they would from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.operators import labels
from placeweave.plans.catalogue import SQL_PLACES, places
from placeweave.plans.registry import query, table

CATEGORIES = ["di_tich", "chua", "bao_tang", "lang_tam", "nha_hang", "song", "cong_vien"]
WITH_DEFAULTS = ["khac", "di_tich", "bao_tang", "lang_tam", "nha_hang"]


# Views ------------------------------------------------------------------------------------------------------------------


def tagged_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("place"), "p_brand")
    tags = F.expr("""map_filter(map('brand', p_brand, 'leisure', CASE size % 7 WHEN 0 THEN 'park' WHEN 1 THEN 'garden' END,
      'building', CASE WHEN size % 3 = 0 THEN 'yes' END, 'natural', CASE WHEN size % 11 = 0 THEN 'cliff' END), (k, v) -> v IS NOT NULL)""")
    return places(spark, sf_dir).join(brands, "place").select(
        "place", "lat", "lon", "size", F.expr("array('Q' || (20 + size), 'Q' || (place % 61))").alias("classes"), tags.alias("tags"),
        F.expr("array('part:' || place, 'alt:' || (place % 100))").alias("ids"))


def class_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.expr("'Q' || n_nationkey").alias("qid"), _pick(CATEGORIES, "n_nationkey").alias("category"))


def tag_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    match = F.expr("""CASE n_nationkey % 3 WHEN 0 THEN map('brand', 'Brand#' || n_nationkey)
      WHEN 1 THEN map('brand', 'Brand#' || n_nationkey, 'leisure', '*') ELSE map('leisure', 'park', 'building', 'yes') END""")
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("priority"), match.alias("match"), _pick(CATEGORIES, "n_nationkey + 3").alias("category"))


def defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(
        _pick(WITH_DEFAULTS, "r_regionkey").alias("category"), ((1 + 2 * F.col("r_regionkey")) / 10.0).alias("indoor_ratio"),
        (30 + 15 * F.col("r_regionkey")).alias("visit_minutes"))


_ENTRY_KEY = "CASE WHEN s_suppkey % 2 = 0 THEN 'part:' || (s_suppkey * 2) ELSE 'alt:' || (s_suppkey * 7) END"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.expr(_ENTRY_KEY).alias("key"), F.expr("CASE WHEN s_suppkey % 3 <> 0 THEN (s_suppkey % 10) / 10.0D END").alias("indoor_ratio"),
        F.expr("CASE WHEN s_suppkey % 3 <> 1 THEN CAST(20 + s_suppkey AS INT) END").alias("visit_minutes"))


def _pick(names: list[str], index: str) -> F.Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.expr(f"CAST(({index}) % {len(names)} + 1 AS INT)"))


def categorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.map_category(tagged_places(spark, sf_dir), class_rules(spark, sf_dir), tag_rules(spark, sf_dir))


def labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base = labels.apply_tag_rules(labels.apply_defaults(categorised(spark, sf_dir), defaults(spark, sf_dir)))
    return labels.apply_entries(base, entries(spark, sf_dir), ["indoor_ratio", "visit_minutes"], ("label_source", "manual"))


_SQL_LABELS = f"""{SQL_PLACES},
tagged AS (SELECT p.*, p_brand AS brand, CASE size % 7 WHEN 0 THEN 'park'
  WHEN 1 THEN 'garden' END AS leisure, size % 3 = 0 AS building, size % 11 = 0 AS nature
  FROM places p JOIN part ON p_partkey = place),
category AS (SELECT t.*, coalesce(
    (SELECT ({CATEGORIES})[n_nationkey % 7 + 1] FROM nation WHERE n_nationkey = 20 + size),
    (SELECT ({CATEGORIES})[n_nationkey % 7 + 1] FROM nation WHERE n_nationkey = place % 61),
    (SELECT arg_min(({CATEGORIES})[(n_nationkey + 3) % 7 + 1], n_nationkey) FROM nation WHERE CASE n_nationkey % 3
      WHEN 0 THEN brand = 'Brand#' || n_nationkey
       WHEN 1 THEN brand = 'Brand#' || n_nationkey AND leisure IS NOT NULL ELSE leisure = 'park' AND building END), 'khac') AS category
         FROM tagged t),
layered AS (SELECT c.*, 0.1::DOUBLE + 0.2::DOUBLE * r_regionkey AS base, 30 + 15 * r_regionkey AS base_minutes FROM category c
  JOIN region ON r_regionkey = coalesce(list_position({WITH_DEFAULTS}, category), 1) - 1),
ruled AS (SELECT *, CASE WHEN leisure IS NOT NULL OR nature THEN 0.05 WHEN base >= 0.5 AND building THEN 0.9 ELSE base END::DOUBLE AS ratio
  FROM layered),
entry AS (SELECT {_ENTRY_KEY} AS key, CASE WHEN s_suppkey % 3 <> 0 THEN (s_suppkey % 10) / 10.0::DOUBLE END AS e_ratio,
  CASE WHEN s_suppkey % 3 <> 1 THEN 20 + s_suppkey END AS e_minutes FROM supplier),
chosen AS (SELECT r.*, coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NOT NULL THEN a.e_ratio ELSE b.e_ratio END AS e_ratio,
    CASE WHEN a.key IS NOT NULL THEN a.e_minutes ELSE b.e_minutes END AS e_minutes
  FROM ruled r LEFT JOIN entry a ON a.key = 'part:' || place LEFT JOIN entry b ON b.key = 'alt:' || (place % 100)),
labelled AS (SELECT place, lat, lon, size, category, coalesce(e_ratio, ratio) AS indoor_ratio,
  coalesce(e_minutes, base_minutes)::INT AS visit_minutes,
  CASE WHEN key IS NULL THEN 'default' ELSE 'manual' END AS label_source FROM chosen)"""


# Queries ----------------------------------------------------------------------------------------------------------------


@query("category_map", f"WITH {_SQL_LABELS} SELECT place, category FROM category")
def category_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categorised(spark, sf_dir).select("place", "category")


@query("visitable_places", f"WITH {_SQL_LABELS} SELECT place, category FROM category WHERE category NOT IN ('song', 'khac')")
def visitable_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.drop_categories(categorised(spark, sf_dir), ["song", "khac"]).select("place", "category")


@query("category_drops", f"WITH {_SQL_LABELS} SELECT category, count(*) AS dropped FROM category WHERE category IN ('song', 'khac') GROUP BY category")
def category_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.drop_counts(categorised(spark, sf_dir), ["song", "khac"])


@query("label_layers", f"WITH {_SQL_LABELS} SELECT place, category, round(indoor_ratio, 5) AS indoor_ratio, visit_minutes, label_source FROM labelled")
def label_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _ = labelled(spark, sf_dir)
    return placed.select("place", "category", F.round("indoor_ratio", 5).alias("indoor_ratio"), "visit_minutes", "label_source")


@query("override_unmatched", f"WITH {_SQL_LABELS} SELECT key FROM entry WHERE key NOT IN (SELECT key FROM chosen WHERE key IS NOT NULL)")
def override_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, unused = labelled(spark, sf_dir)
    return unused


@query("facts_layer", f"""WITH {SQL_PLACES}, fact AS (SELECT c_custkey * 2 AS place, CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey * 1000)::VARCHAR END AS ticket,
  CASE WHEN c_custkey % 3 <> 0 THEN 'Mo-Su 08:00-17:00' END AS opening FROM customer)
SELECT place, coalesce(opening, 'Mo-Su 09:00-12:00') AS opening_hours_raw, ticket, CASE WHEN fact.place IS NULL THEN 'source'
  ELSE 'facts' END AS fact_source
FROM places LEFT JOIN fact USING (place)""")
def facts_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours and tickets entered by hand replace those of the source, field by field."""
    facts = table(spark, sf_dir, "customer").select(
        F.expr("'part:' || (c_custkey * 2)").alias("key"), F.expr("CASE WHEN c_custkey % 3 <> 0 THEN 'Mo-Su 08:00-17:00' END").alias("opening_hours_raw"),
        F.expr("CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey * 1000 AS STRING) END").alias("ticket"))
    known = tagged_places(spark, sf_dir).withColumns(
        {"opening_hours_raw": F.lit("Mo-Su 09:00-12:00"), "ticket": F.lit(None).cast("string"), "fact_source": F.lit("source")})
    placed, _ = labels.apply_entries(known, facts, ["opening_hours_raw", "ticket"], ("fact_source", "facts"))
    return placed.select("place", "opening_hours_raw", "ticket", "fact_source")


_SQL_INSIDE = """
ring AS (SELECT c_custkey % 5 AS region, c_custkey AS seq, 16.335::DOUBLE + (c_custkey * 7919 % 2701) / 10000.0::DOUBLE AS lat,
  107.435::DOUBLE + (c_custkey * 104729 % 2901) / 10000.0::DOUBLE AS lon FROM customer),
edge AS (SELECT region, lat AS lat1, lon AS lon1, coalesce(lead(lat) OVER w, first(lat) OVER f) AS lat2,
  coalesce(lead(lon) OVER w, first(lon) OVER f) AS lon2 FROM ring
  WINDOW w AS (PARTITION BY region ORDER BY seq), f AS (PARTITION BY region ORDER BY seq)),
inside AS (SELECT place, region FROM places p JOIN edge e ON e.region = place % 5 WHERE (lat1 > lat) <> (lat2 > lat)
  AND lon < lon1 + (lat - lat1) / (lat2 - lat1) * (lon2 - lon1) GROUP BY place, region HAVING count(*) % 2 = 1)"""


def inside_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    rings = table(spark, sf_dir, "customer").select(
        (key % 5).alias("region"), key.alias("seq"), (F.lit(16.335) + (key * 7919 % 2701) / F.lit(10000.0)).alias("lat"),
        (F.lit(107.435) + (key * 104729 % 2901) / F.lit(10000.0)).alias("lon"))
    points = places(spark, sf_dir).select("place", (F.col("place") % 5).alias("region"), "lat", "lon")
    return labels.within_polygon(points, rings)


@query("points_in_polygon", f"WITH {SQL_PLACES}, {_SQL_INSIDE} SELECT place, region FROM inside")
def points_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inside_rings(spark, sf_dir)


@query("quality_metrics", f"""WITH {_SQL_LABELS}, {_SQL_INSIDE},
links AS (SELECT DISTINCT l_partkey AS place FROM lineitem WHERE l_linenumber % 3 = 1), images AS (SELECT l_partkey AS place, count(*) AS n
  FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
m AS (SELECT 'inside_boundary' AS metric, avg((place IN (SELECT place FROM inside))::INT) AS value, 0.98 AS threshold FROM places
UNION ALL SELECT 'categorised', avg((category <> 'khac')::INT), 0.9 FROM labelled
UNION ALL SELECT 'core_with_hours', coalesce(avg((size % 7 <> 0)::INT), 0), 0.05 FROM labelled
  WHERE category IN ('di_tich', 'bao_tang', 'lang_tam')
UNION ALL SELECT 'linked_with_image', (SELECT count(*) FROM links JOIN images USING (place)) / greatest((SELECT count(*)
  FROM links), 1), 0.25
UNION ALL SELECT 'manual_labels', count(*), 100 FROM labelled WHERE label_source = 'manual'
UNION ALL SELECT 'five_images', count(*), NULL FROM images WHERE n >= 5)
SELECT metric, round(value, 5) AS value, threshold::DOUBLE AS threshold, coalesce(value >= threshold, true) AS passed FROM m""")
def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = inside_rings(spark, sf_dir).select("place", F.lit(True).alias("inside"))
    placed, _ = labelled(spark, sf_dir)
    judged = placed.join(inside, "place", "left").fillna({"inside": False}).withColumn("has_hours", F.col("size") % 7 != 0)
    lines = table(spark, sf_dir, "lineitem")
    links = lines.select(F.col("l_partkey").alias("place"), F.when(F.col("l_linenumber") % 3 == 1, "wikidata").otherwise("osm").alias("source"))
    images = lines.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("place"))
    return labels.quality_metrics(judged, links, images).withColumn("value", F.round("value", 5))


@query("qa_sample", f"""WITH {_SQL_LABELS} SELECT place, category, ids FROM (SELECT place, category, 'part:' || place || ' alt:' || (place % 100) AS ids,
  row_number() OVER (ORDER BY md5('7:' || place), place) AS n FROM category) WHERE n <= 20""")
def qa_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty places to look at by hand, the same for the same seed."""
    return labels.sample_rows(categorised(spark, sf_dir), "place", 20, 7).select("place", "category", F.array_join("ids", " ").alias("ids"))
