"""Registered queries on places asked for by name, and the facts told about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.functions import hours
from placeweave.operators import lookup
from placeweave.plans.registry import query, table

#: Seller names get a larger key than any part.
_SELLERS = 1_000_000_000


def named_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``place, name``: parts by name, kind and size, some with accents, some by two letters; suppliers by theirs."""
    accented = F.when(F.col("p_size") % 5 == 0, F.lit("Chùa Đông ")).otherwise("")
    name = F.when(F.col("p_partkey") % 97 == 5, F.substring("p_name", 1, 2)).otherwise(
        F.concat(accented, "p_name", F.lit(" "), F.initcap("p_type"), F.lit(" "), F.col("p_size").cast("string")))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("place"), name.alias("name"))
    return parts.unionByName(table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + _SELLERS).alias("place"), F.col("s_name").alias("name")))


def asked_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ask, text``: customers ask for the part of their own number, in seven ways."""
    told = F.element_at(F.array(
        F.upper("p_name"), F.concat(F.lit("the "), "p_name", F.lit(" "), F.lower("p_type"), F.lit(" "), F.col("p_size").cast("string"), F.lit(" by the river")),
        F.element_at(F.split("p_name", " "), -1), F.substring("p_name", 2, 2), F.col("c_name"),
        F.concat(F.lit("đông "), "p_name"), F.lit("")), (F.col("c_custkey") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("c_custkey")).select(
        F.col("c_custkey").alias("ask"), told.alias("text"))


def named_asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asks whose text has an alias of a place."""
    return asked_names(spark, sf_dir).filter("ask % 31 = 3").select("ask", (F.col("ask") % 11).alias("place"))


_SQL_FOLD = "replace(strip_accents(lower({})), 'đ', 'd')"
_SQL_ASKS = f"""
known AS (
  SELECT p_partkey AS place, CASE WHEN p_partkey % 97 = 5 THEN substr(p_name, 1, 2)
    ELSE CASE WHEN p_size % 5 = 0 THEN 'Chùa Đông '
      ELSE '' END || p_name || ' ' || upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) || ' ' || p_size END AS name
  FROM part UNION ALL SELECT s_suppkey + {_SELLERS}, s_name FROM supplier),
asked AS (
  SELECT c_custkey AS ask, CASE c_custkey % 7 WHEN 0 THEN upper(p_name)
    WHEN 1 THEN 'the ' || p_name || ' ' || lower(p_type) || ' ' || p_size || ' by the river'
    WHEN 2 THEN string_split(p_name, ' ')[-1] WHEN 3 THEN substr(p_name, 2, 2) WHEN 4 THEN c_name WHEN 5 THEN 'đông ' || p_name
      ELSE '' END AS text
  FROM customer JOIN part ON p_partkey = c_custkey),
found AS (
  SELECT ask, text, CASE WHEN ask % 31 = 3 THEN ask % 11 ELSE (
    SELECT arg_min(place, (abs(length(n) - length(t)), place)) FROM (
      SELECT k.place, {_SQL_FOLD.format("k.name")} AS n, {_SQL_FOLD.format("a.text")} AS t FROM known k) WHERE t <> '' AND (contains(n, t)
        OR contains(t, n))) END AS place
  FROM asked a)"""


def found_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.find_places(asked_names(spark, sf_dir), named_places(spark, sf_dir), named_asks(spark, sf_dir))


@query("place_lookup", f"WITH {_SQL_ASKS} SELECT ask, text, place FROM found")
def place_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_places(spark, sf_dir)


#: Written hours of parts; the last two are none and unreadable.
_SQL_HOURS = """CASE p_size % 9 WHEN 0 THEN '24/7' WHEN 1 THEN 'Mo-Fr 08:00-11:30,13:30-17:00' WHEN 2 THEN 'Th-Sa 18:00-02:00'
  WHEN 3 THEN 'Sa-Mo 10:00-12:00'
  WHEN 4 THEN 'Tu-Su 07:00-17:00; Mo off' WHEN 5 THEN 'Mo-Su 17:00-01:30' WHEN 6 THEN 'Mo-Su 06:00-22:00; We 09:00-12:00' WHEN 7 THEN NULL
    ELSE 'by appointment' END"""
_SQL_WEEK = """CASE p_size % 9 WHEN 0 THEN '24/7' WHEN 1 THEN 'Mo-Fr 08:00-11:30,13:30-17:00; Sa-Su off'
  WHEN 2 THEN 'Th-Sa 18:00-02:00; Su-We off' WHEN 3 THEN 'Tu-Fr off; Sa-Mo 10:00-12:00'
  WHEN 4 THEN 'Mo off; Tu-Su 07:00-17:00' WHEN 5 THEN 'Mo-Su 17:00-01:30' WHEN 6 THEN 'We 09:00-12:00; Th-Tu 06:00-22:00' END"""
_SQL_PRICE = "CASE p_size % 4 WHEN 0 THEN p_size || '0.000' WHEN 1 THEN p_size || ' 000-' || p_size || '9 000' WHEN 2 THEN '9-1' END"


@query("place_facts", f"""WITH {_SQL_ASKS}
SELECT DISTINCT place, {_SQL_HOURS} AS opening_hours, {_SQL_WEEK} AS week,
  CASE p_size % 4 WHEN 0 THEN p_size * 10000 WHEN 1 THEN p_size * 1000 END::BIGINT AS vnd, CASE p_size % 4
    WHEN 1 THEN p_size * 10000 + 9000 END::BIGINT AS vnd_max
FROM found JOIN part ON p_partkey = place""")
def place_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours as written and as a week, and prices, of the places found; null means not known."""
    written = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("place"), F.expr(_SQL_HOURS).alias("opening_hours_raw"), hours.ticket(F.expr(_SQL_PRICE)).alias("price"))
    found = found_places(spark, sf_dir).select("place").distinct()
    known = hours.add_opening_hours(written.join(found, "place"))
    text = hours.format_hours(F.col("hours"), F.col("opening_hours_raw"))
    return known.select("place", F.nullif(text, F.lit("")).alias("opening_hours"), hours.compact_hours(F.col("hours")).alias("week"), "price.vnd", "price.vnd_max")
