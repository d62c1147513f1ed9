"""Registered queries on free-text requests and lookups. Conversation texts get request phrases that follow from their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.operators import requests as Q
from placeweave.plans.registry import query, table

PHRASES = [
    "Lập lịch 3 ngày từ 05/02 đi bộ", "Giờ mở cửa thứ bảy?", "Thời tiết ngày mai có mưa không", "hôm nay đi taxi hai ngày",
    "Tham quan 12 ngày, xe máy, ngày kia", "khai mạc 31/02", "xin chào"]
TODAY = "2024-01-11"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), ((F.col("conv_id") + F.col("turn")) % len(PHRASES) + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select(
        F.struct("conv_id", "turn").alias("request"), F.concat_ws(" ", "text", F.lit("."), phrase).alias("text"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("request"), "text")


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item's second word, and its first two, name it."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    item = table(spark, sf_dir, "benchmark").select("item_id", words.alias("w"))
    return item.select(F.col("item_id").alias("place"), F.explode(F.array(F.get("w", F.lit(1)), F.array_join(F.slice("w", 1, 2), " "))).alias("alias")).filter("alias <> ''")


_SQL_ALIASES = r"""
item AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark),
alias AS (SELECT alias, min(item_id) AS place FROM (SELECT item_id, unnest([w[2], w[1] || ' ' || w[2]]) AS alias FROM item)
  WHERE alias <> '' GROUP BY 1),
words AS (SELECT conv_id, turn, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}_]+') AS w FROM conversations
  WHERE text IS NOT NULL),
one AS (SELECT conv_id, turn, i AS pos, w[i] AS a, w[i + 1] AS b FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM words)),
hits AS (
  SELECT conv_id, turn, pos, 2 AS n, alias, place FROM one JOIN alias ON alias = a || ' ' || b
  UNION ALL SELECT conv_id, turn, pos, 1, alias, place FROM one JOIN alias ON alias = a),
queue AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY length(alias) DESC, pos, n, place) AS i FROM hits),
walk AS (
  SELECT conv_id, turn, 0::BIGINT AS i, []::BIGINT[] AS taken, NULL::BIGINT AS place, NULL::BIGINT AS pos
    FROM (SELECT DISTINCT conv_id, turn FROM queue)
  UNION ALL
  SELECT w.conv_id, w.turn, q.i, CASE WHEN list_has_any(taken, range(q.pos, q.pos + n)) THEN taken
    ELSE list_concat(taken, range(q.pos, q.pos + n)) END,
         CASE WHEN list_has_any(taken, range(q.pos, q.pos + n)) THEN NULL ELSE q.place END, q.pos
  FROM walk w JOIN queue q ON q.conv_id = w.conv_id AND q.turn = w.turn AND q.i = w.i + 1),
named AS (SELECT conv_id, turn, place, min(pos) AS at_word FROM walk WHERE place IS NOT NULL GROUP BY conv_id, turn, place)"""


def _sql_has(phrases: tuple[str, ...]) -> str:
    edge = r"[^\p{L}\p{N}_]"
    return f"regexp_matches(t, '(^|{edge})({'|'.join(phrases)})({edge}|$)')"


_SQL_PHRASES = " ".join(f"WHEN {n} THEN '{phrase}'" for n, phrase in enumerate(PHRASES))
_SQL_WEEKDAYS = " ".join(f"WHEN {_sql_has((day,))} THEN DATE '{TODAY}' + ({n} - 3 + 7) % 7" for n, day in enumerate(Q.WEEKDAYS))
_SQL_NUMBERS = " ".join(rf"WHEN regexp_matches(t, '\b{word}\s+ngay\b') THEN {n}" for word, n in Q.NUMBERS.items())


@query("request_tags", rf"""WITH RECURSIVE {_SQL_ALIASES.replace("FROM conversations WHERE text IS NOT NULL", "FROM asked")},
folded AS (
  SELECT conv_id, turn, regexp_replace(regexp_replace(replace(strip_accents(lower(text)), 'đ', 'd'), '\s+', ' ', 'g'), '^ | $', '', 'g') AS t,
         EXISTS (SELECT 1 FROM hits h WHERE h.conv_id = asked.conv_id AND h.turn = asked.turn) AS named FROM asked),
dated AS (
  SELECT *, regexp_extract(t, '\b([0-9]{{1,2}})[/-]([0-9]{{1,2}})(?:[/-]([0-9]{{4}}))?\b', ['d', 'm', 'y']) AS p, nullif(regexp_extract(t, '\b(\d+)\s*ngay\b', 1), '') AS number FROM folded),
told AS (
  SELECT *, CASE WHEN p.d <> '' THEN try_strptime(coalesce(nullif(p.y, ''), '2024') || '-' || lpad(p.m, 2, '0') || '-' || lpad(p.d, 2, '0'), '%Y-%m-%d')::DATE
      WHEN {_sql_has(("hom nay",))} THEN DATE '{TODAY}' WHEN {_sql_has(("ngay mai", "mai"))} THEN DATE '{TODAY}' + 1
      WHEN {_sql_has(("ngay kia", "ngay mot", "mot"))} THEN DATE '{TODAY}' + 2 {_SQL_WEEKDAYS} END AS start,
    CASE WHEN number IS NOT NULL THEN greatest(least(coalesce(try_cast(number AS BIGINT), 7), 7), 1)
      ELSE CASE {_SQL_NUMBERS} END END AS days FROM dated)
SELECT conv_id, turn, CASE WHEN {_sql_has(Q.PLAN)} OR number IS NOT NULL THEN 'plan' WHEN {_sql_has(Q.INFO)} AND named THEN 'info'
    WHEN {_sql_has(Q.WEATHER)} THEN 'weather' ELSE 'ask' END AS intent, coalesce(start, DATE '{TODAY}' + 1)::DATE AS start,
      coalesce(days, 1)::INT AS days,
  CASE WHEN {_sql_has(Q.CAR)} THEN 'car' WHEN {_sql_has(Q.WALKING)} THEN 'walking' ELSE 'motorbike' END AS mode,
  concat_ws(',', CASE WHEN start IS NULL THEN 'date' END, CASE WHEN days IS NULL THEN 'days' END, CASE
    WHEN NOT named THEN 'places' END) AS assumed
FROM told""".replace("item AS (", f"""asked AS (
  SELECT conv_id, turn, coalesce(text || ' ', '') || '. ' || CASE (conv_id + turn) % {len(PHRASES)} {_SQL_PHRASES} END AS text
    FROM conversations),
item AS (""", 1))
def request_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intent, date, length and mode of every turn."""
    asked = requests(spark, sf_dir)
    tags = Q.tag_requests(asked, Q.match_aliases(asked, aliases(spark, sf_dir)), F.to_date(F.lit(TODAY)))
    return tags.select("request.conv_id", "request.turn", "intent", "start", "days", "mode", "assumed")


@query("alias_mentions", f"""WITH RECURSIVE {_SQL_ALIASES} SELECT conv_id, turn, alias, count(*) AS n FROM hits GROUP BY ALL""")
def alias_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each name occurs in each turn, overlapping ones included."""
    named = aliases(spark, sf_dir)
    counted = Q.alias_runs(turns(spark, sf_dir), named).groupBy("request", "alias").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("request.conv_id", "request.turn", "alias", "n")


@query("alias_hits", f"""WITH RECURSIVE {_SQL_ALIASES}
SELECT conv_id, turn, place, row_number() OVER (PARTITION BY conv_id, turn ORDER BY at_word, place)::INT AS rank FROM named""")
def alias_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items named in each turn, longest name first where names overlap."""
    return Q.match_aliases(turns(spark, sf_dir), aliases(spark, sf_dir)).select("request.conv_id", "request.turn", "place", "rank")


@query("resolve_ids", """SELECT o_orderkey AS owner, (i - 1)::INT AS pos, p_partkey AS place FROM (SELECT o_orderkey, unnest([o_custkey * 7, o_custkey, o_orderkey]) AS k, unnest([1, 2, 3]) AS i FROM orders) JOIN part ON p_partkey = k""")
def resolve_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = _resolved(spark, sf_dir)
    return found


@query("missing_ids", """SELECT DISTINCT o_orderkey AS owner, 'part:' || k AS key FROM (SELECT o_orderkey, unnest([o_custkey * 7, o_custkey, o_orderkey]) AS k FROM orders) WHERE k NOT IN (SELECT p_partkey FROM part)""")
def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, missing = _resolved(spark, sf_dir)
    return missing


def _resolved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    wanted = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("owner"), F.expr("array('part:' || (o_custkey * 7), 'part:' || o_custkey, 'part:' || o_orderkey)").alias("ids"))
    links = table(spark, sf_dir, "part").select(F.expr("'part:' || p_partkey").alias("key"), F.col("p_partkey").alias("place"))
    return Q.resolve_ids(wanted, links)


@query("page_titles", """SELECT p_partkey AS place, coalesce(nullif(CASE WHEN s_nationkey % 3 <> 0 THEN s_name ELSE '' END, ''), p_name) AS title FROM part LEFT JOIN supplier ON s_suppkey = p_partkey""")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("place"), F.col("p_partkey").alias("key"), F.col("p_name").alias("name"))
    titles = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.expr("CASE WHEN s_nationkey % 3 <> 0 THEN s_name ELSE '' END").alias("title"))
    return Q.page_titles(places, titles)
