"""Chunks, queries and relevance derived from ``documents``, ``benchmark`` and ``embeddings``,
in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.functions import text as X
from placeweave.operators import retrieval as R
from placeweave.plans.registry import table
from placeweave.session import cut_lineage

LANG_CATEGORY = {"en": "di_tich", "fr": "chua", "de": "bao_tang", "es": "boi_canh"}
QUERY_TYPES = ("fact", "descriptive", "paraphrase", "multi", "no_diacritics")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    category = F.coalesce(*[F.when(F.col("lang") == k, v) for k, v in LANG_CATEGORY.items()], F.lit("khac"))
    return docs.select(F.col("doc_id").alias("place_id"),
                       F.concat(F.col("source"), F.lit(" "), F.col("doc_id").cast("string")).alias("name"),
                       category.alias("category"))


def raw_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chunk_id, place_id, content, source_url`` of every document, whole texts, line paragraphs."""
    # A file's row group is one task's work: texts are dealt first, cutting them takes longer than moving them.
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text").repartition("doc_id")
    exploded = docs.select("doc_id", "source", F.posexplode(X.chunk_array(F.col("text"), 1200, r"\n")).alias("pos", "content"))
    return exploded.select(
        F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("pos").cast("string")).alias("chunk_id"), F.col("doc_id").alias("place_id"), "content",
        F.concat(F.lit("https://example.org/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("source_url"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.corpus(raw_chunks(spark, sf_dir), places(spark, sf_dir))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.col("item_id")
    kind = F.element_at(F.array(*[F.lit(t) for t in QUERY_TYPES]), (item % 5 + 1).cast("int"))
    first_words = F.slice(F.filter(F.split("text", r"\s+"), lambda w: w != ""), 1, 2)
    return table(spark, sf_dir, "benchmark").select(
        item.alias("query_id"), F.col("text").alias("query"), kind.alias("type"),
        F.when(item % 5 == 0, first_words).alias("answer_keywords"),
        F.when(item % 7 == 0, F.lit("di_tich")).alias("category"))


def relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, external_id``: documents (as text ids) that share a whole sentence with the query, of any length."""
    def sentences(df: DataFrame, key: str) -> DataFrame:
        parts = F.transform(F.split("text", r"(?<=\.)\s+"), X.strip)
        return df.select(key, F.explode(F.array_distinct(parts)).alias("s")).filter("s <> ''")

    asked = cut_lineage(sentences(table(spark, sf_dir, "benchmark"), "item_id"))
    dealt = table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
    held = cut_lineage(sentences(dealt, "doc_id").join(asked.select("s").distinct(), "s", "left_semi"))
    return asked.join(held, "s").select(F.col("item_id").alias("query_id"), F.concat(F.lit("d:"), F.col("doc_id").cast("string")).alias("external_id")).distinct()


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External ids of documents; every eleventh is unknown, so missing judgements occur."""
    return table(spark, sf_dir, "documents").filter(F.col("doc_id") % 11 != 0).select(
        F.concat(F.lit("d:"), F.col("doc_id").cast("string")).alias("external_id"), F.col("doc_id").alias("place_id"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as a chunk table: two models, two categories, a few missing vectors."""
    vec = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        vec.alias("chunk_id"), F.col("label").cast("bigint").alias("place_id"),
        F.concat(F.lit("label "), F.col("label").cast("string")).alias("place_name"),
        F.when(F.col("label") % 2 == 0, "chua").otherwise("di_tich").alias("category"),
        F.concat(F.lit("vector "), vec.cast("string")).alias("content"),
        F.lit(None).cast("string").alias("source_url"),
        F.when(vec % 17 != 0, F.col("embedding")).alias("embedding"),
        F.when(vec % 13 == 0, "old-model").otherwise("current-model").alias("embedding_model"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") % 10 == 3).select(
        F.col("vec_id").alias("query_id"), F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("query"),
        "embedding", F.when(F.col("vec_id") % 4 == 1, "chua").alias("category"))


SQL_CHUNKS = r"""
paragraphs AS (
  SELECT doc_id, lang, source, unnest(range(len(ps))) AS para_no, unnest(ps) AS para FROM (
    SELECT doc_id, lang, source,
           list_filter(list_transform(string_split(text, chr(10)), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')),
                       lambda p: p <> '') AS ps
    FROM documents)),
sentence_list AS (
  SELECT doc_id, para_no, string_split(regexp_replace(para, '\.\s+', '.' || chr(1), 'g'), chr(1)) AS ss
  FROM paragraphs WHERE length(para) > 1200),
sentence_rows AS (SELECT doc_id, para_no, unnest(range(1, len(ss) + 1)) AS i, unnest(ss) AS s FROM sentence_list),
packing AS (
  SELECT doc_id, para_no, i, 1 AS part, s || ' ' AS open FROM sentence_rows WHERE i = 1
  UNION ALL
  SELECT r.doc_id, r.para_no, r.i,
         CASE WHEN length(p.open) + length(r.s) + 1 > 1200 AND p.open <> '' THEN p.part + 1 ELSE p.part END,
         CASE WHEN length(p.open) + length(r.s) + 1 > 1200 AND p.open <> '' THEN r.s || ' ' ELSE p.open || r.s || ' ' END
  FROM packing p JOIN sentence_rows r ON r.doc_id = p.doc_id AND r.para_no = p.para_no AND r.i = p.i + 1),
pieces AS (
  SELECT doc_id, para_no, 1 AS part, para AS content FROM paragraphs WHERE length(para) <= 1200
  UNION ALL
  SELECT doc_id, para_no, part, regexp_replace(arg_max(open, i), '^\s+|\s+$', '', 'g')
  FROM packing GROUP BY doc_id, para_no, part),
chunks AS (
  SELECT d.doc_id || ':' || (row_number() OVER (PARTITION BY p.doc_id ORDER BY para_no, part) - 1) AS chunk_id,
         d.doc_id AS place_id, p.content,
         'https://example.org/' || d.source || '/' || d.doc_id AS source_url,
         d.source || ' ' || d.doc_id AS place_name,
         CASE d.lang WHEN 'en' THEN 'di_tich' WHEN 'fr' THEN 'chua' WHEN 'de' THEN 'bao_tang'
                     WHEN 'es' THEN 'boi_canh' ELSE 'khac' END AS category
  FROM pieces p JOIN documents d USING (doc_id) WHERE p.content <> ''),
corpus AS (SELECT * FROM chunks WHERE category NOT IN ('boi_canh', 'ha_tang', 'don_vi_hanh_chinh')),
queries AS (
  SELECT item_id AS query_id, text AS query,
         CASE item_id % 5 WHEN 0 THEN 'fact' WHEN 1 THEN 'descriptive' WHEN 2 THEN 'paraphrase'
                          WHEN 3 THEN 'multi' ELSE 'no_diacritics' END AS type,
         CASE WHEN item_id % 5 = 0 THEN list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')[1:2] END
           AS answer_keywords,
         CASE WHEN item_id % 7 = 0 THEN 'di_tich' END AS category
  FROM benchmark)
"""

SQL_PLAIN = r"regexp_extract_all(replace(lower({c}), 'ß', 'ss'), '[\p{{L}}\p{{N}}_]+')"
SQL_FOLD = r"regexp_extract_all(replace(strip_accents(replace(lower({c}), 'ß', 'ss')), 'đ', 'd'), '[\p{{L}}\p{{N}}_]+')"


def sql_terms(column: str, analyzer: str) -> str:
    plain, fold = SQL_PLAIN.format(c=column), SQL_FOLD.format(c=column)
    if analyzer == "plain":
        return plain
    if analyzer == "fold":
        return fold
    return (f"list_concat(list_concat({plain}, list_transform({fold}, lambda t: '~' || t)),"
            f" list_transform(list_zip(({fold})[:-2], ({fold})[2:]), lambda p: '~' || p[1] || '_' || p[2]))")


def sql_bm25(analyzer: str, k: int, name: str = "bm25", filtered: bool = True) -> str:
    """CTEs ending in ``{name}(query_id, rank, chunk_id, score)``."""
    passes = "AND (q.category IS NULL OR q.category = t.category)" if filtered else ""
    return f"""
{name}_docs AS (SELECT chunk_id, category, {sql_terms("place_name || ': ' || content", analyzer)} AS terms FROM corpus),
{name}_stats AS (SELECT count(*)::DOUBLE AS n, avg(len(terms)) AS avgdl FROM {name}_docs),
{name}_tf AS (SELECT chunk_id, category, len, term, count(*) AS tf FROM (
  SELECT chunk_id, category, len(terms) AS len, unnest(terms) AS term FROM {name}_docs) GROUP BY ALL),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term),
{name}_q AS (SELECT query_id, category, term, count(*) AS times FROM (
  SELECT query_id, category, unnest({sql_terms("query", analyzer)}) AS term FROM queries) GROUP BY ALL),
{name}_score AS (
  SELECT q.query_id, t.chunk_id,
         sum(q.times * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0::DOUBLE) * tf * 2.5::DOUBLE
             / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avgdl))) AS score
  FROM {name}_q q JOIN {name}_tf t ON t.term = q.term {passes} JOIN {name}_df d ON d.term = q.term, {name}_stats
  GROUP BY q.query_id, t.chunk_id),
{name} AS (SELECT * FROM (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank,
         chunk_id, score FROM {name}_score) WHERE rank <= {k})
"""
