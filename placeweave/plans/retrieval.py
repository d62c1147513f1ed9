"""Registered retrieval queries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.functions import text as X
from placeweave.operators import evaluation as V
from placeweave.operators import postings as P
from placeweave.operators import resampling as N
from placeweave.operators import retrieval as R
from placeweave.plans import text_views as T
from placeweave.plans.registry import query, table
from placeweave.session import cut_lineage, stored


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("query_id", F.col("rank").cast("bigint").alias("rank"), "chunk_id",
                     F.round("score", 6).alias("score"))


@query("chunk_documents", f"""
WITH RECURSIVE {T.SQL_CHUNKS}
SELECT chunk_id, place_id, length(content)::BIGINT AS n_chars, sha256(content) AS content_hash FROM chunks""")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.raw_chunks(spark, sf_dir).select(
        "chunk_id", "place_id", F.length("content").cast("bigint").alias("n_chars"),
        X.content_hash(F.col("content")).alias("content_hash"))


@query("fold_terms", rf"""
SELECT term, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS docs FROM (
  SELECT doc_id, unnest({T.SQL_FOLD.format(c="text")}) AS term FROM documents) GROUP BY term""")
def fold_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The words are written before they are counted: an array that is exploded from its expression is computed more than once.
    dealt = table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
    docs = stored(dealt.select("doc_id", X.tokens(F.col("text"), True).alias("terms"))).select("doc_id", F.explode("terms").alias("term"))
    # Count inside a document first: a word that fills one text is one row before the second shuffle.
    per_doc = docs.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))


@query("term_bigrams", f"""
SELECT term, count(*)::BIGINT AS n FROM (
  SELECT unnest({T.sql_terms("text", "multi")}) AS term FROM documents) GROUP BY term""")
def term_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, folded words and folded pairs of neighbours of all documents."""
    dealt = table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
    words = stored(X.words_of(dealt.select("text"), "text"))
    terms = words.select(F.explode(X.terms_of(F.col("plain"), F.col("folded"), "multi")).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def _bm25(analyzer: str, k: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _ranked(R.bm25_search(T.queries(spark, sf_dir), T.corpus(spark, sf_dir), k, analyzer))
    return run


for _name, _analyzer in (("bm25_topk", "plain"), ("bm25_fold_topk", "fold"), ("bm25_multi_topk", "multi")):
    query(_name, f"""
WITH RECURSIVE {T.SQL_CHUNKS}, {T.sql_bm25(_analyzer, 5)}
SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM bm25""")(_bm25(_analyzer, 5))

_SQL_VECTORS = """
vectors AS (
  SELECT vec_id AS chunk_id, CASE WHEN label % 2 = 0 THEN 'chua' ELSE 'di_tich' END AS category,
         embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 17 <> 0 AND vec_id % 13 <> 0),
asked AS (
  SELECT vec_id AS query_id, embedding::DOUBLE[] AS e, CASE WHEN vec_id % 4 = 1 THEN 'chua' END AS category
  FROM embeddings WHERE vec_id % 10 = 3),
alike AS (
  SELECT q.query_id, v.chunk_id, v.category, q.category AS wanted,
         round(list_cosine_similarity(q.e, v.e), 9) AS score
  FROM asked q, vectors v)
"""


@query("dense_topk", f"""
WITH {_SQL_VECTORS}
SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM alike)
WHERE rank <= 5""")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = T.vector_queries(spark, sf_dir).drop("category")
    return _ranked(R.dense_search(asked, T.vectors(spark, sf_dir), 5, "current-model", dim=64))


@query("dense_topk_filtered", f"""
WITH {_SQL_VECTORS}
SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM alike
  WHERE score >= 0.2 AND (wanted IS NULL OR wanted = category))
WHERE rank <= 5""")
def dense_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(R.dense_search(T.vector_queries(spark, sf_dir), T.vectors(spark, sf_dir), 5,
                                  "current-model", min_similarity=0.2))


@query("hybrid_rrf", rf"""
WITH texts AS (SELECT vec_id, label, 'label ' || label || ': vector ' || vec_id AS t FROM embeddings),
corpus AS (
  SELECT vec_id AS chunk_id, CASE WHEN label % 2 = 0 THEN 'chua' ELSE 'di_tich' END AS category,
         'label ' || label AS place_name, 'vector ' || vec_id AS content FROM embeddings),
queries AS (
  SELECT vec_id AS query_id, 'vector ' || vec_id AS query, CASE WHEN vec_id % 4 = 1 THEN 'chua' END AS category
  FROM embeddings WHERE vec_id % 10 = 3),
{T.sql_bm25("multi", 50)},
{_SQL_VECTORS},
dense AS (SELECT * FROM (
  SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM alike WHERE wanted IS NULL OR wanted = category) WHERE rank <= 50),
fused AS (
  SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (
    SELECT query_id, chunk_id, rank FROM dense UNION ALL SELECT query_id, chunk_id, rank FROM bm25)
  GROUP BY query_id, chunk_id)
SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM fused)
WHERE rank <= 5""")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(R.hybrid_search(T.vector_queries(spark, sf_dir), T.vectors(spark, sf_dir), 5, "current-model"))


_SQL_DRAW = "('0x' || substr(md5('7:' || query_id || ':' || {x}), 1, 8))::BIGINT"


@query("random_retriever", rf"""
WITH RECURSIVE {T.SQL_CHUNKS},
pool AS (
  SELECT chunk_id, category, ('0x' || substr(md5(chunk_id::VARCHAR), 1, 7))::BIGINT AS bucket FROM corpus),
pools AS (
  SELECT '' AS pool, chunk_id, row_number() OVER (ORDER BY bucket, chunk_id) - 1 AS position FROM pool
  UNION ALL
  SELECT category, chunk_id, row_number() OVER (PARTITION BY category ORDER BY bucket, chunk_id) - 1 FROM pool),
sizes AS (SELECT pool, count(*) AS size FROM pools GROUP BY pool),
asked AS (
  SELECT query_id, s.pool, size, size - least(5, size) AS j0
  FROM queries q JOIN sizes s ON s.pool = coalesce(q.category, '')),
floyd AS (
  SELECT query_id, pool, size, j0 AS j, []::BIGINT[] AS chosen FROM asked
  UNION ALL
  SELECT query_id, pool, size, j + 1, list_append(chosen, CASE
    WHEN list_contains(chosen, {_SQL_DRAW.format(x='j')} % (j + 1)) THEN j
    ELSE {_SQL_DRAW.format(x='j')} % (j + 1) END)
  FROM floyd WHERE j < size),
drawn AS (SELECT query_id, pool, unnest(chosen) AS position FROM floyd WHERE j = size)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY {_SQL_DRAW.format(x='chunk_id')}, chunk_id) AS rank,
       chunk_id, 0.0::DOUBLE AS score
FROM drawn JOIN pools USING (pool, position)""")
def random_retriever(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(R.random_search(T.queries(spark, sf_dir), T.corpus(spark, sf_dir), 5, seed=7))


RETRIEVERS = ("bm25", "bm25_fold", "bm25_multi", "dense", "hybrid", "hybrid_fold", "random")
EVALUATED_DIM, EVALUATED_MODEL = 16, "hash"


def _evaluated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results with place and content, per-query metrics, latencies) of every retriever."""
    # Every retriever reads the chunks, every analyzer their words and every metric the results: each is computed once.
    corpus, asked = stored(T.corpus(spark, sf_dir)), cut_lineage(T.queries(spark, sf_dir))
    words = P.analysed(corpus)
    said = X.embedding_text(F.col("place_name"), F.col("content"))
    # Written, because a search looks at its vectors more than once: to leave out missing ones, to count and to compare.
    chunks = stored(corpus.select("chunk_id", *P.FILTERS, X.hash_embed(said, EVALUATED_DIM).alias("embedding"), F.lit(EVALUATED_MODEL).alias("embedding_model")))
    vectors = asked.withColumn("embedding", X.hash_embed(F.col("query"), EVALUATED_DIM))
    dense = cut_lineage(R.dense_search(vectors, chunks, R.HYBRID_DEPTH, EVALUATED_MODEL))
    deep = {a: cut_lineage(R.bm25_search(asked, corpus, R.HYBRID_DEPTH, a, words=words)) for a in ("fold", "multi")}
    searches = {
        "bm25": R.bm25_search(asked, corpus, 10, "plain", words=words), "bm25_fold": deep["fold"], "bm25_multi": deep["multi"], "dense": dense,
        "hybrid": R.rrf([dense, deep["multi"]], 10), "hybrid_fold": R.rrf([dense, deep["fold"]], 10), "random": R.random_search(asked, corpus, 10, seed=7),
    }
    found = None
    for name, result in searches.items():
        tagged = result.filter(F.col("rank") <= 10).withColumn("retriever", F.lit(name))
        found = tagged if found is None else found.unionByName(tagged)
    results = cut_lineage(found.join(corpus.select("chunk_id", "place_id", "place_name", "content"), "chunk_id"))
    judged, _, _ = V.build_judgements(T.relevant(spark, sf_dir), T.links(spark, sf_dir), corpus)
    metrics = cut_lineage(V.score_queries(results, asked, judged, RETRIEVERS))
    return results, metrics, _latencies(asked, judged)


def _latencies(asked: DataFrame, judged: DataFrame) -> DataFrame:
    """Stands in for measured times: a query's letters times its retriever's number."""
    names = F.posexplode(F.array(*[F.lit(r) for r in RETRIEVERS])).alias("no", "retriever")
    return asked.join(judged.select("query_id").distinct(), "query_id", "left_semi").select("query_id", "type", F.length("query").alias("letters"), names).select(
        "query_id", "type", "retriever", (F.col("letters") * (F.col("no") + 1) / 8.0).alias("latency_ms"))


_SQL_RELEVANT = r"""
item_sentences AS (SELECT DISTINCT item_id, regexp_replace(s, '^\s+|\s+$', '', 'g') AS s FROM (
  SELECT item_id, unnest(string_split(regexp_replace(text, '\.\s+', '.' || chr(1), 'g'), chr(1))) AS s FROM benchmark)
  WHERE regexp_replace(s, '^\s+|\s+$', '', 'g') <> ''),
doc_sentences AS (SELECT DISTINCT doc_id, regexp_replace(s, '^\s+|\s+$', '', 'g') AS s FROM (
  SELECT doc_id, unnest(string_split(regexp_replace(text, '\.\s+', '.' || chr(1), 'g'), chr(1))) AS s FROM documents)),
relevant AS (SELECT DISTINCT item_id AS query_id, doc_id FROM item_sentences JOIN doc_sentences USING (s)),
chunk_counts AS (SELECT place_id, count(*) AS n FROM corpus GROUP BY place_id),
judged_all AS (
  SELECT query_id, doc_id AS place_id, coalesce(n, 0) AS n_chunks
  FROM relevant LEFT JOIN chunk_counts ON place_id = doc_id WHERE doc_id % 11 <> 0),
judged AS (
  SELECT * FROM judged_all WHERE query_id IN (SELECT query_id FROM judged_all GROUP BY 1 HAVING sum(n_chunks) > 0))
"""

_SQL_RANDOM10 = rf"""
pool AS (
  SELECT chunk_id, category, ('0x' || substr(md5(chunk_id::VARCHAR), 1, 7))::BIGINT AS bucket FROM corpus),
pools AS (
  SELECT '' AS pool, chunk_id, row_number() OVER (ORDER BY bucket, chunk_id) - 1 AS position FROM pool
  UNION ALL
  SELECT category, chunk_id, row_number() OVER (PARTITION BY category ORDER BY bucket, chunk_id) - 1 FROM pool),
sizes AS (SELECT pool, count(*) AS size FROM pools GROUP BY pool),
asked AS (
  SELECT query_id, s.pool, size, size - least(10, size) AS j0
  FROM queries q JOIN sizes s ON s.pool = coalesce(q.category, '')),
floyd AS (
  SELECT query_id, pool, size, j0 AS j, []::BIGINT[] AS chosen FROM asked
  UNION ALL
  SELECT query_id, pool, size, j + 1, list_append(chosen, CASE
    WHEN list_contains(chosen, {_SQL_DRAW.format(x='j')} % (j + 1)) THEN j
    ELSE {_SQL_DRAW.format(x='j')} % (j + 1) END)
  FROM floyd WHERE j < size),
drawn AS (SELECT query_id, pool, unnest(chosen) AS position FROM floyd WHERE j = size),
random AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY {_SQL_DRAW.format(x='chunk_id')}, chunk_id) AS rank,
         chunk_id FROM drawn JOIN pools USING (pool, position))
"""


def _sql_metrics() -> str:
    per_k = []
    for k in V.KS:
        ideal = f"list_sum(list_transform(range(1, least({k}, n_relevant)::BIGINT + 1), lambda r: 1.0::DOUBLE / log2(r + 1)))"
        per_k += [
            f"SELECT query_id, type, retriever, 'hit@{k}' AS metric, CASE WHEN first <= {k} THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM agg",
            f"SELECT query_id, type, retriever, 'precision@{k}', rel_{k} / {k}.0::DOUBLE FROM agg",
            f"SELECT query_id, type, retriever, 'ndcg@{k}', coalesce(dcg_{k}, 0.0) / {ideal} FROM agg",
            f"SELECT query_id, type, retriever, 'recall@{k}', places_{k}::DOUBLE / n_places FROM agg WHERE type = 'multi'",
            f"SELECT query_id, type, retriever, 'answer_hit@{k}', CASE WHEN first_answer <= {k} THEN 1.0 ELSE 0.0 END::DOUBLE"
            " FROM agg WHERE answer_keywords IS NOT NULL",
        ]
    columns = ", ".join(
        f"count(*) FILTER (rel AND rank <= {k}) AS rel_{k}, "
        f"sum(1.0::DOUBLE / log2(rank + 1)) FILTER (rel AND rank <= {k}) AS dcg_{k}, "
        f"count(DISTINCT place_id) FILTER (rel AND rank <= {k}) AS places_{k}" for k in V.KS)
    return f"""
found AS (
  SELECT 'bm25' AS retriever, query_id, rank, chunk_id FROM b1 UNION ALL
  SELECT 'bm25_fold', query_id, rank, chunk_id FROM b2 WHERE rank <= 10 UNION ALL
  SELECT 'bm25_multi', query_id, rank, chunk_id FROM b3 WHERE rank <= 10 UNION ALL
  SELECT 'dense', query_id, rank, chunk_id FROM dense WHERE rank <= 10 UNION ALL
  SELECT 'hybrid', query_id, rank, chunk_id FROM hybrid UNION ALL
  SELECT 'hybrid_fold', query_id, rank, chunk_id FROM hybrid_fold UNION ALL
  SELECT 'random', query_id, rank, chunk_id FROM random),
results AS (SELECT f.*, c.place_id, c.place_name, c.content FROM found f JOIN corpus c USING (chunk_id)),
base AS (
  SELECT q.query_id, q.type, q.answer_keywords, r.retriever, j.n_relevant, j.n_places
  FROM queries q JOIN (SELECT query_id, sum(n_chunks) AS n_relevant, count(*) AS n_places FROM judged GROUP BY 1) j
       USING (query_id), (VALUES {", ".join(f"('{r}')" for r in RETRIEVERS)}) r(retriever)),
flagged AS (
  SELECT b.*, r.rank, r.place_id, j.place_id IS NOT NULL AS rel,
         j.place_id IS NOT NULL AND len(list_filter(coalesce(b.answer_keywords, []),
           lambda w: NOT contains(replace(lower(r.content), 'ß', 'ss'), replace(lower(w), 'ß', 'ss')))) = 0 AS answer
  FROM base b LEFT JOIN results r USING (query_id, retriever)
  LEFT JOIN judged j ON j.query_id = b.query_id AND j.place_id = r.place_id),
agg AS (
  SELECT query_id, type, answer_keywords, retriever, n_relevant, n_places,
         min(rank) FILTER (rel) AS first, min(rank) FILTER (answer) AS first_answer, {columns}
  FROM flagged GROUP BY ALL),
metrics AS (
  SELECT query_id, type, retriever, 'mrr' AS metric, coalesce(1.0::DOUBLE / first, 0.0) AS value FROM agg
  UNION ALL SELECT query_id, type, retriever, 'answer_mrr', coalesce(1.0::DOUBLE / first_answer, 0.0) FROM agg
  WHERE answer_keywords IS NOT NULL
  UNION ALL {" UNION ALL ".join(per_k)})
"""


def _sql_hybrid(name: str, lexical: str) -> str:
    return f"""
{name} AS (SELECT * FROM (
  SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id
    ORDER BY round(sum(1.0::DOUBLE / (60 + rank)), 9) DESC, chunk_id) AS rank
  FROM (SELECT query_id, chunk_id, rank FROM dense UNION ALL SELECT query_id, chunk_id, rank FROM {lexical}) GROUP BY query_id, chunk_id)
    WHERE rank <= 10)"""


_SQL_EMBED = (f"list_transform(range({EVALUATED_DIM}), lambda i: ('0x' || substr(sha256({{t}} || ':' || i), 1, 8))::BIGINT::DOUBLE / 4294967295.0::DOUBLE * 2.0::DOUBLE - 1.0::DOUBLE)")
_SQL_DENSE = f"""
chunk_vectors AS MATERIALIZED (SELECT chunk_id, category, {_SQL_EMBED.format(t="(place_name || ': ' || content)")} AS e FROM corpus),
query_vectors AS MATERIALIZED (SELECT query_id, category AS wanted, {_SQL_EMBED.format(t="query")} AS e FROM queries),
dense AS (SELECT query_id, chunk_id, rank FROM (
  SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id
    ORDER BY round(list_cosine_similarity(q.e, v.e), 9) DESC, chunk_id) AS rank
  FROM query_vectors q, chunk_vectors v WHERE wanted IS NULL OR wanted = category) WHERE rank <= {R.HYBRID_DEPTH}),
{_sql_hybrid("hybrid", "b3")}, {_sql_hybrid("hybrid_fold", "b2")}"""

_SQL_EVALUATION = (
    f"WITH RECURSIVE {T.SQL_CHUNKS}, {T.sql_bm25('plain', 10, 'b1')}, {T.sql_bm25('fold', R.HYBRID_DEPTH, 'b2')},"
    f" {T.sql_bm25('multi', R.HYBRID_DEPTH, 'b3')}, {_SQL_DENSE}, {_SQL_RANDOM10}, {_SQL_RELEVANT}, {_sql_metrics()}")


@query("judgements", f"""
WITH RECURSIVE {T.SQL_CHUNKS}, {_SQL_RELEVANT}
SELECT query_id, 'judged' AS kind, 'd:' || place_id AS external_id, n_chunks::BIGINT AS n_chunks FROM judged
UNION ALL SELECT query_id, 'missing', 'd:' || doc_id, 0 FROM relevant WHERE doc_id % 11 = 0
UNION ALL SELECT DISTINCT query_id, 'excluded', '', 0 FROM relevant WHERE query_id NOT IN (SELECT query_id FROM judged)""")
def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, missing, excluded = V.build_judgements(T.relevant(spark, sf_dir), T.links(spark, sf_dir), T.corpus(spark, sf_dir))
    zero = F.lit(0).cast("bigint").alias("n_chunks")
    return (
        judged.select("query_id", F.lit("judged").alias("kind"),
                      F.concat(F.lit("d:"), F.col("place_id").cast("string")).alias("external_id"), "n_chunks")
        .unionByName(missing.select("query_id", F.lit("missing").alias("kind"), "external_id", zero))
        .unionByName(excluded.select("query_id", F.lit("excluded").alias("kind"), F.lit("").alias("external_id"), zero))
    )


@query("retrieval_metrics", f"{_SQL_EVALUATION} SELECT query_id, type, retriever, metric, round(value, 6) AS value FROM metrics")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, metrics, _ = _evaluated(spark, sf_dir)
    return metrics.withColumn("value", F.round("value", 6))


@query("retrieval_summary", f"""{_SQL_EVALUATION}
SELECT retriever, scope, metric, round(avg(value), 6) AS mean, count(*)::BIGINT AS n FROM (
  SELECT *, 'all' AS scope FROM metrics UNION ALL SELECT *, type FROM metrics) GROUP BY retriever, scope, metric
UNION ALL
SELECT retriever, scope, 'latency_p' || (share * 100)::INT || '_ms', max(latency_ms) FILTER (place = greatest(ceil(share * n), 1)), max(n)
  FROM (
  SELECT *, row_number() OVER (PARTITION BY retriever, scope, share ORDER BY latency_ms) AS place,
    count(*) OVER (PARTITION BY retriever, scope, share) AS n
  FROM (SELECT retriever, unnest(['all', type]) AS scope, length(query) * no / 8.0::DOUBLE AS latency_ms
        FROM queries, (VALUES {", ".join(f"('{r}', {n})" for n, r in enumerate(RETRIEVERS, 1))}) r(retriever, no)
          WHERE query_id IN (SELECT query_id FROM judged)),
       (VALUES (0.5::DOUBLE), (0.95::DOUBLE)) s(share)) GROUP BY retriever, scope, share""")
def retrieval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, metrics, latencies = _evaluated(spark, sf_dir)
    return V.summarise_retrieval(metrics, latencies).withColumn("mean", F.round("mean", 6))


@query("retrieval_misses", f"""{_SQL_EVALUATION}
SELECT m.query_id, m.type, m.retriever, coalesce(list_reduce(list(place_name ORDER BY rank) FILTER (place_name IS NOT NULL),
         lambda a, b: CASE WHEN contains(', ' || a || ',', ', ' || b || ',') THEN a ELSE a || ', ' || b END), '') AS top_places
FROM metrics m LEFT JOIN results r ON r.query_id = m.query_id AND r.retriever = m.retriever AND r.rank <= 3
WHERE metric = 'hit@5' AND value = 0 GROUP BY m.query_id, m.type, m.retriever""")
def retrieval_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    results, metrics, _ = _evaluated(spark, sf_dir)
    return V.missed_queries(metrics, results, 5)


_RESAMPLES = 1000
#: Levels of the bootstrap's tree that the SQL follows: 2^levels units at most.
_LEVELS = 12


def _sql_tree() -> str:
    """Draws of every unit in every resample, level by level: a node's draws are split by the inverse of the binomial distribution function."""
    levels = ["tree0 AS MATERIALIZED (SELECT n, r, 0::BIGINT AS low, n::BIGINT AS high, n::BIGINT AS drawn FROM (SELECT DISTINCT n FROM units), range(0, " + str(_RESAMPLES) + ") a(r))"]
    for i in range(_LEVELS):
        levels.append(f"""
tree{i + 1} AS MATERIALIZED (
  WITH node AS (
    SELECT *, (low + high) // 2 AS middle, ((low + high) // 2 - low) / (high - low)::DOUBLE AS p,
           ('0x' || substr(md5('0:' || r || ':' || low || ':' || high), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
    FROM tree{i} WHERE high - low > 1),
  reached AS (
    SELECT n, r, low, k, u, sum(CASE WHEN drawn = 0 THEN 1.0::DOUBLE
      ELSE exp(lgamma(drawn + 1) - lgamma(k + 1) - lgamma(drawn - k + 1) + k * ln(p) + (drawn - k) * ln(1 - p)) END)
             OVER (PARTITION BY n, r, low ORDER BY k) AS cdf
    FROM (SELECT *, unnest(range(0, drawn + 1)) AS k FROM node)),
  split AS (SELECT n, r, low, least(count(*) FILTER (cdf < u), max(k)) AS left_drawn FROM reached GROUP BY n, r, low),
  halves AS (SELECT n, r, low, middle, high, drawn, left_drawn FROM node JOIN split USING (n, r, low))
  SELECT n, r, low, high, drawn FROM tree{i} WHERE high - low = 1
  UNION ALL SELECT n, r, low, middle, left_drawn FROM halves
  UNION ALL SELECT n, r, middle, high, drawn - left_drawn FROM halves)""")
    return ",\n".join(levels)


@query("retrieval_bootstrap", f"""{_SQL_EVALUATION},
diffs AS MATERIALIZED (
  SELECT o.retriever AS other, o.metric, o.query_id, r.value - o.value AS diff
  FROM metrics o JOIN metrics r ON r.query_id = o.query_id AND r.metric = o.metric AND r.retriever = 'bm25_multi'
  WHERE o.retriever <> 'bm25_multi' AND o.metric IN ('mrr', 'hit@5')),
units AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY other, metric
    ORDER BY ('0x' || substr(md5(query_id::VARCHAR), 1, 7))::BIGINT, query_id) - 1 AS idx,
         count(*) OVER (PARTITION BY other, metric) AS n FROM diffs),
{_sql_tree()},
means AS (
  SELECT other, metric, r, round(sum(diff * drawn) / any_value(u.n), 9) AS mean FROM units u JOIN tree{_LEVELS} d ON d.n = u.n
    AND d.low = u.idx GROUP BY other, metric, r),
ordered AS (SELECT *, row_number() OVER (PARTITION BY other, metric ORDER BY mean) - 1 AS pos FROM means)
SELECT d.other, d.metric, round(avg(d.diff), 6) AS mean_diff,
       round((SELECT mean FROM ordered o WHERE o.other = d.other AND o.metric = d.metric AND pos = {int(0.025 * _RESAMPLES)}), 6) AS low,
       round((SELECT mean FROM ordered o WHERE o.other = d.other AND o.metric = d.metric
         AND pos = {int(0.975 * _RESAMPLES) - 1}), 6) AS high,
       count(*)::BIGINT AS n
FROM diffs d GROUP BY d.other, d.metric""")
def retrieval_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, metrics, _ = _evaluated(spark, sf_dir)
    diffs = V.paired_diffs(metrics, ["mrr", "hit@5"], "bm25_multi")
    out = N.paired_bootstrap(diffs, ["other", "metric"], "query_id", _RESAMPLES)
    return out.select("other", "metric", *[F.round(c, 6).alias(c) for c in ("mean_diff", "low", "high")], "n")


@query("index_status", """
SELECT 'total' AS item, count(*)::BIGINT AS chunks FROM embeddings
UNION ALL SELECT 'embedded', count(*) FROM embeddings WHERE vec_id % 17 <> 0 AND vec_id % 13 <> 0
UNION ALL SELECT 'model:' || CASE WHEN vec_id % 13 = 0 THEN 'old-model' ELSE 'current-model' END, count(*)
FROM embeddings GROUP BY ALL""")
def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = T.vectors(spark, sf_dir)
    status = R.index_status(chunks, "current-model").select(F.explode(F.array(
        F.struct(F.lit("total").alias("item"), F.col("total").alias("chunks")),
        F.struct(F.lit("embedded").alias("item"), F.col("embedded").alias("chunks")))).alias("s")).select("s.*")
    models = R.model_counts(chunks).select(F.concat(F.lit("model:"), "embedding_model").alias("item"), "chunks")
    return status.unionByName(models)


_SQL_DIGEST = "md5(array_to_string(list_transform({v}, lambda x: round(x * 10000)::BIGINT), ','))"


_SQL_REFRESHED = rf"""
WITH todo AS (
  SELECT vec_id, 'label ' || label || ': vector ' || vec_id AS t FROM embeddings WHERE vec_id % 17 = 0 OR vec_id % 13 = 0),
parts AS (
  SELECT vec_id, list_transform(range(64), lambda i: ('0x' || substr(sha256(t || ':' || i), 1, 8))::BIGINT::DOUBLE / 4294967295.0::DOUBLE * 2.0::DOUBLE - 1.0::DOUBLE) AS v
  FROM todo),
norms AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM parts)
SELECT vec_id AS chunk_id, 'current-model' AS embedding_model, len(v) AS dim, {_SQL_DIGEST.format(v="list_transform(v, lambda x: x / norm)")} AS digest FROM norms
UNION ALL SELECT vec_id, 'current-model', len(embedding), {_SQL_DIGEST.format(v="embedding::DOUBLE[]")} FROM embeddings
WHERE vec_id % 17 <> 0 AND vec_id % 13 <> 0"""


def _doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of doubles, so that new ones are not cut to floats: that would move some components over a tie of the fourth decimal."""
    return T.vectors(spark, sf_dir).withColumn("embedding", F.col("embedding").cast("array<double>"))


def _digested(done: DataFrame) -> DataFrame:
    rounded = F.transform("embedding", lambda x: F.round(x.cast("double") * 10000).cast("bigint").cast("string"))
    return done.select("chunk_id", "embedding_model", F.size("embedding").cast("bigint").alias("dim"), F.md5(F.array_join(rounded, ",")).alias("digest"))


@query("embedding_refresh", _SQL_REFRESHED)
def embedding_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors in the end, compared by a digest of all components to four decimals."""
    return _digested(R.refresh_embeddings(_doubles(spark, sf_dir), "current-model", lambda text: X.hash_embed(text, 64)))


@query("embedding_batches", _SQL_REFRESHED)
def embedding_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a model that takes batches of texts of about one length, as a network would; the stand-in hashes."""
    def embed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            heads = [[int(hashlib.sha256(f"{text}:{i}".encode()).hexdigest()[:8], 16) for i in range(64)] for text in frame["text"]]
            raw = np.array(heads, float).reshape(-1, 64) / 4294967295.0 * 2.0 - 1.0
            yield pd.DataFrame({"chunk_id": frame["chunk_id"], "embedding": list(raw / np.sqrt((raw * raw).sum(1, keepdims=True)))})

    return _digested(R.refresh_embeddings(_doubles(spark, sf_dir), "current-model", embed_batches=embed))
