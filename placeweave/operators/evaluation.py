"""Retrieval evaluation: judgements, per-query metrics, summaries and paired differences."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.functions import text as X
from placeweave.operators.resampling import nearest_rank

KS = (1, 3, 5, 10)


def build_judgements(relevant: DataFrame, links: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(judged, missing, excluded) from ``relevant(query_id, external_id)`` and ``links(external_id, place_id)``.

    judged: ``query_id, place_id, n_chunks`` of queries with at least one relevant chunk;
    missing: relevant ids no place carries; excluded: queries no relevant chunk exists for."""
    wanted = relevant.select("query_id", "external_id").distinct()
    resolved = wanted.join(links.select("external_id", "place_id"), "external_id", "left")
    missing = resolved.filter(F.col("place_id").isNull()).select("query_id", "external_id")
    places = resolved.filter(F.col("place_id").isNotNull()).select("query_id", "place_id").distinct()
    counts = (
        corpus.join(places.select("place_id").distinct(), "place_id", "left_semi")
        .groupBy("place_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    )
    counted = places.join(counts, "place_id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
    alive = counted.groupBy("query_id").agg(F.sum("n_chunks").alias("_n")).filter("_n > 0").select("query_id")
    judged = counted.join(alive, "query_id", "left_semi")
    excluded = wanted.select("query_id").distinct().join(alive, "query_id", "left_anti")
    return judged, missing, excluded


def _gain(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank + 1)


def _ideal(n: Column, k: int) -> Column:
    prefix, table = 0.0, [0.0]
    for r in range(1, k + 1):
        prefix += 1.0 / math.log2(r + 1)
        table.append(prefix)
    return F.element_at(F.array(*[F.lit(v) for v in table]), (F.least(n, F.lit(k)) + 1).cast("int"))


def score_queries(results: DataFrame, queries: DataFrame, judged: DataFrame, retrievers: Sequence[str],
                  ks: Sequence[int] = KS) -> DataFrame:
    """``query_id, type, retriever, metric, value``.

    ``results`` carry ``retriever, query_id, rank, place_id, content``; ``queries`` carry ``type`` and
    ``answer_keywords``. Every judged query is scored for every retriever, also when it found nothing."""
    top = max(ks)
    per_query = judged.groupBy("query_id").agg(
        F.sum("n_chunks").alias("n_relevant"), F.count(F.lit(1)).alias("n_places"))
    base = (
        queries.select("query_id", "type", F.coalesce(
            "answer_keywords", F.array().cast("array<string>")).alias("keywords"))
        .join(per_query, "query_id")
        .withColumn("retriever", F.explode(F.array(*[F.lit(r) for r in retrievers])))
    )
    marks = judged.select("query_id", "place_id", F.lit(True).alias("_rel"))
    hits = (
        results.filter(F.col("rank") <= top).join(marks, ["query_id", "place_id"])
        .join(queries.select("query_id", F.transform(
            F.coalesce("answer_keywords", F.array().cast("array<string>")), X.casefold).alias("_kw")), "query_id")
        .withColumn("_answer", F.forall("_kw", lambda w: F.contains(X.casefold(F.col("content")), w)))
    )
    rank = F.col("rank")
    aggregates = [F.min("rank").alias("first"), F.min(F.when(F.col("_answer"), rank)).alias("first_answer")]
    for k in ks:
        aggregates += [
            F.count_if(rank <= k).alias(f"rel_{k}"),
            F.sum(F.when(rank <= k, _gain(rank))).alias(f"dcg_{k}"),
            F.size(F.collect_set(F.when(rank <= k, F.col("place_id")))).alias(f"places_{k}"),
        ]
    scored = base.join(hits.groupBy("query_id", "retriever").agg(*aggregates), ["query_id", "retriever"], "left")

    def metric(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"))

    def or_zero(c: Column) -> Column:
        return F.coalesce(c.cast("double"), F.lit(0.0))

    has_keywords = F.size("keywords") > 0
    values = [metric("mrr", or_zero(1.0 / F.col("first")))]
    values.append(metric("answer_mrr", F.when(has_keywords, or_zero(1.0 / F.col("first_answer")))))
    for k in ks:
        ideal = _ideal(F.col("n_relevant"), k)
        values += [
            metric(f"hit@{k}", or_zero(F.when(F.col("first") <= k, 1.0))),
            metric(f"precision@{k}", or_zero(F.col(f"rel_{k}") / F.lit(float(k)))),
            metric(f"ndcg@{k}", F.when(ideal > 0, or_zero(F.col(f"dcg_{k}")) / ideal).otherwise(0.0)),
            metric(f"recall@{k}", F.when(F.col("type") == "multi",
                                         or_zero(F.col(f"places_{k}")) / F.col("n_places"))),
            metric(f"answer_hit@{k}", F.when(has_keywords, or_zero(F.when(F.col("first_answer") <= k, 1.0)))),
        ]
    long = scored.select("query_id", "type", "retriever", F.explode(F.array(*values)).alias("_m"))
    return long.select("query_id", "type", "retriever", "_m.metric", "_m.value").filter(F.col("value").isNotNull())


def summarise_retrieval(metrics: DataFrame, latencies: DataFrame | None = None) -> DataFrame:
    """``retriever, scope, metric, mean, n``: the mean of each metric over all queries (``all``) and per query type. ``latencies``
    (``query_id, type, retriever, latency_ms``) add their median and 95th percentile, by nearest rank."""
    def scopes(rows: DataFrame) -> DataFrame:
        return rows.withColumn("scope", F.explode(F.array(F.lit("all"), F.col("type"))))

    out = scopes(metrics).groupBy("retriever", "scope", "metric").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    if latencies is None:
        return out
    name = F.concat(F.lit("latency_p"), (F.col("share") * 100).cast("int").cast("string"), F.lit("_ms"))
    ranked = nearest_rank(scopes(latencies), ["retriever", "scope"], "latency_ms", (0.5, 0.95))
    return out.unionByName(ranked.select("retriever", "scope", name.alias("metric"), F.col("value").alias("mean"), "n"))


def missed_queries(metrics: DataFrame, results: DataFrame, main_k: int = 5) -> DataFrame:
    """Queries without a hit in the first ``main_k``, with the distinct places of their first three rows."""
    missed = metrics.filter((F.col("metric") == f"hit@{main_k}") & (F.col("value") == 0)).select(
        "query_id", "type", "retriever")
    seen = results.filter(F.col("rank") <= 3).groupBy("query_id", "retriever").agg(
        F.array_sort(F.collect_list(F.struct("rank", "place_name"))).alias("_rows"))
    names = F.array_join(F.array_distinct(F.transform("_rows", lambda r: r["place_name"])), ", ")
    return missed.join(seen, ["query_id", "retriever"], "left").select(
        "query_id", "type", "retriever", F.coalesce(names, F.lit("")).alias("top_places"))


def paired_diffs(metrics: DataFrame, names: Sequence[str], reference: str, by: Sequence[str] = ()) -> DataFrame:
    """``query_id, other, metric, diff`` = reference minus every other retriever, paired by query."""
    wanted = metrics.filter(F.col("metric").isin(*names))
    ref = wanted.filter(F.col("retriever") == reference).select(
        "query_id", "metric", F.col("value").alias("_ref"))
    others = wanted.filter(F.col("retriever") != reference)
    return others.join(ref, ["query_id", "metric"]).select(
        "query_id", F.col("retriever").alias("other"), "metric", (F.col("_ref") - F.col("value")).alias("diff"), *by)
