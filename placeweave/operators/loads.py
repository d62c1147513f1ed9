"""Loads that can be repeated: each takes the stored table and a batch and returns the new table; the caller writes it as a new version."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placeweave.operators.scale import dense_index


def upsert_by_key(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the batch replace stored rows of the same key. One row per key is expected in the batch."""
    return target.join(batch.select(*keys), list(keys), "left_anti").unionByName(batch)


def upsert_forecast(target: DataFrame, batch: DataFrame, keep: Sequence[str] = ("uv_index",)) -> DataFrame:
    """As :func:`upsert_by_key` on ``cell, hour``; a stored value of the ``keep`` columns outlives a null of the batch."""
    old = target.select("cell", "hour", *[F.col(c).alias("_" + c) for c in keep])
    merged = batch.join(old, ["cell", "hour"], "left").withColumns({c: F.coalesce(c, "_" + c) for c in keep}).select(batch.columns)
    return upsert_by_key(target, merged, ["cell", "hour"])


def insert_absent(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows that get written: the first row (by ``order``) per key of the batch whose key is not stored yet."""
    rest = [c for c in batch.columns if c not in keys]
    first = batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*keys, "row.*")
    return first.join(target.select(*keys), list(keys), "left_anti")


def upsert_places(target: DataFrame, links: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(places, links, conflicts)`` after a load that is applied to the stored state as a whole.

    ``target`` is ``place_id`` and fields, ``links`` ``key, place_id`` (one place per key), ``batch`` ``record, ids`` and the fields. A record
    takes the place that any of its ids is linked to, the smallest where they disagree (that is reported), else a new number in the order
    of :func:`dense_index`. Where several records take one place, the highest ``record`` sets the fields. New ids are linked, to the smallest
    place that claims them; a stored link never changes."""
    fields = [c for c in target.columns if c != "place_id"]
    asked = batch.select("record", F.explode("ids").alias("key"))
    hits = asked.join(links, "key").groupBy("record").agg(F.min("place_id").alias("place_id"), F.sort_array(F.collect_set("place_id")).alias("_all"))
    conflicts = hits.filter(F.size("_all") > 1).select("record", "place_id", F.array_join("_all", ",").alias("matched"))
    top = target.agg(F.coalesce(F.max("place_id"), F.lit(0)).alias("_top"))
    fresh = dense_index(batch.join(hits, "record", "left_anti").select("record"), [], "record", "_n").crossJoin(F.broadcast(top)).select(
        "record", (F.col("_top") + 1 + F.col("_n")).alias("place_id"))
    placed = batch.join(hits.select("record", "place_id").unionByName(fresh), "record")
    latest = placed.groupBy("place_id").agg(F.max_by(F.struct(*fields), "record").alias("_row")).select("place_id", *[F.col("_row")[c].alias(c) for c in fields])
    claimed = placed.select("place_id", F.explode("ids").alias("key")).groupBy("key").agg(F.min("place_id").alias("place_id"))
    return (upsert_by_key(target, latest, ["place_id"]),
            links.unionByName(claimed.join(links.select("key"), "key", "left_anti").select(links.columns)), conflicts)


def image_candidates(single: DataFrame, listed: DataFrame, limit: int = 30) -> DataFrame:
    """``place, image_url, route, rank``: the image named by the place itself, then those of its category, the first ``limit`` per place.
    Both sides are ``place, pos, image_url``."""
    every = single.withColumn("route", F.lit(0)).unionByName(listed.withColumn("route", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy("place").orderBy("route", "pos", "image_url"))
    return every.withColumn("rank", rank).filter(F.col("rank") <= limit).select("place", "image_url", "route", "rank")
