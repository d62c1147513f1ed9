"""Shards by vector bin packing: bytes, tokens and rows are balanced jointly.

Equal texts form a group. Groups are packed by the dot-product rule: the next group, largest first, goes to the shard where
its (bytes, tokens, rows) vector has the highest dot product with what the shard has left, all in shares of one shard.
The law that holds is ``bytes``: shard sizes are near equal.

How it stays distributed and bounded:

* A group with at least ``1 / HEAVY`` of all bytes, tokens or rows is an item of its own; there are at most 3 * HEAVY of
  them. The other groups are dealt by the hash of their text to ``PARCELS`` parcels, each one item. So the packed list has
  a fixed bound, whatever the input; groups of one text stay together.
* Groups that are items of their own are numbered in pieces by hashed id, as many as parcels of their share would be and ``SALT`` at
  most from ``1 / SALTED`` on, so a task numbers about a parcel; a group above half a shard could not be balanced whole and its
  pieces are packed one by one.
* Slots: an item's offset in its shard is known from the packing; inside an item (or piece) rows are numbered by id.

Defined results: null text takes no bytes and no tokens, is grouped with the empty text and has that text's checksum; rows
that repeat are all placed and numbered; null ids come first; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placeweave.session import cut_lineage

SHARDS = 24
ROW_BYTES = 8
HEAVY = 6144
PARCELS = 24_576
SALTED = 384
SALT = 64


def pack(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item. ``vectors`` holds (bytes, tokens, rows); ties go to the earlier item and shard."""
    total = vectors.sum(0)
    unit = vectors / np.where(total > 0, total, 1) * shards
    left = np.ones((shards, vectors.shape[1]))
    out = np.zeros(len(vectors), np.int64)
    for item in np.lexsort((np.arange(len(unit)), -unit[:, 0], -unit.max(1))):
        v = unit[item]
        fits = (left >= v - 1e-12).all(1)
        worth = left @ v
        if fits.any():
            worth[~fits] = -np.inf
        else:  # nothing has room in every dimension: bytes decide, the law of the result
            worth = left[:, 0] + 1e-9 * worth
        out[item] = shard = int(worth.argmax())
        left[shard] -= v
    return out


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = cut_lineage(docs.select(
        "doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"), F.unhex(F.md5(text)).alias("digest"),
        F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int").alias("salt")))
    sums = (F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.sum("n").alias("n"))
    pieces = cut_lineage(rows.withColumn("n", F.lit(1)).groupBy("digest", "salt").agg(*sums))
    groups = pieces.groupBy("digest").agg(*sums)
    total = groups.agg(*(F.sum(c).alias(c) for c in ("size", "tokens", "n"))).first()
    share = F.greatest(*(F.col(c) / F.lit(max(total[c] or 0, 1)) for c in ("size", "tokens", "n")))
    # At most 3 * HEAVY rows: each holds 1 / HEAVY of one of three totals.
    cuts = F.when(F.col("share") >= 1 / SALTED, SALT).otherwise(F.ceil(F.col("share") * PARCELS)).cast("int")
    heavy = groups.withColumn("share", share).filter(F.col("share") >= 1 / HEAVY).select(
        "digest", F.when(F.col("share") > 0.5 / shards, 2).otherwise(1).alias("kind"), cuts.alias("cuts"))
    parcel = F.pmod(F.xxhash64("digest"), F.lit(PARCELS)).cast("string")
    unit = F.when(F.col("kind").isNull(), parcel).otherwise(F.hex("digest"))
    part = F.when(F.col("kind").isNotNull(), F.pmod(F.col("salt"), F.col("cuts"))).otherwise(F.lit(0))
    known = cut_lineage(heavy)

    def named(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(known), "digest", "left").withColumns({"unit": unit, "part": part})

    # At most 4 * PARCELS + 3 * HEAVY + 3 * SALTED * SALT rows.
    items = named(pieces).groupBy("unit", "part").agg(F.max("kind").alias("kind"), *sums).orderBy("unit", "part").collect()
    places: dict[tuple, list[int]] = {}
    for k, item in enumerate(items):
        places.setdefault((item["unit"], item["part"] if item["kind"] == 2 else None), []).append(k)
    vectors = np.array([[sum(items[k][c] for k in ks) for c in ("size", "tokens", "n")] for ks in places.values()], float)
    filled = [0] * shards
    table = []
    for ks, shard in zip(places.values(), pack(vectors.reshape(-1, 3), shards).tolist(), strict=True):
        for k in ks:
            table.append((items[k]["unit"], items[k]["part"], shard, filled[shard]))
            filled[shard] += items[k]["n"]
    offsets = spark.createDataFrame(table, "unit string, part int, shard int, start long")
    number = F.row_number().over(Window.partitionBy("unit", "part").orderBy("doc_id", "digest"))
    return named(rows).join(F.broadcast(offsets), ["unit", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("start") + number - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
