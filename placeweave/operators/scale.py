"""Numbering, newest rows and top-k over groups that may be arbitrarily large. One plan for every size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a task numbers.
NUMBERED_ROWS = 100_000
_HASH_BITS = 28


def hash_number(key: Column | str) -> Column:
    """Stable number below 2^28 of a key's text; same arithmetic in any SQL engine with md5."""
    col = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(col.cast("string")), 1, _HASH_BITS // 4), 16, 10).cast("bigint")


def dense_index(df: DataFrame, keys: Sequence[str], unique_key: str, name: str) -> DataFrame:
    """0-based gapless number per key, in the order of (hash number, unique_key).

    A task numbers a range of hashes, as many ranges as the rows ask for, so a key that holds most of the rows is spread over them; the
    numbers do not depend on how many there are. The offsets are at most one row per key and range."""
    keys = list(keys)
    buckets = max(1, -(-df.count() // NUMBERED_ROWS))
    tagged = df.withColumn("_hash", hash_number(unique_key)).withColumn("_bucket", F.floor(F.col("_hash") * F.lit(buckets) / F.lit(1 << _HASH_BITS)))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    rank = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy("_hash", unique_key))
    return (
        tagged.withColumn("_rank", rank)
        .join(offsets, [*keys, "_bucket"])
        .withColumn(name, (F.col("_offset") + F.col("_rank") - 1).cast("bigint"))
        .drop("_hash", "_bucket", "_rank", "_offset")
    )


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the one with the highest ``order``. Aggregated before the shuffle, so a hot key stays small."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*keys, "row.*")


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """Best ``k`` rows per key with their rank. Spark prunes each partition to ``k`` rows per key
    before the shuffle (window group limit), so one busy key cannot flood a task."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
