"""Weather tables fed continuously: daily totals under a watermark, and the forecast table kept up to date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from placeweave.operators.loads import upsert_forecast
from placeweave.operators.scale import latest_per_key
from placeweave.session import cut_lineage


def stream_daily(hourly: DataFrame, late: str = "6 hours") -> DataFrame:
    """Hourly stream (``cell, time, precip_mm, temp_c, wind_kmh, code``) to daily rows; rows later than ``late`` are dropped."""
    day = F.window("time", "1 day")
    return hourly.withWatermark("time", late).groupBy("cell", day).agg(
        F.sum("precip_mm").alias("precip_mm"), F.max("temp_c").alias("temp_c"), F.max("wind_kmh").alias("wind_kmh"),
        F.max("code").alias("code")).select("cell", F.to_date("window.start").alias("date"), "precip_mm", "temp_c", "wind_kmh", "code")


BUCKETS = 256


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("cell"), F.lit(buckets)).cast("int")


def _manifest(spark: SparkSession, folder: str, version: int | None = None) -> dict[int, int]:
    """The version that each bucket was last written in, as of a version (the newest for None): at most one row a bucket."""
    if version is not None and version < 0:
        return {}
    rows = spark.read.option("basePath", f"{folder}/manifest").parquet(f"{folder}/manifest" if version is None else f"{folder}/manifest/as_of={version}")
    newest = rows.filter(F.col("as_of") == rows.agg(F.max("as_of")).first()[0])
    return {r["bucket"]: r["version"] for r in newest.filter("bucket >= 0").collect()}


def _read(spark: SparkSession, folder: str, versions: dict[int, int], schema: StructType) -> DataFrame:
    paths = [f"{folder}/data/version={v}/bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def apply_batch(batch: DataFrame, folder: str, version: int, buckets: int = BUCKETS) -> None:
    """One batch of forecast rows (``cell, hour, uv_index, fetched_s`` and more; newest ``fetched_s`` wins) into the table at ``folder``.

    The table is cut into buckets of cells. Only buckets that the batch touches are read and written, as files of this version; the manifest of
    the version says where each bucket now is. Versions count from 0 without gaps. A batch that is repeated after a failure reads the manifest
    before its own and writes the same files again; readers see it when its manifest is there, which comes last."""
    spark, schema = batch.sparkSession, batch.schema
    newest = cut_lineage(latest_per_key(batch, ["cell", "hour"], ["fetched_s"]).select(*batch.columns).withColumn("bucket", _bucket(buckets)))
    before = _manifest(spark, folder, version - 1)
    touched = [r["bucket"] for r in newest.select("bucket").distinct().collect()]
    old = _read(spark, folder, {b: v for b, v in before.items() if b in touched}, schema)
    merged = upsert_forecast(old, newest.drop("bucket")).withColumn("bucket", _bucket(buckets))
    merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/data/version={version}")
    # A row for the version itself, so that a batch without rows leaves a manifest too.
    rows = [(-1, version), *(before | dict.fromkeys(touched, version)).items()]
    spark.createDataFrame(rows, "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/as_of={version}")


def read_forecast(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The table as of the newest version."""
    return _read(spark, folder, _manifest(spark, folder), schema)


def load_forecast(stream: DataFrame, folder: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """:func:`apply_batch` for every micro-batch of a stream. Both folders must be reachable from every executor. The caller drops files that no
    manifest in use names."""
    return stream.writeStream.foreachBatch(lambda batch, n: apply_batch(batch, folder, n, buckets)).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
