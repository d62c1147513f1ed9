"""Queries and, next to each, the independent SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
#: Rows in memory take up to so many times the bytes of their Parquet files (the columns are encoded and compressed).
UNPACKED = 30
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver. Spark plans joins by the bytes of files; without the factor it takes millions of rows for a small table and
    collects them in the driver for a broadcast. With it such joins begin as sort merge joins, and small sides are still broadcast at run time."""
    spark.conf.set("spark.sql.sources.fileCompressionFactor", UNPACKED)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
