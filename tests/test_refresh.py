"""Refreshed vectors keep the digits that their digest looks at, also in tables large enough to have components near a tie."""

import duckdb
import pytest
from oracle import rows_of
from pyspark.sql import functions as F

from placeweave.plans import retrieval  # noqa: F401
from placeweave.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", ["embedding_refresh", "embedding_batches"])
def test_new_vectors_are_not_cut_to_floats(spark, tmp_path, name):
    spark.range(6000).select((F.col("id") * 13).alias("vec_id"), F.array(*[F.lit(0.125).cast("float")] * 64).alias("embedding"),
                             (F.col("id") % 10).cast("int").alias("label")).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    expected = rows_of(columns, want.fetchall())
    got = QUERIES[name](spark, str(tmp_path))
    assert rows_of(got.columns, got.collect()) == expected
