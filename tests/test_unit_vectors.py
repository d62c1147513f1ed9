"""A vector is computed once for its norm and its components."""

import pytest
from pyspark.sql import functions as F

from placeweave.functions import text as X


def test_a_vector_is_computed_once(spark):
    # Numbers drawn at random: a vector that is computed again differs from the one its norm was taken of.
    drawn = spark.range(5).coalesce(1).select(X.unit(F.array(*[F.rand(n) for n in range(8)])).alias("v"))
    for row in drawn.collect():
        assert sum(x * x for x in row.v) == pytest.approx(1.0)


def test_vectors_without_length(spark):
    kinds = spark.createDataFrame([(0, [0.0, 0.0]), (1, []), (2, None), (3, [3.0, 4.0])], "id int, v array<double>")
    assert [r.u for r in kinds.select("id", X.unit(F.col("v")).alias("u")).orderBy("id").collect()] == [[0.0, 0.0], [], None, [0.6, 0.8]]
