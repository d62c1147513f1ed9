"""Connected components of a link table by label exchange and pointer jumping, all of it in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.session import cut_lineage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: root is the smallest node reachable. Nodes without a link are not listed.

    Every round each node takes the smallest label among itself and its neighbours, then its label's label;
    each round is checkpointed, so a lost executor repeats one round. Joins on hot nodes stay splittable
    because both sides come straight from a shuffle.
    """
    both = cut_lineage(
        links.select(F.col(a).alias("node"), F.col(b).alias("near"))
        .unionByName(links.select(F.col(b).alias("node"), F.col(a).alias("near")))
        .filter("node <> near").distinct())
    labels = cut_lineage(both.groupBy("node").agg(F.least("node", F.min("near")).alias("root")))
    while True:
        told = both.join(labels.select(F.col("node").alias("near"), F.col("root").alias("heard")), "near")
        least = cut_lineage(
            labels.select("node", F.col("root").alias("now"), F.col("root").alias("heard"))
            .unionByName(told.select("node", F.lit(None).cast("bigint").alias("now"), "heard"))
            .groupBy("node").agg(F.min("now").alias("was"), F.min("heard").alias("root")))
        jumped = least.join(least.select(F.col("node").alias("root"), F.col("root").alias("further")), "root", "left")
        after = cut_lineage(jumped.select("node", "was", F.least("root", "further").alias("root")))
        labels = after.select("node", "root")
        if after.filter("was <> root").isEmpty():
            return labels
