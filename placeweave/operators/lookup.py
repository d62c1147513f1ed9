"""Places looked up by what a user calls them: names that contain the words asked for, or are contained in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.functions import text
from placeweave.session import cut_lineage

#: Letters of a gram of the index, and how many names a task reads of one gram.
GRAM = 3
GRAM_NAMES = 4096


def _grams(of: Column, size: int) -> Column:
    """Distinct substrings of ``size`` letters."""
    starts = F.sequence(F.lit(1), F.length(of) - size + 1)
    return F.array_distinct(F.when(F.length(of) < size, F.array().cast("array<string>")).otherwise(
        F.transform(starts, lambda i: F.substring(of, i, F.lit(size)))))


def contained_pairs(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """``needle`` and the columns of ``hays`` for every needle that is a part of a ``hay``; needles have ``GRAM`` letters at least.

    A needle is looked for under its rarest gram, so texts meet only where they share it; then the letters are compared. The texts under
    one gram are dealt to as many tasks as their number asks for. Both sides are distinct texts."""
    indexed = cut_lineage(hays.withColumn("gram", F.explode(_grams(F.col("hay"), GRAM))))
    held = indexed.groupBy("gram").agg(F.count(F.lit(1)).alias("held"))
    grams = needles.select("needle", F.explode(_grams(F.col("needle"), GRAM)).alias("gram"))
    # A gram that no text has rules the needle out, so it counts as rarest.
    rarest = grams.join(held, "gram", "left").withColumn("held", F.coalesce("held", F.lit(0))).groupBy("needle").agg(
        F.min(F.struct("held", "gram")).alias("r")).filter("r.held > 0").select("needle", "r.gram", F.ceil(F.col("r.held") / GRAM_NAMES).alias("parts"))
    probes = cut_lineage(rarest)
    used = probes.select("gram", "parts").distinct()
    dealt = indexed.join(used, "gram").withColumn("part", F.pmod(F.xxhash64("hay"), F.col("parts"))).drop("parts")
    spread = probes.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).drop("parts")
    return spread.join(dealt, ["gram", "part"]).filter(F.contains("hay", F.col("needle"))).drop("gram", "part")


def _short(df: DataFrame, name: str, keep: list[str]) -> DataFrame:
    """The distinct parts of fewer than ``GRAM`` letters of the texts in ``name``."""
    return df.select(*keep, F.explode(F.flatten(F.array(*[_grams(F.col(name), n) for n in range(1, GRAM)]))).alias("part"))


def find_by_name(asked: DataFrame, places: DataFrame) -> DataFrame:
    """``asked`` (``ask, text``) with ``place``: the place whose folded name contains the folded text or is contained in it, the one nearest
    in length, then the smallest ``place``; null where there is none. ``places`` are ``place, name``.

    Every distinct text is looked up once and equal names are one. Texts and names below ``GRAM`` letters meet by equality with the short
    parts of the other side, of which only the best per part is kept. Texts that fold to nothing find nothing, names that do are found by
    nothing."""
    names = cut_lineage(places.select("place", text.fold(F.col("name")).alias("hay")).filter("hay <> ''").groupBy("hay").agg(F.min("place").alias("place")))
    texts = cut_lineage(asked.select(text.fold(F.col("text")).alias("needle")).filter("needle <> ''").distinct())
    size = F.length("hay")
    found = F.struct(F.abs(size - F.length("needle")).alias("off"), "place").alias("found")

    holds = contained_pairs(texts.filter(F.length("needle") >= GRAM), names).select("needle", found)
    parts = _short(names.withColumn("n", size), "hay", ["place", "n"]).groupBy(F.col("part").alias("needle")).agg(F.min(F.struct("n", "place")).alias("b"))
    short_texts = texts.filter(F.length("needle") < GRAM).join(parts, "needle").select(
        "needle", F.struct((F.col("b.n") - F.length("needle")).alias("off"), F.col("b.place").alias("place")).alias("found"))

    within = contained_pairs(names.filter(size >= GRAM).select(F.col("hay").alias("needle")), texts.select(F.col("needle").alias("hay"))).select(
        F.col("hay").alias("needle"), F.col("needle").alias("hay")).join(names, "hay").select("needle", found)
    short_names = _short(texts, "needle", ["needle"]).join(names.filter(size < GRAM).withColumnRenamed("hay", "part"), "part").withColumn(
        "hay", F.col("part")).select("needle", found)

    best = holds.unionByName(short_texts).unionByName(within).unionByName(short_names).groupBy("needle").agg(F.min("found").alias("best"))
    return asked.withColumn("needle", text.fold(F.col("text"))).join(best, "needle", "left").select(*asked.columns, F.col("best.place").alias("place"))


def find_places(asked: DataFrame, places: DataFrame, named: DataFrame) -> DataFrame:
    """As :func:`find_by_name`, but a place the text names by an alias comes first. ``named`` are ``ask, place`` of that place, if any."""
    known = asked.join(named.select("ask", F.col("place").alias("_alias")), "ask", "left")
    rest = find_by_name(known.filter("_alias IS NULL").select(asked.columns), places)
    return known.filter("_alias IS NOT NULL").select(*asked.columns, F.col("_alias").alias("place")).unionByName(rest)
