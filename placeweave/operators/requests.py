"""Requests in free text: intent, date, length and mode of a trip, places named in it, lookup of places by name."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeweave.functions import text

# The phrases (folded) that decide.
PLAN = ("lich trinh", "lap lich", "len lich", "xep lich", "ke hoach", "di choi", "tham quan", "tour", "nen di dau", "di dau")
INFO = ("gio mo cua", "mo cua", "may gio", "dong cua", "gia ve", "ve vao", "bao nhieu tien", "trang phuc", "mac gi")
WEATHER = ("thoi tiet", "co mua", "mua khong", "nang khong", "du bao", "nhiet do")
WEEKDAYS = ("thu hai", "thu ba", "thu tu", "thu nam", "thu sau", "thu bay", "chu nhat")
NUMBERS = {"mot": 1, "hai": 2, "ba": 3, "bon": 4, "nam": 5}
CAR = ("o to", "oto", "xe hoi", "taxi", "grab car")
WALKING = ("di bo",)
MOTORBIKE = ("xe may", "xe dap dien", "grab bike")


def _has(folded: Column, *phrases: str) -> Column:
    return folded.rlike(r"(?U)(?<!\w)(?:" + "|".join(phrases) + r")(?!\w)")


def tag_requests(requests: DataFrame, mentions: DataFrame, today: Column, default_mode: str = "motorbike") -> DataFrame:
    """``request, intent, start, days, mode, assumed`` of ``requests`` (``request, text``); ``mentions`` are the requests that name a place.
    ``assumed`` lists what the text does not say: ``date`` (tomorrow), ``days`` (one), ``places``."""
    t = F.col("_t")
    rows = requests.withColumn("_t", text.fold_ws(F.coalesce("text", F.lit("")))).join(
        mentions.select("request").distinct().withColumn("_named", F.lit(True)), "request", "left")
    named = F.coalesce("_named", F.lit(False))
    counted = r"(?U)\b(\d+)\s*ngay\b"
    intent = F.when(_has(t, *PLAN) | t.rlike(counted), "plan").when(_has(t, *INFO) & named, "info").when(_has(t, *WEATHER), "weather").otherwise("ask")

    date = r"(?U)\b([0-9]{1,2})[/-]([0-9]{1,2})(?:[/-]([0-9]{4}))?\b"
    part = [F.nullif(F.regexp_extract(t, date, i), F.lit("")) for i in (1, 2, 3)]
    written = F.try_to_date(F.format_string("%04d-%02d-%02d", F.coalesce(part[2].try_cast("int"), F.year(today)), part[1].try_cast("int"), part[0].try_cast("int")), "yyyy-MM-dd")
    weekday = reduce(lambda found, n: found.when(_has(t, WEEKDAYS[n]), F.date_add(today, F.pmod(F.lit(n) - F.weekday(today), F.lit(7)))), range(1, 7),
                     F.when(_has(t, WEEKDAYS[0]), F.date_add(today, F.pmod(F.lit(0) - F.weekday(today), F.lit(7)))))
    told = F.when(part[0].isNotNull(), written).when(_has(t, "hom nay"), today).when(_has(t, "ngay mai", "mai"), F.date_add(today, 1)).when(
        _has(t, "ngay kia", "ngay mot", "mot"), F.date_add(today, 2)).otherwise(weekday)

    number = F.nullif(F.regexp_extract(t, counted, 1), F.lit(""))
    in_words = F.coalesce(*[F.when(t.rlike(rf"(?U)\b{word}\s+ngay\b"), n) for word, n in NUMBERS.items()])
    days = F.when(number.isNotNull(), F.greatest(F.least(F.coalesce(number.try_cast("bigint"), F.lit(7)), F.lit(7)), F.lit(1))).otherwise(in_words)
    mode = F.when(_has(t, *CAR), "car").when(_has(t, *WALKING), "walking").when(_has(t, *MOTORBIKE), "motorbike").otherwise(default_mode)
    assumed = F.array_compact(F.array(F.when(told.isNull(), F.lit("date")), F.when(days.isNull(), F.lit("days")), F.when(~named, F.lit("places"))))
    return rows.select("request", intent.alias("intent"), F.coalesce(told, F.date_add(today, 1)).alias("start"),
                       F.coalesce(days, F.lit(1)).cast("int").alias("days"), mode.alias("mode"), F.array_join(assumed, ",").alias("assumed"))


def alias_runs(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """``request, at, n, alias, place``: every run of words of a text that is an alias (``at``: index of its first word, ``n``: its words).

    A text's runs of words, as long as an alias may be, meet the aliases by equality; no text is compared with every alias."""
    words = F.regexp_extract_all(text.fold_ws(F.coalesce("text", F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))
    known = aliases.select(F.array_join(F.regexp_extract_all("alias", F.lit(r"(?U)\w+"), F.lit(0)), " ").alias("alias"), "place").filter("alias <> ''").groupBy(
        "alias").agg(F.min("place").alias("place")).withColumn("n", F.size(F.split("alias", " ")))
    lengths = known.agg(F.sort_array(F.collect_set("n")).alias("_lengths"))
    runs = texts.select("request", words.alias("_w")).crossJoin(F.broadcast(lengths)).withColumn("n", F.explode("_lengths")).filter("size(_w) >= n").select(
        "request", "n", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("_w") - F.col("n") + 1), lambda i: F.array_join(F.slice("_w", i, F.col("n")), " "))).alias("at", "alias"))
    return runs.join(known, ["alias", "n"]).select("request", "at", "n", "alias", "place")


def match_aliases(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """``request, place, at, rank``: places named in ``texts`` (``request, text``) in order of first mention. ``aliases`` are ``alias`` (folded
    words), ``place``. Where names overlap the longer wins, then the earlier.

    The mentions of a text pass by in that order, and one stays when none of its words is taken; a task holds the taken words of the text
    at hand, not its mentions, so the work grows with the mentions, not with their square."""
    hits = alias_runs(texts, aliases).withColumn("letters", F.length("alias"))
    order = ["request", F.desc("letters"), "at", "n", "place"]
    schema = f"request {hits.schema['request'].dataType.simpleString()}, place {hits.schema['place'].dataType.simpleString()}, at int"

    def settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        request, taken = None, set()
        for frame in frames:
            stays = np.zeros(len(frame), bool)
            for i, (key, at, n) in enumerate(zip(frame["_key"], frame["at"], frame["n"], strict=True)):
                if key != request:
                    request, taken = key, set()
                words = range(at, at + n)
                if taken.isdisjoint(words):
                    taken.update(words)
                    stays[i] = True
            yield frame.loc[stays, ["request", "place", "at"]]

    key = F.to_json(F.struct("request")).alias("_key")
    sorted_hits = hits.select("request", key, "place", "at", "n", "letters").repartition("request").sortWithinPartitions(*order)
    first = sorted_hits.mapInPandas(settle, schema).groupBy("request", "place").agg(F.min("at").alias("at"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("request").orderBy("at", "place")))


def resolve_ids(wanted: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(found, missing)`` of ``wanted`` (``owner, ids``): ``owner, pos, place`` in the order asked, and ids without a place."""
    asked = wanted.select("owner", F.posexplode("ids").alias("pos", "key"))
    return asked.join(links, "key").select("owner", "pos", "place"), asked.join(links, "key", "left_anti").select("owner", "key").distinct()


def page_titles(places: DataFrame, titles: DataFrame) -> DataFrame:
    """``place, title``: the encyclopedia's title of the place (``titles``: ``key, title``), or else its name."""
    return places.join(titles, "key", "left").select("place", F.coalesce(F.nullif("title", F.lit("")), "name").alias("title"))
