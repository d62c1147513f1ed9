"""URL verdicts: rules first, then multinomial naive Bayes over words that a unigram Viterbi splits out of host and path.

1. Host and path are cut from the url; the longest rule whose host fits (itself or a subdomain) and whose path opens the
   url's path decides.
2. Word counts come from the visible text of all pages, every word counts. The substrings of the distinct letter runs meet
   them by a join, so no task holds the model.
3. Each letter run of host and path is split into the word sequence of highest probability; letters no word covers cost as
   much as an unseen word of their length.
4. Naive Bayes learns from weak labels of one view and scores another: a page counts as bad when its visible text has
   ``TEXT_SEEDS`` different seed words or more; what is counted and scored are the tokens of its host and path. A seed word in a
   host weighs what the texts of the pages with it make it weigh, like any other word. Token counts per class come from all
   pages with visible words; a token that none of these has says nothing, all others count, add-one smoothing. Pages that no
   rule decides get the likelier verdict, ties allow.

Joins send the ``HOT`` most used keys to every task and shuffle the rest, so no key crowds a task and nothing is left out.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule and is judged by the method (no
token: the prior); without any page of either class its counts are the smoothing alone; repeated rows are judged alike; a run of
more than ``RUN_LETTERS`` letters is split in pieces of that many, so no task holds all substrings of a very long path.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeweave.session import cut_lineage

HOT = 50_000
LONGEST_WORD = 24
RUN_LETTERS = 4096
#: Different seed words that make a visible text bad.
TEXT_SEEDS = 1
#: Fixed values: (host, path, verdict) of the rules.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Words that hint at an unwanted page where they stand as words of their own; they make the weak labels.
SEEDS = frozenset("ads adult bet bets betting casino escort gambling jackpot lottery malware payday phishing pills poker porn "
                  "replica sex slots spam spyware torrent viagra warez xxx".split())
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RUN = re.compile(r"[a-z]+|[0-9]+|[^\x00-\x7f]+")


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``ruled`` (the rule's verdict)."""
    url = F.coalesce("url", F.lit(""))
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    out = pages.withColumns({"host": host, "path": path})
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for own, prefix, verdict in sorted(RULES, key=lambda r: len(r[0] + r[1])):  # the longest is tried first, outermost
        fits = ((F.col("host") == own) | F.endswith(F.col("host"), F.lit(f".{own}"))) & F.startswith(F.col("path"), F.lit(prefix))
        rule, ruled = F.when(fits, own + prefix).otherwise(rule), F.when(fits, verdict).otherwise(ruled)
    return out.withColumns({"rule": rule, "ruled": ruled})


def most_frequent(counts: DataFrame, n: F.Column, most: int) -> DataFrame:
    """For broadcasts: rows of the highest ``n`` whose number stays within ``most``, cut between steps of a sixteenth of a doubling. Only the
    steps' sizes, a few hundred numbers, reach the driver; equal counts stay or go together."""
    step = F.floor(F.log2(n) * 16)
    sizes = {r["step"]: r["size"] for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("size")).collect()}
    kept, lowest = 0, max(sizes, default=0) + 1
    for s in sorted(sizes, reverse=True):
        if kept + sizes[s] > most:
            break
        kept, lowest = kept + sizes[s], s
    return counts.filter(step >= lowest)


def meet(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` joined to ``table``, which has every key of theirs once and how many of them have it (``uses``)."""
    hot = most_frequent(table, F.col("uses"), HOT)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table, key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def _visible() -> F.Column:
    return F.regexp_replace(F.lower(F.coalesce("html", F.lit(""))), "(?s)<[^>]*>", " ")


def _speaks_of_seeds() -> F.Column:
    """Whether the visible text has enough different seed words, null without any word. Most pages hold no seed anywhere, and the first letter
    outside tags stands near the beginning: these looks spare them the splitting."""
    seeds = sorted(SEEDS)
    lower = F.lower(F.coalesce("html", F.lit("")))
    found = F.array_distinct(F.regexp_extract_all(_visible(), F.lit(rf"(?<![a-z])(?:{'|'.join(seeds)})(?![a-z])"), F.lit(0)))
    anywhere = reduce(lambda a, b: a | b, [F.contains(lower, F.lit(seed)) for seed in seeds])
    has_words = lower.rlike(r"(?s)(?:^|>)[^<]*?[a-z]|<[^>]*?[a-z][^>]*\z")
    return F.when(~has_words, F.lit(None)).when(anywhere, F.size(found) >= TEXT_SEEDS).otherwise(False)


def word_counts(pages: DataFrame) -> tuple[DataFrame, float, float]:
    """(``word, n`` of every word, log of all occurrences, cost of an unseen letter); a seed word no page has counts as one."""
    seen = cut_lineage(pages.select(F.explode(F.split(_visible(), "[^a-z]+")).alias("word")).filter(
        F.length("word").between(1, LONGEST_WORD)).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    seeds = pages.sparkSession.createDataFrame([(word,) for word in sorted(SEEDS)], "word string")
    unheard = seeds.join(seen.filter(F.col("word").isin(*SEEDS)), "word", "left_anti").select("word", F.lit(1).cast("long").alias("n"))
    counts = cut_lineage(seen.unionByName(unheard))
    whole = math.log((seen.agg(F.sum("n")).first()[0] or 1) + 1)
    return counts, whole, whole - math.log(counts.agg(F.min("n")).first()[0]) + math.log(10)


def segment(run: str, costs: dict[str, float], unseen: float) -> list[str]:
    """Words of the cheapest split; ties take the longer last word. Uncovered letters stay together."""
    best, last = [0.0], [0]
    for end in range(1, len(run) + 1):
        cheapest, begin = best[end - 1] + unseen, end - 1
        for start in range(max(0, end - LONGEST_WORD), end):
            cost = costs.get(run[start:end])
            if cost is not None and best[start] + cost < cheapest:
                cheapest, begin = best[start] + cost, start
        best.append(cheapest)
        last.append(begin)
    words, end = [], len(run)
    while end:
        words.append(run[last[end]:end])
        end = last[end]
    out: list[str] = []
    for word in reversed(words):
        if out and word not in costs and out[-1] not in costs:
            out[-1] += word
        else:
            out.append(word)
    return out


def pieces_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of host and path, marked by where they stand: letters as ``run``, all else as ``token``; digit runs count by length."""
    for frame in frames:
        rows = []
        for row, host, path in zip(frame["row"], frame["host"], frame["path"], strict=True):
            for mark, text in (("h:", host), ("p:", path.lower())):
                for run in _RUN.findall(text):
                    if "a" <= run[0] <= "z":
                        rows += [(row, mark, run[k:k + RUN_LETTERS], None) for k in range(0, len(run), RUN_LETTERS)]
                    else:
                        rows.append((row, mark, None, f"{mark}#{len(run)}" if run[0].isdigit() else mark + run))
        yield pd.DataFrame(rows, columns=["row", "mark", "run", "token"])


def _substrings(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for run in frame["run"]:
            parts = {run[i:j] for i in range(len(run)) for j in range(i + 1, min(len(run), i + LONGEST_WORD) + 1)}
            yield pd.DataFrame({"run": run, "word": sorted(parts)})


def split_runs(runs: DataFrame, counts: DataFrame, whole: float, unseen: float) -> DataFrame:
    """``run, uses, words`` of every run."""
    pairs = runs.select("run").mapInPandas(_substrings, "run string, word string")
    parts = cut_lineage(pairs.groupBy("word").agg(F.count(F.lit(1)).alias("uses")).join(counts, "word", "left"))
    known = meet(pairs, parts, "word").filter("n IS NOT NULL").groupBy("run").agg(
        F.collect_list("word").alias("known"), F.collect_list("n").alias("n"))

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            words = []
            for run, known, n in zip(frame["run"], frame["known"], frame["n"], strict=True):
                costs = {w: whole - math.log(c) for w, c in zip(known, n, strict=True)} if known is not None else {}
                words.append(segment(run, costs, unseen))
            yield pd.DataFrame({"run": frame["run"], "uses": frame["uses"], "words": words})

    return cut_lineage(runs.join(known, "run", "left").mapInPandas(split, "run string, uses long, words array<string>"))


def judge_urls(pages: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row."""
    counts, whole, unseen = word_counts(pages)
    parted = cut_lineage(with_parts(pages.select("page_id", "url", _speaks_of_seeds().alias("speaks"))).select(
        "page_id", "host", "path", "rule", "ruled", "speaks", F.monotonically_increasing_id().alias("row")))
    pieces = cut_lineage(parted.select("row", "host", "path").mapInPandas(pieces_of, "row long, mark string, run string, token string"))
    letters = pieces.filter("run IS NOT NULL").select("row", "mark", "run")
    runs = cut_lineage(letters.groupBy("run").agg(F.count(F.lit(1)).alias("uses")))
    spelled = meet(letters, split_runs(runs, counts, whole, unseen), "run").select(
        "row", F.explode(F.transform("words", lambda w: F.concat("mark", w))).alias("token"))
    each = cut_lineage(pieces.filter("run IS NULL").select("row", "token").unionByName(spelled).join(parted.select("row", F.col("speaks").cast("int").alias("b")), "row"))
    bad, good = (parted.filter(F.col("speaks") == said).count() for said in (True, False))
    prior = math.log(bad + 1) - math.log(good + 1)
    per_token = cut_lineage(each.groupBy("token").agg(F.count(F.lit(1)).alias("uses"), F.count_if(F.col("b") == 1).alias("block"), F.count_if(F.col("b") == 0).alias("allow")))
    sums = per_token.agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"), F.count(F.lit(1)).alias("size")).first()
    size = (sums["size"] or 0) + 1
    blank = {v: math.log((sums[v] or 0) + size) for v in ("block", "allow")}
    weight = F.log(F.col("block") + 1) - F.log(F.col("allow") + 1) + F.lit(blank["allow"] - blank["block"])
    weights = per_token.select("token", "uses", F.when(F.col("block") + F.col("allow") > 0, weight).otherwise(0.0).alias("w"))
    # Added up in one order, whatever the partitions.
    scores = meet(each.select("row", "token"), weights, "token").groupBy("row").agg(
        F.reduce(F.array_sort(F.collect_list("w")), F.lit(0.0), lambda a, w: a + w).alias("score"))
    by_method = F.when(F.lit(prior) + F.coalesce("score", F.lit(0.0)) > 1e-12, "block").otherwise("allow")
    return parted.join(scores, "row", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", by_method).alias("verdict"))
