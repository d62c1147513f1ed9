"""BM25 over an index in blocks: texts are split into words once, and questions meet blocks as matrices, skipping rows that cannot reach their kth score."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.functions import text as X
from placeweave.operators.scale import top_k
from placeweave.session import cut_lineage, stored

# Fixed values of the score.
BM25_K1 = 1.5
BM25_B = 0.75
# Scores closer than this are equal: the order in which Spark adds doubles must not rank copies.
SCORE_DECIMALS = 9
FILTERS = ("category", "place_id")
#: Chunks of a block, and the blocks a task scores between two looks at the kth scores that further chunks must reach.
BLOCK_CHUNKS = 128
FIRST_BLOCKS = 6
#: Questions of a group, groups and blocks of a cell at most.
GROUP_QUESTIONS = 256
CELL_GROUPS, CELL_BLOCKS = 16, 64
#: Cells of a questions x words matrix in a task.
MATRIX_CELLS = 1 << 22
#: Different words asked for that are sent to every task; beyond, texts and words meet by a shuffle.
SENT_WORDS = 200_000
_SLACK = 1e-6


def filters_of(queries: DataFrame) -> list[str]:
    return [f for f in FILTERS if f in queries.columns]


def analysed(corpus: DataFrame) -> DataFrame:
    """``chunk, chunk_id, category, place_id, plain, folded``: the words of every chunk, written once for all analyzers. ``chunk`` numbers the
    chunks in the order of their ids, so that numbers can stand for ids from here on, ties included.

    Chunks are dealt over the tasks before they are split: a file's row group, however large, is read by one task, and the words take far
    longer than the reading."""
    texts = stored(corpus.select("chunk_id", *FILTERS, X.embedding_text(F.col("place_name"), F.col("content")).alias("_text")))
    dealt = texts.repartitionByRange("chunk_id").sortWithinPartitions("chunk_id")
    return stored(X.words_of(dealt.select(F.monotonically_increasing_id().alias("chunk"), "chunk_id", *FILTERS, "_text"), "_text"))


def query_terms(queries: DataFrame, analyzer: str) -> DataFrame:
    """``query_id, filters, term, times``: a repeated query term keeps its multiplicity."""
    keep = ["query_id", *filters_of(queries)]
    words = cut_lineage(queries.select(*keep, X.tokens(F.col("query")).alias("plain"), X.tokens(F.col("query"), folded=True).alias("folded")))
    terms = words.select(*keep, F.explode(X.terms_of(F.col("plain"), F.col("folded"), analyzer)).alias("term"))
    return terms.groupBy(*keep, "term").agg(F.count(F.lit(1)).alias("times"))


@dataclass(frozen=True)
class Index:
    """``blocks``: ``block, category, terms, chunks, places, gains``, the occurrences of the words asked for in a share of a category's chunks, as
    arrays of one length; ``frequencies``: ``word, df``, how many chunks hold a word; ``vocabulary``: ``term, word``; ``names``: ``chunk,
    chunk_id``; ``size``, the number of chunks of the collection."""

    blocks: DataFrame
    frequencies: DataFrame
    vocabulary: DataFrame
    names: DataFrame
    size: int


def _sent(vocabulary: DataFrame) -> DataFrame:
    """Spark takes the written words for more than they are; a shuffle would carry every word of every text instead."""
    return F.broadcast(vocabulary) if vocabulary.count() <= SENT_WORDS else vocabulary


def build_index(words: DataFrame, analyzer: str, asked: DataFrame, k1: float = BM25_K1, b: float = BM25_B) -> Index:
    """The index of the words of ``asked`` (``term``). A gain is what a word adds to a chunk's score, before the weight the question gives it.

    The words of a block are shuffled once, to one task, where repeats are counted and the block is put together; a block has about
    ``BLOCK_CHUNKS`` chunks, whatever a word's frequency."""
    terms = X.terms_of(F.col("plain"), F.col("folded"), analyzer)
    length = X.count_of(F.col("plain"), F.col("folded"), analyzer).cast("bigint")
    vocabulary = stored(asked.select("term").distinct().select("term", F.monotonically_increasing_id().alias("word")))
    # One row a category; written, so that Spark knows its size when it plans the join.
    counts = stored(words.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum(length).alias("length")))
    totals = counts.agg(F.sum("n").alias("n"), F.sum("length").alias("length")).first()
    size = totals["n"] or 0
    average = F.lit((totals["length"] or 0) / size if size else 0.0)
    buckets = counts.select(F.col("category").alias("_category"), F.ceil(F.col("n") / BLOCK_CHUNKS).alias("_buckets"))
    block = F.concat_ws(":", F.pmod(F.xxhash64("chunk"), F.col("_buckets")).cast("string"), F.col("category"))
    placed = words.join(buckets, F.col("category").eqNullSafe(F.col("_category"))).select(
        block.alias("block"), "category", "place_id", "chunk", length.alias("length"), terms.alias("terms")).repartition("block")
    key = ["block", "category", "place_id", "chunk", "length"]
    each = placed.select(*key, F.explode("terms").alias("term")).join(_sent(vocabulary), "term")
    tf = F.col("tf")
    gain = tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / average))
    counted = each.groupBy(*key, "word").agg(F.count(F.lit(1)).alias("tf")).select("block", "category", F.struct("word", "chunk", "place_id", gain.alias("gain")).alias("e"))
    gathered = counted.groupBy("block", "category").agg(F.collect_list("e").alias("e"))
    blocks = stored(gathered.select("block", "category", F.col("e.word").alias("terms"), F.col("e.chunk").alias("chunks"),
                                    F.col("e.place_id").alias("places"), F.col("e.gain").alias("gains")))
    # A word is in a chunk's entries once.
    frequencies = stored(blocks.select(F.explode("terms").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")))
    return Index(blocks, frequencies, vocabulary, words.select("chunk", "chunk_id"), size)


class _Questions:
    """A group of questions and the best chunks each has met so far: highest score first, ties to the smaller chunk."""

    def __init__(self, row: pd.Series, k: int) -> None:
        self.k, self.ids = k, list(row["ids"])
        self.categories = np.array(list(row["categories"]), object)
        self.places = [None if p is None or pd.isna(p) else int(p) for p in row["places"]]
        words = [np.asarray(w, np.int64) for w in row["words"]]
        word, question = np.concatenate(words), np.repeat(np.arange(len(words)), [len(w) for w in words])
        order = np.argsort(word, kind="stable")
        self.words, self.question = word[order], question[order]
        self.weights = np.concatenate([np.asarray(w, float) for w in row["weights"]])[order]
        self.floor = np.zeros(len(self.ids))
        self.held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.open: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def meet(self, category: str | None, words: np.ndarray, chunks: np.ndarray, places: np.ndarray, gains: np.ndarray) -> None:
        begin, end = np.searchsorted(self.words, words, "left"), np.searchsorted(self.words, words, "right")
        column = np.repeat(np.arange(len(words)), end - begin)
        at = np.arange(len(column)) - np.repeat(np.cumsum(end - begin) - (end - begin), end - begin) + np.repeat(begin, end - begin)
        tops = gains.max(1)
        bounds = np.bincount(self.question[at], self.weights[at] * tops[column], len(self.ids))
        asks = np.array([c is None or c == category for c in self.categories])
        rows = np.flatnonzero(asks & (bounds > 0) & (bounds >= self.floor - _SLACK))
        row = np.full(len(self.ids), -1)
        step = max(1, MATRIX_CELLS // max(1, len(words)))
        for first in range(0, len(rows), step):
            part = rows[first:first + step]
            row[:] = -1
            row[part] = np.arange(len(part))
            inside = row[self.question[at]] >= 0
            weights = np.zeros((len(part), len(words)))
            weights[row[self.question[at[inside]]], column[inside]] = self.weights[at[inside]]
            scores = np.round(weights @ gains, SCORE_DECIMALS)
            fits = (scores > 0) & (scores >= self.floor[part][:, None])
            for n, place in enumerate(self.places[q] for q in part):
                if place is not None:
                    fits[n] &= places == place
            n, c = np.nonzero(fits)
            self.open.append((part[n], chunks[c], scores[n, c]))
            self.waiting += len(n)
            if self.waiting > 4 * self.k * len(self.ids):
                self.look()

    def look(self) -> None:
        """Keeps the best ``k`` of each question; its kth score is the floor from here on."""
        question, chunk, score = (np.concatenate(parts) for parts in zip(self.held, *self.open, strict=True))
        order = np.lexsort((chunk, -score, question))
        question, chunk, score = question[order], chunk[order], score[order]
        place = np.arange(len(question)) - np.searchsorted(question, question, "left")
        self.floor[question[place == self.k - 1]] = score[place == self.k - 1]
        self.held = tuple(part[place < self.k] for part in (question, chunk, score))
        self.open, self.waiting = [], 0

    def found(self) -> pd.DataFrame:
        self.look()
        question, chunk, score = self.held
        return pd.DataFrame({"query_id": [self.ids[q] for q in question], "chunk": chunk, "score": score})


def _cell_scores(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Best chunks of a cell's blocks for each of its questions: questions x words times words x chunks, in slices of bounded size."""
    def score(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        groups = [_Questions(row, k) for _, row in asked.iterrows()]
        for turn, row in enumerate(held.itertuples(index=False) if groups else (), 1):
            words, word = np.unique(np.asarray(row.terms), return_inverse=True)
            chunks, first, chunk = np.unique(np.asarray(row.chunks), return_index=True, return_inverse=True)
            places = np.asarray(row.places)[first]
            gains = np.zeros((len(words), len(chunks)))
            gains[word, chunk] = row.gains
            for group in groups:
                group.meet(row.category, words, chunks, places, gains)
                if turn % FIRST_BLOCKS == 0:
                    group.look()
        out = [group.found() for group in groups] if len(held) else []
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "chunk": [], "score": []})

    return score


def best(scores: DataFrame, k: int, chunk: str = "chunk_id") -> DataFrame:
    ranked = top_k(scores, ["query_id"], [F.round("score", SCORE_DECIMALS).desc(), F.col(chunk).asc()], k)
    return ranked.select("query_id", "rank", chunk, "score")


def search(queries: DataFrame, index: Index, asked: DataFrame, k: int) -> DataFrame:
    """Chunks scoring above zero, best first: the same rows as a full scan.

    A cell is some groups of questions and some blocks; it emits ``k`` rows per question. A block's bound for a question is the sum of its words'
    weights times their highest gains there: questions whose kth score in the cell is higher leave the block out. Neither pairs of questions and
    blocks nor their words are rows of a join."""
    filters = filters_of(queries)
    n = F.lit(float(index.size))
    weights = asked.join(index.vocabulary, "term").join(index.frequencies, "word").withColumn(
        "weight", F.col("times") * F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0))
    own = [F.first(f).alias(f) if f in filters else F.first(F.lit(None).cast(kind)).alias(f) for f, kind in zip(FILTERS, ("string", "bigint"), strict=True)]
    questions = cut_lineage(weights.groupBy("query_id").agg(*own, F.collect_list("word").alias("words"), F.collect_list("weight").alias("weights")))
    n_groups, n_blocks = (max(1, -(-df.count() // size)) for df, size in ((questions, GROUP_QUESTIONS), (index.blocks, 1)))
    wanted = 2 * queries.sparkSession.sparkContext.defaultParallelism
    per_cell = min(max(n_blocks // wanted, 1), CELL_BLOCKS)
    columns, rows = -(-n_blocks // per_cell), -(-n_groups // CELL_GROUPS)

    def spread(name: str, most: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias(name)

    member = F.struct("query_id", *FILTERS, "words", "weights")
    groups = questions.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(n_groups)).alias("group")).agg(F.collect_list(member).alias("m")).select(
        (F.col("group") % rows).cast("int").alias("row"), spread("column", columns), F.col("m.query_id").alias("ids"), F.col("m.category").alias("categories"),
        F.col("m.place_id").alias("places"), F.col("m.words").alias("words"), F.col("m.weights").alias("weights"))
    blocks = index.blocks.select(spread("row", rows), F.pmod(F.xxhash64("block"), F.lit(columns)).cast("int").alias("column"), "category", "terms", "chunks", "places", "gains")
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk long, score double"
    scored = groups.groupBy("row", "column").cogroup(blocks.groupBy("row", "column")).applyInPandas(_cell_scores(k), schema)
    return best(scored, k, "chunk").join(index.names, "chunk").select("query_id", "rank", "chunk_id", "score")
