"""Batch retrieval: many queries against one chunk corpus, ranked rows out.

queries: ``query_id, query`` and optionally ``category``, ``place_id`` (NULL = no filter), ``embedding``.
corpus:  ``chunk_id, place_id, place_name, category, content, source_url`` and optionally
``embedding, embedding_model``.
results: ``query_id, rank, chunk_id, score``."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.functions import text as X
from placeweave.operators import postings as P
from placeweave.operators.scale import dense_index, top_k
from placeweave.session import cut_lineage

# Categories that are context rather than destinations, fusion constants.
NON_DESTINATIONS = ("boi_canh", "ha_tang", "don_vi_hanh_chinh")
RRF_K = 60
HYBRID_DEPTH = 50
# Vectors packed into one row for exact search.
QUERY_BLOCK = 256
CHUNK_BLOCK = 4096
#: Blocks of a side in a cell at most.
MOST_GROUPED = 32


def corpus(chunks: DataFrame, places: DataFrame, exclude: Sequence[str] = NON_DESTINATIONS) -> DataFrame:
    """Chunks with their place's name and category, minus excluded categories."""
    kept = places.filter(~F.col("category").isin(*exclude)) if exclude else places
    return chunks.join(kept.select("place_id", F.col("name").alias("place_name"), "category"), "place_id")


def _asked(queries: DataFrame) -> DataFrame:
    """Queries that say something; an empty category is no filter."""
    if "query" in queries.columns:
        queries = queries.filter(X.strip(F.col("query")) != "")
    if "category" in queries.columns:
        queries = queries.withColumn("category", F.nullif("category", F.lit("")))
    return queries


def bm25_search(queries: DataFrame, corpus_df: DataFrame, k: int = 5, analyzer: str = "plain",
                k1: float = P.BM25_K1, b: float = P.BM25_B, words: DataFrame | None = None) -> DataFrame:
    """Chunks scoring above zero, best first. ``words`` are those of the corpus, where they are known already (see ``postings.analysed``)."""
    queries = _asked(queries)
    asked = cut_lineage(P.query_terms(queries, analyzer))
    index = P.build_index(P.analysed(corpus_df) if words is None else words, analyzer, asked, k1, b)
    return P.search(queries, index, asked, k)


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms > 0, norms, 1.0)


class _Asked:
    """A block of queries and the best chunks each has met so far: (-similarity, chunk id), ties to the smaller id."""

    def __init__(self, ids: Sequence, vectors: Sequence[float], filters: dict[str, list]) -> None:
        self.ids, self.filters = list(ids), filters
        self.vectors = _unit_rows(np.asarray(vectors, np.float64).reshape(len(self.ids), -1))
        self.best: list[list[tuple]] = [[] for _ in self.ids]

    def meet(self, ids: np.ndarray, vectors: np.ndarray, values: dict[str, np.ndarray], k: int, floor: float) -> None:
        similarity = np.round(self.vectors @ vectors.T, P.SCORE_DECIMALS)
        for n, held in enumerate(self.best):
            allowed = similarity[n] >= (max(floor, -held[-1][0]) if len(held) == k else floor)
            for f, asked in self.filters.items():
                if asked[n] is not None:
                    allowed &= values[f] == asked[n]
            at = np.flatnonzero(allowed)
            if len(at) > k:  # all that tie with the kth
                at = at[similarity[n, at] >= np.partition(similarity[n, at], -k)[-k]]
            self.best[n] = sorted([*held, *zip((-similarity[n, at]).tolist(), ids[at].tolist(), strict=True)])[:k]

    def found(self) -> pd.DataFrame:
        rows = [(query, chunk, -minus) for query, held in zip(self.ids, self.best, strict=True) for minus, chunk in held]
        return pd.DataFrame(rows, columns=["query_id", "chunk_id", "score"])


def dense_search(queries: DataFrame, chunks: DataFrame, k: int = 5, model: str | None = None,
                 min_similarity: float = -1.0, dim: int | None = None) -> DataFrame:
    """Exact cosine search. Chunks of another model or without a vector are ignored, blank queries and
    queries without a vector return nothing, and filters apply before the top-k.

    Both sides are packed into blocks of a bounded number of vectors. A cell of the grid is a group of query blocks, which are held, and a group of
    chunk blocks, which stream by; each block is sent to one cell per group of the other side, and a cell emits ``k`` rows per query. Groups
    grow with the work, so that there are enough cells for the cores and no more copies than that needs. The driver sees two counts."""
    queries = _asked(queries)
    filters = P.filters_of(queries)
    usable = chunks.filter(F.col("embedding").isNotNull())
    asked = queries.filter(F.col("embedding").isNotNull())
    if model is not None:
        usable = usable.filter(F.col("embedding_model") == model)
    if dim is not None:
        def checked(c: str) -> Column:
            return F.when(F.size(c) == dim, F.col(c)).otherwise(
                F.raise_error(F.lit(f"expected vectors of {dim} dimensions")).cast("array<double>"))
        usable, asked = usable.withColumn("embedding", checked("embedding")), asked.withColumn(
            "embedding", checked("embedding").cast("array<double>"))

    def packed(df: DataFrame, key: str, size: int) -> tuple[DataFrame, int]:
        blocks = max(1, -(-df.count() // size))
        row = F.struct(F.col(key).alias("id"), *filters, F.col("embedding").cast("array<double>").alias("vector"))
        gathered = df.groupBy(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block")).agg(F.collect_list(row).alias("r"))
        return gathered.select("block", F.col("r.id").alias("ids"), F.flatten("r.vector").alias("vectors"), *[F.col(f"r.{f}").alias(f) for f in filters]), blocks

    (asked_blocks, n_asked), (held_blocks, n_held) = packed(asked, "query_id", QUERY_BLOCK), packed(usable, "chunk_id", CHUNK_BLOCK)
    cells = 4 * queries.sparkSession.sparkContext.defaultParallelism
    group = int(min(max((n_asked * n_held / cells) ** 0.5, 1), MOST_GROUPED))

    def dealt(blocks: DataFrame, side: int, others: int) -> DataFrame:
        own = F.floor(F.col("block") / group)
        other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit((others - 1) // group).cast("bigint")))
        cell = F.concat_ws(":", "_own", "_other") if side == 0 else F.concat_ws(":", "_other", "_own")
        return blocks.withColumns({"_own": own, "_other": other}).withColumns({"cell": cell, "side": F.lit(side)}).drop("_own", "_other")

    # Both sides have one shape; ids of either kind stay what they are.
    def shaped(blocks: DataFrame, names: tuple[str, str]) -> DataFrame:
        mine, theirs = names
        other = queries.schema["query_id"] if mine == "chunk_ids" else chunks.schema["chunk_id"]
        empty = F.lit(None).cast(f"array<{other.dataType.simpleString()}>")
        return blocks.withColumnRenamed("ids", mine).withColumn(theirs, empty).select("cell", "side", "block", "query_ids", "chunk_ids", "vectors", *filters)

    grid = shaped(dealt(asked_blocks, 0, n_held), ("query_ids", "chunk_ids")).unionByName(
        shaped(dealt(held_blocks, 1, n_asked), ("chunk_ids", "query_ids"))).repartition("cell").sortWithinPartitions("cell", "side", "block")

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, held = None, []
        for frame in frames:
            for row in frame.itertuples(index=False):
                if row.cell != cell:
                    yield from (block.found() for block in held)
                    cell, held = row.cell, []
                if row.side == 0:
                    held.append(_Asked(row.query_ids, row.vectors, {f: list(getattr(row, f)) for f in filters}))
                    continue
                ids = np.array(list(row.chunk_ids), object)
                vectors = _unit_rows(np.asarray(row.vectors, np.float64).reshape(len(ids), -1))
                values = {f: np.array(list(getattr(row, f)), object) for f in filters}
                for block in held:
                    block.meet(ids, vectors, values, k, min_similarity)
        yield from (block.found() for block in held)

    shape = ", ".join(f"{name} {df.schema[name].dataType.simpleString()}" for df, name in ((queries, "query_id"), (chunks, "chunk_id")))
    return P.best(grid.mapInPandas(score, f"{shape}, score double"), k)


def rrf(rankings: Sequence[DataFrame], k: int, c: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked results; ties go to the smaller chunk id."""
    votes = None
    for ranking in rankings:
        part = ranking.select("query_id", "chunk_id", (1.0 / (c + F.col("rank"))).alias("vote"))
        votes = part if votes is None else votes.unionByName(part)
    return P.best(votes.groupBy("query_id", "chunk_id").agg(F.sum("vote").alias("score")), k)


def hybrid_search(queries: DataFrame, chunks: DataFrame, k: int = 5, model: str | None = None,
                  analyzer: str = "multi", depth: int = HYBRID_DEPTH, c: int = RRF_K, words: DataFrame | None = None) -> DataFrame:
    asked = queries.filter(X.strip(F.col("query")) != "")
    deep = max(depth, k)
    return rrf([dense_search(asked, chunks, deep, model), bm25_search(asked, chunks, deep, analyzer, words=words)], k, c)


def random_search(queries: DataFrame, chunks: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """``k`` distinct chunks per query without looking at the text: the floor any retriever must beat.

    Each query draws ``k`` positions (Floyd's sampling) and joins them to the numbered pool, so the
    work grows with queries x k plus one numbering of the chunks, not with their product."""
    pools = dense_index(chunks.select("chunk_id").withColumn("pool", F.lit("")), ["pool"], "chunk_id", "position")
    asked = queries.select("query_id", F.lit("").alias("pool"))
    if "category" in queries.columns:
        by_category = dense_index(chunks.select("chunk_id", F.col("category").alias("pool")),
                                  ["pool"], "chunk_id", "position")
        pools = pools.unionByName(by_category)
        asked = queries.select("query_id", F.coalesce("category", F.lit("")).alias("pool"))
    sizes = pools.groupBy("pool").agg(F.count(F.lit(1)).alias("size"))

    def draw(tag: Column) -> Column:
        text = F.concat(F.lit(f"{seed}:"), F.col("query_id").cast("string"), F.lit(":"), tag.cast("string"))
        return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")

    def floyd(chosen: Column, j: Column) -> Column:
        pick = draw(j) % (j + 1)
        return F.concat(chosen, F.array(F.when(F.array_contains(chosen, pick), j).otherwise(pick)))

    wanted = F.least(F.lit(k).cast("bigint"), F.col("size"))
    picks = F.aggregate(F.sequence(F.col("size") - wanted, F.col("size") - 1),
                        F.array().cast("array<bigint>"), floyd)
    drawn = asked.join(sizes, "pool").select("query_id", "pool", F.explode(picks).alias("position"))
    found = drawn.join(pools, ["pool", "position"]).withColumn("_order", draw(F.col("chunk_id")))
    ranked = top_k(found, ["query_id"], [F.col("_order"), F.col("chunk_id")], k)
    return ranked.select("query_id", "rank", "chunk_id", F.lit(0.0).alias("score"))


# -- embedding maintenance ---------------------------------------------------------------------

def needs_embedding(chunks: DataFrame, model: str, force: bool = False) -> DataFrame:
    stale = F.col("embedding").isNull() | ~F.col("embedding_model").eqNullSafe(F.lit(model))
    return chunks if force else chunks.filter(stale)


def length_batches(df: DataFrame, column: str, key: str) -> DataFrame:
    """Neighbours of similar length share a partition, so model batches carry little padding."""
    length = F.length(column)
    return df.repartitionByRange(length, F.col(key)).sortWithinPartitions(length, F.col(key))


def refresh_embeddings(chunks: DataFrame, model: str, embed: Callable[[Column], Column] | None = None,
                       embed_batches: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] | None = None,
                       force: bool = False) -> DataFrame:
    """All chunks, with a vector of ``model`` for those that lacked one; a rerun touches nothing.

    ``embed`` maps a text column to a vector column; ``embed_batches`` is the ``mapInPandas`` form
    for an external model (rows ``chunk_id, text`` in, ``chunk_id, embedding`` out)."""
    todo = needs_embedding(chunks, model, force)
    text = X.embedding_text(F.col("place_name"), F.col("content"))
    vector_type = chunks.schema["embedding"].dataType.simpleString()
    if embed_batches is None:
        fresh = todo.withColumn("embedding", embed(text).cast(vector_type))
        fresh = fresh.withColumn("embedding_model", F.lit(model))
    else:
        batches = length_batches(todo.select("chunk_id", text.alias("text")), "text", "chunk_id")
        vectors = batches.mapInPandas(embed_batches, f"chunk_id bigint, embedding {vector_type}")
        fresh = (todo.drop("embedding").join(vectors, "chunk_id")
                 .withColumn("embedding_model", F.lit(model)).select(*chunks.columns))
    if force:
        return fresh
    done = chunks.filter(F.col("embedding").isNotNull() & F.col("embedding_model").eqNullSafe(F.lit(model)))
    return done.unionByName(fresh)


def index_status(chunks: DataFrame, model: str) -> DataFrame:
    """Total chunks and chunks embedded by the current model."""
    current = F.col("embedding").isNotNull() & F.col("embedding_model").eqNullSafe(F.lit(model))
    return chunks.agg(F.count(F.lit(1)).alias("total"), F.count_if(current).alias("embedded"))


def model_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("embedding_model").agg(F.count(F.lit(1)).alias("chunks"))


# -- presenting results ------------------------------------------------------------------------

def rerank_named(results: DataFrame, named: DataFrame, k: int = 5, max_chars: int = 900) -> DataFrame:
    """Drops header-like chunks (unless nothing else is left), moves chunks of the places a query
    names to the front, keeps ``k``. ``results`` carry ``content, place_id, rank``."""
    from pyspark.sql import Window
    body = (F.length("content") >= 80) & ~F.ltrim("content").startswith("==")
    flagged = results.withColumn("_body", body).withColumn(
        "_any", F.max("_body").over(Window.partitionBy("query_id")))
    marks = named.select("query_id", "place_id").distinct().withColumn("_named", F.lit(True))
    kept = flagged.filter(F.col("_body") | ~F.col("_any")).join(marks, ["query_id", "place_id"], "left")
    best = top_k(kept, ["query_id"], [F.coalesce("_named", F.lit(False)).desc(), F.col("rank")], k, "ref")
    return best.select(
        "query_id", "ref", "chunk_id", "place_id", "place_name", F.substring("content", 1, max_chars).alias("content"),
        "source_url")


# Wording of the assembled context.
CONTEXT_EMPTY = "Không tìm thấy thông tin tri thức phù hợp trong CSDL."
CONTEXT_HEAD = "--- TRI THỨC ĐỊA DANH HUẾ (RAG CONTEXT) ---"
CONTEXT_TAIL = "-------------------------------------------"


def build_context(queries: DataFrame, results: DataFrame) -> DataFrame:
    """One prompt-ready text per query from its ranked chunks."""
    source = F.when(F.coalesce("source_url", F.lit("")) != "", F.concat(F.lit("\nNguồn: "), "source_url"))
    block = F.concat(F.lit("\n["), F.col("rank").cast("string"), F.lit("] Địa danh: "), "place_name", F.lit(" ("),
                     "category", F.lit(")\nNội dung: "), "content", F.coalesce(source, F.lit("")))
    blocks = results.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", block.alias("text")))).alias("_blocks"))
    text = F.array_join(F.concat(F.array(F.lit(CONTEXT_HEAD)), F.transform("_blocks", lambda r: r["text"]),
                                 F.array(F.lit(CONTEXT_TAIL))), "\n")
    return queries.select("query_id").join(blocks, "query_id", "left").select(
        "query_id", F.when(F.col("_blocks").isNull(), F.lit(CONTEXT_EMPTY)).otherwise(text).alias("context"))


def extractive_answers(results: DataFrame, sentences: int = 3, sources: int = 3) -> DataFrame:
    """Answer without a model: best sentences of the first chunk and its distinct sources.
    ``results`` carry ``query, rank, place_name, content, source_url``."""
    first = results.filter(F.col("rank") == 1).select(
        "query_id", F.concat(F.lit("**"), "place_name", F.lit("**: "),
                             X.snippet(F.col("query"), F.col("content"), F.col("place_name"), sentences)).alias("answer"))
    cited = (
        results.filter((F.col("rank") <= sources) & (F.coalesce("source_url", F.lit("")) != ""))
        .groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source_url"))).alias("_s"))
        .select("query_id", F.array_distinct(F.transform("_s", lambda s: s["source_url"])).alias("sources"))
    )
    return first.join(cited, "query_id", "left")
