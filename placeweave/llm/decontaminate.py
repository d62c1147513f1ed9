"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted similarity.

Words are lower-cased runs of letters, digits and non-ASCII bytes. Every item is a weighted multiset of its five-word
shingles (an item below five words is one shingle of its own length); a shingle weighs ``ln(1 + items / items with it)``,
one that no item has weighs as if one item had it. Per document, for whole texts:

1. For every length that items have, the windows of that many words (or the whole text, when that is shorter) are looked at. A
   window reaches the threshold only if its shingles that any item has weigh ``THRESHOLD`` of the lightest item of that
   length; all others are out without loss. No item is known yet.
2. Each such window gets a 64-bit SimHash of its weighted shingles, and the index names its candidates: item fingerprints are
   kept under five blocks of 13 or 12 bits, and a window asks for all block values within ``RADIUS // 5`` bits of its own (378
   of 8,192). By the pigeonhole principle every item within ``RADIUS`` bits is found; a block value leads to about a
   twentieth of the items.
3. The weighted Jaccard similarity of window and candidate decides, computed exactly; the best window of a (document, item)
   pair is reported, the first on ties.

A fingerprint is a sample of 64 directions: a window at similarity 0.8 differs in about 10 bits, and in more than ``RADIUS`` with a
probability of about one in two thousand; at 0.9 it is one in ten million. README gives the recall measured against all pairs.

The items are broadcast in blocks of about ``BLOCK_BYTES`` of text; a larger benchmark takes more blocks, each one scan. The
weights are those of the whole benchmark in every block: each gets the number of all items and the counts of all shingles
that several items have, wherever these are (12 to 16 bytes a shingle; one that a single item has weighs like one that none has).

Defined results: null or wordless texts and items match nothing; repeated rows are each reported; several equal items are
each reported; an empty table on either side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.llm import words as W

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 19
#: Bits of the blocks of a fingerprint.
BLOCK_BITS = (13, 13, 13, 13, 12)
BLOCK_BYTES = 16 << 20
FILTER_BITS = 22
WINDOWS_AT_ONCE = 1024
_EPS = 1e-9
#: Everything ASCII but letters and digits separates words.
_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[:128] = True
for _range in (range(48, 58), range(65, 91), range(97, 123)):
    _SEPARATORS[list(_range)] = False


def _word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = W.split(data, at, _SEPARATORS)
    return found.hashes(), found.first


def _lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)


def _shingles(hashes: np.ndarray, first: np.ndarray, items: np.ndarray) -> list[np.ndarray]:
    return [W.windows(hashes[first[i]:first[i + 1]], min(int(first[i + 1] - first[i]), SHINGLE)) for i in items]


class ItemIndex:
    """All items of one block: shingles with weights, item multisets, fingerprints and their block tables. ``among`` is for a
    benchmark of several blocks: number of all items, shingles that several items have (sorted), how many have each."""

    def __init__(self, ids: list, texts: list[str], among: tuple[int, np.ndarray, np.ndarray] | None = None) -> None:
        data, at = W.utf8(_lower(pa.array(texts, pa.string())))
        hashes, first = _word_hashes(data, at)
        n_words = np.diff(first)
        kept = np.flatnonzero(n_words)
        self.ids = [ids[i] for i in kept]
        self.words = n_words[kept]
        self.size = np.minimum(self.words, SHINGLE)
        shingles = _shingles(hashes, first, kept)
        values = np.concatenate([*shingles, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(kept)), [len(s) for s in shingles]).astype(np.int64)
        n_items, repeated, holders = among or (len(kept), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.values = np.union1d(values, repeated)
        code = np.searchsorted(self.values, values)
        cell, self.count = np.unique(code * len(kept) + owner, return_counts=True)
        self.code, self.item = np.divmod(cell, max(len(kept), 1))
        spread = np.bincount(self.code, minlength=len(self.values))
        everywhere = spread.copy()
        everywhere[np.searchsorted(self.values, repeated)] = holders
        self.rare = float(np.log1p(n_items))
        self.weight = np.log1p(n_items / np.maximum(everywhere, 1))
        #: ``entry[c]:entry[c + 1]`` are the (item, count) cells of shingle c.
        self.entry = np.concatenate([[0], np.cumsum(spread)])
        self.total = np.bincount(self.item, self.count * self.weight[self.code], len(kept))
        self.cell_key = self.code * max(len(kept), 1) + self.item
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self._slot(self.values)] = True
        self.fps = np.zeros(len(kept), np.uint64)
        if len(kept):
            votes = np.zeros((len(kept), 64))
            np.add.at(votes, self.item, _signs(self.values[self.code]) * (self.count * self.weight[self.code])[:, None])
            self.fps = _pack(votes)
        #: Item lengths with the lightest item of each, and that of all items longer than a number of words.
        self.lengths, place = np.unique(self.words, return_inverse=True)
        self.lightest = np.full(len(self.lengths), np.inf)
        np.minimum.at(self.lightest, place, self.total)
        self.lightest_from = np.minimum.accumulate(self.lightest[::-1])[::-1]
        self.blocks = [self._block(b) for b in range(len(BLOCK_BITS))]

    @staticmethod
    def _slot(values: np.ndarray) -> np.ndarray:
        return (values >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    @staticmethod
    def _block_values(fps: np.ndarray, b: int) -> np.ndarray:
        return ((fps >> np.uint64(sum(BLOCK_BITS[:b]))) & np.uint64((1 << BLOCK_BITS[b]) - 1)).astype(np.int64)

    def _block(self, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start of each block value's items, items by value, masks of the bits that may differ)."""
        own = self._block_values(self.fps, b)
        order = np.argsort(own, kind="stable")
        every = np.arange(1 << BLOCK_BITS[b])
        return np.searchsorted(own[order], np.arange((1 << BLOCK_BITS[b]) + 1)), order, every[np.bitwise_count(every) <= RADIUS // len(BLOCK_BITS)]

    def lookup(self, codes: np.ndarray) -> np.ndarray:
        """Index of each shingle among the items' shingles, -1 for none."""
        out = np.full(len(codes), -1)
        if len(self.values):
            maybe = np.flatnonzero(self.filter[self._slot(codes)])
            place = np.minimum(np.searchsorted(self.values, codes[maybe]), len(self.values) - 1)
            sure = self.values[place] == codes[maybe]
            out[maybe[sure]] = place[sure]
        return out

    def within_radius(self, fps: np.ndarray, words: int, longer: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs whose fingerprints differ in ``RADIUS`` bits at most; items of ``words`` words, or all ``longer`` ones."""
        fits = self.words > words if longer else self.words == words
        pairs = []
        for b, (start, items, masks) in enumerate(self.blocks):
            value = (self._block_values(fps, b)[:, None] ^ masks).ravel()
            n = start[value + 1] - start[value]
            held = np.flatnonzero(n)
            value, n = value[held], n[held]
            window = np.repeat(held // len(masks), n)
            item = items[np.arange(int(n.sum())) + np.repeat(start[value] - (np.cumsum(n) - n), n)]
            near = fits[item] & (np.bitwise_count(fps[window] ^ self.fps[item]) <= RADIUS)
            pairs.append(window[near] * len(self.ids) + item[near])
        return np.divmod(np.unique(np.concatenate(pairs)), max(len(self.ids), 1))


def _signs(values: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.float32) * 2 - 1


def _pack(votes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.packbits(votes > 0, axis=1, bitorder="little")).view(np.uint64).ravel()


def _matches(index: ItemIndex, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
    """(text, item, similarity, first word, words) of the best window of each contaminated pair."""
    for size in np.unique(index.size).tolist():
        begin = W.inside_one(first, size)
        if not len(begin):
            continue
        shingle = W.windows(hashes, size)
        code = index.lookup(shingle[begin])
        of_size = np.flatnonzero(np.minimum(index.lengths, SHINGLE) == size)
        known = np.where(code >= 0, index.weight[code], 0.0)
        doc = np.searchsorted(first, begin, "right") - 1
        # Texts that hold too little of any item are out before windows are thought of.
        kept = np.flatnonzero((np.bincount(doc, known, len(first) - 1) >= THRESHOLD * index.lightest[of_size].min() - _EPS)[doc])
        if len(kept):
            texts = _Texts(shingle[begin[kept]], code[kept], known[kept], doc[kept], size)
            for (d, item), found in sorted(_best_windows(index, texts, of_size).items()):
                yield d, item, *found


class _Texts:
    """The shingles of some texts one after the other, their places in the index, the text of each and where it ends, and the sum of what the
    shingles before weigh."""

    def __init__(self, shingles: np.ndarray, codes: np.ndarray, known: np.ndarray, doc: np.ndarray, size: int) -> None:
        self.shingles, self.codes, self.doc, self.size = shingles, codes, doc, size
        self.head, self.stop = np.searchsorted(doc, doc, "left"), np.searchsorted(doc, doc, "right")
        self.before = np.concatenate([[0.0], np.cumsum(known)])


Best = dict[tuple[int, int], tuple[float, int, int]]


def _best_windows(index: ItemIndex, texts: _Texts, of_size: np.ndarray) -> Best:
    """(similarity, first word, words) of the best window for each (text, item) that has one."""
    best: Best = {}
    every = np.arange(len(texts.shingles))
    heads = np.unique(texts.head)
    words = texts.stop[heads] - heads + texts.size - 1
    for n in of_size.tolist():
        span = int(index.lengths[n]) - texts.size + 1
        if span > len(texts.shingles):
            break
        sums = texts.before[span:] - texts.before[:len(texts.before) - span]
        near = sums >= THRESHOLD * index.lightest[n] - _EPS
        starts = np.flatnonzero(near & (every[:len(sums)] + span <= texts.stop[:len(sums)]))
        _compare(index, texts, starts, span, False, best)
    for w in np.unique(words[words < index.lengths[of_size[-1]]]).tolist():  # whole texts shorter than items
        starts = heads[words == w]
        span = w - texts.size + 1
        least = THRESHOLD * index.lightest_from[np.searchsorted(index.lengths, w, "right")] - _EPS
        _compare(index, texts, starts[texts.before[starts + span] - texts.before[starts] >= least], span, True, best)
    return best


def _compare(index: ItemIndex, texts: _Texts, every: np.ndarray, span: int, longer: bool, best: Best) -> None:
    """The candidates that the index names for some windows, measured exactly. Windows are in order, so the first stays on ties."""
    words = span + texts.size - 1
    for p in range(0, len(every), WINDOWS_AT_ONCE):
        starts = every[p:p + WINDOWS_AT_ONCE]
        inside = texts.shingles[starts[:, None] + np.arange(span)]
        codes = texts.codes[starts[:, None] + np.arange(span)]
        weights = np.where(codes >= 0, index.weight[codes], index.rare)
        votes = np.zeros((len(starts), 64))
        for column in range(span):
            votes += _signs(inside[:, column]) * weights[:, column, None]
        for w, item in zip(*index.within_radius(_pack(votes), words, longer), strict=True):
            similarity, pair = _similarity(index, int(item), inside[w], codes[w], weights[w]), (int(texts.doc[starts[w]]), int(item))
            if similarity >= THRESHOLD - _EPS and (pair not in best or similarity > best[pair][0] + _EPS):
                best[pair] = (similarity, int(starts[w] - texts.head[starts[w]]), words)


def _similarity(index: ItemIndex, item: int, values: np.ndarray, codes: np.ndarray, weights: np.ndarray) -> float:
    """Weighted multiset Jaccard of a window and an item."""
    own, head, count = np.unique(values, return_index=True, return_counts=True)
    code, weight = codes[head], weights[head]
    wanted = code * len(index.ids) + item
    cell = np.minimum(np.searchsorted(index.cell_key, wanted), len(index.cell_key) - 1)
    held = np.where((code >= 0) & (index.cell_key[cell] == wanted), index.count[cell], 0)
    both = float((np.minimum(held, count) * weight).sum())
    return both / (float((count * weight).sum()) + float(index.total[item]) - both)


def _item_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct shingles of each item that has words, and a null for the item."""
    for batch in batches:
        for _, data, at in W.slices(_lower(batch.column(0))):
            hashes, first = _word_hashes(data, at)
            kept = np.flatnonzero(np.diff(first))
            found = np.concatenate([*map(np.unique, _shingles(hashes, first, kept)), np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(found), pa.nulls(len(kept), pa.int64())])], names=["shingle"])


def _among(items: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    counts = items.select("text").mapInArrow(_item_shingles, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    n_items = counts.filter("shingle IS NULL").first()
    table = counts.filter("shingle IS NOT NULL AND n > 1").toArrow()
    values, n = (table.column(c).to_numpy() for c in ("shingle", "n"))
    values = values.astype(np.int64).view(np.uint64)
    order = np.argsort(values)
    return (n_items["n"] if n_items else 0), values[order], n[order]


def _item_blocks(benchmark: DataFrame) -> Iterator[ItemIndex]:
    items = benchmark.filter("text IS NOT NULL").select("item_id", "text")
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    among = _among(items) if blocks > 1 else None
    for b in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = part.orderBy("item_id", "text").collect()
        yield ItemIndex([r["item_id"] for r in rows], [r["text"] for r in rows], among)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, similarity, start_word, n_words``: each document's best window for each item it holds."""
    spark = docs.sparkSession
    item_field = benchmark.schema["item_id"]
    schema = docs.select("doc_id").schema.add(item_field.name, item_field.dataType).add("similarity", "double").add(
        "start_word", "long").add("n_words", "long")

    def scan_with(shared):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                rows = [(row + d, index.ids[i], *found) for row, data, at in W.slices(_lower(batch.column(1)))
                        for d, i, *found in _matches(index, *_word_hashes(data, at))]
                if rows:
                    row, item, similarity, start, n = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row)), pa.array(item), pa.array(similarity, pa.float64()),
                         pa.array(start, pa.int64()), pa.array(n, pa.int64())], names=schema.names)
        return scan

    texts = docs.select("doc_id", "text")
    parts = [texts.mapInArrow(scan_with(spark.sparkContext.broadcast(index)), schema) for index in _item_blocks(benchmark)]
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold no benchmark item, columns unchanged. Batches are filtered in place, no join moves texts."""
    spark, at = docs.sparkSession, docs.columns.index("text")

    def drop_with(shared):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for row, data, bounds in W.slices(_lower(batch.column(at))):
                    clean[[row + m[0] for m in _matches(shared.value, *_word_hashes(data, bounds))]] = False
                yield batch.filter(pa.array(clean))
        return scan

    for index in _item_blocks(benchmark):
        docs = docs.mapInArrow(drop_with(spark.sparkContext.broadcast(index)), docs.schema)
    return docs
