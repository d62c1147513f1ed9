"""Substring deduplication: words covered by a 35-word window that starts somewhere else too are removed.

1. Prefilter. Every window has an anchor, the leftmost of its 12-word runs with the smallest hash. Equal windows have equal
   anchors at different places, so the number of places of an anchor is never below the number of its windows. Each
   partition counts its anchors' places in a count-min sketch (two rows, counters that stop at two); the partition
   sketches are merged by block, and the cells that reached two are sent back. A window is estimated repeated when its
   anchor's cells reached two in both rows: overestimates occur, underestimates cannot.
2. Exact pass. Only windows estimated repeated are grouped, by 96 bits of two independent hashes of their word sequence (10^12 such
   windows meet falsely with a chance of 10^-5). A
   partition first counts its own, chunk by chunk, and sends one row per chunk and window, so a passage that fills a third
   of the corpus meets in few rows. Further places of a window in its chunk are settled there: they travel as runs of
   consecutive starts, one row a run.
3. Removal. Starts of repeated windows go back to their document as intervals of covered words; the kept words are joined and
   hashed.

The sketch's width follows the input's bytes up to ``MOST_CELLS``, a fixed bound of 128 MB for what is sent to tasks; beyond
it more windows pass the prefilter and the result stays the same.

Defined results: null and blank texts have no words and the digest of nothing; texts below 35 words lose nothing; repeated
rows count as other places; rows without an id are told apart by their text; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeweave.llm import words as W
from placeweave.session import cut_lineage

WINDOW = 35
ANCHOR = 12
SKETCH_ROWS = 2
BLOCK_BITS = 20
LEAST_BITS = 20
MOST_CELLS = 1 << 29
BYTES_PER_WORD = 6
CELLS_PER_ANCHOR = 4
CHUNK_WINDOWS = 3 << 18
MERGED_AT_ONCE = 256
_OTHER_BASE = np.uint64(0xC2B2AE3D27D4EB4F)


def _first_least(values: np.ndarray, span: int) -> np.ndarray:
    """Position of the leftmost minimum of each run of ``span`` values."""
    at, size = np.arange(len(values)), 1
    while 2 * size <= span:
        left, right = at[:-size], at[size:]
        at = np.where(values[left] <= values[right], left, right)
        size *= 2
    rest = span - size
    left, right = at[:len(at) - rest], at[rest:]
    return np.where(values[left] <= values[right], left, right)


def _anchors(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, anchor place of each window, hash of the run at every place)."""
    starts = W.inside_one(first, WINDOW)
    runs = W.windows(hashes, ANCHOR)
    if not len(starts):
        return starts, starts, runs
    return starts, _first_least(runs, WINDOW - ANCHOR + 1)[starts], runs


def _cells(anchors: np.ndarray, row: int, bits: int) -> np.ndarray:
    """Cell of each anchor in one row of the sketch."""
    return (W.mix(anchors ^ W.mix(np.full(1, row + 1, np.uint64))) >> np.uint64(64 - bits)).astype(np.int64)


def _bits_for(text_bytes: int) -> int:
    anchors = text_bytes / BYTES_PER_WORD * 2 / (WINDOW - ANCHOR + 2)
    cells = min(max(anchors * CELLS_PER_ANCHOR, 1), MOST_CELLS)
    return max(LEAST_BITS, int(np.ceil(np.log2(cells))))


def repeated_cells(docs: DataFrame, bits: int) -> list[np.ndarray]:
    """For each sketch row the packed bits of the cells that reached two over the whole corpus."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId() // MERGED_AT_ONCE if context else 0
        once = [[np.zeros(0, np.uint32)] for _ in range(SKETCH_ROWS)]
        for batch in batches:
            for _, data, at in W.slices(batch.column(0)):
                found = W.split(data, at)
                _, anchor, runs = _anchors(found.hashes(), found.first)
                places = runs[np.unique(anchor)]
                for r in range(SKETCH_ROWS):
                    once[r].append(_cells(places, r, bits).astype(np.uint32))
        for r in range(SKETCH_ROWS):
            cells, times = np.unique(np.concatenate(once[r]), return_counts=True)
            yield _sketch_rows(cells, times, r, part, bits)

    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        seen, twice = (np.zeros(1 << BLOCK_BITS, bool) for _ in range(2))
        for one, more in zip(frame["seen"], frame["twice"], strict=True):
            one, more = np.frombuffer(one, "<u4"), np.frombuffer(more, "<u4")
            twice[one[seen[one]]] = True
            seen[one] = True
            twice[more] = True
            seen[more] = True
        once = np.flatnonzero(seen & ~twice).astype("<u4").tobytes()
        return pd.DataFrame({"block": [int(key[0])], "seen": [once], "twice": [np.flatnonzero(twice).astype("<u4").tobytes()]})

    shape = "block long, part int, seen binary, twice binary"
    partial = docs.select("text").mapInArrow(count, shape)
    by_part = partial.groupBy("block", "part").applyInPandas(merge, "block long, seen binary, twice binary")
    merged = by_part.groupBy("block").applyInPandas(merge, "block long, seen binary, twice binary")
    packed = merged.filter(F.length("twice") > 0).select("block", "twice").toLocalIterator()
    out = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(SKETCH_ROWS)]
    for row in packed:
        r, block = divmod(row["block"], 1 << (bits - BLOCK_BITS))
        cell = np.frombuffer(row["twice"], "<u4").astype(np.int64) + (block << BLOCK_BITS)
        np.bitwise_or.at(out[r], cell >> 3, (1 << (cell & 7)).astype(np.uint8))
    return out


def _sketch_rows(cells: np.ndarray, times: np.ndarray, row: int, part: int, bits: int) -> pa.RecordBatch:
    block = cells >> np.uint32(BLOCK_BITS)
    bounds = np.searchsorted(block, np.arange((1 << (bits - BLOCK_BITS)) + 1))
    inside = (cells & np.uint32((1 << BLOCK_BITS) - 1)).astype("<u4")
    names, seen, twice = [], [], []
    for b in np.unique(block).tolist():
        own, n = inside[bounds[b]:bounds[b + 1]], times[bounds[b]:bounds[b + 1]]
        names.append((row << (bits - BLOCK_BITS)) + b)
        seen.append(own[n == 1].tobytes())
        twice.append(own[n > 1].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([part] * len(names), pa.int32()),
                                       pa.array(seen, pa.binary()), pa.array(twice, pa.binary())], names=["block", "part", "seen", "twice"])


def repeated_windows(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, start, run`` of all windows whose words also start elsewhere: ``run`` of them begin at ``start`` and the words after
    it; ``mark`` tells texts of one id apart."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = _bits_for(size)
    sketch = docs.sparkSession.sparkContext.broadcast(repeated_cells(docs, bits))
    # What differs from row to row stands together, what repeats (n, id, mark) surrounds it: such rows compress best.
    names = ["doc_id", "mark", "h1", "h2", "start", "run", "n"]
    schema = docs.select("doc_id").schema
    for name, kind in zip(names[1:], ("long", "long", "integer", "integer", "integer", "integer"), strict=True):
        schema = schema.add(name, kind)

    def estimated(anchor: np.ndarray) -> np.ndarray:
        out = np.ones(len(anchor), bool)
        for r, packed in enumerate(sketch.value):
            cell = _cells(anchor, r, bits)
            out &= (packed[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
        return out

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def send() -> Iterator[pa.RecordBatch]:
            ids = pa.chunked_array([x[0] for x in held]).combine_chunks()
            mark, start, h1, h2, doc = (np.concatenate([x[i] for x in held]) for i in range(1, 6))
            held.clear()
            order = np.lexsort((h2, h1)).astype(np.int32)
            new = np.ones(len(order), bool)
            new[1:] = False
            for h in (h1, h2):  # one sorted copy at a time
                own = h[order]
                new[1:] |= own[1:] != own[:-1]
            heads = np.flatnonzero(new)
            n = np.full(len(order), 2, np.int32)
            n[order[heads]] = np.minimum(np.diff(np.r_[heads, len(order)]), 2)
            known = np.ones(len(order), bool)
            known[order[heads]] = False
            # Further places in this chunk are settled: they travel under keys of their own, not under the shared one, and those
            # that follow each other in a text as one row. Rows that share such a key are all settled, so it need not be unique.
            h1[known] = mark[known].view(np.uint64)
            h2[known] = start[known].view(np.uint32)
            goes_on = np.r_[False, known[1:] & known[:-1] & (doc[1:] == doc[:-1]) & (start[1:] == start[:-1] + 1)]
            kept = np.flatnonzero(~goes_on)
            run = np.diff(np.r_[kept, len(order)]).astype(np.int32)
            ids, mark, start, h1, h2, n = ids.take(pa.array(kept)), mark[kept], start[kept], h1[kept], h2[kept], n[kept]
            step = 1 << 17
            for p in range(0, len(kept), step):
                s = slice(p, p + step)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(p, step), pa.array(mark[s]), pa.array(h1[s].view(np.int64)), pa.array(h2[s].view(np.int32)),
                     pa.array(start[s]), pa.array(run[s]), pa.array(n[s])], names=names)

        texts = 0
        for batch in batches:
            marks = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            for row, data, at in W.slices(batch.column(1)):
                found = W.split(data, at)
                h = found.hashes()
                starts, anchor, runs = _anchors(h, found.first)
                if not len(starts):
                    continue
                places, which = np.unique(anchor, return_inverse=True)
                starts = starts[estimated(runs[places])[which]]
                if not len(starts):
                    continue
                doc = found.doc[starts]
                held.append((batch.column(0).take(pa.array(row + doc)), marks[row + doc],
                             (starts - found.first[doc]).astype(np.int32), W.windows(h, WINDOW)[starts],
                             (W.windows(W.mix(h ^ _OTHER_BASE), WINDOW, _OTHER_BASE)[starts] >> np.uint64(32)).astype(np.uint32),
                             (texts + row + doc).astype(np.int32)))
                if sum(len(x[1]) for x in held) >= CHUNK_WINDOWS:
                    yield from send()
            texts += batch.num_rows
        if held:
            yield from send()

    sent = docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).mapInArrow(candidates, schema)
    places = F.sum("n").over(Window.partitionBy("h1", "h2"))
    return sent.withColumn("places", places).filter("places > 1").select("doc_id", "mark", "start", "run")


def remove_repeated(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row; ``kept_text`` has the words that stay."""
    return kept_texts(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words that windows starting at ``starts`` and in ``runs`` cover, as intervals that neither overlap nor touch."""
    for batch in batches:
        rows, begins, ends = [], [], []
        for column, has_run in ((batch.column(2), False), (batch.column(3), True)):
            rows.append(np.repeat(np.arange(batch.num_rows), column.value_lengths().to_numpy(zero_copy_only=False)))
            values = column.flatten()
            start, run = values.flatten() if has_run else (values, None)
            begins.append(start.to_numpy(zero_copy_only=False).astype(np.int64))
            ends.append(begins[-1] + WINDOW + (run.to_numpy(zero_copy_only=False) - 1 if has_run else 0))
        row, begin, end = (np.concatenate(x) for x in (rows, begins, ends))
        order = np.lexsort((begin, row))
        apart = np.int64(1) << 32  # rows lie this far apart on one line
        begin, end = begin[order] + row[order] * apart, end[order] + row[order] * apart
        reach = np.maximum.accumulate(end)
        heads = np.flatnonzero(np.r_[True, begin[1:] > reach[:-1]][:len(begin)])
        last = np.r_[heads[1:], len(begin)] - 1
        where = row[order][heads]
        pairs = pa.StructArray.from_arrays([pa.array((begin[heads] - where * apart).astype(np.int32)), pa.array((reach[last] - where * apart).astype(np.int32))],
                                           names=["begin", "end"])
        offsets = np.searchsorted(where, np.arange(batch.num_rows + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pairs)], names=["doc_id", "mark", "covered"])


def kept_texts(docs: DataFrame) -> DataFrame:
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    single, several = F.when(F.col("run") == 1, F.col("start")), F.when(F.col("run") > 1, F.struct("start", "run"))
    starts = repeated_windows(docs).groupBy("doc_id", "mark").agg(F.collect_set(single).alias("starts"), F.collect_list(several).alias("runs"))
    schema = docs.select("doc_id").schema.add("mark", "long").add("covered", T.ArrayType(T.StructType().add("begin", "integer").add("end", "integer")))
    told = cut_lineage(starts.mapInArrow(_covered, schema)).withColumnsRenamed({"doc_id": "of_id", "mark": "of_mark"})
    both = own.join(told, F.col("mark").eqNullSafe(F.col("of_mark")) & F.col("doc_id").eqNullSafe(F.col("of_id")), "left")
    schema = docs.select("doc_id").schema.add("n_words", "long").add("n_removed", "long").add("kept_text", T.BinaryType())

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            covered, n_words, n_removed, kept = batch.column(2), [], [], []
            for row, data, at in W.slices(batch.column(1)):
                found = W.split(data, at)
                own = covered.slice(row, len(at) - 1)
                size = own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                begin, end = (column.to_numpy(zero_copy_only=False) + np.repeat(found.first[:-1], size) for column in own.flatten().flatten())
                cover = np.zeros(len(found.start) + 1, np.int64)
                np.add.at(cover, begin, 1)
                np.add.at(cover, end, -1)
                gone = np.cumsum(cover)[:len(found.start)] > 0
                stay = np.flatnonzero(~gone)
                length = found.end[stay] - found.start[stay]
                out = np.full(int((length + 1).sum()), 32, np.uint8)
                place = np.cumsum(length + 1) - (length + 1)
                inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
                out[inside + np.repeat(place, length)] = data[inside + np.repeat(found.start[stay], length)]
                text = out.tobytes()
                bounds = np.r_[place, len(text)][np.searchsorted(stay, found.first)].tolist()
                kept += [text[a:max(a, b - 1)] for a, b in zip(bounds, bounds[1:])]
                n_words += np.diff(found.first).tolist()
                n_removed += np.diff(np.r_[0, np.cumsum(gone)][found.first]).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                                              pa.array(kept, pa.binary())], names=schema.names)

    return both.select("doc_id", "text", "covered").mapInArrow(remove, schema)
