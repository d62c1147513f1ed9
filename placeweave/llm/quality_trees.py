"""Quality of whole texts by histogram gradient-boosted trees over document statistics.

Statistics come from one numpy pass over all texts. Training uses about ``SAMPLE_ROWS`` labelled rows (a bounded,
documented sample, chosen by hashed id); trees grow level by level on binned columns and are stored as flat arrays,
so that scoring steps all rows of a batch through one tree level at a time.

Defined results: null text counts as empty and is scored; rows whose label or id is null teach nothing; several labels
of one id teach their mean; with no label at all every score is 0.5; repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeweave.llm import words as W
from placeweave.session import cut_lineage

SAMPLE_ROWS = 20_000
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.15
LAMBDA = 1.0
MIN_ROWS = 5

_CLASSES = ("upper", "lower", "digit", "blank", "newline", "stop", "quote", "symbol", "beyond", "control")
_CLASS_OF = np.full(256, 9, np.uint8)
for _i, _bytes in enumerate((range(65, 91), range(97, 123), range(48, 58), b" \t", b"\n", b".,;:", b"'\"()-",
                             b"!#$%&*+/<=>?@[\\]^_`{|}~", range(128, 256))):
    _CLASS_OF[list(_bytes)] = _i
STATISTICS = (
    "log_bytes", "log_words", *(f"{c}_share" for c in _CLASSES), "word_bytes", "word_bytes_spread", "line_words",
    "distinct_words", "top_word", "distinct_lines", "repeated_runs", "symbol_words", "upper_words", "long_words")


def _distinct_share(doc: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: distinct values / values, and the share of the most frequent value (1 and 0 without values)."""
    total = np.bincount(doc, minlength=n)
    order = np.lexsort((value, doc))
    d, v = doc[order], value[order]
    heads = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (v[1:] != v[:-1])]) if len(d) else np.zeros(0, int)
    runs = np.diff(np.r_[heads, len(d)])
    most = np.zeros(n, np.int64)
    np.maximum.at(most, d[heads], runs)
    some = np.maximum(total, 1)
    return np.where(total > 0, np.bincount(d[heads], minlength=n) / some, 1.0), most / some


def statistics(column: pa.Array) -> np.ndarray:
    """float32 matrix, one row a text, columns as ``STATISTICS``."""
    out = [np.zeros((0, len(STATISTICS)), np.float32)]
    newline = np.zeros(256, bool)
    newline[10] = True
    for _, data, at in W.slices(column):
        n, size = len(at) - 1, np.diff(at)
        row = np.repeat(np.arange(n), size)
        per_class = np.bincount(row * len(_CLASSES) + _CLASS_OF[data], minlength=n * len(_CLASSES)).reshape(n, -1)
        share = per_class / np.maximum(size, 1)[:, None]
        found, lines = W.split(data, at), W.split(data, at, newline)
        n_words, n_lines = np.diff(found.first), np.diff(lines.first)
        some = np.maximum(n_words, 1)
        length = (found.end - found.start).astype(float)
        mean = np.bincount(found.doc, length, n) / some
        spread = np.sqrt(np.maximum(np.bincount(found.doc, length ** 2, n) / some - mean ** 2, 0))
        h = found.hashes()
        word_share, top = _distinct_share(found.doc, h, n)
        line_share, _ = _distinct_share(lines.doc, lines.hashes(), n)
        begin = W.inside_one(found.first, 3)
        run_share, _ = _distinct_share(found.doc[begin], W.windows(h, 3)[begin] if len(begin) else h[:0], n)
        kind = _CLASS_OF[data]
        def words_with(mask: np.ndarray) -> np.ndarray:
            seen = np.concatenate([[0], np.cumsum(mask)])
            return np.bincount(found.doc, seen[found.end] - seen[found.start] > 0, n) / some
        seen_lower = np.concatenate([[0], np.cumsum(kind == 1)])
        seen_upper = np.concatenate([[0], np.cumsum(kind == 0)])
        shouted = (seen_upper[found.end] - seen_upper[found.start] > 1) & (seen_lower[found.end] == seen_lower[found.start])
        out.append(np.column_stack([
            np.log1p(size), np.log1p(n_words), share, mean, spread, n_words / np.maximum(n_lines, 1), word_share, top,
            line_share, 1 - run_share, words_with(kind == 7), np.bincount(found.doc, shouted, n) / some,
            np.bincount(found.doc, length > 20, n) / some]).astype(np.float32))
    return np.concatenate(out)


@dataclass
class Trees:
    """All trees in flat arrays: node i of a tree has children 2i + 1 and 2i + 2 and goes right above its threshold."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - (2 ** DEPTH - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic loss, second order, equal-frequency bins; exact ties go to the first column and bin."""
    inner, leaves, columns = 2 ** DEPTH - 1, 2 ** DEPTH, x.shape[1]
    rate = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if len(y) else 0.5
    model = Trees(float(np.log(rate / (1 - rate))), np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32),
                  np.zeros((0, leaves)))
    if not len(y) or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, c], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in range(columns)]
    binned = np.column_stack([np.searchsorted(e, x[:, c], "left") for c, e in enumerate(edges)])
    flat = binned + np.arange(columns) * BINS
    raw = np.full(len(y), model.base)
    feature, threshold, value = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, p * (1 - p)
        f, t, node = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32), np.zeros(len(y), np.int64)
        cut = np.full(inner, BINS, np.int64)
        for level in range(DEPTH):
            width, low = 2 ** level, 2 ** level - 1
            cell = (flat + ((node - low) * columns * BINS)[:, None]).ravel()
            hist = [np.bincount(cell, np.repeat(v, columns), width * columns * BINS).reshape(width, columns, BINS)
                    for v in (grad, hess, np.ones(len(y)))]
            left = [h.cumsum(2) for h in hist]
            (gl, hl, nl), (g, h, n) = left, [v[:, :, -1:] for v in left]
            gain = gl ** 2 / (hl + LAMBDA) + (g - gl) ** 2 / (h - hl + LAMBDA) - g ** 2 / (h + LAMBDA)
            gain[(nl < MIN_ROWS) | (n - nl < MIN_ROWS)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                c, b = divmod(int(best[k]), BINS)
                if gain[k, c, b] > 1e-9 and b < len(edges[c]):
                    f[low + k], t[low + k], cut[low + k] = c, edges[c][b], b
            node = 2 * node + 1 + (binned[np.arange(len(y)), f[node]] > cut[node])
        leaf = node - inner
        v = -RATE * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + LAMBDA)
        raw += v[leaf]
        feature.append(f), threshold.append(t), value.append(v)
    return Trees(model.base, np.array(feature), np.array(threshold), np.array(value))


def with_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, stats`` (array of float) for every row."""
    schema = docs.select("doc_id").schema.add("stats", T.ArrayType(T.FloatType()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(1))
            stats = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), stats], names=["doc_id", "stats"])

    return docs.select("doc_id", "text").mapInArrow(scan, schema)


def taught_rows(labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, y`` of about ``rows`` labelled documents that are not held out: all of them, or the share with the smallest hashed ids."""
    taught = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        F.avg("quality").alias("y")).filter(~held_out(F.col("doc_id")))
    share = rows / max(taught.count(), 1)
    return cut_lineage(taught.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)))


def train(stats: DataFrame, chosen: DataFrame) -> Trees:
    """Trees from the chosen documents' statistics, which the driver gets: as many rows as were chosen, whatever the input."""
    sample = stats.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).collect()
    sample.sort(key=lambda r: r["doc_id"])
    x = np.array([r["stats"] for r in sample], np.float32).reshape(-1, len(STATISTICS))
    return fit(x, np.array([r["y"] for r in sample], float))


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    stats = cut_lineage(with_statistics(docs))
    model = docs.sparkSession.sparkContext.broadcast(train(stats, taught_rows(labels)))
    schema = docs.select("doc_id").schema.add("score", "double")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.score(x))], names=["doc_id", "score"])

    return stats.mapInArrow(scan, schema).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents predicted good, columns unchanged: statistics and text travel together, so no join moves texts. Only the texts that teach are
    measured before the model is known."""
    chosen = taught_rows(labels)
    teaching = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    model = docs.sparkSession.sparkContext.broadcast(train(with_statistics(teaching), chosen))
    at = docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.value.score(statistics(batch.column(at))) >= 0.5))

    return docs.mapInArrow(scan, docs.schema)
