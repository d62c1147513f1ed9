"""Byte-pair encoding as a streaming transducer with bounded lookahead, and its incremental decoder.

``Merges`` reads a public tokenizer file (its path is a parameter; executors read their own installed copy) and computes
from the merge list how far to the right of a token a later byte can still matter:

* A merge of x and y is undone only by an earlier-ranked merge that takes y, or a token on the right edge of y, as its left
  part; that one in turn only by a still earlier-ranked one. ``lookahead`` is the byte length of the longest such chain.

A pretoken is pushed in pieces; tokens that end ``lookahead`` bytes before the end of what has come are final and leave
the buffer, so memory does not grow with the pretoken. A pretoken's end is final too. Texts are cut into pieces before white
space, where pretokens always end. The decoder turns ids into bytes by table and bytes into text with UTF-8 state kept
between pieces; malformed bytes become U+FFFD.

Defined results: null text is empty: no tokens, and the digests of nothing; repeated rows are encoded alike; the text of
the special token becomes the special id.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

PIECE_CHARS = 1 << 16
CACHED_PRETOKENS = 300_000
CACHED_BYTES = 64
# Fixed value: the pretoken pattern of byte-level vocabularies, white space written as its Unicode property.
PRETOKEN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
_SAFE_CUT = regex.compile(r"(?<=\P{White_Space})\p{White_Space}")


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary file: printable Latin-1 for itself, the rest
    from U+0100 on in byte order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in plain)}


class Merges:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        letter = _byte_letters()
        byte = {c: b for b, c in letter.items()}
        self.of_byte = [vocab[letter[b]] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        texts = {i: bytes(byte[c] for c in t) for t, i in vocab.items()}
        texts |= {i: t.encode() for t, i in self.special.items()}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.size = [len(texts.get(i, b"")) for i in range(max(texts) + 1)]
        self.longest = max(self.size[i] for i in vocab.values())
        self._flat = np.frombuffer(b"".join(texts.get(i, b"") for i in range(len(self.size))), np.uint8)
        self._len = np.array(self.size, np.int64)
        self._at = np.cumsum(self._len) - self._len
        self.lookahead = self.longest + self._longest_chain()
        split = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self._specials = regex.compile(f"({split})") if split else None
        self._cache = _Pretokens(self)

    def _longest_chain(self) -> int:
        right_part = {made: b for (_, b), (_, made) in self.pairs.items()}
        reach: dict[int, int] = {}
        most = 0
        for (a, b), _ in sorted(self.pairs.items(), key=lambda x: x[1][0]):
            edge, chain = b, 0
            while edge is not None:
                chain = max(chain, reach.get(edge, 0))
                edge = right_part.get(edge)
            chain += self.size[b]
            reach[a] = max(reach.get(a, 0), chain)
            most = max(most, chain)
        return most

    def merged(self, data: bytes) -> list[int]:
        """Tokens of a short byte string: the earliest-ranked pair first, leftmost among equals."""
        ids = [self.of_byte[b] for b in data]
        if len(ids) > CACHED_BYTES:
            return self._merged_long(ids)
        pairs = self.pairs
        while len(ids) > 1:
            least = None
            for k in range(len(ids) - 1):
                found = pairs.get((ids[k], ids[k + 1]))
                if found is not None and (least is None or found[0] < least[0]):
                    least, at = found, k
            if least is None:
                break
            a, b = ids[at], ids[at + 1]
            out, k = ids[:at], at
            while k < len(ids):
                if k + 1 < len(ids) and ids[k] == a and ids[k + 1] == b:
                    out.append(least[1])
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same through a heap of candidate pairs over a linked list."""
        pairs, n = self.pairs, len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(*found, k, ids[k], ids[k + 1]) for k in range(n - 1) if (found := pairs.get((ids[k], ids[k + 1])))]
        heap = [(rank, k, made, a, b) for rank, made, k, a, b in heap]
        heapify(heap)
        while heap:
            _, k, made, a, b = heappop(heap)
            j = after[k]
            if ids[k] != a or j < 0 or ids[j] != b:
                continue
            ids[k], ids[j] = made, -1
            after[k] = after[j]
            if after[k] >= 0:
                before[after[k]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y >= 0 and (found := pairs.get((ids[x], ids[y]))):
                    heappush(heap, (found[0], x, found[1], ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def pretoken(self, data: bytes) -> Iterator[int]:
        """Tokens of one pretoken of any length, final ones first; the buffer stays below three lookaheads."""
        step, start, done = 2 * self.lookahead, 0, 0
        while len(data) - start > step + self.lookahead:
            end = start
            stop = start + step  # tokens ending here have a lookahead's bytes to their right
            for token in self.merged(data[start:stop + self.lookahead]):
                if end + self.size[token] > stop:
                    break
                end += self.size[token]
                yield token
            done = end
            if done == start:
                raise AssertionError("no token is final within the lookahead")
            start = done
        yield from self.merged(data[start:])

    def pieces(self, text: str) -> Iterator[str]:
        """The text cut before white space into pieces of about ``PIECE_CHARS``."""
        begin = 0
        while len(text) - begin > PIECE_CHARS:
            cut = _SAFE_CUT.search(text, begin + PIECE_CHARS)
            if cut is None:
                break
            yield text[begin:cut.start()]
            begin = cut.start()
        yield text[begin:]

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers, a piece at a time."""
        parts = self._specials.split(text) if self._specials and any(s in text for s in self.special) else [text]
        for part in parts:
            if part in self.special:
                yield self.special[part].to_bytes(4, "little")
            elif part:
                cache = self._cache
                for piece in self.pieces(part):
                    yield b"".join([cache[t] for t in PRETOKEN.findall(piece)])

    def decode(self, pieces: Iterator[bytes]) -> Iterator[str]:
        """Text of packed ids; a character split over pieces waits for its last byte."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for piece in pieces:
            ids = np.frombuffer(piece, "<u4").astype(np.int64)
            n = self._len[ids]
            source = np.repeat(self._at[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            yield state.decode(self._flat[source].tobytes())
        yield state.decode(b"", True)


class _Pretokens(dict):
    """Packed ids of short pretokens; emptied when full, so a worker's memory is bounded."""

    def __init__(self, merges: Merges) -> None:
        super().__init__()
        self.merges = merges

    def __missing__(self, text: str) -> bytes:
        data = text.encode("utf-8", "replace")
        packed = np.fromiter(self.merges.pretoken(data), "<u4").tobytes()
        if len(data) <= CACHED_BYTES:
            if len(self) >= CACHED_PRETOKENS:
                self.clear()
            self[text] = packed
        return packed


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    """One per Python worker and file."""
    return Merges(path)


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row, and ``ids`` (packed) if asked for."""
    schema = docs.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_ids:
        schema = schema.add("ids", "binary")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = merges(path)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids, decoded, n, kept = hashlib.sha256(), hashlib.sha256(), 0, []

                def told(pieces: Iterator[bytes]) -> Iterator[bytes]:
                    nonlocal n
                    for piece in pieces:
                        ids.update(piece)
                        n += len(piece) // 4
                        if with_ids:
                            kept.append(piece)
                        yield piece

                for piece in model.decode(told(model.encode(text.as_py() or ""))):
                    decoded.update(piece.encode())
                rows.append((n, ids.hexdigest(), decoded.hexdigest(), *([b"".join(kept)] if with_ids else [])))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.binary()),
                                                      strict=False)] if rows else [pa.array([], pa.int64()), *[pa.array([], pa.string())] * 2, *[pa.array([], pa.binary())] * with_ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(scan, schema)
